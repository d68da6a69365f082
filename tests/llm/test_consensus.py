import random

from corpusloom.llm.consensus import Consensus, agreement, judgments, read_label

SCHEMA = "qid string, avaliador string, rotulo string, julgado bigint, recebido bigint, label string, item string"


def read(spark, rows):
    return judgments(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA), "qid", "avaliador", "rotulo", "julgado", "recebido")


def test_spellings(spark):
    df = spark.createDataFrame([("PARC.",), (" sim",), ("Não",), ("?",), ("",), (None,), ("parcialmente ",)], "x string")
    assert [r[0] for r in df.select(read_label(df.x)).collect()] == ["PARCIAL", "S", "N", None, None, None, "PARCIAL"]


def test_reliable_annotators_decide(spark):
    rng = random.Random(4)
    classes = ["S", "PARCIAL", "N"]
    truth = {f"q{i}": rng.choice(classes) for i in range(400)}
    rows = []
    for q, t in truth.items():
        for a in range(3):
            rows.append((q, f"good{a}", t if rng.random() < 0.9 else rng.choice(classes), 1, 1))
        for a in range(3):  # always S, at random, and turned round
            rows.append((q, f"bad{a}", ["S", rng.choice(classes), {"S": "N", "N": "S"}.get(t, t)][a], 1, 1))
    model = Consensus(read(spark, rows))
    got = {r.item: r.label for r in model.labels().collect()}
    right = sum(got[q] == t for q, t in truth.items()) / len(truth)
    score = dict(model.reliability())
    assert right > 0.95 and min(score[f"good{a}"] for a in range(3)) > 0.8 and max(score["bad0"], score["bad1"]) < 0.5


def test_revisions_repeats_and_unjudged_rows(spark):
    rows = [("a", "x", "S", 1, 1), ("a", "x", "N", 2, 1), ("a", "x", "N", 2, 1), ("a", "y", "sim", 1, 1), ("a", "z", "", 1, 1), ("a", None, "S", 1, 1), (None, "x", "S", 1, 1), ("b", "x", "S", None, None), ("b", "y", "S", 1, 1), ("b", "z", "S.", 1, 1)]
    got = read(spark, rows)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "x", "N"), ("a", "y", "S"), ("b", "x", "S"), ("b", "y", "S"), ("b", "z", "S")]
    assert {r.item for r in Consensus(got, rounds=3).labels().collect()} == {"b"}
    alpha = agreement(got).collect()[0]
    assert alpha["items"] == 2 and alpha["judgments"] == 5 and abs(alpha["observed"] - 0.4) < 1e-9 and abs(alpha["expected"] - 0.4) < 1e-9


def test_empty_table(spark):
    empty = read(spark, [])
    model = Consensus(empty)
    assert model.labels().count() == 0 and model.reliability() == [] and agreement(empty).collect()[0]["alpha"] is None
