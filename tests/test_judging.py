import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import fold
from corpusloom.operators import agreement as A
from corpusloom.operators import gold as B
from corpusloom.operators import statistics as Q
from corpusloom.operators.substrings import fold_slice, held_in, marks


def one(df):
    return df.collect()[0]


def test_corrections(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.20)], "name string, p double")
    got = {r.name: r for r in Q.corrections(t).collect()}
    assert [round(got[n].holm, 6) for n in "acbd"] == [0.04, 0.09, 0.09, 0.2]
    assert all(r.p <= r.bh <= r.holm <= r.bonferroni <= 1 for r in got.values())


def test_cliffs_delta_and_auc(spark):
    rows = [("a", 3.0)] * 3 + [("b", 1.0)] * 2
    assert one(Q.cliffs_delta(spark.createDataFrame(rows, "side string, x double"))).delta == 1
    assert one(Q.cliffs_delta(spark.createDataFrame([("b" if s == "a" else "a", x) for s, x in rows], "side string, x double"))).delta == -1
    s = spark.createDataFrame([(0.9, True), (0.5, True), (0.5, False), (0.1, False)], "score double, positive boolean")
    assert one(Q.auc(s)).auc == pytest.approx(3.5 / 4)


@pytest.mark.parametrize(("b", "c"), [(0, 0), (3, 37), (13, 24), (1, 1), (900, 1100)])
def test_exact_mcnemar(spark, b, c):
    n = b + c
    want = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n) if n else 1.0
    df = spark.createDataFrame([(b, c)], "b bigint, c bigint")
    assert one(df.select(Q.exact_mcnemar(F.col("b"), F.col("c")).alias("p"))).p == pytest.approx(want, rel=1e-6)


def test_paired_tests(spark):
    d = spark.createDataFrame([(i, 0.1 + i / 100) for i in range(12)], "key int, diff double")
    zero = spark.createDataFrame([(i, 0.0) for i in range(5)], "key int, diff double")
    assert one(Q.paired_randomization(d, 300)).p < 0.02 and one(Q.paired_randomization(zero, 50)).p == 1
    assert one(Q.signed_ranks(d)).p < 0.01 and one(Q.signed_ranks(d)).w == 78
    v = d.select("key", F.col("diff").alias("x"))
    r = one(Q.bootstrap_interval(v, 200))
    assert r.low < r["mean"] < r.high


def test_rounds_and_thresholds_are_the_whole_grid(spark):
    d = spark.createDataFrame([(i, 0.1 + i / 100) for i in range(20)], "key int, diff double")
    assert one(Q.paired_randomization(d)).p < 1 / 1001
    v = d.select("key", F.col("diff").alias("x"))
    assert one(Q.bootstrap_interval(v)) == one(Q.bootstrap_interval(v, 10_000)) != one(Q.bootstrap_interval(v, 1_000))
    s = spark.createDataFrame([(i, 0.4105 if i % 2 else 0.4155, i % 2 == 0) for i in range(200)], "key int, score double, positive boolean")
    assert one(Q.split_threshold(s)).asDict() == {"threshold": pytest.approx(0.411), "refused": 1.0, "lost": 0.0}


def test_resamples_are_sums_over_all_rows(spark):
    rows = [(f"k{i}", math.sin(i)) for i in range(150)] + [("null", None)]
    df = spark.createDataFrame(rows, "key string, x double")
    a, b = one(Q.bootstrap_interval(df.repartition(7), 500)), one(Q.bootstrap_interval(df.coalesce(1), 500))
    values = [x for _, x in rows if x is not None]
    mean = sum(values) / len(values)
    sd = math.sqrt(sum((x - mean) ** 2 for x in values)) / len(values)
    assert a.low == pytest.approx(b.low) and a.high == pytest.approx(b.high) and a["mean"] == pytest.approx(mean)
    assert a.low == pytest.approx(mean - 1.96 * sd, abs=sd / 3) and a.high == pytest.approx(mean + 1.96 * sd, abs=sd / 3)
    diffs = df.withColumnRenamed("x", "diff")
    r = one(Q.paired_randomization(diffs, 400))

    def sign(k, at):
        digest = hashlib.md5(f"7|{at // 128}|{k}".encode()).digest()
        return -1 if digest[at % 128 // 8] >> (7 - at % 8) & 1 else 1

    far = sum(round(abs(sum(sign(k, at) * x for k, x in rows if x is not None) / 150), 9) >= round(abs(mean), 9) for at in range(400))
    assert r.n == 150 and r.p == pytest.approx((far + 1) / 401)


def test_sums_over_all_rows_before(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 9)) for i in rng.sample(range(10_000), 500)]
    got = {r.k: r.s for r in Q.before(spark.createDataFrame(rows, "k bigint, v bigint").repartition(6), ["k"], {"s": "v"}).collect()}
    assert got == {k: sum(v for j, v in rows if j < k) for k, _ in rows}
    assert Q.before(spark.createDataFrame([], "k bigint, v bigint"), ["k"], {"s": "v"}).count() == 0


@pytest.mark.parametrize(("values", "want"), [([3, 1, 2], 2), ([4, 1, 3, 2], 3), ([5, 5, 5, 1], 5), ([7], 7)])
def test_upper_median(spark, values, want):
    assert one(spark.createDataFrame([(v,) for v in values], "v bigint").agg(Q.upper_median("v").alias("m"))).m == want


def scores(spark, rows):
    return spark.createDataFrame(rows, "item string, judge string, score int")


def test_agreement_of_identical_and_known_judges(spark):
    rows = [(str(i), j, 1 + i % 3) for i in range(9) for j in "ab"]
    r = one(A.pair_agreement(scores(spark, rows)))
    assert (r.n, r.exact, r.kappa_w, r.spearman, r.alpha) == pytest.approx((9, 1, 1, 1, 1))
    x, y = [1, 2, 3, 3, 2, 1, 1, 3], [1, 2, 3, 2, 2, 1, 2, 3]
    r = one(A.pair_agreement(scores(spark, [(str(i), j, v) for j, vs in (("a", x), ("b", y)) for i, v in enumerate(vs)])))
    both = x + y
    n = {v: both.count(v) for v in (1, 2, 3)}
    delta = lambda c, k: (sum(n[g] for g in range(min(c, k), max(c, k) + 1)) - (n[c] + n[k]) / 2) ** 2
    do = sum(2 * delta(a, b) for a, b in zip(x, y) if a != b)
    de = sum(n[c] * n[k] * delta(c, k) for c in n for k in n if c != k)
    assert r.alpha == pytest.approx(1 - 15 * do / de)
    sx = sum((a - b) ** 2 for a, b in zip(x, y)) / 8
    ex = sum((a - b) ** 2 for a in x for b in y) / 64
    assert r.kappa_w == pytest.approx(1 - sx / ex)
    assert one(A.ordinal_alpha(scores(spark, [(str(i), j, v) for j, vs in (("a", x), ("b", y)) for i, v in enumerate(vs)]))).alpha == pytest.approx(r.alpha)


def test_majority_goes_to_the_lowest_of_equals(spark):
    rows = [("x", "a", 3), ("x", "b", 1), ("y", "a", 2), ("y", "b", 2), ("y", "c", 3)]
    got = {r.item: (r.vote, r.votes, r.amplitude) for r in A.majority(scores(spark, rows)).collect()}
    assert got == {"x": (1, 1, 2), "y": (2, 2, 1)} and [r.item for r in A.strong_disagreements(scores(spark, rows)).collect()] == ["x"]
    assert A.chance_of_majority(3, 3) == pytest.approx(1 - 6 / 27) and A.chance_of_majority(4, 3) == 1


def test_panels_and_completion(spark):
    rows = [("x", "a", 1), ("x", "b", 1), ("y", "a", 2), ("y", "b", 2), ("y", "c", 2), ("z", "c", 3), ("w", "a", 1), ("w", "b", 1)]
    assert {(r.item, r.judge) for r in A.dominant_panel(scores(spark, rows)).collect()} == {(i, j) for i in "xyw" for j in "ab"}
    new = scores(spark, [("x", "a", 3), ("z", "a", 2)])
    assert {(r.item, r.judge): r.score for r in A.complete_judge(scores(spark, rows), new).collect()} | {} == {(i, j): s for i, j, s in rows} | {("z", "a"): 2}


def test_refusals(spark):
    rows = [("Não encontrei informações suficientes.", False), ("Não é possível responder com segurança.", True), ("Há informações suficientes.", True), (None, False)]
    r = one(A.refusal_rates(spark.createDataFrame(rows, "answer string, should_answer boolean")))
    assert (r.unanswerable, r.right, r.right_share, r.answerable, r.wrong, r.wrong_share) == (2, 1, 0.5, 2, 1, 0.5)
    empty = one(A.refusal_rates(spark.createDataFrame([], "answer string, should_answer boolean")))
    assert empty.right_share is None


def test_scores_round_half_to_even(spark):
    df = spark.createDataFrame([("2.5",), ("3.5",), ("na",), (None,), ("0",)], "x string")
    assert [r.s for r in df.select(A.parse_score(F.col("x"), 1, 3).alias("s")).collect()] == [2, None, None, None, None]


def test_containment_against_brute_force(spark):
    texts = [(1, "A cópia de segurança do exercício anterior deve ser mantida pelo operador de referência em meio digital."), (2, "Nada a ver"), (3, None)]
    quotes = [("q1", "copia de SEGURANÇA do exercício"), ("q2", "opia de segurança do exercício anterior deve ser mantida pelo operador de refer"), ("q3", "curta demais"), ("q4", "isto não está em texto algum mesmo")]
    found = B.containment(spark.createDataFrame(quotes, "quote_id string, quote string"), spark.createDataFrame(texts, "text_id int, text string"))
    assert {(r.quote_id, r.text_id) for r in found.collect()} == {("q1", 1), ("q2", 1)}


def test_quotes_of_few_words_are_found_wherever_they_stand(spark):
    glued = "thepatientsheetofeachversionremainsthedutyofthehealthunit" * 2
    texts = ["A cópia de segurança do exercício anterior", f"antes {glued} depois", "cop ia", "de de", None, ""]
    quotes = ["cópia", "OPIA DE", "cópia de segurança", "a de segurança do", "p", "de", "ia", "de d", glued, glued[3:60], "segurança  cópia", "exercícios", "", None]
    found = B.containment(spark.createDataFrame(list(enumerate(quotes)), "quote_id int, quote string"), spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"))
    plain = lambda s: " ".join((s or "").lower().translate(str.maketrans("óçí", "oci")).split())
    want = {(i, j, plain(t).index(plain(q)) + 1) for i, q in enumerate(quotes) for j, t in enumerate(texts) if plain(q) and plain(q) in plain(t)}
    assert sorted((r.quote_id, r.text_id, r.position) for r in found.collect()) == sorted(want) and len(want) > 12


def test_reanchoring(spark):
    old = spark.createDataFrame([("a", "d", "Texto igual."), ("b", "d", "mesmo texto noutro id"), ("c", "d", "parte"), ("e", "d", "sumiu")], "id string, document string, text string")
    new = spark.createDataFrame([("a", "d", "texto igual."), ("n", "f", "Mesmo texto noutro id"), ("m", "d", "uma parte maior")], "id string, document string, text string")
    got = {r.id: (r.new_id, r.how) for r in B.reanchor(old, new).collect()}
    assert got == {"a": ("a", "id"), "b": ("n", "text"), "c": ("m", "contained"), "e": (None, "lost")}


def test_reanchoring_against_all_pairs(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["norma", "ficha", "dado", "prazo", "auditor", "a", "de", "registro"])
    texts = [" ".join(word() for _ in range(rng.choice([1, 3, 6, 12, 30]))) for _ in range(60)]
    old = [(f"o{i}", f"d{i % 3}", t) for i, t in enumerate(texts)]
    new = [(f"n{i}", f"d{i % 3}", " ".join(t.split()[1:]) if i % 2 else "novo " + t + " fim") for i, t in enumerate(texts)] + [("blank", "d0", " "), ("null", "d1", None)]
    got = {r.id: (r.how, r.candidates) for r in B.reanchor(spark.createDataFrame(old, "id string, document string, text string"), spark.createDataFrame(new, "id string, document string, text string")).collect()}
    for key, doc, t in old:
        equal = {k for k, _, u in new if u == t}
        inside = {k for k, e, u in new if e == doc and u and u.strip() and t in u}
        holds = {k for k, e, u in new if e == doc and u and u.strip() and u in t}
        want = ("text", len(equal)) if equal else ("contained", len(inside)) if inside else ("contains", len(holds)) if holds else ("lost", 0)
        assert got[key] == want, (key, t)


def test_folding_in_slices_equals_the_expression(spark):
    rng = random.Random(5)
    some = "aZ çÃé\u0301 \u00ad\u0130\u03a3\u03c3\u1e9e\u2003\t\n\u3000€𝔸Ññ.\u00a0"
    texts = ["", " ", "\u00ad", "ΟΔΟΣ ΟΔΟΣ", "İSTANBUL Σ"] + ["".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(300)]
    want = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "k int, x string").select("k", fold(F.col("x")).alias("t")).orderBy("k").collect()]
    raw = [x.encode() for x in texts]
    data, bounds = fold_slice(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [data[a:b].tobytes().decode() for a, b in zip(bounds, bounds[1:])] == want


def test_texts_within_texts_of_a_document_against_all_pairs(spark):
    """Parts of every length, cut anywhere, of texts that repeat themselves; rows come twice."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abç d") for _ in range(n)) for n in (3, 9, 40, 200, 700)] + ["ab" * 90, "e" * 50]
    rows = [(f"o{i}", "d", t) for i, t in enumerate(texts)]
    parts = [t[a : a + n] for t in texts for n in (1, 2, 7, 16, 31, 64, 130, 500) for a in (rng.randrange(len(t)),)] + ["x" * 30]
    new = [(f"n{i}", rng.choice("dde"), t) for i, t in enumerate(parts)]
    kinds = "id string, document string, text string"
    old, later = spark.createDataFrame(rows * 2, kinds), spark.createDataFrame(new, kinds)
    ready = marks(later).filter("size > 0").drop("id").distinct()
    plain = {r.k: r.t for r in spark.createDataFrame([(k, t) for k, _, t in rows + new], "k string, x string").select("k", fold(F.col("x")).alias("t")).collect()}
    named = {r.h: r.id for r in marks(old.union(later)).collect()}
    got = {(plain[named[r.in_h]], plain[named[r.out_h]]) for r in held_in(ready, old).collect()}
    assert got == {(plain[a], plain[b]) for a, d, _ in new for b, e, _ in rows if d == e and plain[a] and plain[a] in plain[b]} and len(got) > 20


def test_reanchoring_makes_no_row_of_every_word_run(spark):
    """Such rows filled the disk."""
    text = " ".join(f"palavra{i}" for i in range(3_000))
    kinds = "id string, document string, text string"
    marked = marks(spark.createDataFrame([("a", "d", text), ("b", "d", text[50:])], kinds))
    assert marked.count() == 2 and "text" not in marked.columns
    old, new = spark.createDataFrame([("a", "d", text)], kinds), spark.createDataFrame([("b", "d", text[55:])], kinds)
    got = B.reanchor(old, new)
    assert [tuple(r) for r in got.collect()] == [("a", "b", "contains", 1)]
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_nearest_boundary(spark):
    p = spark.createDataFrame([("k", 5), ("k", 100), ("k", 0), ("z", 1)], "key string, x bigint")
    b = spark.createDataFrame([("k", 2), ("k", 8), ("k", 50)], "key string, at bigint")
    assert {(r.key, r.x): r["at"] for r in B.nearest_boundary(p, b).collect()} == {("k", 5): 2, ("k", 100): 50, ("k", 0): 2, ("z", 1): None}


def test_rejections_come_in_order(spark):
    rows = [("Uma pergunta bem longa?", "r", ["trecho que não está aqui no texto"], "outro"), ("Curta?", "r", ["x"], "y"), (None, "r", [], "y"), ("Uma pergunta bem longa?", "r", None, "y"), ("Uma pergunta bem longa?", "r", ["o trecho literal da passagem"], "Eis O Trecho literal da passagem.")]
    df = spark.createDataFrame(rows, "q string, a string, e array<string>, p string")
    assert [r.x for r in df.select(B.rejection(*[F.col(c) for c in "qaep"]).alias("x")).collect()] == ["quote_not_found", "short_question", "no_question", "no_quote", None]
