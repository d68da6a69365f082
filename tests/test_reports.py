import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.operators import ann as N
from corpusloom.operators import dense as D
from corpusloom.operators import reports as P


def test_cells_find_the_nearest(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 12))
    v = centres[rng.integers(0, 10, 600)] + 0.25 * rng.normal(size=(600, 12))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, vector array<double>")
    q = df.filter("id % 50 = 0").selectExpr("id AS qid", "vector")
    found = N.search_cells(q, df, 10, cells=10, probes=3)
    assert N.recall(found, D.search(q, df, 10)).collect()[0].recall >= 0.9
    assert N.assign(df, N.fit_centres(df, 10, sample=50), 1).count() == 600  # fitted on a sample, every row indexed


SF01 = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF01), reason="no data here")
def test_registered_cell_search_has_the_recall_that_is_claimed(spark):
    from corpusloom.plans.ranking_queries import ranked

    share = N.recall(entry.queries()["r_cell_search"](spark, SF01), ranked(spark, SF01, k=10)).collect()[0].recall
    assert share >= 0.9


@pytest.mark.parametrize(
    ("text", "clean", "removed"),
    [
        ("a 1 b 2 c 3 d 4 e", "a  b  c  d  e", 4),
        ("a 17 b 18 c 5630 d 20 e 21 f 23 g 24", "a 17 b 18 c 5630 d  e  f  g ", 4),
        ("prazo de 90 dias", "prazo de 90 dias", 0),
        ("", "", 0),
    ],
)
def test_line_numbers(text, clean, removed):
    assert P.strip_line_numbers(text) == (clean, removed)
    assert P.strip_line_numbers(clean) == (clean, 0)


def test_line_numbers_keep_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "k int, t string")
    assert {(r.k, r.text, r.removed) for r in P.without_line_numbers(df, "k", "t").collect()} == {(1, None, 0), (2, "x", 0)}


def test_contexts_and_sheets(spark):
    r = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "qid int, id string, rank int")
    t = spark.createDataFrame([("a", "um"), ("b", None), ("c", "três")], "id string, text string")
    assert {x.qid: x.context for x in P.contexts(r, t).collect()} == {1: "[1] um\n\n[2] ", 2: "[1] três"}
    g = spark.createDataFrame([(1, "b", 2)], "qid int, id string, grade int")
    rows = {x.qid: x for x in P.wide_ranking(r, g, 2).collect()}
    assert (rows[1].id1, rows[1].grade1, rows[1].id2, rows[1].grade2) == ("a", 0, "b", 2) and rows[2].id2 is None


def test_contexts_hold_whole_texts_and_their_source(spark):
    long = "palavra " * 2000 + "fim"
    r = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "z", 3)], "qid int, id string, rank int")
    t = spark.createDataFrame([("a", long, "Título", "https://x.org"), ("b", "dois", "", None)], "id string, text string, title string, url string")
    assert P.contexts(r, t).collect()[0].context == f"[1] {long}\nTítulo — https://x.org\n\n[2] dois\n?\n\n[3] \n?"
    g = spark.createDataFrame([(1, 0, "a"), (1, 0, "q"), (1, 1, "q"), (2, 0, "a")], "qid int, group_no int, id string")
    assert [tuple(x) for x in P.context_coverage(r, g, 3).collect()] == [(1, 2, 1, False)]


def test_ideal_order_changes_only_the_pool(spark):
    r = spark.createDataFrame([("s", 1, c, i) for i, c in enumerate("abcd", 1)], "system string, qid int, id string, rank int")
    g = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (1, "d", 2)], "qid int, id string, grade int")
    assert [x.id for x in P.ideal_order(r, g, 3).orderBy("rank").collect()] == ["c", "b", "a", "d"]


def test_names(spark):
    q = spark.createDataFrame([(1, "O que a LGPD e o Código de Ética exigem?"), (2, "E a lgpd?"), (3, None), (4, "Nada")], "qid int, question string")
    a = spark.createDataFrame([("l", "LGPD"), ("c", "código de ética"), ("c", "CEM")], "document string, alias string")
    assert {r.qid: r.names for r in P.names_documents(q, a).collect()} == {1: "both", 2: "one", 3: "none", 4: "none"}


def test_blocked_pages_are_queued_once(spark):
    p = spark.createDataFrame([("u", "x"), ("v", "longo"), ("w", "x")], "url string, text string")
    e = spark.createDataFrame([("w", "old")], "url string, reason string")
    kept, errors = P.requeue_blocked(p, F.length("text") < 3, e)
    assert [r.url for r in kept.collect()] == ["v"] and {tuple(r) for r in errors.collect()} == {("w", "old"), ("u", "blocked")}


def test_inflation(spark):
    s = spark.createDataFrame([("a", 0.5), ("b", 0.6)], "scenario string, alpha double")
    assert P.inflation(s, 0.65).collect()[0].inflated and not P.inflation(s, 0.61).collect()[0].inflated
