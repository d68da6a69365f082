import math

import numpy as np
import pytest

from corpusloom.operators import dense as D
from corpusloom.operators import lexical as L
from corpusloom.operators import metrics as M
from corpusloom.operators import ranking as R


def order(df, by="qid"):
    return [r.id for r in df.orderBy(by, "rank").collect()]


def test_search_against_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, vector array<double>")
    q = df.filter("id % 50 = 0").selectExpr("id AS qid", "vector")
    got = {}
    for r in D.search(q, df, 5, query_block=2, corpus_block=64).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id, r.score))
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    for k, rows in got.items():
        s = np.round(unit @ unit[k], 6)
        assert [i for _, i, _ in sorted(rows)] == sorted(range(300), key=lambda i: (-s[i], i))[:5]
    assert len(got) == 6 and D.search(q.limit(0), df, 5).count() == 0


def test_bm25_by_hand(spark):
    t = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a", "c"]), (3, ["d"])], "id int, tokens array<string>")
    got = {r.id: r.score for r in L.bm25(spark.createDataFrame([(9, ["a", "c", "a"])], "qid int, tokens array<string>"), t).collect()}
    n, avg = 3, 2.0
    raw = {k: math.log(n - df + 0.5) - math.log(df + 0.5) for k, df in {"a": 2, "b": 1, "c": 1, "d": 1}.items()}
    idf = {k: v if v >= 0 else 0.25 * sum(raw.values()) / 4 for k, v in raw.items()}
    part = lambda term, tf, size: idf[term] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / avg))
    assert got == pytest.approx({1: part("a", 1, 2), 2: part("a", 2, 3) + part("c", 1, 3)}, abs=1e-6)


LISTS = "system string, qid int, id string, rank int"


def test_fusion_and_reranking(spark):
    l = spark.createDataFrame([("x", 1, "a", 1), ("x", 1, "b", 2), ("y", 1, "b", 1), ("y", 1, "c", 2)], LISTS)
    assert order(R.reciprocal_fusion(l)) == ["b", "a", "c"]
    r = spark.createDataFrame([(1, c, i) for i, c in enumerate("abcde", 1)], "qid int, id string, rank int")
    s = spark.createDataFrame([(1, "c", 0.9), (1, "a", 0.1)], "qid int, id string, score double")
    assert order(R.rerank_pool(r, s, 3)) == ["c", "a", "b", "d", "e"]


def test_caps_and_distance(spark):
    r = spark.createDataFrame([(1, "a", 1, "d1", 0), (1, "b", 2, "d1", 1), (1, "c", 3, "d1", 9), (1, "d", 4, "d2", 1), (1, "e", 5, "d1", 20)], "qid int, id string, rank int, document string, position int")
    assert order(R.cap_reorder(r, 2)) == ["a", "b", "d", "c", "e"]
    assert order(R.cap_select(r, 1, 3)) == ["a", "d", "b"] and order(R.cap_select(r, 1, 3, backfill=False)) == ["a", "d"]
    assert order(R.apart(r, 5, 4)) == ["a", "c", "d", "e"] and order(R.apart(r, 50, 4)) == ["a", "d", "b", "c"]


def test_diverse_prefers_the_different(spark):
    r = spark.createDataFrame([(1, c, i) for i, c in enumerate("abc", 1)], "qid int, id string, rank int")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, vector array<double>")
    assert order(R.diverse(r, v, 0.3, 2)) == ["a", "c"] and order(R.diverse(r, v, 1.0, 2)) == ["a", "b"]


SIDES = [(1, 1, "a", 0.9), (1, 1, "b", 0.8), (1, 2, "a", 0.95), (1, 2, "c", 0.3), (1, 1, "d", 0.7)]


def test_sides(spark):
    s = spark.createDataFrame(SIDES, "qid int, side int, id string, score double")
    assert order(R.best_score(s, 3)) == ["a", "b", "d"]
    assert order(R.reserve_best(s, 3)) == ["a", "c", "b"]
    assert order(R.interleave(s, 4)) == ["a", "c", "b", "d"]
    assert order(R.partition(s, 1, 1)) == ["a", "b"] and order(R.union_by_need(s, 2)) == ["a", "b", "c"]


def test_budget_overshoots_once(spark):
    r = spark.createDataFrame([(1, c, i, 60) for i, c in enumerate("abc", 1)], "qid int, id string, rank int, chars int")
    assert order(R.within_budget(r, 100)) == ["a", "b"]


def graded(spark, ranked, grades, k=5):
    l = spark.createDataFrame([("s", 1, c, i) for i, c in enumerate(ranked, 1)] or [("s", 2, "z", 1)], LISTS)
    q = spark.createDataFrame([(1, c, g) for c, g in grades.items()], "qid int, id string, grade int")
    return M.graded(l, q, k).filter("qid = 1").collect()[0]


def test_graded_metrics(spark):
    g = {"a": 2, "b": 1, "c": 1}
    assert graded(spark, "abc", g).ndcg == pytest.approx(1) and graded(spark, "cba", g).ndcg < 1
    assert graded(spark, "abx", g).recall == pytest.approx(2 / 3) and graded(spark, "xa", g).mrr == 0.5
    assert graded(spark, "axb", g).ap == pytest.approx((1 + 2 / 3) / 3) and graded(spark, "", g).ndcg == 0


def test_evidence(spark):
    q = spark.createDataFrame([(1, "a", 2), (1, "b", 2), (1, "v", 1)], "qid int, id string, grade int")
    docs = spark.createDataFrame([("a", "d1"), ("b", "d2"), ("v", "d1")], "id string, document string")
    for ids, want in (("axy", (0.5, 0.0, 0.0)), ("ab", (1.0, 1.0, 1.0)), ("xyzwqab", (0.0, 0.0, 0.0))):
        l = spark.createDataFrame([("s", 1, c, i) for i, c in enumerate(ids, 1)], LISTS)
        r = M.evidence(l, q, docs).collect()[0]
        assert (r.completeness, r.complete, r.document_coverage) == want


def test_geo_risk(spark):
    rows = [("a", i, 0.5) for i in range(4)] + [("b", i, 0.5) for i in range(4)]
    risk = {r.system: r.georisk for r in M.geo_risk(spark.createDataFrame(rows, "system string, qid int, ndcg double")).collect()}
    assert risk["a"] == pytest.approx(risk["b"]) == pytest.approx(math.sqrt(0.5 * 0.5), abs=1e-6)
    rows = [("steady", i, 0.5) for i in range(4)] + [("swingy", i, float(i % 2)) for i in range(4)]
    risk = {r.system: r.georisk for r in M.geo_risk(spark.createDataFrame(rows, "system string, qid int, ndcg double")).collect()}
    assert risk["steady"] > risk["swingy"]
