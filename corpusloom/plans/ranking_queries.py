"""Queries of vector search, ranking and metrics.

Every fiftieth vector asks, all vectors answer; the list `full` ranks by all numbers, `half` by the first
half; vectors of one label are relevant, those of an id divisible by 7 as anchors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import dense as D
from corpusloom.operators import metrics as M
from corpusloom.operators import ranking as R
from corpusloom.plans.registry import query
from corpusloom.session import table


def vectors(spark: SparkSession, d: str, half: bool = False) -> DataFrame:
    v = F.slice("embedding", 1, 32) if half else F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), v.alias("vector"), "label")


def asking(v: DataFrame) -> DataFrame:
    return v.filter("id % 50 = 0").select(F.col("id").alias("qid"), "vector")


def ranked(spark: SparkSession, d: str, half: bool = False, k: int = 100) -> DataFrame:
    v = vectors(spark, d, half)
    return D.search(asking(v), v, k).withColumn("document", F.col("id") % 20)


def lists(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).withColumn("system", F.lit("full")).union(ranked(spark, d, True).withColumn("system", F.lit("half")))


def sides(spark: SparkSession, d: str) -> DataFrame:
    return lists(spark, d).select("qid", F.when(F.col("system") == "full", 1).otherwise(2).alias("side"), "id", "score")


def qrels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    q = e.filter("id % 50 = 0").select(F.col("id").alias("qid"), "label")
    return e.join(q, "label").select("qid", "id", F.when(F.col("id") % 7 == 0, 2).otherwise(1).alias("grade"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 20).alias("document"))


def groups(spark: SparkSession, d: str) -> DataFrame:
    return qrels(spark, d).filter("grade = 2").select("qid", (F.col("id") % 3).alias("group_no"), "id", F.col("id").alias("place"))


NORMS = """v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT *, e[1:32] AS h, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS s, sqrt(list_sum(list_transform(e[1:32], lambda x: x * x))) AS hs FROM v)"""
LISTS = f"""{NORMS}, pr AS (SELECT q.id AS qid, c.id, round(list_inner_product(q.e, c.e) / (q.s * c.s), 6) AS f, round(list_inner_product(q.h, c.h) / (q.hs * c.hs), 6) AS h FROM n q, n c WHERE q.id % 50 = 0),
lists AS (SELECT * FROM (SELECT 'full' AS system, qid, id, f AS score, row_number() OVER (PARTITION BY qid ORDER BY f DESC, id) AS rank, id % 20 AS document FROM pr UNION ALL SELECT 'half', qid, id, h, row_number() OVER (PARTITION BY qid ORDER BY h DESC, id), id % 20 FROM pr) WHERE rank <= 100),
ranked AS (SELECT * FROM lists WHERE system = 'full')"""
QRELS = "qrels AS (SELECT q.vec_id AS qid, c.vec_id AS id, CASE WHEN c.vec_id % 7 = 0 THEN 2 ELSE 1 END AS grade FROM embeddings q JOIN embeddings c USING (label) WHERE q.vec_id % 50 = 0)"
SIDES = "sides AS (SELECT qid, CASE WHEN system = 'full' THEN 1 ELSE 2 END AS side, id, score FROM lists)"
GRADED = f"""{LISTS}, {QRELS}, per AS (SELECT qid, sum((pow(2, grade) - 1) / log2(i + 1)) FILTER (i <= 5) AS idcg, sum(grade / log2(i + 1)) FILTER (i <= 5) AS lin, count(*) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, id) AS i FROM qrels) GROUP BY qid),
hits AS (SELECT system, qid, id, rank, grade, count(*) OVER (PARTITION BY system, qid ORDER BY rank) AS nth FROM lists JOIN qrels USING (qid, id)),
fnd AS (SELECT system, qid, sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 5) AS dcg, sum(grade / log2(rank + 1)) FILTER (rank <= 5) AS ldcg, count(*) FILTER (rank <= 5) AS got, min(rank) AS first, sum(nth / CAST(rank AS DOUBLE)) AS aps FROM hits GROUP BY ALL),
per_query AS (SELECT s.system, per.qid, coalesce(dcg, 0) / idcg AS ndcg, coalesce(ldcg, 0) / lin AS ndcg_linear, coalesce(got, 0) / CAST(relevant AS DOUBLE) AS recall, coalesce(got, 0) / 5.0 AS precision, CASE WHEN first <= 5 THEN 1.0 / first ELSE 0 END AS mrr, coalesce(aps, 0) / relevant AS ap FROM (SELECT DISTINCT system FROM lists) s CROSS JOIN per LEFT JOIN fnd ON fnd.system = s.system AND fnd.qid = per.qid)"""


def _six(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {LISTS} SELECT qid, id, score, rank, document FROM ranked")
def r_dense_top(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d)


@query(f"WITH {LISTS}, c AS (SELECT qid, id FROM lists WHERE system = 'half' AND rank <= 20 UNION SELECT q.id, -1 FROM n q WHERE q.id % 50 = 0) SELECT qid, id, f AS score, row_number() OVER (PARTITION BY qid ORDER BY f DESC, id) AS rank FROM c JOIN pr USING (qid, id)")
def r_score_candidates(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    c = ranked(spark, d, True, 20).select("qid", "id").union(asking(v).select("qid", F.lit(-1).cast("long")))
    return D.score_candidates(c, asking(v), v)


@query(f"""WITH {LISTS}, a AS (SELECT system, qid, list(id ORDER BY rank) AS l FROM lists GROUP BY ALL), b AS (SELECT x.qid, x.l AS a, y.l AS b FROM a x JOIN a y ON x.qid = y.qid AND x.system = 'full' AND y.system = 'half')
SELECT qid, a[1:5] = b[1:5] AS same_order, list_sort(a[1:5]) = list_sort(b[1:5]) AS same_set, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS jaccard FROM b""")
def r_compare_search(spark: SparkSession, d: str) -> DataFrame:
    return _six(D.compare_top(ranked(spark, d), ranked(spark, d, True)))


@query(f"""WITH {LISTS}, e AS (SELECT qid, unnest(c.e) AS x, generate_subscripts(c.e, 1) AS i FROM ranked JOIN n c USING (id) WHERE rank <= 5), m AS (SELECT qid, i, avg(x) AS x FROM e GROUP BY ALL),
mv AS (SELECT m.qid, i, n.e[i] + 0.5 * m.x AS y FROM m JOIN n ON n.id = m.qid), nv AS (SELECT qid, list(y ORDER BY i) AS y, sqrt(sum(y * y)) AS s FROM mv GROUP BY 1) SELECT qid, unnest(list_transform(y, lambda e: round(e / s, 6))) AS x, CAST(generate_subscripts(y, 1) AS BIGINT) AS i FROM nv""")
def r_feedback(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    f = D.feedback(asking(v), ranked(spark, d), v)
    return f.select("qid", F.posexplode("vector").alias("i", "x")).select("qid", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("WITH e AS (SELECT label, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, i, round(avg(x), 6) AS x FROM e GROUP BY label, i")
def r_mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    m = D.mean_vectors(vectors(spark, d), "label").select("label", F.posexplode("vector").alias("i", "x"))
    return m.select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(f"""WITH {LISTS}, {QRELS}, rq AS (SELECT DISTINCT qid, id % 20 AS document FROM qrels WHERE grade = 2), a AS (SELECT qid, id, f AS score, id % 20 AS document, row_number() OVER (PARTITION BY qid ORDER BY f DESC, id) AS rank FROM pr),
h AS (SELECT qid, document, id, rank, row_number() OVER (PARTITION BY qid, document ORDER BY score DESC, id) AS inside FROM a JOIN rq USING (qid, document)) SELECT * FROM h WHERE inside <= 5""")
def r_routed(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).withColumn("document", F.col("id") % 20)
    required = qrels(spark, d).filter("grade = 2").select("qid", (F.col("id") % 20).alias("document")).distinct()
    return D.routed(asking(v), v, required)


@query(f"WITH {LISTS}, {QRELS}, a AS (SELECT qid, id, rank() OVER (PARTITION BY qid ORDER BY f DESC) AS place FROM pr) SELECT qid, id, place FROM a JOIN qrels USING (qid, id) WHERE grade = 2")
def r_rank_of(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return D.places(qrels(spark, d).filter("grade = 2"), asking(v), v).select("qid", "id", (F.col("higher") + 1).alias("place"))


_RRF = f"{LISTS}, rs AS (SELECT qid, id, round(sum(1.0 / (30 + rank)), 9) AS score FROM lists GROUP BY ALL), rrf AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM rs)"


@query(f"WITH {_RRF} SELECT * FROM rrf WHERE rank <= 100")
def r_reciprocal_fusion(spark: SparkSession, d: str) -> DataFrame:
    return R.reciprocal_fusion(lists(spark, d))


@query(f"WITH {LISTS}, rs AS (SELECT qid, id, round(1.0 / (30 + rank), 9) AS score FROM ranked) SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM rs")
def r_best_of_families(spark: SparkSession, d: str) -> DataFrame:
    quality = spark.createDataFrame([("full", "dense", 0.9), ("half", "dense", 0.4)], "system string, family string, value double")
    return R.best_of_families(lists(spark, d), quality)


@query(f"WITH {LISTS}, g AS (SELECT r.qid, r.id, r.rank AS old, coalesce(h.score, -1e9) AS given FROM ranked r LEFT JOIN (SELECT * FROM lists WHERE system = 'half') h USING (qid, id)) SELECT qid, id, old, row_number() OVER (PARTITION BY qid ORDER BY old > 20, CASE WHEN old <= 20 THEN -given END, old) AS rank FROM g")
def r_rerank_pool(spark: SparkSession, d: str) -> DataFrame:
    return R.rerank_pool(ranked(spark, d), ranked(spark, d, True), 20).withColumnRenamed("old", "old")


_CAP = f"{LISTS}, c0 AS (SELECT *, row_number() OVER (PARTITION BY qid, document ORDER BY rank) AS nth FROM ranked), cap AS (SELECT qid, id, document, rank AS old, nth, row_number() OVER (PARTITION BY qid ORDER BY nth > 1, rank) AS rank FROM c0)"


@query(f"WITH {_CAP} SELECT qid, id, document, old, rank FROM cap")
def r_cap_reorder(spark: SparkSession, d: str) -> DataFrame:
    return R.cap_reorder(ranked(spark, d), 1)


@query(f"WITH {_CAP} SELECT qid, id, rank FROM cap WHERE rank <= 5")
def r_cap_select(spark: SparkSession, d: str) -> DataFrame:
    return R.cap_select(ranked(spark, d), 1).select("qid", "id", "rank")


@query(f"WITH {_CAP}, x AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY old) AS rank FROM cap WHERE nth <= 1) SELECT * FROM x WHERE rank <= 5")
def r_cap_no_backfill(spark: SparkSession, d: str) -> DataFrame:
    return R.cap_select(ranked(spark, d), 1, backfill=False).select("qid", "id", "rank")


@query(
    f"""WITH RECURSIVE {LISTS}, pool AS (SELECT r.qid, r.id, 1.0 - (rank - 1) / 29.0 AS rel, list_transform(n.e, lambda x: x / n.s) AS u, rank FROM ranked r JOIN n USING (id) WHERE rank <= 30),
sim AS (SELECT a.qid, a.id AS a, b.id AS b, list_inner_product(a.u, b.u) AS c FROM pool a JOIN pool b USING (qid)),
step AS (SELECT DISTINCT qid, 0 AS k, CAST([] AS BIGINT[]) AS chosen FROM pool UNION ALL
SELECT s.qid, s.k + 1, list_append(s.chosen, (SELECT arg_min(p.id, row(-round(0.7 * p.rel - 0.3 * coalesce((SELECT max(c) FROM sim WHERE sim.qid = s.qid AND sim.a = p.id AND list_contains(s.chosen, sim.b)), 0), 9), p.rank)) FROM pool p WHERE p.qid = s.qid AND NOT list_contains(s.chosen, p.id))) FROM step s WHERE s.k < 5)
SELECT qid, unnest(chosen) AS id, generate_subscripts(chosen, 1) AS rank FROM step WHERE k = 5"""
)
def r_diverse(spark: SparkSession, d: str) -> DataFrame:
    return R.diverse(ranked(spark, d), vectors(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""WITH RECURSIVE {LISTS}, w AS (SELECT DISTINCT qid, 0 AS k, CAST([] AS BIGINT[]) AS picked FROM ranked UNION ALL
SELECT w.qid, w.k + 1, CASE WHEN len(picked) < 5 AND len(list_filter(picked, lambda e: e % 3 = r.id % 3 AND abs(e - r.id) < 40)) = 0 THEN list_append(picked, r.id) ELSE picked END FROM w JOIN ranked r ON r.qid = w.qid AND r.rank = w.k + 1),
l AS (SELECT w.qid, list_concat(picked, (SELECT list(id ORDER BY rank) FROM ranked r WHERE r.qid = w.qid AND NOT list_contains(picked, id)))[1:5] AS ids FROM w WHERE k = 100) SELECT qid, unnest(ids) AS id, generate_subscripts(ids, 1) AS rank FROM l"""
)
def r_apart(spark: SparkSession, d: str) -> DataFrame:
    r = ranked(spark, d).withColumn("document", F.col("id") % 3).withColumn("position", F.col("id"))
    return R.apart(r, 40).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {LISTS}, b AS (SELECT qid, id, rank, id % 900 + 100 AS chars, coalesce(sum(id % 900 + 100) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked) SELECT qid, id, rank, chars, CAST(before AS BIGINT) AS before FROM b WHERE before < 2000")
def r_within_budget(spark: SparkSession, d: str) -> DataFrame:
    r = ranked(spark, d).withColumn("chars", F.col("id") % 900 + 100)
    return R.within_budget(r, 2000).select("qid", "id", "rank", "chars", "before")


_BEST = f"{LISTS}, {SIDES}, best AS (SELECT qid, id, max(score) AS score FROM sides GROUP BY ALL), ord AS (SELECT *, row_number() OVER (PARTITION BY qid, side ORDER BY score DESC, id) AS r FROM sides)"


@query(f"WITH {_BEST}, x AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM best) SELECT * FROM x WHERE rank <= 10")
def r_best_score(spark: SparkSession, d: str) -> DataFrame:
    return R.best_score(sides(spark, d), 10)


@query(
    f"""WITH {_BEST}, f AS (SELECT qid, id FROM ord WHERE side = 1 AND r = 1), s AS (SELECT qid, arg_min(id, r) AS id FROM ord ANTI JOIN f USING (qid, id) WHERE side = 2 GROUP BY qid),
h AS (SELECT qid, id, 0 AS slot FROM f UNION ALL SELECT qid, id, 1 FROM s), x AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY coalesce(slot, 9), score DESC, id) AS rank FROM best LEFT JOIN h USING (qid, id)) SELECT * FROM x WHERE rank <= 10"""
)
def r_reserve_best(spark: SparkSession, d: str) -> DataFrame:
    return R.reserve_best(sides(spark, d), 10)


@query(
    f"""WITH RECURSIVE {_BEST}, turn AS (SELECT DISTINCT qid, 0 AS t, CAST([] AS BIGINT[]) AS out FROM sides UNION ALL
SELECT w.qid, w.t + 1, CASE WHEN len(out) >= 10 THEN out ELSE list_concat(out, coalesce((SELECT [arg_min(o.id, o.r)] FROM ord o WHERE o.qid = w.qid AND o.side = w.t % 2 + 1 AND NOT list_contains(w.out, o.id) HAVING count(*) > 0), [])) END FROM turn w WHERE w.t < 20)
SELECT qid, unnest(out) AS id, generate_subscripts(out, 1) AS rank FROM turn WHERE t = 20"""
)
def r_interleave(spark: SparkSession, d: str) -> DataFrame:
    return R.interleave(sides(spark, d), 10).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""WITH {_BEST}, k AS (SELECT qid, id, min(CASE WHEN side = 1 AND r <= 3 THEN r WHEN side = 2 AND r <= 2 THEN 10 + r WHEN side = 1 THEN 100 + 2 * (r - 3) ELSE 101 + 2 * (r - 2) END) AS k FROM ord GROUP BY ALL),
x AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY k) AS rank FROM k) SELECT * FROM x WHERE rank <= 5"""
)
def r_partition(spark: SparkSession, d: str) -> DataFrame:
    return R.partition(sides(spark, d), 3, 2).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_BEST}, x AS (SELECT qid, id, min(2 * r + side) AS place FROM ord WHERE r <= 10 GROUP BY ALL) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY place, id) AS rank FROM x")
def r_union_by_need(spark: SparkSession, d: str) -> DataFrame:
    return R.union_by_need(sides(spark, d), 10)


@query(f"WITH {LISTS}, p AS (SELECT qid, id // 4 AS parent, min(rank) AS first FROM ranked WHERE rank <= 12 GROUP BY ALL), x AS (SELECT qid, parent, row_number() OVER (PARTITION BY qid ORDER BY first) AS rank FROM p) SELECT * FROM x WHERE rank <= 3")
def r_first_parents(spark: SparkSession, d: str) -> DataFrame:
    return R.first_parents(ranked(spark, d).withColumn("parent", F.floor(F.col("id") / 4)))


@query(f"WITH {LISTS}, {QRELS}, p AS (SELECT qid, id, system AS origin FROM lists WHERE rank <= 10 UNION ALL SELECT qid, id, 'anchor' FROM qrels WHERE grade = 2) SELECT qid, id, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins, bool_or(origin = 'anchor') AS anchor FROM p GROUP BY ALL")
def r_judging_pool(spark: SparkSession, d: str) -> DataFrame:
    return R.judging_pool(lists(spark, d), qrels(spark, d).filter("grade = 2"), 10).withColumn("origins", F.array_join("origins", ","))


@query(f"WITH {LISTS} SELECT system, qid, id, rank FROM ranked WHERE qid % 100 = 0 UNION ALL SELECT system, qid, id, rank FROM ranked WHERE qid % 100 <> 0")
def r_complete_rankings(spark: SparkSession, d: str) -> DataFrame:
    r = ranked(spark, d).select(F.lit("full").alias("system"), "qid", "id", "rank")
    return R.complete_rankings(r.filter("qid % 100 = 0"), r)


@query(f"WITH {LISTS}, x AS (SELECT DISTINCT system, id FROM lists WHERE rank <= 20) SELECT system, round(avg(CASE WHEN id % 10 <> 3 THEN 1.0 ELSE 0 END), 6) AS known, avg(CASE WHEN id % 10 <> 3 THEN 1.0 ELSE 0 END) >= 0.95 AS alive FROM x GROUP BY 1")
def r_living_systems(spark: SparkSession, d: str) -> DataFrame:
    return _six(R.living_systems(lists(spark, d), vectors(spark, d).filter("id % 10 <> 3").select("id")))


_GROUPS = "grp AS (SELECT qid, id % 3 AS group_no, id FROM qrels WHERE grade = 2)"


@query(f"WITH {LISTS}, {QRELS}, {_GROUPS}, b AS (SELECT g.qid, group_no, min(rank) AS best FROM grp g LEFT JOIN ranked r USING (qid, id) GROUP BY ALL), w AS (SELECT qid, max(coalesce(best, 1000000000)) AS worst FROM b GROUP BY 1) SELECT qid, CASE WHEN worst <= 5 THEN 'hit' WHEN worst <= 100 THEN 'order' ELSE 'impossible' END AS outcome FROM w")
def r_ceiling_split(spark: SparkSession, d: str) -> DataFrame:
    return R.ceiling_split(ranked(spark, d), groups(spark, d))


@query(f"WITH {GRADED} SELECT system, qid, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(precision, 6) AS precision, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1, round(mrr, 6) AS mrr, round(ap, 6) AS ap FROM per_query")
def m_graded(spark: SparkSession, d: str) -> DataFrame:
    return _six(M.graded(lists(spark, d), qrels(spark, d)))


@query(f"WITH {GRADED} SELECT system, qid, round(ndcg_linear, 6) AS ndcg FROM per_query")
def m_ndcg_linear(spark: SparkSession, d: str) -> DataFrame:
    return _six(M.graded(lists(spark, d), qrels(spark, d), linear=True).select("system", "qid", "ndcg"))


@query(f"WITH {GRADED} SELECT system, count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ap), 6) AS ap FROM per_query GROUP BY 1")
def m_run_means(spark: SparkSession, d: str) -> DataFrame:
    return _six(M.run_means(M.graded(lists(spark, d), qrels(spark, d)))).select("system", "queries", "ndcg", "recall", "mrr", "ap")


@query(f"""WITH {LISTS}, {QRELS}, a AS (SELECT s.system, qid, q.id, q.id % 20 AS document, CASE WHEN l.rank <= 5 THEN 1 ELSE 0 END AS hit FROM (SELECT DISTINCT system FROM lists) s CROSS JOIN (SELECT * FROM qrels WHERE grade = 2) q LEFT JOIN lists l USING (system, qid, id)),
p AS (SELECT system, qid, document, max(hit) AS h, sum(hit) AS s, count(*) AS n FROM a GROUP BY ALL) SELECT system, qid, round(sum(s) / CAST(sum(n) AS DOUBLE), 6) AS completeness, CASE WHEN sum(s) = sum(n) THEN 1.0 ELSE 0.0 END::DOUBLE AS complete, min(h)::DOUBLE AS document_coverage FROM p GROUP BY ALL""")
def m_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _six(M.evidence(lists(spark, d), qrels(spark, d), documents(spark, d)))


@query(f"""WITH {LISTS}, {QRELS}, {_GROUPS}, a AS (SELECT s.system, g.qid, group_no, min(rank) AS best, min(id) % 20 AS document FROM (SELECT DISTINCT system FROM lists) s CROSS JOIN grp g LEFT JOIN lists l USING (system, qid, id) GROUP BY ALL),
h AS (SELECT *, CASE WHEN best <= 5 THEN 1 ELSE 0 END AS hit FROM a), c AS (SELECT system, qid, document, max(hit) AS anyhit FROM h GROUP BY ALL), cc AS (SELECT system, qid, min(anyhit)::DOUBLE AS document_coverage FROM c GROUP BY ALL)
SELECT system, qid, min(hit)::DOUBLE AS joint, round(avg(hit), 6) AS completeness, max(hit)::DOUBLE AS loose, round(coalesce(CASE WHEN min(best) <= 5 THEN 1.0 / min(best) END, 0), 6) AS mrr, any_value(document_coverage) AS document_coverage FROM h JOIN cc USING (system, qid) GROUP BY ALL""")
def m_groups(spark: SparkSession, d: str) -> DataFrame:
    return _six(M.group_metrics(lists(spark, d), groups(spark, d), documents(spark, d)))


_PHI = "0.5 * (1 + sign(x) * (1 - ({t}) * (0.254829592 + ({t}) * (-0.284496736 + ({t}) * (1.421413741 + ({t}) * (-1.453152027 + ({t}) * 1.061405429)))) * exp(-x * x / 2)))".format(t="1 / (1 + 0.3275911 * abs(x) / sqrt(2))")


@query(f"""WITH {GRADED}, s AS (SELECT system, qid, ndcg AS x0 FROM per_query), c AS (SELECT qid, sum(x0) AS t FROM s GROUP BY 1), r AS (SELECT system, sum(x0) AS si, count(*) AS n FROM s GROUP BY 1), e AS (SELECT s.system, x0, si, n, si * t / (SELECT sum(x0) FROM s) AS e FROM s JOIN c USING (qid) JOIN r USING (system)),
z AS (SELECT system, any_value(si) AS si, any_value(n) AS n, sum(CASE WHEN e > 0 THEN (x0 - e) / sqrt(e) * CASE WHEN x0 < e THEN 3.0 ELSE 1.0 END ELSE 0 END) / any_value(n) AS x FROM e GROUP BY 1) SELECT system, round(sqrt(si / n * {_PHI}), 6) AS georisk FROM z""")
def m_geo_risk(spark: SparkSession, d: str) -> DataFrame:
    return _six(M.geo_risk(M.graded(lists(spark, d), qrels(spark, d))))


@query(f"WITH {GRADED} SELECT system, label, count(*) AS queries, round(avg(ndcg), 6) AS mean FROM per_query JOIN embeddings ON vec_id = qid GROUP BY GROUPING SETS ((system, label), (system))")
def m_stratified(spark: SparkSession, d: str) -> DataFrame:
    strata = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "label")
    return _six(M.stratified(M.graded(lists(spark, d), qrels(spark, d)), strata, "label"))


@query(f"WITH {LISTS}, m AS (SELECT system, qid, document, count(*) AS n FROM lists WHERE rank <= 5 GROUP BY ALL) SELECT system, qid, max(n) AS slots FROM m GROUP BY ALL")
def m_monopoly(spark: SparkSession, d: str) -> DataFrame:
    return M.monopoly(lists(spark, d))


@query(f"WITH {GRADED}, j AS (SELECT a.ndcg AS x, b.ndcg AS y FROM per_query a JOIN per_query b USING (qid) WHERE a.system = 'full' AND b.system = 'half') SELECT count(*) FILTER (y > x + 1e-9) AS better, count(*) FILTER (y < x - 1e-9) AS worse, count(*) FILTER (abs(y - x) <= 1e-9) AS same FROM j")
def m_better_worse(spark: SparkSession, d: str) -> DataFrame:
    g = M.graded(lists(spark, d), qrels(spark, d))
    return M.better_worse(g.filter("system = 'full'"), g.filter("system = 'half'"))


@query(f"""WITH {QRELS}, {_GROUPS}, f AS (SELECT qid, group_no, min(id // 10) AS p FROM grp GROUP BY ALL), x AS (SELECT qid, count(*) AS groups, max(p) - min(p) AS distance FROM f GROUP BY 1)
SELECT *, CASE WHEN groups = 1 THEN 'single' WHEN distance = 0 THEN 'same' WHEN distance <= 2 THEN 'next' WHEN distance <= 10 THEN 'near' ELSE 'far' END AS dispersion FROM x""")
def m_dispersion(spark: SparkSession, d: str) -> DataFrame:
    return M.dispersion(groups(spark, d), vectors(spark, d).select("id", F.floor(F.col("id") / 10).alias("position")))


@query(f"""WITH {LISTS} SELECT system, qid, max(score) FILTER (rank = 1) AS top1, round(sum(score) FILTER (rank <= 5), 6) AS sum5, round(stddev_pop(score) FILTER (rank <= 5), 4) AS spread5, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 6) AS gap12, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 10), 6) AS drop10, count(DISTINCT document) FILTER (rank <= 5) AS documents5 FROM lists GROUP BY ALL""")
def m_failure_features(spark: SparkSession, d: str) -> DataFrame:
    f = M.failure_features(lists(spark, d))
    return f.select("system", "qid", "top1", F.round(5 * F.col("mean5"), 6).alias("sum5"), F.round("spread5", 4).alias("spread5"), *[F.round(c, 6).alias(c) for c in ("gap12", "drop10")], "documents5")


@query(f"WITH {LISTS}, {QRELS}, {_GROUPS} SELECT s.system, g.qid, group_no, min(rank) AS best FROM (SELECT DISTINCT system FROM lists) s CROSS JOIN grp g LEFT JOIN lists l USING (system, qid, id) GROUP BY ALL")
def m_best_group_ranks(spark: SparkSession, d: str) -> DataFrame:
    return M.best_group_ranks(lists(spark, d), groups(spark, d))


@query(f"""WITH {LISTS}, d AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank, r.document, floor(score * 10) AS band FROM ranked r), c AS (SELECT qid, band, count(*) AS n, sum(count(*)) OVER (PARTITION BY qid ORDER BY band DESC) AS upto FROM d GROUP BY qid, band)
SELECT qid, CAST(band AS BIGINT) AS band, n, CAST(upto AS BIGINT) AS upto FROM c""")
def m_score_bands(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    c = ranked(spark, d).groupBy("qid", F.floor(F.col("score") * 10).alias("band")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("qid").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.withColumn("upto", F.sum("n").over(w))
