"""Queries of statistics, agreement and refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import agreement as A
from corpusloom.operators import metrics as M
from corpusloom.operators import statistics as Q
from corpusloom.plans.ranking_queries import _PHI, GRADED, _six, lists, qrels
from corpusloom.plans.registry import query
from corpusloom.plans.text_queries import _replies, unaccent_sql
from corpusloom.session import table


def draw_sql(*parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || left(md5({text}), 8) AS BIGINT)"


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    g = M.graded(lists(spark, d), qrels(spark, d)).select("system", "qid", F.round("ndcg", 6).alias("ndcg"))
    a, b = (g.filter(F.col("system") == s).select(F.col("qid").alias("key"), F.col("ndcg").alias(n)) for s, n in (("full", "x"), ("half", "y")))
    return a.join(b, "key").select("key", F.round(F.col("x") - F.col("y"), 6).alias("diff"))


DIFFS = f"{GRADED}, diffs AS (SELECT a.qid AS key, round(round(a.ndcg, 6) - round(b.ndcg, 6), 6) AS diff FROM per_query a JOIN per_query b USING (qid) WHERE a.system = 'full' AND b.system = 'half')"


@query(
    f"""WITH {DIFFS}, h AS (SELECT diff, g.range AS g, md5('7|' || g.range || '|' || key) AS h FROM diffs, range(79) g),
s AS (SELECT g * 128 + b.range AS round, round(abs(avg(CASE WHEN (CAST('0x' || substr(h, CAST(b.range // 4 AS INT) + 1, 1) AS INT) >> CAST(3 - b.range % 4 AS INT)) & 1 = 1 THEN -diff ELSE diff END)), 9) AS m FROM h, range(128) b WHERE g * 128 + b.range < 10000 GROUP BY 1),
o AS (SELECT avg(diff) AS mean, max(abs(diff)) AS most, count(*) AS n FROM diffs) SELECT n, round(mean, 6) AS mean, round(CASE WHEN most = 0 THEN 1 ELSE ((SELECT count(*) FROM s WHERE m >= round(abs(mean), 9)) + 1) / 10001.0 END, 6) AS p FROM o"""
)
def q_paired_randomization(spark: SparkSession, d: str) -> DataFrame:
    return _six(Q.paired_randomization(_diffs(spark, d)))


@query(
    f"""WITH {DIFFS}, d AS (SELECT *, round(abs(diff), 9) AS a FROM diffs WHERE diff <> 0), z AS (SELECT a, count(*) AS t, count(*) FILTER (diff > 0) AS up FROM d GROUP BY 1), r AS (SELECT *, coalesce(sum(t) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS rk FROM z),
s AS (SELECT CAST(sum(t) AS BIGINT) AS n, sum(rk * up) AS w, sum(pow(t, 3) - t) AS ties FROM r), u AS (SELECT n, w, (w - n * (n + 1) / 4.0) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM s), zz AS (SELECT *, -abs(z) AS x FROM u) SELECT n, round(w, 6) AS w, round(z, 6) AS z, round(2 * {_PHI}, 6) AS p FROM zz"""
)
def q_signed_ranks(spark: SparkSession, d: str) -> DataFrame:
    return _six(Q.signed_ranks(_diffs(spark, d)))


@query(
    f"""WITH {DIFFS}, h AS (SELECT diff AS x, g.range AS g, md5('7|' || g.range || '|' || key) AS h FROM diffs, range(1250) g),
pk AS (SELECT x, g * 8 + b.range AS round, CAST('0x' || substr(h, CAST(b.range * 4 AS INT) + 1, 4) AS INT) AS u FROM h, range(8) b),
c AS (SELECT round, x, list_sum(list_transform({Q.POISSON_BOUNDS}, lambda t: CASE WHEN u >= t THEN 1 ELSE 0 END)) AS times FROM pk),
m AS (SELECT round, sum(times * x) / sum(times) AS m FROM c GROUP BY 1 HAVING sum(times) > 0) SELECT round(quantile_cont(m, 0.025), 5) AS low, round(quantile_cont(m, 0.975), 5) AS high, (SELECT round(avg(diff), 5) FROM diffs) AS mean FROM m"""
)
def q_bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    v = _diffs(spark, d).select("key", F.col("diff").alias("x"))
    return Q.bootstrap_interval(v).select(*[F.round(c, 5).alias(c) for c in ("low", "high", "mean")])


_SIDE = "rws AS (SELECT CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS side, round(CAST(embedding[1] AS DOUBLE), 2) AS x, label < 5 AS positive FROM embeddings)"


def _sides(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.when(F.col("label") < 5, "a").otherwise("b").alias("side"), F.round(F.col("embedding")[0].cast("double"), 2).alias("x"), (F.col("label") < 5).alias("positive"))


@query(f"WITH {_SIDE} SELECT count(DISTINCT a.rowid) AS na, count(DISTINCT b.rowid) AS nb, round(avg(sign(a.x - b.x)), 6) AS delta FROM (SELECT *, row_number() OVER () AS rowid FROM rws WHERE side = 'a') a, (SELECT *, row_number() OVER () AS rowid FROM rws WHERE side = 'b') b")
def q_cliffs_delta(spark: SparkSession, d: str) -> DataFrame:
    return _six(Q.cliffs_delta(_sides(spark, d)))


@query(f"WITH {_SIDE} SELECT (SELECT count(*) FROM rws WHERE positive) AS positives, (SELECT count(*) FROM rws WHERE NOT positive) AS negatives, round(avg(CASE WHEN a.x > b.x THEN 1 WHEN a.x = b.x THEN 0.5 ELSE 0 END), 6) AS auc FROM rws a, rws b WHERE a.positive AND NOT b.positive")
def q_auc(spark: SparkSession, d: str) -> DataFrame:
    return _six(Q.auc(_sides(spark, d), "x"))


_TESTS = "tests AS (SELECT source AS name, count(*) FILTER (lang = 'pt') / CAST(count(*) AS DOUBLE) / 10 AS p FROM documents GROUP BY 1)"


def _tests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg((F.count_if(F.col("lang") == "pt") / F.count("*") / 10).alias("p"))


@query(
    f"""WITH {_TESTS}, r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS i, count(*) OVER () AS m FROM tests) SELECT name, round(p, 6) AS p, round(least(1, p * m), 6) AS bonferroni, round(least(1, max((m - i + 1) * p) OVER (ORDER BY p, name)), 6) AS holm,
round(least(1, min(p * m / i) OVER (ORDER BY p, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh FROM r"""
)
def q_corrections(spark: SparkSession, d: str) -> DataFrame:
    return _six(Q.corrections(_tests(spark, d)))


@query(f"WITH {_TESTS}, r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS i, count(*) OVER () AS m FROM tests) SELECT CAST(coalesce(max(i) FILTER (p <= i / CAST(m AS DOUBLE) * 0.05), 0) AS INT) AS rejected, round(max(p) FILTER (p <= i / CAST(m AS DOUBLE) * 0.05), 6) AS cutoff, round(0.05 / max(m), 6) AS bonferroni FROM r")
def q_step_up(spark: SparkSession, d: str) -> DataFrame:
    return _six(Q.step_up_cutoff(_tests(spark, d)))


_READ = f"regexp_replace({unaccent_sql('lower(juiz_suficiente_s_parcial_n)')}, '[^a-z]', '', 'g')"
SCORES = f"""rd AS (SELECT qid AS item, avaliador AS judge, julgado_em, CASE WHEN {_READ} IN ('s', 'sim') THEN 3 WHEN {_READ} IN ('parcial', 'parc', 'parcialmente') THEN 2 WHEN {_READ} IN ('n', 'nao') THEN 1 END AS score FROM auditoria_perguntas),
scores AS (SELECT item, judge, max(row(julgado_em, score))[2] AS score FROM rd WHERE score IS NOT NULL AND item IS NOT NULL AND judge IS NOT NULL GROUP BY ALL),
prs AS (SELECT a.judge AS a, b.judge AS b, item, a.score AS x, b.score AS y FROM scores a JOIN scores b USING (item) WHERE a.judge < b.judge)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    return A.last_scores(table(spark, d, "auditoria_perguntas"), "qid", "avaliador", A.read_scale(F.col("juiz_suficiente_s_parcial_n")), "julgado_em")


@query(f"""WITH {SCORES}, c AS (SELECT a, b, count(*) FILTER (x = 3 AND y < 3) AS l, count(*) FILTER (x < 3 AND y = 3) AS r FROM prs GROUP BY ALL)
SELECT a, b, l, r, round(CASE WHEN l + r = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(l, r) + 1), lambda i: exp(lgamma(l + r + 1) - lgamma(i + 1) - lgamma(l + r - i + 1) - (l + r) * ln(2))))) END, 6) AS p FROM c""")
def q_exact_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    c = A.pairs(scores(spark, d)).groupBy("a", "b").agg(F.count_if((F.col("x") == 3) & (F.col("y") < 3)).alias("l"), F.count_if((F.col("x") < 3) & (F.col("y") == 3)).alias("r"))
    return _six(c.withColumn("p", Q.exact_mcnemar(F.col("l"), F.col("r"))))


_SCORED = "sc AS (SELECT vec_id AS key, (CAST(embedding[1] AS DOUBLE) + 1) / 2 AS score, label < 5 AS positive FROM embeddings)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), ((F.col("embedding")[0].cast("double") + 1) / 2).alias("score"), (F.col("label") < 5).alias("positive"))


@query(f"WITH {_SCORED}, k AS (SELECT least(greatest(floor(score * 100), 0), 100) AS k, positive FROM sc) SELECT g.range / 100.0 AS threshold, (SELECT count(*) FROM k WHERE k < g.range AND NOT positive) AS refused_negatives, (SELECT count(*) FROM k WHERE k < g.range AND positive) AS refused_positives FROM range(1, 100) g")
def q_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return Q.threshold_sweep(_scored(spark, d))


@query(
    f"""WITH {_SCORED}, h AS (SELECT least(greatest(floor(score * 1000), 0), 1000) AS k, positive, {draw_sql("'half'", 'key')} % 2 AS half FROM sc), s AS (SELECT g.range AS t, (SELECT count(*) FROM h WHERE half = 0 AND k < g.range AND NOT positive) AS rn, (SELECT count(*) FROM h WHERE half = 0 AND k < g.range AND positive) AS rp FROM range(1, 1000) g),
c AS (SELECT -max(row(rn, -t))[2] AS t FROM s WHERE rp <= 0.1 * (SELECT count(*) FROM h WHERE half = 0 AND positive))
SELECT t / 1000.0 AS threshold, round(avg(CASE WHEN k < t THEN 1.0 ELSE 0 END) FILTER (NOT positive), 6) AS refused, round(avg(CASE WHEN k < t THEN 1.0 ELSE 0 END) FILTER (positive), 6) AS lost FROM h, c WHERE half = 1 GROUP BY t"""
)
def q_split_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _six(Q.split_threshold(_scored(spark, d)))


@query("WITH s AS (SELECT source, list(n_chars ORDER BY n_chars) AS l FROM documents WHERE n_chars IS NOT NULL GROUP BY 1) SELECT source, CAST(l[len(l) // 2 + 1] AS BIGINT) AS upper_median, CAST(l[1] AS BIGINT) AS least, CAST(l[-1] AS BIGINT) AS most FROM s")
def q_group_medians(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("n_chars IS NOT NULL").withColumn("n", F.col("n_chars").cast("long"))
    return docs.groupBy("source").agg(Q.upper_median("n").cast("long").alias("upper_median"), F.min("n").alias("least"), F.max("n").alias("most"))


@query(f"WITH {DIFFS} SELECT count(*) AS n, avg(diff) - stddev_samp(diff) > -0.03 AS noninferior FROM diffs")
def q_noninferior(spark: SparkSession, d: str) -> DataFrame:
    return _diffs(spark, d).agg(F.count("*").alias("n"), Q.noninferior(F.avg("diff") - F.stddev_samp("diff")).alias("noninferior"))


@query(f"WITH {SCORES} SELECT item, judge, score FROM scores")
def a_read_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d)


@query("SELECT n, CASE WHEN round_even(janela / 400.0, 0) BETWEEN 1 AND 3 THEN CAST(round_even(janela / 400.0, 0) AS INT) END AS score, coalesce(lower(trim(difficulty)) = 'na', FALSE) AS na, coalesce(trim(answer), '') <> '' AS applies FROM (SELECT DISTINCT n, janela, difficulty, answer FROM perguntas_lote01)")
def a_parse_scores(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "perguntas_lote01").select("n", "janela", "difficulty", "answer").distinct()
    raw = (F.col("janela") / 400.0).cast("string")
    return r.select("n", A.parse_score(raw, 1, 3).alias("score"), F.coalesce(A.is_na(F.col("difficulty")), F.lit(False)).alias("na"), A.applies(F.lit("correctness"), F.col("answer"), F.lit(None).cast("string")).alias("applies"))


@query(
    f"""WITH {SCORES}, mr AS (SELECT a, b, v, w, coalesce(sum(n) OVER (PARTITION BY a, b, w ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS r FROM (SELECT a, b, x AS v, 1 AS w, count(*) AS n FROM prs GROUP BY ALL UNION ALL SELECT a, b, y, 2, count(*) FROM prs GROUP BY ALL)),
bs AS (SELECT p.a, p.b, count(*) AS n, avg(CASE WHEN x = y THEN 1.0 ELSE 0 END) AS exact, avg(CASE WHEN abs(x - y) <= 1 THEN 1.0 ELSE 0 END) AS within1, corr(rx.r, ry.r) AS spearman, sum((x - y) * (x - y)) AS o FROM prs p JOIN mr rx ON rx.a = p.a AND rx.b = p.b AND rx.w = 1 AND rx.v = x JOIN mr ry ON ry.a = p.a AND ry.b = p.b AND ry.w = 2 AND ry.v = y GROUP BY ALL),
ex AS (SELECT l.a, l.b, sum(l.n * r.n * (l.x - r.y) * (l.x - r.y)) AS e FROM (SELECT a, b, x, count(*) AS n FROM prs GROUP BY ALL) l JOIN (SELECT a, b, y, count(*) AS n FROM prs GROUP BY ALL) r ON l.a = r.a AND l.b = r.b GROUP BY ALL)
SELECT a, b, n, round(exact, 6) AS exact, round(within1, 6) AS within1, round(1 - o * n / CAST(e AS DOUBLE), 6) AS kappa_w, round(spearman, 6) AS spearman FROM bs JOIN ex USING (a, b)"""
)
def a_pair_agreement(spark: SparkSession, d: str) -> DataFrame:
    return _six(A.pair_agreement(scores(spark, d))).drop("alpha")


_ALPHA = """vals AS (SELECT a, b, item, 1 AS w, x AS v FROM prs UNION ALL SELECT a, b, item, 2, y FROM prs), nc AS (SELECT a, b, v, count(*) AS n FROM vals GROUP BY ALL), dl AS (SELECT l.a, l.b, l.v AS c, r.v AS k, l.n AS nl, r.n AS nr, (SELECT sum(n) FROM nc g WHERE g.a = l.a AND g.b = l.b AND g.v BETWEEN least(l.v, r.v) AND greatest(l.v, r.v)) - (l.n + r.n) / 2.0 AS dd FROM nc l JOIN nc r ON l.a = r.a AND l.b = r.b)"""


@query(f"WITH {SCORES}, {_ALPHA}, o AS (SELECT p.a, p.b, sum(2 * dd * dd) AS o FROM prs p JOIN dl ON dl.a = p.a AND dl.b = p.b AND dl.c = x AND dl.k = y AND x <> y GROUP BY ALL), e AS (SELECT a, b, sum(nl * nr * dd * dd) FILTER (c <> k) AS e FROM dl GROUP BY ALL), t AS (SELECT a, b, count(*) AS t FROM vals GROUP BY ALL) SELECT a, b, round(1 - (t - 1) * coalesce(o, 0) / e, 6) AS alpha FROM t JOIN e USING (a, b) LEFT JOIN o USING (a, b)")
def a_pair_alpha(spark: SparkSession, d: str) -> DataFrame:
    return _six(A.pair_agreement(scores(spark, d))).select("a", "b", "alpha")


@query(
    f"""WITH {SCORES}, u AS (SELECT *, count(*) OVER (PARTITION BY item) AS m FROM scores), v AS (SELECT * FROM u WHERE m >= 2), nc AS (SELECT score, count(*) AS n FROM v GROUP BY 1), dl AS (SELECT l.score AS c, r.score AS k, l.n AS nl, r.n AS nr, (SELECT sum(n) FROM nc g WHERE g.score BETWEEN least(l.score, r.score) AND greatest(l.score, r.score)) - (l.n + r.n) / 2.0 AS dd FROM nc l, nc r),
o AS (SELECT sum(dd * dd / (x.m - 1)) AS o FROM v x JOIN v y ON x.item = y.item AND x.judge <> y.judge JOIN dl ON c = x.score AND k = y.score WHERE c <> k)
SELECT (SELECT count(DISTINCT item) FROM v) AS items, (SELECT count(*) FROM v) AS scores, round(1 - ((SELECT count(*) FROM v) - 1) * o / (SELECT sum(nl * nr * dd * dd) FROM dl WHERE c <> k), 6) AS alpha FROM o"""
)
def a_ordinal_alpha(spark: SparkSession, d: str) -> DataFrame:
    return _six(A.ordinal_alpha(scores(spark, d)))


@query(
    f"""WITH {SCORES}, n AS (SELECT a, b, count(*) AS n, avg(CASE WHEN x = y THEN 1.0 ELSE 0 END) AS po FROM prs GROUP BY ALL), e AS (SELECT l.a, l.b, sum(l.n * r.n) AS e FROM (SELECT a, b, x, count(*) AS n FROM prs GROUP BY ALL) l JOIN (SELECT a, b, y, count(*) AS n FROM prs GROUP BY ALL) r ON l.a = r.a AND l.b = r.b AND x = y GROUP BY ALL),
k AS (SELECT a, b, n, CASE WHEN coalesce(e, 0) < n * n THEN (po - coalesce(e, 0) / CAST(n * n AS DOUBLE)) / (1 - coalesce(e, 0) / CAST(n * n AS DOUBLE)) ELSE 1 END AS kappa FROM n LEFT JOIN e USING (a, b)) SELECT a, b, n, round(kappa, 6) AS kappa, CASE WHEN kappa < 0.2 THEN 'poor' WHEN kappa < 0.4 THEN 'fair' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'good' ELSE 'very good' END AS word FROM k"""
)
def a_nominal_kappa(spark: SparkSession, d: str) -> DataFrame:
    return _six(A.nominal_kappa(scores(spark, d)))


MAJORITY = "cnt AS (SELECT item, score, count(*) AS n FROM scores GROUP BY ALL), maj AS (SELECT item, CAST(sum(n) AS BIGINT) AS judges, arg_min(score, row(-n, score)) AS vote, max(n) AS votes, max(score) - min(score) AS amplitude FROM cnt GROUP BY 1)"


@query(f"WITH {SCORES}, {MAJORITY} SELECT item, judges, vote, votes, amplitude FROM maj")
def a_majority(spark: SparkSession, d: str) -> DataFrame:
    return A.majority(scores(spark, d))


@query(f"WITH {SCORES}, {MAJORITY} SELECT judges, count(*) AS items, round(avg(CASE WHEN votes >= 2 THEN 1.0 ELSE 0 END), 6) AS covered, round(avg(amplitude), 6) AS amplitude, round(1 - list_product(list_transform(range(0, judges), lambda i: greatest(0, 3 - i) / 3.0)), 6) AS chance FROM maj GROUP BY judges")
def a_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _six(A.coverage(scores(spark, d), 3))


@query(f"WITH {SCORES}, {MAJORITY} SELECT item, judges, amplitude FROM maj WHERE amplitude >= 2")
def a_strong_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return A.strong_disagreements(scores(spark, d))


@query("WITH c AS (SELECT lote, count(*) AS n FROM auditoria_perguntas WHERE lote IS NOT NULL GROUP BY 1), b AS (SELECT arg_min(lote, row(-n, lote)) AS lote FROM c) SELECT qid, avaliador, lote FROM auditoria_perguntas WHERE lote = (SELECT lote FROM b)")
def a_dominant(spark: SparkSession, d: str) -> DataFrame:
    return A.dominant(table(spark, d, "auditoria_perguntas").select("qid", "avaliador", "lote"), "lote")


@query(
    f"""WITH {SCORES}, p AS (SELECT item, list_sort(list(DISTINCT judge)) AS panel FROM scores GROUP BY 1), b AS (SELECT arg_min(panel, row(-n, panel)) AS best FROM (SELECT panel, count(*) AS n FROM p GROUP BY 1)),
h AS (SELECT item, best FROM p, b WHERE len(list_filter(best, lambda x: NOT list_contains(panel, x))) = 0) SELECT item, judge, score FROM scores JOIN h USING (item) WHERE list_contains(best, judge)"""
)
def a_dominant_panel(spark: SparkSession, d: str) -> DataFrame:
    return A.dominant_panel(scores(spark, d))


_FOLDED = unaccent_sql("lower(coalesce(r[3], ''))")


@query(
    f"""WITH r AS (SELECT n, max(row(carregado_em, question, answer)) AS r, any_value(evidencia) AS ev FROM perguntas_lote01 GROUP BY n), x AS (SELECT {' OR '.join(f"regexp_matches({_FOLDED}, '{p}')" for p in A.REFUSALS)} AS rf, n % 2 = 0 AS s FROM r)
SELECT count(*) FILTER (NOT s) AS unanswerable, count(*) FILTER (NOT s AND rf) AS right, round(count(*) FILTER (NOT s AND rf) / CAST(count(*) FILTER (NOT s) AS DOUBLE), 4) AS right_share, count(*) FILTER (s) AS answerable, count(*) FILTER (s AND rf) AS wrong, round(count(*) FILTER (s AND rf) / CAST(count(*) FILTER (s) AS DOUBLE), 4) AS wrong_share FROM x""".replace("AS right,", 'AS "right",')
)
def a_refusal_rates(spark: SparkSession, d: str) -> DataFrame:
    return A.refusal_rates(_replies(spark, d).select("answer", (F.col("n") % 2 == 0).alias("should_answer")))


@query(f"WITH {SCORES} SELECT split_part(judge, '_', 1) AS generator, CASE WHEN starts_with(item, 'f') THEN 'factual' ELSE 'lote' END AS scenario, 'enough' AS criterion, count(*) AS n, round(avg(score), 6) AS mean, round(avg(CASE WHEN score = 3 THEN 1.0 ELSE 0 END), 6) AS ok FROM scores GROUP BY ALL")
def a_quality_matrix(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).select(F.split_part("judge", F.lit("_"), F.lit(1)).alias("generator"), F.when(F.col("item").startswith("f"), "factual").otherwise("lote").alias("scenario"), F.lit("enough").alias("criterion"), "score")
    return _six(A.quality_matrix(s, 3))


@query(f"WITH {SCORES} SELECT item, max(score) FILTER (judge = 'anotador_2') AS anotador_2, max(score) FILTER (judge = 'anotador_4') AS anotador_4, max(score) FILTER (judge = 'especialista_1') AS especialista_1, round(avg(score), 2) AS mean FROM scores GROUP BY 1")
def a_wide_scores(spark: SparkSession, d: str) -> DataFrame:
    return A.wide_scores(scores(spark, d), ["anotador_2", "anotador_4", "especialista_1"])


@query(f"WITH {SCORES} SELECT item, judge, score FROM scores")
def a_complete_judge(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    return A.complete_judge(s.filter("judge <> 'anotador_2'"), s.filter("judge = 'anotador_2'"))


@query(
    f"""WITH {SCORES}, {MAJORITY}, h AS (SELECT item, vote, {draw_sql("'7'", 'item')} AS h FROM maj), t AS (SELECT item, vote FROM (SELECT *, row_number() OVER (PARTITION BY vote ORDER BY h, item) AS r FROM h) WHERE r <= 20), p AS (SELECT item, vote, row_number() OVER (ORDER BY {draw_sql("'7/show'", 'item')}, item) AS place FROM t) SELECT item, vote, place, CAST((place - 1) // 30 + 1 AS BIGINT) AS lot FROM p"""
)
def a_audit_sample(spark: SparkSession, d: str) -> DataFrame:
    return A.audit_sample(A.majority(scores(spark, d)).select("item", "vote"), "item", ["vote"], 20)


@query(f"""WITH {SCORES}, k AS (SELECT item, x, y, CASE WHEN x <> y THEN 0 WHEN x = 3 THEN 1 ELSE 2 END AS kind, {draw_sql("'7'", 'item')} AS h FROM prs WHERE a = 'anotador_2' AND b = 'anotador_4') SELECT item, x, y, kind FROM k ORDER BY kind, h, item LIMIT 25""")
def a_discordant_first(spark: SparkSession, d: str) -> DataFrame:
    p = A.pairs(scores(spark, d)).filter("a = 'anotador_2' AND b = 'anotador_4'")
    return A.discordant_first(p, 25)
