"""Queries of reports and of approximate search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.operators import ann as N
from corpusloom.operators import metrics as M
from corpusloom.operators import reports as P
from corpusloom.operators import ranking as R
from corpusloom.plans.gold_queries import QUESTIONS, fold_sql, questions
from corpusloom.plans.judging_queries import draw_sql
from corpusloom.plans.ranking_queries import LISTS, QRELS, _GROUPS, _six, asking, groups, lists, qrels, ranked, vectors
from corpusloom.plans.registry import query
from corpusloom.plans.text_queries import CHUNKS, chunks, unaccent_sql
from corpusloom.session import table


def cell_hits(spark: SparkSession, d: str) -> DataFrame:
    """The one search by cells that is registered, and whose recall is measured."""
    v = vectors(spark, d)
    return N.search_cells(asking(v), v, 10, probes=13)


@query()
def r_cell_search(spark: SparkSession, d: str) -> DataFrame:
    return cell_hits(spark, d)


@query()
def r_cell_recall(spark: SparkSession, d: str) -> DataFrame:
    """The share of the exact search's first ten that the registered search by cells finds."""
    return N.recall(cell_hits(spark, d), ranked(spark, d, k=10)).select(F.round("recall", 6).alias("recall"))


@query(f"WITH {LISTS} SELECT qid, string_agg('[' || rank || '] ' || 'vetor ' || id, chr(10) || chr(10) ORDER BY rank) AS context FROM ranked WHERE rank <= 5 GROUP BY qid")
def r_contexts(spark: SparkSession, d: str) -> DataFrame:
    texts = vectors(spark, d).select("id", F.concat(F.lit("vetor "), F.col("id").cast("string")).alias("text"))
    return P.contexts(ranked(spark, d), texts)


@query(f"WITH {LISTS} SELECT qid, string_agg('[' || rank || '] ' || coalesce(text, '') || chr(10) || coalesce(nullif(title, ''), '?') || coalesce(' — ' || nullif(url, ''), ''), chr(10) || chr(10) ORDER BY rank) AS context FROM ranked LEFT JOIN documents ON doc_id = id WHERE rank <= 5 GROUP BY qid")
def r_document_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of real texts: a vector stands for the document of its number."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "title", "url")
    return P.contexts(ranked(spark, d), texts)


@query(f"WITH {LISTS}, {QRELS}, {_GROUPS}, f AS (SELECT qid FROM ranked WHERE rank <= 5 GROUP BY 1 HAVING count(*) = 5), b AS (SELECT g.qid, group_no, min(rank) AS best FROM grp g JOIN f USING (qid) LEFT JOIN ranked r ON r.qid = g.qid AND r.id = g.id GROUP BY ALL) SELECT qid, count(*) AS required, count(*) FILTER (best <= 5) AS arrived, count(*) FILTER (best <= 5) = count(*) AS complete FROM b GROUP BY 1")
def r_context_coverage(spark: SparkSession, d: str) -> DataFrame:
    return P.context_coverage(ranked(spark, d), groups(spark, d))


@query(f"WITH {LISTS}, {QRELS}, g AS (SELECT r.qid, r.id, rank, coalesce(grade, 0) AS grade FROM ranked r LEFT JOIN qrels USING (qid, id) WHERE rank <= 3) SELECT qid, max(id) FILTER (rank = 1) AS id1, max(grade) FILTER (rank = 1) AS grade1, max(id) FILTER (rank = 2) AS id2, max(grade) FILTER (rank = 2) AS grade2, max(id) FILTER (rank = 3) AS id3, max(grade) FILTER (rank = 3) AS grade3 FROM g GROUP BY qid")
def r_wide_ranking(spark: SparkSession, d: str) -> DataFrame:
    return P.wide_ranking(ranked(spark, d), qrels(spark, d))


@query(f"""WITH {LISTS}, {QRELS}, o AS (SELECT system, qid, coalesce(grade, 0) AS grade, row_number() OVER (PARTITION BY system, qid ORDER BY rank > 20, CASE WHEN rank <= 20 THEN -coalesce(grade, 0) END, rank) AS rk FROM lists LEFT JOIN qrels USING (qid, id)),
c AS (SELECT system, qid, sum((pow(2, grade) - 1) / log2(rk + 1)) AS dcg FROM o WHERE rk <= 5 GROUP BY ALL), i AS (SELECT qid, sum((pow(2, grade) - 1) / log2(i + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, id) AS i FROM qrels) WHERE i <= 5 GROUP BY qid) SELECT system, qid, round(dcg / idcg, 6) AS ceiling FROM c JOIN i USING (qid)""")
def r_rerank_ceiling(spark: SparkSession, d: str) -> DataFrame:
    return _six(M.graded(P.ideal_order(lists(spark, d), qrels(spark, d), 20), qrels(spark, d)).select("system", "qid", F.col("ndcg").alias("ceiling")))


@query(f"""WITH {LISTS}, {QRELS}, s AS (SELECT r.qid, score, grade IS NOT NULL AS relevant, (r.id % 10) / 10.0 AS shared FROM ranked r LEFT JOIN qrels USING (qid, id)), l AS (SELECT qid, min(score) AS least FROM s WHERE relevant GROUP BY 1),
j AS (SELECT s.qid, shared FROM s JOIN l USING (qid) WHERE NOT relevant AND score >= least) SELECT CAST(t AS DOUBLE) AS share, count(*) FILTER (shared >= t) AS rows, count(DISTINCT qid) FILTER (shared >= t) AS queries FROM j, (SELECT unnest([0.3, 0.4, 0.5, 0.6]) AS t) GROUP BY t""")
def m_false_negatives(spark: SparkSession, d: str) -> DataFrame:
    s = ranked(spark, d).join(qrels(spark, d), ["qid", "id"], "left").select("qid", "score", F.col("grade").isNotNull().alias("relevant"), ((F.col("id") % 10) / 10.0).alias("shared"))
    return P.false_negatives(s, [0.3, 0.4, 0.5, 0.6])


_SIG = lambda c: f"list_distinct(list_concat(list_concat(regexp_extract_all(lower({unaccent_sql(c)}), '[a-z]{{5,}}'), regexp_extract_all({unaccent_sql(c)}, '[0-9][0-9.,]*')), list_transform(regexp_extract_all({unaccent_sql(c)}, '[A-Z]{{3,}}'), lambda x: lower(x))))"


@query(f"WITH {QUESTIONS} SELECT n, round(CASE WHEN len({_SIG('answer')}) > 0 THEN len(list_intersect({_SIG('answer')}, {_SIG('passagem_texto')})) / CAST(len({_SIG('answer')}) AS DOUBLE) ELSE 0 END, 6) AS shared FROM qs WHERE answer IS NOT NULL AND passagem_texto IS NOT NULL")
def m_signal_share(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d).filter("answer IS NOT NULL AND passagem_texto IS NOT NULL")
    return _six(q.select("n", P.signal_share(F.col("answer"), F.col("passagem_texto")).alias("shared")))


@query(f"WITH {QUESTIONS}, a AS (SELECT DISTINCT question AS alias, n AS document FROM (SELECT n, 'auditor externo' AS question FROM range(1) t(n) UNION ALL SELECT 1, 'ficha do paciente' UNION ALL SELECT 2, 'cópia de segurança')), h AS (SELECT qs.n, count(DISTINCT document) AS k FROM qs JOIN a ON contains({fold_sql('question')}, {fold_sql('alias')}) GROUP BY 1) SELECT qs.n AS qid, coalesce(k, 0) AS n, CASE WHEN coalesce(k, 0) >= 2 THEN 'both' WHEN k = 1 THEN 'one' ELSE 'none' END AS names FROM qs LEFT JOIN h USING (n)")
def m_names_documents(spark: SparkSession, d: str) -> DataFrame:
    aliases = spark.createDataFrame([(0, "auditor externo"), (1, "ficha do paciente"), (2, "cópia de segurança")], "document int, alias string")
    return P.names_documents(questions(spark, d).select(F.col("n").alias("qid"), "question"), aliases)


@query(f"WITH {QRELS} SELECT qid, CASE WHEN id % 2 = 0 THEN id + 100000 ELSE id END AS id, grade, id % 2 = 0 AS known FROM qrels")
def b_id_migration(spark: SparkSession, d: str) -> DataFrame:
    m = vectors(spark, d).filter("id % 2 = 0").select("id", (F.col("id") + 100000).alias("new_id"))
    return P.id_migration(qrels(spark, d), m)


@query(f"WITH {QRELS}, b AS (SELECT qid, arg_min(id, row(-grade, id)) AS id FROM qrels GROUP BY 1) SELECT qid, id FROM b ORDER BY qid LIMIT 5")
def b_examples(spark: SparkSession, d: str) -> DataFrame:
    return P.examples(qrels(spark, d), 5)


@query(f"WITH {QRELS} SELECT qid, id, {draw_sql(repr('9'), 'qid')} AS question_key, row_number() OVER (PARTITION BY qid ORDER BY {draw_sql(repr('9/ana'), 'qid', 'id')}, id) AS place FROM qrels")
def a_two_orders(spark: SparkSession, d: str) -> DataFrame:
    return P.two_orders(qrels(spark, d).select("qid", "id"), "id", "ana", "9")


@query(f"WITH i AS (SELECT vec_id AS id, vec_id % 7 = 0 AS anchor FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY {draw_sql(repr('7'), 'id')}, id) AS k FROM i) SELECT * FROM k WHERE k <= 10")
def a_pilot_sample(spark: SparkSession, d: str) -> DataFrame:
    return P.pilot_sample(vectors(spark, d).select("id", (F.col("id") % 7 == 0).alias("anchor")), "id", 20)


@query(f"""WITH {LISTS}, {QRELS}, {_GROUPS}, b AS (SELECT system, g.qid, group_no, min(rank) AS best FROM (SELECT DISTINCT system FROM lists) s CROSS JOIN grp g LEFT JOIN lists l USING (system, qid, id) GROUP BY ALL), w AS (SELECT system, qid, max(coalesce(best, 1000000000)) AS worst FROM b GROUP BY ALL),
o AS (SELECT system, qid, CASE WHEN worst <= 5 THEN 'hit' WHEN worst <= 100 THEN 'order' ELSE 'impossible' END AS outcome FROM w) SELECT a.outcome AS first, b.outcome AS second, count(*) AS n FROM o a JOIN o b USING (qid) WHERE a.system = 'full' AND b.system = 'half' GROUP BY ALL""")
def b_outcome_matrix(spark: SparkSession, d: str) -> DataFrame:
    g = groups(spark, d)
    return P.outcome_matrix(R.ceiling_split(ranked(spark, d), g), R.ceiling_split(ranked(spark, d, True), g))


@query("SELECT sha256(text) AS hash, any_value(text) AS text, count(*) AS rows FROM pdf_chunks WHERE text IS NOT NULL GROUP BY 1")
def b_distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    return P.distinct_texts(table(spark, d, "pdf_chunks"), "text")


@query()
def c_without_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    return P.without_line_numbers(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT url, 'blocked' AS reason FROM (SELECT DISTINCT url FROM documents WHERE url IS NOT NULL AND length(text) < 200) WHERE url NOT LIKE '%/en/%' UNION ALL SELECT DISTINCT url, 'old' FROM documents WHERE url LIKE '%/en/%'")
def h_requeue_blocked(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("url IS NOT NULL")
    errors = docs.filter("url LIKE '%/en/%'").select("url", F.lit("old").alias("reason")).distinct()
    return P.requeue_blocked(docs.filter("text IS NOT NULL"), H.is_empty_page(F.col("text")), errors)[1]


@query(f"WITH {CHUNKS} SELECT metadata.document_id AS document_id, count(*) AS chunks, count(DISTINCT metadata.section_path) AS sections, string_agg(DISTINCT metadata.theme, '|' ORDER BY metadata.theme) AS themes FROM chunks GROUP BY 1")
def k_document_summary(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "document_id", "section_path", "theme").groupBy("metadata.document_id").agg(F.count("*").alias("chunks"), F.count_distinct("metadata.section_path").alias("sections"), F.array_join(F.array_sort(F.collect_set("metadata.theme")), "|").alias("themes")).withColumn("themes", F.nullif("themes", F.lit("")))
