"""Queries of sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.plans.text_queries import _HOST, _NORMAL, CHUNKS, chunks
from corpusloom.sources import readers as S
from corpusloom.sources import sinks as K
from corpusloom.session import table


@query("SELECT trim(filename) AS filename, title, source_type FROM corpus_manifest WHERE upper(trim(source_type)) = 'PDF' AND trim(filename) <> ''")
def s_pdf_manifest(spark: SparkSession, d: str) -> DataFrame:
    return S.pdf_manifest(table(spark, d, "corpus_manifest"), unique=False).select("filename", "title", "source_type")


@query(f"SELECT filename, address FROM (SELECT filename, {_NORMAL.format(u='source_url')} AS address FROM corpus_manifest WHERE upper(trim(source_type)) = 'HTML') WHERE address IS NOT NULL")
def s_html_manifest(spark: SparkSession, d: str) -> DataFrame:
    return S.html_manifest(table(spark, d, "corpus_manifest"), unique=False).select("filename", "address")


@query("SELECT url, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source = 'portal_normas' DESC, doc_id) AS k FROM documents WHERE url IS NOT NULL AND source IS NOT NULL) WHERE k = 1")
def s_collected_pages(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").filter("url IS NOT NULL AND source IS NOT NULL").select("url", "doc_id", F.col("doc_id").alias("pos"), F.when(F.col("source") == "portal_normas", "raiz").otherwise("filho").alias("relation"))
    return S.collected_pages(r).select("url", "doc_id")


@query("SELECT n, row_number() OVER (ORDER BY n) > 0 AS kept, arg_max(question, row(carregado_em, question)) AS question FROM perguntas_factuais GROUP BY n")
def s_last_by_id(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "perguntas_factuais").withColumn("at", F.struct("carregado_em", "question"))
    return S.last_by_id(r, "n", "at").select("n", F.lit(True).alias("kept"), "question")


@query("SELECT trim(source_url) AS url, min(filename) AS pos FROM corpus_manifest WHERE lower(trim(source_type)) = 'html' AND trim(source_url) <> '' GROUP BY 1")
def s_seeds(spark: SparkSession, d: str) -> DataFrame:
    return S.seeds(table(spark, d, "corpus_manifest").select(F.col("source_url").alias("url"), "source_type", F.col("filename").alias("pos")))


@query(f"WITH {CHUNKS} SELECT upper(trim(metadata.source_type)) AS source_type, count(*) AS chunks, count(DISTINCT metadata.document_id) AS documents FROM chunks WHERE trim(text) <> '' GROUP BY 1")
def k_merge_corpora(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "document_id", "source_type", "page").filter("trim(text) <> ''")
    a, b = c.filter("metadata.page IS NULL"), c.filter("metadata.page IS NOT NULL")
    return K.corpus_counts(K.merge_corpora(a.withColumn("relation", F.lit("filho")), b))


@query(f"WITH {CHUNKS} SELECT id FROM chunks WHERE left(sha256(id), 1) >= '8'")
def k_pending(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).select("id")
    return K.pending(c, c.filter(F.left(F.sha2(F.col("id").cast("binary"), 256), F.lit(1)) < "8"))


@query(f"SELECT {_HOST.format(u='url')} AS domain, count(DISTINCT url) AS addresses FROM documents WHERE url IS NOT NULL GROUP BY 1")
def s_domains(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.functions.urls import host

    return table(spark, d, "documents").filter("url IS NOT NULL").groupBy(host(F.col("url")).alias("domain")).agg(F.count_distinct("url").alias("addresses"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def k_hourly_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).withColumn("start", F.col("start").cast(e.schema["ts"].dataType))


@query("SELECT n_name AS nation, o_orderpriority AS priority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, o_orderpriority)")
def k_rollup_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.rollup(F.col("n_name").alias("nation"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
