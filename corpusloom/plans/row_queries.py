"""Queries of guards, page texts, bibliographies and files that are written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import urls as U
from corpusloom.operators import agreement as A
from corpusloom.operators import cleaning as C
from corpusloom.operators import metrics as M
from corpusloom.plans.cleaning_queries import PAGES, _legal, _pages
from corpusloom.plans.ranking_queries import asking, vectors
from corpusloom.plans.registry import query
from corpusloom.plans.text_queries import CHUNKS, chunks, tokens_sql
from corpusloom.session import shared_folder, table
from corpusloom.sources import readers, sinks

CRITERIA = ["correctness", "completeness", "faithfulness", "hallucination", "relevance"]


@query("SELECT avaliador, count(*) AS rows, count(*) FILTER (lower(trim(avaliador)) = lower(trim(fazer))) AS own FROM auditoria_perguntas GROUP BY avaliador")
def a_same_model(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each judge would judge of its own making."""
    rows = table(spark, d, "auditoria_perguntas")
    return rows.groupBy("avaliador").agg(F.count("*").alias("rows"), F.count_if(A.same_model(F.col("avaliador"), F.col("fazer"))).alias("own"))


@query(
    f"""SELECT c AS criterion, count(*) AS rows, count(*) FILTER (CASE WHEN c IN ('correctness', 'completeness') THEN answer IS NOT NULL AND trim(answer) <> '' WHEN c IN ('faithfulness', 'hallucination') THEN passagem_texto IS NOT NULL AND trim(passagem_texto) <> '' ELSE TRUE END) AS applicable
FROM perguntas_lote01, (SELECT unnest({CRITERIA}) AS c) GROUP BY c"""
)
def a_applicable(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each criterion applies to: some need a reference, some a context."""
    rows = table(spark, d, "perguntas_lote01").select("answer", "passagem_texto", F.explode(F.array(*map(F.lit, CRITERIA))).alias("criterion"))
    ok = A.applies(F.col("criterion"), F.col("answer"), F.col("passagem_texto"))
    return rows.groupBy("criterion").agg(F.count("*").alias("rows"), F.count_if(ok).alias("applicable"))


@query(
    f"""WITH t AS (SELECT DISTINCT item_id AS id, unnest({tokens_sql('text')}) AS term FROM itens_avaliacao), f AS (SELECT term, count(DISTINCT id) AS df FROM t GROUP BY 1)
SELECT id, count(*) AS terms, round(avg(CASE WHEN df <= 3 THEN 1.0 ELSE 0.0 END), 6) AS rare FROM t JOIN f USING (term) GROUP BY id"""
)
def m_rare_share(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "itens_avaliacao").select(F.col("item_id").alias("id"), F.explode(T.tokens(F.col("text"))).alias("term"))
    return M.rare_share(terms).withColumn("rare", F.round("rare", 6))


@query(f"WITH {PAGES} SELECT document_id, page, text FROM pt")
def g_page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of one page each: the page's parts in order, one under the other."""
    return C.pages_of(chunks(spark, d, "document_id", "page", "chunk")).select("document_id", "page", "text")


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = C.page_signals(_pages(spark, d)).withColumn("reference_like", C.is_reference_page(F.col("lines"))).join(_legal(spark, d), "document_id")
    return pages, C.references_span(pages)


@query()
def c_references_span(spark: SparkSession, d: str) -> DataFrame:
    """Where the bibliography of each document begins and on which page it has ended."""
    return _spans(spark, d)[1]


@query()
def c_without_references(spark: SparkSession, d: str) -> DataFrame:
    """The pages of documents with a bibliography, without its lines."""
    pages, spans = _spans(spark, d)
    return C.cut_references(pages.select("document_id", "page", "lines"), spans)


@query("SELECT doc_id, CASE WHEN url IS NOT NULL THEN 'iso:std:iso:' || doc_id || ':ed-1' END AS name FROM documents")
def u_iso_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of standards in the fragments of addresses."""
    made = F.concat("url", F.lit("#iso:std:iso:"), F.col("doc_id").cast("string"), F.lit(":ed-1?x"))
    return table(spark, d, "documents").select("doc_id", U.iso_name(made).alias("name"))


@query("SELECT item_id AS qid FROM itens_avaliacao WHERE item_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0)")
def r_without_vector(spark: SparkSession, d: str) -> DataFrame:
    """Judged questions that no vector was worked out for."""
    return sinks.pending(table(spark, d, "itens_avaliacao").select(F.col("item_id").alias("qid")), asking(vectors(spark, d)), "qid")


@query(f"WITH {CHUNKS} SELECT id, text, metadata.document_id AS document_id FROM chunks")
def k_jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as lines of JSON and read again."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    sinks.write_jsonl(chunks(spark, d, "document_id").select("id", "text", F.col("metadata.document_id").alias("document_id")), path)
    return readers.read_jsonl(spark, path, "id string, text string, document_id string")


@query("SELECT filename, nullif(title, '') AS title, nullif(author, '') AS author, nullif(pub_year, '') AS pub_year FROM corpus_manifest")
def k_sheet_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The manifest written as a sheet and read again."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    sinks.write_sheet(table(spark, d, "corpus_manifest").select("filename", "title", "author", "pub_year"), path, ";")
    return readers.read_sheet(spark, path, ";")
