"""Queries of the training-data operators: name -> (spark, directory) -> DataFrame, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.allocation import allocation_report, draw_sample, latest
from corpusloom.llm.consensus import Consensus, agreement, judgments
from corpusloom.llm.language import label_documents, label_segments, latest_passages, train_on, wrong_labels
from corpusloom.llm.leakage import find_leaks
from corpusloom.llm.pairs import defective_pairs, prepare
from corpusloom.llm.pairs import train_on as train_pairs
from corpusloom.llm.splitting import oversized_items, split_oversized
from corpusloom.llm.tokenize import encode_corpus
from corpusloom.llm.truncation import length_hazards, lengths_of, truncated_texts, truncation_by_source
from corpusloom.session import cut_lineage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "perguntas_factuais"), "n", "carregado_em", ["question_type", "difficulty"])


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return allocation_report(_pool(spark, d), table(spark, d, "metas_amostra")).filter("shortfall > 0").select("question_type", "difficulty")


@query
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return allocation_report(_pool(spark, d), table(spark, d, "metas_amostra"))


@query
def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return draw_sample(_pool(spark, d), table(spark, d, "metas_amostra"), "n")


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    # Used twice, to learn from and to judge: kept in the shared folder.
    prepared = cut_lineage(prepare(table(spark, d, "perguntas_lote01"), "n", "question", "answer", "carregado_em"))
    return defective_pairs(prepared, train_pairs(prepared)).selectExpr("key AS n", "defect")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return judgments(table(spark, d, "auditoria_perguntas"), "qid", "avaliador", "juiz_suficiente_s_parcial_n", "julgado_em", "recebido_em")


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return Consensus(_judged(spark, d)).labels().selectExpr("item AS qid", "label AS rotulo")


@query
def p3_annotators(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(Consensus(_judged(spark, d)).reliability(), "avaliador string, reliability double")


@query
def p3_agreement(spark: SparkSession, d: str) -> DataFrame:
    return agreement(_judged(spark, d)).selectExpr("items", "judgments", "round(observed, 9) AS observed", "round(expected, 9) AS expected", "round(alpha, 9) AS alpha")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "perguntas_factuais")
    passages = latest_passages(rows, "n", "passagem_texto", "source_lang", "carregado_em")
    # Any delivery will do to learn from; only the labelling needs the latest.
    return label_segments(passages, train_on(rows.select(F.col("passagem_texto").alias("text"), F.col("source_lang").alias("label"))))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return wrong_labels(label_documents(_segments(spark, d))).selectExpr("key AS n", "lang")


@query
def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select(F.col("key").alias("n"), "segment", "start", "stop", "lang", "confidence")


@query
def p4_documents(spark: SparkSession, d: str) -> DataFrame:
    return label_documents(_segments(spark, d)).select(F.col("key").alias("n"), "lang", "confidence")


def _cut(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    chunks = split_oversized(table(spark, d, "pdf_chunks"), "id", "text", "pdf_chunks", "extraido_em", with_text=with_text)
    return chunks.union(split_oversized(table(spark, d, "perguntas_lote01"), "n", "passagem_texto", "perguntas_lote01", "carregado_em", with_text=with_text))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return oversized_items(_cut(spark, d, with_text=False))


@query
def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d, with_text=True)


@query
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "itens_avaliacao"))


@query
def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each leaked item stands in."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated_texts(table(spark, d, "documents")).select("doc_id")


@query
def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation_by_source(table(spark, d, "documents"))


@query
def p8_hazards(spark: SparkSession, d: str) -> DataFrame:
    h = length_hazards(lengths_of(table(spark, d, "documents")))
    return h.select("source", "unit", F.col("length").cast("long").alias("length"), "texts", "at_risk", F.round("hazard", 6).alias("hazard"), F.round("near_hazard", 6).alias("near_hazard"), "significant")


_LAST = "SELECT '{table}' AS item_table, CAST({key} AS VARCHAR) AS item_key FROM (SELECT {key}, {text} AS t, row_number() OVER (PARTITION BY {key} ORDER BY {time} DESC NULLS LAST, length({text}) > 1200 DESC NULLS LAST) AS k FROM {table} WHERE {key} IS NOT NULL) WHERE k = 1 AND length(t) > 1200"
SQL["p5_found"] = f"""
{_LAST.format(table="pdf_chunks", key="id", text="text", time="extraido_em")}
UNION ALL {_LAST.format(table="perguntas_lote01", key="n", text="passagem_texto", time="carregado_em")}"""

_FOLD = r"regexp_replace(lower({}), '[\s\x{{0085}}\x{{00a0}}\x{{00ad}}\x{{2000}}-\x{{200f}}\x{{2010}}-\x{{2015}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{2060}}\x{{2212}}\x{{3000}}\x{{feff}}_-]+', '', 'g')"
SQL["p1_found"] = f"""
WITH last AS (SELECT n, max(row(carregado_em, question_type, difficulty)) AS r FROM perguntas_factuais WHERE n IS NOT NULL GROUP BY n),
counted AS (SELECT {_FOLD.format("r[2]")} AS t, {_FOLD.format("r[3]")} AS f, count(*) AS c FROM last GROUP BY ALL)
SELECT m.question_type, m.difficulty FROM metas_amostra m
LEFT JOIN counted ON t = {_FOLD.format("m.question_type")} AND f = {_FOLD.format("m.difficulty")}
WHERE coalesce(c, 0) < greatest(min_rows, target_share * sample_size)"""
_CLASS = "CASE WHEN l IN ('s','sim','si','yes','suficiente') THEN 'S' WHEN l IN ('parcial','parcialmente','parc','p','partial') THEN 'PARCIAL' WHEN l IN ('n','nao','no','insuficiente') THEN 'N' END"
SQL["p3_agreement"] = f"""
WITH read AS (SELECT qid, avaliador, julgado_em, recebido_em, regexp_replace(translate(lower(juiz_suficiente_s_parcial_n), 'áàâãäéêíóôõúüç', 'aaaaaeeiooouuc'), '[^a-z]+', '', 'g') AS l FROM auditoria_perguntas),
valid AS (SELECT *, {_CLASS} AS label FROM read WHERE qid IS NOT NULL AND avaliador IS NOT NULL AND {_CLASS} IS NOT NULL),
one AS (SELECT qid, avaliador, label FROM (SELECT *, row_number() OVER (PARTITION BY qid, avaliador ORDER BY julgado_em DESC NULLS LAST, recebido_em DESC NULLS LAST, label DESC) AS k FROM valid) WHERE k = 1),
sizes AS (SELECT qid, label, count(*) AS n FROM one GROUP BY ALL),
items AS (SELECT qid, sum(n) AS m, sum(n * n) AS sq FROM sizes GROUP BY qid HAVING sum(n) >= 2),
obs AS (SELECT count(*) AS items, sum(m) AS judgments, sum((m * m - sq) / CAST(m - 1 AS DOUBLE)) AS apart FROM items),
sh AS (SELECT sum(n) AS total, sum(n * n) AS squares FROM (SELECT label, sum(n) AS n FROM sizes JOIN items USING (qid) GROUP BY label)),
r AS (SELECT items, CAST(judgments AS BIGINT) AS judgments, apart / judgments AS observed, (total * total - squares) / CAST(total * (total - 1) AS DOUBLE) AS expected FROM obs, sh)
SELECT items, judgments, round(observed, 9) AS observed, round(expected, 9) AS expected, round(1 - observed / expected, 9) AS alpha FROM r"""

_WORDS = r"regexp_extract_all(regexp_replace(regexp_replace(lower(strip_accents(text)), '([\p{L}\p{N}_])[-\x{2010}\x{2011}\x{ad}\x{ac}][ \t\x{200b}]*(?:\r\n?|\n)\s*([\p{L}\p{N}_])', '\1\2', 'g'), '[\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}\x{300}-\x{36f}]', '', 'g'), '[\p{L}\p{N}]+')"
_GRAMS = "SELECT {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS gram FROM (SELECT {key}, {words} AS w FROM {table} WHERE text IS NOT NULL)"
SQL["p7_found"] = f"""
WITH docs AS ({_GRAMS.format(key="doc_id", words=_WORDS, table="documents")}), items AS ({_GRAMS.format(key="item_id", words=_WORDS, table="itens_avaliacao")})
SELECT DISTINCT doc_id, item_id FROM docs JOIN items USING (gram)"""
SQL["p7_items"] = f"SELECT item_id, count(*) AS documents FROM ({SQL['p7_found']}) GROUP BY item_id"
SQL["p8_hazards"] = """
WITH l AS (SELECT source, 'chars' AS unit, length(text) AS length FROM documents WHERE length(text) > 0 UNION ALL SELECT source, 'bytes', strlen(text) FROM documents WHERE length(text) > 0),
c AS (SELECT source, unit, length, count(*) AS texts FROM l GROUP BY ALL),
r AS (SELECT *, sum(texts) OVER (PARTITION BY source, unit ORDER BY length DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_risk,
sum(texts) OVER (PARTITION BY source, unit ORDER BY length RANGE BETWEEN 150 PRECEDING AND 150 FOLLOWING) - sum(texts) OVER (PARTITION BY source, unit ORDER BY length RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS near FROM c),
e AS (SELECT *, (near + 1) / CAST(greatest(least(length, 150) + 151 - 25, 1) AS DOUBLE) AS expected FROM r),
t AS (SELECT *, CASE WHEN texts > expected THEN exp(texts - expected - texts * ln(texts / expected)) ELSE 1.0 END AS p FROM e),
k AS (SELECT *, p * count(*) OVER (PARTITION BY source, unit) / (count(*) OVER (PARTITION BY source, unit) - row_number() OVER (PARTITION BY source, unit ORDER BY p DESC, length) + 1) AS raw, row_number() OVER (PARTITION BY source, unit ORDER BY p DESC, length) AS place FROM t),
f AS (SELECT *, min(raw) OVER (PARTITION BY source, unit ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM k)
SELECT source, unit, length, texts, CAST(at_risk AS BIGINT) AS at_risk, round(texts / CAST(at_risk AS DOUBLE), 6) AS hazard, round(expected / at_risk, 6) AS near_hazard, q <= 0.01 AND texts >= 3 AS significant FROM f"""
