"""Queries of the chunkers and of lexical search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking as G
from corpusloom.operators import lexical as L
from corpusloom.plans.registry import query
from corpusloom.plans.text_queries import CHUNKS, chunks, collapse_sql, tokens_sql
from corpusloom.session import table

_BASE = f"base AS (SELECT doc_id, {collapse_sql('text')} AS t FROM documents WHERE text IS NOT NULL AND {collapse_sql('text')} <> '')"
_CUT = """CASE WHEN spot + 1200 >= length(t) THEN length(t) WHEN regexp_extract(substr(t, low + 1, spot + 1200 - low), '(?s)^(.*[.;:?!]) ', 1) <> '' THEN low + length(regexp_extract(substr(t, low + 1, spot + 1200 - low), '(?s)^(.*[.;:?!]) ', 1))
WHEN contains(substr(t, low + 1, spot + 1200 - low), ' ') THEN low + length(regexp_extract(substr(t, low + 1, spot + 1200 - low), '(?s)^(.*) ', 1)) ELSE spot + 1200 END"""
_SPANS = f"""{_BASE}, walk AS (SELECT doc_id, t, 0 AS k, 0 AS spot, 1000 AS low FROM base
UNION ALL SELECT doc_id, t, k + 1, least(greatest(stop - 200, spot + 800), stop), greatest(least(greatest(stop - 200, spot + 800), stop) + 300, least(greatest(stop - 200, spot + 800), stop) + 1000) FROM (SELECT *, {_CUT} AS stop FROM walk) WHERE stop < length(t)),
spans AS (SELECT doc_id, t, k, spot AS start, {_CUT} AS stop FROM walk)"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.collapse(F.col("text")).alias("t")).filter("t <> ''")


@query(f"WITH RECURSIVE {_SPANS} SELECT doc_id, k, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM spans")
def g_sliding_spans(spark: SparkSession, d: str) -> DataFrame:
    e = _texts(spark, d).select("doc_id", F.posexplode(G.sliding_spans(F.col("t"))).alias("k", "s"))
    return e.select("doc_id", "k", F.col("s.start").cast("long").alias("start"), F.col("s.stop").cast("long").alias("stop"))


_PARTS = f"""{_SPANS}, p AS (SELECT doc_id, k, trim(substr(t, start + 1, stop - start)) AS part, max(k) OVER (PARTITION BY doc_id) AS last FROM spans),
j AS (SELECT *, last > 0 AND k = last AND length(part) < 300 AS small, lead(part) OVER (PARTITION BY doc_id ORDER BY k) AS nxt, k = last - 1 AS before FROM p),
ch AS (SELECT doc_id, k, CASE WHEN before AND length(nxt) < 300 THEN trim(part || ' ' || nxt) ELSE part END AS chunk FROM j WHERE NOT small)"""


@query(f"WITH RECURSIVE {_PARTS} SELECT doc_id, k, chunk, length(chunk) AS chars FROM ch")
def g_sliding_chunks(spark: SparkSession, d: str) -> DataFrame:
    e = _texts(spark, d).select("doc_id", F.posexplode(G.sliding_chunks(F.col("t"))).alias("k", "chunk"))
    return e.select("doc_id", "k", "chunk", F.length("chunk").cast("long").alias("chars"))


@query(f"WITH RECURSIVE {_PARTS}, c AS (SELECT source, length(chunk) AS chars FROM ch JOIN documents USING (doc_id)) SELECT source, count(*) AS chunks, median(chars) AS median, round(avg(chars), 6) AS mean, min(chars) AS least, max(chars) AS most, count(*) FILTER (chars < 300) AS under_300, count(*) FILTER (chars > 2500) AS over_2500 FROM c GROUP BY 1")
def g_size_statistics(spark: SparkSession, d: str) -> DataFrame:
    c = g_sliding_chunks(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return G.size_statistics(c, "source").withColumn("mean", F.round("mean", 6))


_SEP_WIN = "substr(t, spot + 501, 500)"
_SEP_CUT = "CASE WHEN spot + 1000 >= length(t) THEN length(t) " + " ".join(f"WHEN contains({_SEP_WIN}, {s}) THEN spot + 500 + length(regexp_extract({_SEP_WIN}, '(?s)^(.*{r})', 1))" for s, r in (("chr(10) || chr(10)", "\\n\\n"), ("chr(10)", "\\n"), ("'. '", "\\. "), ("'; '", "; "), ("', '", ", "), ("' '", " "))) + " ELSE spot + 1000 END"
_RAW = "base AS (SELECT doc_id, text AS t FROM documents WHERE length(text) > 0)"
_SEP = f"""{_RAW}, walk AS (SELECT doc_id, t, 0 AS k, 0 AS spot FROM base UNION ALL SELECT doc_id, t, k + 1, greatest(stop - 200, spot + 1) FROM (SELECT *, {_SEP_CUT} AS stop FROM walk) WHERE stop < length(t)),
spans AS (SELECT doc_id, k, spot AS start, {_SEP_CUT} AS stop, t FROM walk)"""


@query(f"WITH RECURSIVE {_SEP} SELECT doc_id, k, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM spans")
def g_separator_spans(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("length(text) > 0")
    e = docs.select("doc_id", F.posexplode(G.separator_spans(F.col("text"))).alias("k", "s"))
    return e.select("doc_id", "k", F.col("s.start").cast("long").alias("start"), F.col("s.stop").cast("long").alias("stop"))


@query(
    f"""WITH {CHUNKS} SELECT metadata.document_id AS document_id, CAST(metadata.page AS INT) AS page, count(*) AS parts, sum(length(trim(text)))::BIGINT AS chars FROM chunks WHERE length(trim(text)) > 0 AND metadata.page IS NOT NULL GROUP BY ALL"""
)
def g_page_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "document_id", "page").filter("length(trim(text)) > 0 AND metadata.page IS NOT NULL")
    return c.groupBy(F.col("metadata.document_id").alias("document_id"), F.col("metadata.page").cast("int").alias("page")).agg(F.count("*").alias("parts"), F.sum(F.length(F.trim("text"))).alias("chars"))


_ART = r"(?m)^[ \t]*(?:Art\.|Artigo|Article|Artículo) *[0-9]+"


@query(
    rf"""WITH u AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '({_ART})', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS units FROM documents WHERE len(regexp_extract_all(text, '{_ART}')) >= 5)
SELECT doc_id, generate_subscripts(units, 1) - 1 AS k, unnest(units) AS unit FROM u"""
)
def g_legal_units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(G.legal_units(F.col("text"))).alias("k", "unit"))


@query(
    rf"""WITH u AS (SELECT doc_id, len(regexp_extract_all(text, '{_ART}')) AS markers, length(text) AS chars FROM documents WHERE text IS NOT NULL) SELECT doc_id, markers, CASE WHEN markers > 0 THEN round(chars / CAST(markers AS DOUBLE), 6) END AS chars_per_marker, markers >= 5 AS viable FROM u"""
)
def g_unit_viability(spark: SparkSession, d: str) -> DataFrame:
    m = F.regexp_count("text", F.lit(_ART))
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", m.cast("long").alias("markers"), F.when(m > 0, F.round(F.length("text") / m, 6)).alias("chars_per_marker"), (m >= 5).alias("viable"))


@query(
    rf"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n+'), lambda x: {collapse_sql('x')}), lambda x: x <> '') AS parts FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, parts, 0 AS k, CAST([] AS VARCHAR[]) AS done FROM p UNION ALL SELECT doc_id, parts, k + 1, CASE WHEN len(done) > 0 AND length(parts[k + 1]) < 300 THEN list_append(done[1:len(done) - 1], done[len(done)] || chr(10) || parts[k + 1]) ELSE list_append(done, parts[k + 1]) END FROM w WHERE k < len(parts))
SELECT doc_id, generate_subscripts(done, 1) - 1 AS k, unnest(done) AS part FROM w WHERE k = len(parts)"""
)
def g_merge_small(spark: SparkSession, d: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", "\n+"), T.collapse), lambda x: x != "")
    return table(spark, d, "documents").filter("length(text) > 0").select("doc_id", F.posexplode(G.merge_small(parts)).alias("k", "part"))


@query()
def g_parent_child(spark: SparkSession, d: str) -> DataFrame:
    return G.parent_child(table(spark, d, "documents"), "doc_id", "text")


@query(f"SELECT doc_id, {collapse_sql('text')} AS text FROM documents WHERE {collapse_sql('text')} <> ''")
def g_rejoin(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows joined again give the text back."""
    t = F.col("t")
    parts = F.transform(G.sliding_spans(t), lambda s: F.substring(t, s["start"] + 1, s["stop"] - s["start"]))
    return _texts(spark, d).select("doc_id", G.rejoin(parts, 21, 400).alias("text"))


@query()
def g_semantic(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select((F.col("vec_id") % 20).alias("key"), F.col("vec_id").alias("pos"), (F.col("vec_id") % 400 + 50).alias("chars"), F.col("embedding").alias("vector"))
    return G.semantic_breaks(v)


@query()
def g_neutral_windows(spark: SparkSession, d: str) -> DataFrame:
    return G.neutral_windows(table(spark, d, "documents"), "doc_id", "text")


_TOK = f"tok AS (SELECT doc_id AS id, {tokens_sql('text')} AS tokens FROM documents WHERE text IS NOT NULL)"
_QTOK = f"q AS (SELECT item_id AS qid, {tokens_sql('question')} AS tokens FROM itens_avaliacao WHERE question IS NOT NULL)"
_STATS = f"""{_TOK}, {_QTOK}, post AS (SELECT id, term, count(*) AS tf, any_value(len) AS length FROM (SELECT id, len(tokens) AS len, unnest(tokens) AS term FROM tok) GROUP BY id, term),
raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM tok) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY term),
stats AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_BM25 = f"""{_STATS}, qt AS (SELECT qid, unnest(list_distinct(tokens)) AS term FROM q),
sc AS (SELECT qid, id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / (SELECT avg(len(tokens)) FROM tok)))), 6) AS score FROM qt JOIN stats USING (term) JOIN post USING (term) GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc)"""


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("tokens"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "itens_avaliacao").filter("question IS NOT NULL").select(F.col("item_id").alias("qid"), T.tokens(F.col("question")).alias("tokens"))


@query(f"WITH {_STATS} SELECT term, df, round(idf, 6) AS idf FROM stats")
def r_term_statistics(spark: SparkSession, d: str) -> DataFrame:
    return L.term_statistics(_tokens(spark, d)).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_BM25} SELECT qid, id, score, rank FROM bm WHERE rank <= 10")
def r_bm25(spark: SparkSession, d: str) -> DataFrame:
    return L.bm25(_queries(spark, d), _tokens(spark, d))


@query(
    f"""WITH {_BM25}, c AS (SELECT qid, term, sum(tf) AS tf FROM bm JOIN post USING (id) WHERE rank <= 5 GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tf DESC, term) AS r FROM c)
SELECT qid, array_to_string(any_value(q.tokens), ' ') AS own, coalesce(string_agg(term, ' ' ORDER BY r), '') AS added FROM q LEFT JOIN (SELECT * FROM m WHERE r <= 10) x USING (qid) GROUP BY qid"""
)
def r_expand_query(spark: SparkSession, d: str) -> DataFrame:
    q, t = _queries(spark, d), _tokens(spark, d)
    more = L.expand_query(q, t, L.bm25(q, t, 5)).join(q.select("qid", F.col("tokens").alias("own")), "qid")
    return more.select("qid", F.array_join("own", " ").alias("own"), F.array_join(F.slice("tokens", F.size("own") + 1, F.size("tokens")), " ").alias("added"))


@query(f"WITH {_QTOK}, l AS (SELECT item_id AS qid, {tokens_sql('text')} AS other FROM itens_avaliacao) SELECT q.qid, list_sort(list_distinct(list_concat(tokens, other))) AS terms FROM q JOIN l USING (qid)")
def r_two_languages(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "itens_avaliacao").filter("question IS NOT NULL")
    return items.select(F.col("item_id").alias("qid"), F.array_sort(L.two_language_tokens(T.tokens(F.col("question")), T.tokens(F.col("text")))).alias("terms"))
