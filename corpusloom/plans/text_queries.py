"""Queries of the text and address functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import urls as U
from corpusloom.plans.registry import query
from corpusloom.session import table

#: The same class of white space in the SQL.
WS = T.BLANK_CLASS


def collapse_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def unaccent_sql(c: str) -> str:
    return f"translate(regexp_replace({c}, '[\\x{{0300}}-\\x{{036f}}]', '', 'g'), '{T.MARKED}', '{T.PLAIN}')"


STOP = ", ".join(f"'{w}'" for w in sorted(set(T.STOP_PT + T.STOP_EN)))


def tokens_sql(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[a-zA-Zà-úÀ-Ú0-9]+'), lambda x: length(x) >= 2 AND x NOT IN ({STOP}))"


def count_sql(lang: str, c: str) -> str:
    return " + ".join(f"(length({c}) - length(replace({c}, ' {m} ', ''))) / {len(m) + 2}.0" for m in T.MARKERS[lang])


def chunks(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    """One row a chunk, with these fields of its metadata or all: deliveries of an id have one text."""
    rows = table(spark, d, "pdf_chunks")
    fields = fields or tuple(rows.schema["metadata"].dataType.names)
    one = rows.groupBy("id").agg(F.first("text").alias("text"), *[F.first(f"metadata.{f}").alias(f"m_{f}") for f in fields])
    return one.select("id", "text", F.struct(*[F.col(f"m_{f}").alias(f) for f in fields]).alias("metadata"))


CHUNKS = "chunks AS (SELECT id, any_value(text) AS text, arg_min(metadata, extraido_em) AS metadata FROM pdf_chunks GROUP BY id)"


@query(f"SELECT doc_id, {collapse_sql('text')} AS clean, coalesce({collapse_sql('text')}, '') AS identity FROM documents")
def t_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.collapse(F.col("text")).alias("clean"), T.identity_text(F.col("text")).alias("identity"))


@query(f"""SELECT filename, trim(lower({collapse_sql('title')}), ' -–—•·.:;|"') AS form FROM corpus_manifest""")
def t_match_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_manifest").select("filename", T.match_form(F.col("title")).alias("form"))


@query(f"SELECT doc_id, {collapse_sql(unaccent_sql('lower(replace(text, chr(173), chr(0)))').replace('chr(0)', repr('')))} AS folded FROM documents")
def t_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query(
    f"""WITH p AS (SELECT doc_id, {unaccent_sql('text')} AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(lower(t), '[a-z]{{5,}}'), regexp_extract_all(t, '[0-9][0-9.,]*')), list_transform(regexp_extract_all(t, '[A-Z]{{3,}}'), lambda x: lower(x))))), ' ') AS signals FROM p"""
)
def t_signals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.array_join(T.signals(F.col("text")), " ").alias("signals"))


@query(f"SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS tokens, len({tokens_sql('text')}) AS n FROM documents WHERE text IS NOT NULL")
def t_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.array_join(t, " ").alias("tokens"), F.size(t).cast("long").alias("n"))


@query(
    f"""WITH w AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS token FROM documents WHERE text IS NOT NULL)
SELECT token, CASE WHEN length(token) >= 6 THEN regexp_replace(regexp_replace(token, '(ções|coes)$', 'cao'), '(mente|idades|idade|amentos|amento|imentos|imento|ings|ing|ed|es|s)$', '') ELSE token END AS stem FROM w"""
)
def t_stems(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").filter("text IS NOT NULL").select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    return words.select("token", T.light_stem(F.col("token")).alias("stem"))


@query(
    f"""WITH p AS (SELECT doc_id, ' ' || lower(coalesce(text, '')) || ' ' AS t FROM documents)
SELECT doc_id, CASE WHEN {count_sql('en', 't')} > {count_sql('pt', 't')} THEN 'en' ELSE 'pt' END AS language FROM p"""
)
def t_detect_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.detect_language(F.col("text")).alias("language"))


@query(
    r"""WITH p AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '(?:Art\.|Article|Artigo)[ ]*([0-9]{1,4})', 1), lambda x: CAST(x AS INT))) AS a FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_filter(a, lambda x: list_contains(a, x + 1))) >= 8 AS articulated FROM p"""
)
def t_articulated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", T.is_articulated(F.col("text")).alias("articulated"))


@query(
    """SELECT filename, left(trim(split_part(author, ';', 1)), 40) AS issuer,
array_to_string(list_filter(list_transform(string_split(coalesce(ria_dimension, ''), ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS dimensions FROM corpus_manifest"""
)
def t_manifest_fields(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "corpus_manifest")
    return m.select("filename", T.issuer(F.col("author")).alias("issuer"), F.array_join(T.semicolon_list(F.col("ria_dimension")), "|").alias("dimensions"))


_LINES = f"list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r'), lambda x: {collapse_sql('x')}), lambda x: x <> '')"


@query(
    f"""SELECT doc_id, len({_LINES}) AS lines, trim(regexp_replace(regexp_replace(array_to_string({_LINES}, chr(10)), '([\\p{{L}}0-9_])-{WS}+([\\p{{L}}0-9_])', '\\1\\2', 'g'), '{WS}+', ' ', 'g')) AS joined FROM documents"""
)
def t_join_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = T.page_lines(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("lines"), T.join_lines(lines).alias("joined"))


_REPLIES = "SELECT n, max(row(carregado_em, question, answer)) AS r FROM perguntas_lote01 GROUP BY n"


def _replies(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "perguntas_lote01").groupBy("n").agg(F.max(F.struct("carregado_em", "question", "answer")).alias("r"))
    return last.select("n", F.col("r.question").alias("question"), F.col("r.answer").alias("answer"))


@query(
    rf"""WITH p AS (SELECT n, '<think>' || r[2] || chr(10) || '</think> ' || r[3] AS t FROM ({_REPLIES}))
SELECT n, trim(regexp_replace(t, '(?is)<think>.*?</think>', '', 'g')) AS reply FROM p"""
)
def t_strip_reasoning(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).select("n", T.strip_reasoning(F.concat(F.lit("<think>"), "question", F.lit("\n</think> "), "answer")).alias("reply"))


@query(
    f"""WITH p AS (SELECT n, CAST(to_json(struct_pack(q := r[2])) AS VARCHAR) AS j FROM ({_REPLIES}) WHERE r[2] IS NOT NULL)
SELECT n, j AS json FROM p"""
)
def t_extract_json(spark: SparkSession, d: str) -> DataFrame:
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct(F.col("question").alias("q"))), F.lit("\n``` Done"))
    return _replies(spark, d).filter("question IS NOT NULL").select("n", T.extract_json(reply).alias("json"))


@query(
    f"""WITH p AS (SELECT n, r[3] AS a, trim(r[3]) AS t FROM ({_REPLIES}))
SELECT n, CASE WHEN a IS NULL OR t = '' THEN 'empty' WHEN contains(t, '<think>') THEN 'reasoning' WHEN regexp_matches(t, '(\\*\\*|[-*#|:])$') THEN 'stub'
WHEN regexp_matches(t, '[.!?)]$') OR regexp_matches(t, 'https?://[^ ]+$') OR regexp_matches(t, '["}}\\]]$') THEN 'ok' ELSE 'cut' END AS state FROM p"""
)
def t_answer_state(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).select("n", T.answer_state(F.col("answer")).alias("state"))


_HEAD = "concat_ws(' · ', nullif(trim(coalesce(metadata.title, '')), ''), nullif(trim(coalesce(metadata.author, '')), ''), nullif(trim(coalesce(metadata.section_path, '')), ''))"


@query(
    f"""WITH {CHUNKS}, h AS (SELECT id, text, {_HEAD} AS head FROM chunks), e AS (SELECT id, CASE WHEN head = '' THEN coalesce(text, '') ELSE '[' || head || ']' || chr(10) || coalesce(text, '') END AS body FROM h)
SELECT id, body, sha256('v1' || chr(1) || body) AS fingerprint FROM e"""
)
def t_embedding_text(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "title", "author", "section_path")
    body = T.embedding_text(F.col("metadata.title"), F.col("metadata.author"), F.col("metadata.section_path"), F.col("text"))
    return c.select("id", body.alias("body")).select("id", "body", T.content_hash(F.concat(F.lit("v1\x01"), "body")).alias("fingerprint"))


@query(
    f"""WITH {CHUNKS}, r AS (SELECT left(sha256(id), 2) AS bucket, id, sha256(length(id) || ':' || id || coalesce(text, '')) AS h FROM chunks),
b AS (SELECT bucket, sha256(string_agg(h, '' ORDER BY id)) AS h FROM r GROUP BY bucket)
SELECT sha256(string_agg(h, '' ORDER BY bucket)) AS fingerprint, count(*) AS buckets FROM b"""
)
def t_corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators.identity import corpus_fingerprint

    return corpus_fingerprint(chunks(spark, d), digits=2)


@query(
    f"""WITH {CHUNKS} SELECT id, metadata.document_id || '_' || left(sha256(coalesce({collapse_sql('text')}, '')), 12) AS made,
coalesce(nullif(regexp_extract(id, '^(.+)_[0-9a-f]{{12}}(?:-[0-9]+)?$', 1), ''), nullif(regexp_extract(id, '^(.+)_p[0-9]+_c[0-9]+$', 1), ''), nullif(regexp_extract(id, '^(.+)_c[0-9]+$', 1), ''), id) AS document FROM chunks"""
)
def t_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "document_id").select("id", T.chunk_id(F.col("metadata.document_id"), F.col("text")).alias("made"), T.document_of(F.col("id")).alias("document"))


@query(
    f"""WITH {CHUNKS}, c AS (SELECT metadata.document_id AS doc, id, left(sha256(coalesce({collapse_sql('text')}, '')), 12) AS h FROM chunks),
s AS (SELECT *, row_number() OVER (PARTITION BY doc, h ORDER BY id) AS k FROM c)
SELECT id, doc || '_' || h || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS new_id FROM s"""
)
def t_unique_ids(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators.identity import unique_chunk_ids

    return unique_chunk_ids(chunks(spark, d, "document_id").select("id", "text", F.col("metadata.document_id").alias("document_id")))


@query(
    """SELECT filename, regexp_replace(title, '[^a-zA-Z0-9_.-]+', '_', 'g') AS safe,
trim(regexp_replace(regexp_replace(regexp_replace(title, '[ \\t\\x{a0}]+', ' ', 'g'), ' ?\\r?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS paragraphs FROM corpus_manifest"""
)
def t_safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_manifest").select("filename", T.safe_name(F.col("title")).alias("safe"), T.keep_paragraphs(F.col("title")).alias("paragraphs"))


@query(
    """WITH p AS (SELECT DISTINCT metadata.document_id AS document_id, metadata.page AS page FROM pdf_chunks WHERE metadata.page IS NOT NULL),
g AS (SELECT *, page - row_number() OVER (PARTITION BY document_id ORDER BY page) AS island FROM p),
r AS (SELECT document_id, min(page) AS a, max(page) AS b FROM g GROUP BY document_id, island)
SELECT document_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM r GROUP BY document_id"""
)
def t_page_ranges(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators.identity import page_ranges

    return page_ranges(table(spark, d, "pdf_chunks").select("metadata.document_id", "metadata.page"))


@query(
    f"""WITH {CHUNKS} SELECT id, CASE WHEN upper(trim(metadata.source_type)) = 'HTML' THEN 'web page ' || coalesce(metadata.source_url, 'without address')
WHEN metadata.page IS NOT NULL THEN 'page ' || CAST(metadata.page AS BIGINT) ELSE 'unknown place' END AS place FROM chunks"""
)
def t_location(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "source_type", "page", "source_url").select("id", T.location(F.col("metadata.source_type"), F.col("metadata.page"), F.col("metadata.source_url")).alias("place"))


@query(
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 5) AS square, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS first FROM embeddings"""
)
def t_unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), 5).alias("square"), F.round(T.unit_vector(F.col("embedding"))[0], 6).alias("first"))


_SCHEME = "lower(regexp_extract(trim({u}), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
_HOST = "lower(regexp_extract(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH = "regexp_extract(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_NORMAL = f"CASE WHEN {_SCHEME} <> '' AND {_HOST} <> '' THEN {_SCHEME} || '://' || {_HOST} || coalesce(nullif(regexp_replace({_PATH}, '/+$', ''), ''), '/') || regexp_extract(trim({{u}}), '^[^?#]*(\\?[^#]*)', 1) END"


@query(f"SELECT doc_id, {_NORMAL.format(u='url')} AS normal, {_HOST.format(u='url')} AS domain FROM documents WHERE url IS NOT NULL")
def u_normalize(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("url IS NOT NULL")
    return docs.select("doc_id", U.normalize_url(F.col("url")).alias("normal"), U.host(F.col("url")).alias("domain"))


@query(
    f"""SELECT doc_id, {_SCHEME.format(u='url')} || '://' || {_HOST.format(u='url')} || coalesce(nullif(regexp_replace({_PATH.format(u='url')}, '[^/]*$', ''), ''), '/') || 'anexo.pdf' AS relative,
{_SCHEME.format(u='url')} || '://' || {_HOST.format(u='url')} || '/raiz?q=1' AS rooted, url || '#!/parte' AS kept, TRUE AS is_file, TRUE AS same FROM documents WHERE url IS NOT NULL"""
)
def u_links(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("url IS NOT NULL")
    u = F.col("url")
    relative = U.resolve_link(u, F.lit("./anexo.pdf#p2"))
    return docs.select(
        "doc_id",
        relative.alias("relative"),
        U.resolve_link(u, F.lit("/raiz?q=1#fim")).alias("rooted"),
        U.resolve_link(u, F.lit("#!/parte")).alias("kept"),
        U.is_file(relative).alias("is_file"),
        U.same_domain(u, relative).alias("same"),
    )
