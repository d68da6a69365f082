"""Queries of the cleaning operators; pages are the chunks of a document's page, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import cleaning as C
from corpusloom.plans.registry import query
from corpusloom.plans.text_queries import CHUNKS, chunks, collapse_sql
from corpusloom.session import table

PAGES = f"""{CHUNKS},
pt AS (SELECT metadata.document_id AS document_id, CAST(metadata.page AS INT) AS page, string_agg(text, chr(10) ORDER BY metadata.chunk, id) AS text FROM chunks WHERE metadata.page IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
pages AS (SELECT *, list_filter(list_transform(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda x: {collapse_sql('x')}), lambda x: x <> '') AS lines FROM pt)"""


def form_sql(x: str) -> str:
    return f"""trim(lower({collapse_sql(x)}), ' -–—•·.:;|"')"""


def page_number_sql(x: str) -> str:
    return f"(regexp_matches({x}, '{C.PAGE_NUMBER}') OR (trim({x}, '-–— ') <> '' AND regexp_matches(trim({x}, '-–— '), '{C.ROMAN}')))"


def noise_sql(x: str) -> str:
    return f"({x} = '' OR {page_number_sql(x)} OR (length({x}) <= 2 AND NOT regexp_matches({x}, '^\\p{{L}}+$')) OR regexp_matches({x}, '{C.ONLY_RULES}'))"


def legal_sql(t: str, title: str) -> str:
    return f"regexp_matches(lower(coalesce({t}, '') || chr(10) || coalesce({title}, '')), '{'|'.join(C.LEGAL_TERMS)}')"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return C.pages_of(chunks(spark, d, "document_id", "page", "chunk"))


def _legal(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "pdf_chunks").select("metadata.document_id", C.is_legal(F.col("metadata.document_type"), F.col("metadata.title")).alias("legal"))
    return c.groupBy("document_id").agg(F.max("legal").alias("legal"))


LEGAL = f"legal AS (SELECT metadata.document_id AS document_id, bool_or({legal_sql('metadata.document_type', 'metadata.title')}) AS legal FROM pdf_chunks GROUP BY 1)"


@query(f"WITH {PAGES} SELECT document_id, page, len(lines) AS lines, len(list_filter(lines, lambda x: {noise_sql('x')})) AS noise, len(list_filter(lines, lambda x: {page_number_sql('x')})) AS numbers, len(list_filter(lines, lambda x: regexp_matches(x, '{C.CONTENTS_LINE}'))) AS toc FROM pages")
def c_noise_lines(spark: SparkSession, d: str) -> DataFrame:
    long = lambda c: F.size(c).cast("long")
    return _pages(spark, d).select("document_id", "page", long("lines").alias("lines"), long(F.filter("lines", C.is_noise)).alias("noise"), long(F.filter("lines", C.is_page_number)).alias("numbers"), long(F.filter("lines", lambda x: x.rlike(C.CONTENTS_LINE))).alias("toc"))


_MARGINS = f"""u AS (SELECT document_id, page, len(lines) AS n, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS spot FROM pages),
f AS (SELECT DISTINCT document_id, page, {form_sql('line')} AS form FROM u WHERE spot < 4 OR spot >= n - 4),
margins AS (SELECT document_id, form, count(*) AS pages FROM f JOIN (SELECT document_id, count(*) AS total FROM pages GROUP BY 1 HAVING count(*) >= 3) t USING (document_id)
WHERE length(form) BETWEEN 4 AND 180 GROUP BY document_id, form, total HAVING count(*) >= greatest(3, floor(total * 0.25)))"""


@query(f"WITH {PAGES}, {_MARGINS} SELECT * FROM margins")
def c_margin_lines(spark: SparkSession, d: str) -> DataFrame:
    return C.margin_lines(_pages(spark, d))


@query(
    f"""WITH {PAGES}, {_MARGINS}, m AS (SELECT u.*, margins.form IS NOT NULL AND (spot < 4 OR spot >= n - 4) AS margin, {noise_sql('line')} AS noise FROM u LEFT JOIN margins ON u.document_id = margins.document_id AND {form_sql('line')} = margins.form)
SELECT p.document_id, p.page, coalesce(string_agg(line, chr(10) ORDER BY spot) FILTER (NOT margin AND NOT noise), '') AS clean, count(*) FILTER (margin) AS margin_removed, count(*) FILTER (NOT margin AND noise) AS noise_removed
FROM pages p LEFT JOIN m USING (document_id, page) GROUP BY ALL"""
)
def c_clean_pages(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_pages(_pages(spark, d)).select("document_id", "page", F.array_join("clean", "\n").alias("clean"), F.col("margin_removed").cast("long").alias("margin_removed"), F.col("noise_removed").cast("long").alias("noise_removed"))


def _n(p: str) -> str:
    return f"len(list_filter(lines, lambda x: regexp_matches(x, '{p}')))"


def _h(p: str) -> str:
    return f"len(list_filter(heads, lambda x: regexp_matches(x, '{p}'))) > 0"


SIGNALS = f"""h AS (SELECT *, list_transform(lines[1:8], lambda x: regexp_replace({form_sql('x')}, '^[0-9]+ +([a-zà-ÿ])', '\\1')) AS heads FROM pages),
signals AS (SELECT document_id, page, lines, len(lines) AS n, coalesce(length(array_to_string(lines, ' ')), 0) AS chars, {_h(C.TOC_HEADS)} AS toc_head, {_h(C.SUBJECT_INDEX_HEADS)} AS subject_head, {_h(C.INDEX_HEADS)} AS index_head, {_h(C.LIST_HEADS)} AS list_head, {_h(C.THANKS_HEADS)} AS thanks_head, {_h(C.SUBSTANTIVE_HEADS)} AS substantive_head,
{_n(C.CONTENTS_LINE)} AS toc_lines, CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: length(x) <= 110)) / CAST(len(lines) AS DOUBLE) ELSE 0 END AS short_share, {_n(C.LOCATOR)} AS locators,
len(list_filter(lines, lambda x: regexp_matches(x, '^[A-ZÁÉÍÓÚÀÂÊÔÃÕÇ].{{2,90}}') AND regexp_matches(x, '{C.LOCATOR}'))) AS entries,
len(list_filter(lines, lambda x: regexp_matches(x, '{C.PROVISION}') AND regexp_matches(x, '{C.PRESCRIBES}'))) > 0 OR {_n(C.PROVISION)} >= 2 AS normative, {_n('^[^:]{2,70}: +.{25,}$')} >= 2 AS glossary,
len(list_filter(lines, lambda x: length(x) >= 100 AND regexp_matches(x, '[.!?]$'))) AS prose FROM h)"""


@query(f"WITH {PAGES}, {SIGNALS} SELECT document_id, page, chars, toc_head, subject_head, list_head, thanks_head, toc_lines, round(short_share, 6) AS short_share, locators, entries, normative, glossary, prose FROM signals")
def c_page_signals(spark: SparkSession, d: str) -> DataFrame:
    s = C.page_signals(_pages(spark, d))
    long = [F.col(c).cast("long").alias(c) for c in ("chars", "toc_lines", "locators", "entries", "prose")]
    return s.select("document_id", "page", "toc_head", "subject_head", "list_head", "thanks_head", F.round("short_share", 6).alias("short_share"), "normative", "glossary", *long)


_STATES = f"""{LEGAL}, s0 AS (SELECT signals.*, legal, locators >= 4 AND locators / CAST(n AS DOUBLE) >= 0.45 AND entries >= 2 AND short_share >= 0.65 AND prose = 0 AND NOT glossary AND NOT normative AND n > 0 AS loc, toc_lines >= 2 AND prose = 0 AS goes FROM signals JOIN legal USING (document_id)),
s1 AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page) AS k, CASE WHEN normative THEN 'normal' WHEN loc AND (subject_head OR index_head) THEN 'subject_index' WHEN toc_lines >= 2 AND (toc_head OR (index_head AND NOT subject_head)) THEN 'toc' END AS own,
CASE WHEN normative THEN NULL WHEN n = 0 THEN 'empty' WHEN (toc_head OR index_head) AND (toc_lines >= 2 OR chars < 2500) THEN 'toc_start' WHEN list_head THEN 'list' WHEN NOT legal AND thanks_head AND chars < 3500 THEN 'acknowledgements' END AS static FROM s0),
walk AS (SELECT document_id, page, k, coalesce(own, 'normal') AS state, CASE WHEN own IS NOT NULL AND own <> 'normal' THEN own || '_start' ELSE static END AS reason FROM s1 WHERE k = 1
UNION ALL SELECT s.document_id, s.page, s.k, CASE WHEN s.own IS NOT NULL THEN s.own WHEN w.state = 'toc' AND s.goes THEN 'toc' WHEN w.state = 'subject_index' AND s.loc THEN 'subject_index' ELSE 'normal' END,
CASE WHEN s.own IS NOT NULL AND s.own <> 'normal' THEN s.own || '_start' WHEN s.own IS NULL AND w.state = 'toc' AND s.goes THEN 'toc_continuation' WHEN s.own IS NULL AND w.state = 'subject_index' AND s.loc THEN 'subject_index_continuation' ELSE s.static END
FROM walk w JOIN s1 s ON s.document_id = w.document_id AND s.k = w.k + 1)"""


@query(f"WITH RECURSIVE {PAGES}, {SIGNALS}, {_STATES} SELECT document_id, page, state, reason FROM walk")
def c_classify_pages(spark: SparkSession, d: str) -> DataFrame:
    return C.classify_pages(C.page_signals(_pages(spark, d)).join(_legal(spark, d), "document_id"))


@query(
    f"""WITH {PAGES}, {SIGNALS}, {LEGAL}, late AS (SELECT s.*, row_number() OVER (PARTITION BY document_id ORDER BY page) - 1 AS nth, count(*) OVER (PARTITION BY document_id) AS total FROM signals s JOIN legal USING (document_id) WHERE NOT legal),
l AS (SELECT document_id, page, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_no FROM late WHERE nth >= floor(total * 0.55)),
hd AS (SELECT *, {form_sql('line')} AS form FROM l), st AS (SELECT document_id, min(row(page, line_no)) AS s FROM hd WHERE form IN ({', '.join(repr(x) for x in C.REFERENCE_HEADS)}) OR (length(form) <= 35 AND starts_with(form, 'references')) GROUP BY 1)
SELECT document_id, s[1] AS start_page, s[2] AS start_line FROM st"""
)
def c_references_start(spark: SparkSession, d: str) -> DataFrame:
    pages = C.page_signals(_pages(spark, d)).withColumn("reference_like", C.is_reference_page(F.col("lines"))).join(_legal(spark, d), "document_id")
    return C.references_span(pages).select("document_id", "start_page", F.col("start_line").cast("long").alias("start_line"))


def _m(p: str) -> str:
    return f"len(list_filter(real, lambda x: regexp_matches(x, '{p}')))"


@query(
    f"""WITH {PAGES}, r AS (SELECT document_id, page, list_filter(lines, lambda x: NOT {page_number_sql('x')}) AS real FROM pages),
e AS (SELECT document_id, page, {_m(C.ENTRY)} AS numbered, {_m(C.ADDRESS)} AS address, {_m(C.PUBLISHED)} AS published, len(list_filter(real, lambda x: regexp_matches(x, '{C.YEAR}') AND regexp_matches(x, '[,.(]'))) AS years FROM r)
SELECT document_id, page, (numbered >= 2 AND address = 0 AND years = 0) OR (numbered >= 2 AND (address >= 1 OR years >= 2)) OR (address >= 3 AND years >= 2) OR (published >= 3 AND years >= 2) AS reference_like FROM e"""
)
def c_reference_pages(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("document_id", "page", C.is_reference_page(F.col("lines")).alias("reference_like"))


@query()
def c_short_pages(spark: SparkSession, d: str) -> DataFrame:
    return C.noninformative_short_page(_pages(spark, d))


_AUDIT = f"""ct AS (SELECT metadata.document_id AS document_id, CAST(metadata.page AS INT) AS page, count(*) AS chunks FROM chunks WHERE length(trim(text)) > 0 AND metadata.page IS NOT NULL GROUP BY ALL),
ev AS (SELECT document_id, unnest(generate_series(1, greatest(max(page), 1))) AS page FROM pages GROUP BY 1),
audit AS (SELECT document_id, page, CASE WHEN p.text IS NULL THEN 'RAW_EMPTY' WHEN len(lines) = 0 THEN 'EMPTY_AFTER_CLEANING' WHEN reason IS NOT NULL THEN 'NONINFORMATIVE_REMOVED' WHEN coalesce(chunks, 0) = 0 THEN 'NO_CHUNKS' ELSE 'INDEXED' END AS status, coalesce(length(p.text), 0) AS raw_chars, coalesce(chunks, 0) AS chunks
FROM ev FULL JOIN pages p USING (document_id, page) LEFT JOIN walk USING (document_id, page) LEFT JOIN ct USING (document_id, page))"""


def _audit(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    counts = chunks(spark, d, "document_id", "page").filter("length(trim(text)) > 0 AND metadata.page IS NOT NULL").groupBy(F.col("metadata.document_id").alias("document_id"), F.col("metadata.page").cast("int").alias("page")).agg(F.count("*").alias("chunks"))
    return C.page_audit(pages, c_classify_pages(spark, d), counts)


@query(f"WITH RECURSIVE {PAGES}, {SIGNALS}, {_STATES}, {_AUDIT} SELECT document_id, CAST(page AS INT) AS page, status, raw_chars, chunks FROM audit")
def c_page_audit(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d).withColumn("raw_chars", F.col("raw_chars").cast("long"))


@query(f"WITH RECURSIVE {PAGES}, {SIGNALS}, {_STATES}, {_AUDIT} SELECT document_id, count(*) AS pages, count(*) FILTER (status = 'INDEXED') AS indexed, count(*) FILTER (status = 'RAW_EMPTY') AS raw_empty, count(*) FILTER (status = 'NONINFORMATIVE_REMOVED') AS removed FROM audit GROUP BY 1")
def c_audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d).groupBy("document_id").agg(F.count("*").alias("pages"), F.count_if(F.col("status") == "INDEXED").alias("indexed"), F.count_if(F.col("status") == "RAW_EMPTY").alias("raw_empty"), F.count_if(F.col("status") == "NONINFORMATIVE_REMOVED").alias("removed"))


# DuckDB's patterns have no look-around, which the rules need.
@query()
def c_apply_rules(spark: SparkSession, d: str) -> DataFrame:
    clean = C.apply_rules(F.col("text"))
    return chunks(spark, d).filter("text IS NOT NULL").select("id", clean.alias("clean"), (clean != F.col("text")).alias("changed"), F.regexp_count(clean, F.lit("TABELA")).cast("long").alias("left_marks"))


@query(
    f"""WITH {CHUNKS}, d AS (SELECT metadata.document_id AS document_id, id, text FROM chunks WHERE text IS NOT NULL),
a AS (SELECT id, list_transform(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: regexp_matches(x, '^[0-9]{{1,5}}$')), lambda x: CAST(x AS INT)) AS n, length(text) AS l FROM d)
SELECT id, len(n) AS numbers, len(n) >= 50 AND l / CAST(greatest(len(n), 1) AS DOUBLE) < 150 AND len(list_filter(list_zip(n[1:-2], n[2:]), lambda x: x[2] > x[1])) / CAST(greatest(len(n) - 1, 1) AS DOUBLE) > 0.75 AS line_numbers FROM a"""
)
def c_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).filter("text IS NOT NULL").select("id", F.size(C.loose_numbers(F.col("text"))).cast("long").alias("numbers"), C.has_line_numbers(F.col("text")).alias("line_numbers"))


@query(
    r"""WITH t AS (SELECT doc_id AS key, unnest(string_split_regex(text, '[ \t\r\n]+')) AS w, generate_subscripts(string_split_regex(text, '[ \t\r\n]+'), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
n AS (SELECT key, pos, CAST(w AS INT) AS number FROM t WHERE regexp_matches(w, '^[0-9]{1,5}$')), b AS (SELECT *, CASE WHEN number - lag(number) OVER (PARTITION BY key ORDER BY pos) BETWEEN 1 AND 15 THEN 0 ELSE 1 END AS br FROM n),
r AS (SELECT *, sum(br) OVER (PARTITION BY key ORDER BY pos) AS run FROM b), s AS (SELECT key, run, count(*) AS size, min(pos) AS first FROM r GROUP BY ALL HAVING count(*) >= 2),
best AS (SELECT key, min(row(-size, first, run)) AS x FROM s GROUP BY 1) SELECT r.key, r.pos, r.number FROM r JOIN best ON r.key = best.key AND r.run = best.x[3]"""
)
def c_number_chain(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("key"), F.posexplode(F.split("text", r"[ \t\r\n]+")).alias("pos", "w")).filter(F.col("w").rlike("^[0-9]{1,5}$"))
    return C.longest_chain(tokens.select("key", F.col("pos").cast("long").alias("pos"), F.col("w").cast("int").alias("number")), least=2)


@query(
    r"""WITH l AS (SELECT doc_id AS key, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT key, trim(regexp_extract(line, '^[ \t]*([^\n:]{6,120}):[ \t]', 1)) AS prefix FROM l),
c AS (SELECT key, prefix, count(*) AS n FROM p WHERE prefix <> '' GROUP BY ALL HAVING count(*) >= 3) SELECT key, min(prefix) AS caption FROM c GROUP BY key HAVING count(*) = 1"""
)
def c_captions(spark: SparkSession, d: str) -> DataFrame:
    return C.repeated_caption(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"))


_WORDS = "regexp_extract_all(text, '[A-Za-zÀ-ÿ]{2,}')"
_VERBS = ", ".join(f"'{v}'" for v in C.VERBS)


@query(
    f"""SELECT doc_id, regexp_matches(text, '{C.EDITORIAL}') AND len({_WORDS}) >= 10 AND len(list_filter({_WORDS}, lambda w: regexp_matches(w, '^[A-ZÀ-ÖØ-Þ]'))) / CAST(greatest(len({_WORDS}), 1) AS DOUBLE) > 0.45
AND len(list_filter({_WORDS}, lambda w: lower(w) IN ({_VERBS}))) / CAST(greatest(len({_WORDS}), 1) AS DOUBLE) < 0.04 AS editorial, len(list_filter({_WORDS}, lambda w: lower(w) IN ({_VERBS}))) AS verbs FROM documents WHERE text IS NOT NULL"""
)
def c_editorial(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]{2,}"), F.lit(0))
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", C.is_editorial(F.col("text")).alias("editorial"), F.size(F.filter(words, lambda w: F.lower(w).isin(C.VERBS))).cast("long").alias("verbs"))


@query(
    f"""WITH {CHUNKS}, p AS (SELECT metadata.document_id AS document_id, count(*) AS chunks, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars, count(*) FILTER (regexp_matches(text, '{C.DEONTIC}')) AS prescriptive,
CAST(sum(coalesce(len(regexp_extract_all(text, '(?:Art\\.|Artigo|Article|Artículo) *[0-9]+')), 0)) AS BIGINT) AS clauses, count(DISTINCT metadata.page) AS pages, CAST(max(metadata.page) AS BIGINT) AS last_page, count(*) FILTER (text IS NULL OR trim(text) = '') AS empty FROM chunks GROUP BY 1)
SELECT *, coalesce(last_page, 0) - pages AS gap, CASE WHEN empty > 0.05 * chunks THEN 'extract_again' WHEN coalesce(last_page, 0) - pages > 0 THEN 'missing_pages' WHEN prescriptive = 0 AND clauses = 0 THEN 'review' ELSE 'keep' END AS advice FROM p"""
)
def c_integrity(spark: SparkSession, d: str) -> DataFrame:
    return C.integrity(chunks(spark, d, "document_id", "page"))


@query(
    """WITH m AS (SELECT regexp_replace(trim(filename), '\\.pdf$', '') AS document_id FROM corpus_manifest), c AS (SELECT DISTINCT metadata.document_id AS document_id FROM pdf_chunks WHERE metadata.document_id IS NOT NULL)
SELECT document_id, 'registered_twice' AS finding FROM m GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT document_id, 'without_chunks' FROM m ANTI JOIN c USING (document_id) UNION ALL SELECT document_id, 'not_registered' FROM c ANTI JOIN m USING (document_id)"""
)
def c_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return C.reconcile(table(spark, d, "corpus_manifest"), table(spark, d, "pdf_chunks"))


@query(
    f"""WITH {CHUNKS}, v AS (SELECT id, list_filter([CASE WHEN id IS NULL OR trim(id) = '' THEN 'no_id' END, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty_text' END, CASE WHEN metadata.document_id IS NULL THEN 'no_document' END, CASE WHEN metadata.title IS NULL OR trim(metadata.title) = '' THEN 'no_title' END,
CASE WHEN metadata.source IS NULL THEN 'no_source' END, CASE WHEN upper(trim(metadata.source_type)) = 'PDF' AND metadata.page IS NULL THEN 'pdf_without_page' END, CASE WHEN metadata.chunk IS NULL THEN 'no_chunk_number' END], lambda x: x IS NOT NULL) AS p FROM chunks) SELECT id, unnest(p) AS problem FROM v"""
)
def c_violations(spark: SparkSession, d: str) -> DataFrame:
    return C.violations(chunks(spark, d))


@query()
def c_clean_corpus(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.functions.text import chunk_id

    c = chunks(spark, d, "document_id").filter("text IS NOT NULL").withColumn("clean", C.apply_rules(F.col("text")))
    return c.select("id", F.when(F.col("clean") == F.col("text"), F.col("id")).otherwise(chunk_id(F.col("metadata.document_id"), F.col("clean"))).alias("new_id"))
