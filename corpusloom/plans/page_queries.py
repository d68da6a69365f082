"""Queries of HTML and structure operators; pages are made from the documents' titles, addresses and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import text as T
from corpusloom.operators import structure as X
from corpusloom.plans.registry import query
from corpusloom.plans.text_queries import CHUNKS, chunks, collapse_sql
from corpusloom.session import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a page with layout around its text."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(
        F.lit("<html><head><title>"), esc(F.col("title")), F.lit("</title><script>var a = 1;</script></head><body><nav>Menu <a href='/menu'>menu</a></nav><div class='cookie-bar'>Aceite</div><main><p>"), esc(F.col("text")),
        F.lit("</p><a href='./anexo.pdf#p2'>anexo</a><figure><img data-src='/f.png' alt='figura'><figcaption>Legenda</figcaption></figure></main><footer>Rodape</footer></body></html>"),
    )
    return table(spark, d, "documents").select("doc_id", "url", page.alias("html"))


_DOC = f"dx AS (SELECT doc_id, coalesce(nullif({collapse_sql('title')}, ''), '(sem título)') AS title, trim({collapse_sql('coalesce(text, chr(32))')} || ' anexo Legenda') AS text FROM documents)"


@query(f"WITH {_DOC} SELECT doc_id, title, text, 1 AS links, 'Legenda' AS caption FROM dx")
def h_read_pages(spark: SparkSession, d: str) -> DataFrame:
    r = H.read_pages(_pages(spark, d), "doc_id", "html")
    return r.select("doc_id", "title", "text", F.size("raw_links").alias("links"), F.col("figures")[0]["caption"].alias("caption"))


@query("SELECT doc_id, regexp_replace(regexp_extract(url, '^([^?#]*/)', 1), '^([A-Za-z]+)', '\\1') || 'anexo.pdf' AS links FROM documents WHERE url IS NOT NULL")
def h_links(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).filter("url IS NOT NULL")
    r = H.read_pages(p, "doc_id", "html").join(p.select("doc_id", "url"), "doc_id")
    return r.select("doc_id", F.array_join(H.links_of(F.col("url"), F.col("raw_links")), " ").alias("links"))


_ANY = lambda c, w: f"regexp_matches({c}, '{'|'.join(w)}')"


@query(f"SELECT doc_id, length(coalesce(text, '')) < 200 AS empty, {_ANY('lower(coalesce(title, chr(32)))', H.BLOCK_TITLES)} OR {_ANY('lower(coalesce(text, chr(32)))', H.BLOCK_TEXTS)} OR (length(coalesce(text, '')) < 400 AND {_ANY('lower(coalesce(text, chr(32)))', H.WAIT_WORDS)}) AS blocked FROM documents")
def h_blocked(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return table(spark, d, "documents").select("doc_id", H.is_empty_page(F.col("text")).alias("empty"), H.is_blocked(F.col("title"), F.col("text"), none).alias("blocked"))


_BLOCKS = f"""pg AS (SELECT url, lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS domain, max(text) AS text FROM documents WHERE url IS NOT NULL AND text IS NOT NULL GROUP BY url),
sn AS (SELECT DISTINCT domain, url, trim(b) AS block FROM (SELECT domain, url, unnest(string_split(regexp_replace(text, '([.!?;:])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1))) AS b FROM pg) WHERE length(trim(b)) >= 40),
nb AS (SELECT domain, block, count(*) AS pages FROM sn GROUP BY ALL HAVING count(*) >= 2), blocks AS (SELECT domain, block, pages, total, regexp_matches(block, '{H.LEGAL_MARKS}') AS legal, pages / CAST(total AS DOUBLE) AS share FROM nb JOIN (SELECT domain, count(*) AS total FROM pg GROUP BY 1) USING (domain))"""


def _collected(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("url IS NOT NULL AND text IS NOT NULL").groupBy("url").agg(F.max("text").alias("text"))


@query(f"WITH {_BLOCKS} SELECT domain, block, pages, round(share, 6) AS share, legal, NOT legal AND share >= 0.01 AS remove FROM blocks")
def h_repeated_blocks(spark: SparkSession, d: str) -> DataFrame:
    return H.repeated_blocks(_collected(spark, d), share=0.01).select("domain", "block", "pages", F.round("share", 6).alias("share"), "legal", "remove")


@query()
def h_remove_blocks(spark: SparkSession, d: str) -> DataFrame:
    p = _collected(spark, d)
    return H.remove_blocks(p, H.repeated_blocks(p, share=0.01))


@query("SELECT lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS domain, count(*) AS pages, count(DISTINCT document_type) AS kinds, max(n_chars)::BIGINT AS most FROM documents WHERE url IS NOT NULL GROUP BY 1")
def h_crawl_report(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.functions.urls import host

    docs = table(spark, d, "documents").filter("url IS NOT NULL")
    return docs.groupBy(host(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"), F.count_distinct("document_type").alias("kinds"), F.max("n_chars").cast("long").alias("most"))


_LINKS = "lk AS (SELECT DISTINCT 'http://h' || (o_custkey % 7) || '/' || o_custkey AS url, 'http://h' || (o_orderkey % 7) || '/' || (o_orderkey % 1500) AS target FROM orders)"


@query(
    f"""WITH RECURSIVE {_LINKS}, rt AS (SELECT 'http://h1/1' AS url UNION SELECT 'http://h2/2'), w AS (SELECT url, 0 AS depth FROM rt UNION SELECT target, depth + 1 FROM w JOIN lk USING (url) WHERE depth < 2), m AS (SELECT url, min(depth) AS depth FROM w GROUP BY 1),
p AS (SELECT m.url, m.depth, (SELECT min(lk.url) FROM lk JOIN m x ON x.url = lk.url WHERE lk.target = m.url AND x.depth = m.depth - 1) AS parent FROM m), q AS (SELECT *, row_number() OVER (PARTITION BY regexp_extract(url, '//([^/]*)', 1) ORDER BY depth, url) AS nth FROM p) SELECT url, depth, parent, nth FROM q WHERE nth <= 10 ORDER BY depth, url LIMIT 60"""
)
def h_crawl_order(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    at = lambda k, n: F.concat(F.lit("http://h"), (F.col(k) % 7).cast("string"), F.lit("/"), n.cast("string"))
    links = o.select(at("o_custkey", F.col("o_custkey")).alias("url"), at("o_orderkey", F.col("o_orderkey") % 1500).alias("target")).distinct()
    roots = spark.createDataFrame([("http://h1/1",), ("http://h2/2",)], "url string")
    return H.crawl_order(links, roots, quota=10, cap=60)


def _units(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r"), lambda x: T.collapse(x) != "")
    u = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.posexplode(lines).alias("pos", "text"))
    return u.select("key", F.col("pos").cast("long").alias("pos"), X.text_kind(F.col("text")).alias("kind"), "text")


_KIND = f"CASE WHEN regexp_matches({collapse_sql('text')}, '{X.ARTICLE}') THEN 'article' WHEN regexp_matches({collapse_sql('text')}, '{X.HEADING}') THEN 'heading' ELSE 'text' END"
_LEVEL = "CASE " + " ".join(f"WHEN regexp_matches(label, '{p}') THEN {n}" for n, p in X.LEVELS) + " ELSE 5 END"
_UNITS = f"u0 AS (SELECT doc_id AS key, list_filter(string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r'), lambda x: {collapse_sql('x')} <> '') AS l FROM documents), u1 AS (SELECT key, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS pos FROM u0), units AS (SELECT key, pos, text, {collapse_sql('text')} AS label, {_KIND} AS kind FROM u1)"


@query(f"WITH {_UNITS} SELECT key, pos, kind, {_LEVEL} AS level FROM units")
def x_text_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).select("key", "pos", "kind", X.heading_level(F.col("text")).alias("level"))


@query(
    f"""WITH RECURSIVE {_UNITS}, lv AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS k, {_LEVEL} AS level FROM units),
w AS (SELECT key, pos, k, CASE WHEN kind = 'heading' THEN [struct_pack(l := level, t := label)] ELSE [] END AS st, CASE WHEN kind = 'article' THEN regexp_extract(label, '{X.ARTICLE}') END AS art, kind FROM lv WHERE k = 1
UNION ALL SELECT n.key, n.pos, n.k, CASE WHEN n.kind = 'heading' THEN list_append(list_filter(w.st, lambda s: s.l < n.level), struct_pack(l := n.level, t := n.label)) ELSE w.st END, CASE WHEN n.kind = 'heading' THEN NULL WHEN n.kind = 'article' THEN regexp_extract(n.label, '{X.ARTICLE}') ELSE w.art END, n.kind FROM w JOIN lv n ON n.key = w.key AND n.k = w.k + 1)
SELECT key, pos, nullif(array_to_string(list_concat(list_transform(st, lambda s: s.t), CASE WHEN art IS NOT NULL THEN [art] ELSE [] END), ' > '), '') AS path FROM w"""
)
def x_section_paths(spark: SparkSession, d: str) -> DataFrame:
    return X.section_paths(_units(spark, d)).select("key", "pos", "path")


_ROWS = f"{CHUNKS}, tr AS (SELECT id, list_filter(list_transform(list_filter(string_split(regexp_replace(text, '\\[/?TABELA\\] ?', '', 'g'), chr(10)), lambda x: contains(x, '|')), lambda x: list_transform(string_split(x, '|'), lambda c: trim(c))), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS rws FROM chunks WHERE text LIKE '%|%')"


@query(f"WITH {_ROWS}, e AS (SELECT id, unnest(rws[2:]) AS cells, generate_subscripts(rws[2:], 1) - 1 AS k, rws[1] AS headers FROM tr) SELECT id, k, CASE WHEN len(headers) < 2 THEN array_to_string(list_filter(cells, lambda c: c <> ''), ' | ') ELSE array_to_string(list_transform(list_zip(headers[1:least(len(headers), len(cells))], cells[1:least(len(headers), len(cells))]), lambda p: p[1] || ': ' || {collapse_sql('p[2]')}), chr(10)) END AS line FROM e")
def x_serialize_rows(spark: SparkSession, d: str) -> DataFrame:
    t = chunks(spark, d).filter("text LIKE '%|%'").select("id", X.table_rows(F.col("text")).alias("r"))
    e = t.select("id", F.col("r")[0].alias("headers"), F.posexplode(F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0)))).alias("k", "cells"))
    return e.select("id", F.col("k").cast("long").alias("k"), X.serialize_row(F.col("headers"), F.col("cells")).alias("line"))


@query(
    "WITH b AS (SELECT l_orderkey AS page_key, l_linenumber AS table_id, l_shipmode AS signature, l_quantity AS x0, l_quantity + 10 AS x1 FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS l_shipmode, l_quantity FROM lineitem)) SELECT DISTINCT b.page_key, b.table_id FROM b a JOIN b ON a.page_key = b.page_key AND a.signature = b.signature AND a.table_id < b.table_id WHERE greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * 10 / 100 >= 0.9"
)
def x_duplicate_tables(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    box = F.struct(q.alias("x0"), F.lit(0.0).alias("y0"), (q + 10).alias("x1"), F.lit(10.0).alias("y1"))
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_key"), F.col("l_linenumber").alias("table_id"), F.col("l_returnflag").alias("signature"), box.alias("box"))
    return X.duplicate_tables(t)


@query()
def x_pack_units(spark: SparkSession, d: str) -> DataFrame:
    u = X.section_paths(_units(spark, d)).withColumn("kind", F.when(F.col("kind") == "article", "text").otherwise(F.col("kind")))
    return X.pack_units(u.select(F.col("key").alias("page_key"), "pos", "kind", "text", "path"))


@query(f"WITH {_ROWS} SELECT id, coalesce(len(list_filter(flatten(rws), lambda c: length(c) > 3)) > 0, FALSE) AS supported FROM tr")
def x_supported_tables(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).filter("text LIKE '%|%'")
    return c.select("id", F.coalesce(X.supported(F.flatten(X.table_rows(F.col("text"))), F.col("text")), F.lit(False)).alias("supported"))


@query(f"SELECT filename, {collapse_sql('title')} AS title FROM corpus_manifest")
def x_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_manifest").select("filename", T.collapse(F.col("title")).alias("title"))
