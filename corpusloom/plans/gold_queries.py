"""Queries of gold-set building; questions are those of perguntas_lote01, their latest delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import gold as B
from corpusloom.plans.judging_queries import draw_sql
from corpusloom.plans.registry import query
from corpusloom.plans.text_queries import CHUNKS, chunks, collapse_sql, unaccent_sql
from corpusloom.session import table


def fold_sql(c: str) -> str:
    return collapse_sql(unaccent_sql(f"lower(replace({c}, chr(173), ''))"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    r = F.struct("carregado_em", "question", "answer", "evidencia", "passagem_texto", "documento", "difficulty")
    return table(spark, d, "perguntas_lote01").groupBy("n").agg(F.max(r).alias("r")).select("n", "r.*")


QUESTIONS = "qs AS (SELECT n, r.question, r.answer, r.evidencia, r.passagem_texto, r.documento, r.difficulty FROM (SELECT n, max(struct_pack(carregado_em := carregado_em, question := question, answer := answer, evidencia := evidencia, passagem_texto := passagem_texto, documento := documento, difficulty := difficulty)) AS r FROM perguntas_lote01 GROUP BY n))"
QUOTES = f"{QUESTIONS}, quotes AS (SELECT n, unnest(evidencia) AS quote, generate_subscripts(evidencia, 1) - 1 AS group_no, passagem_texto AS text FROM qs)"


def quotes(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("n", F.posexplode("evidencia").alias("group_no", "quote"), F.col("passagem_texto").alias("text"))


@query(f"WITH {QUOTES} SELECT n, group_no, coalesce({fold_sql('quote')} <> '' AND contains({fold_sql('text')}, {fold_sql('quote')}), FALSE) AS found, coalesce(instr({fold_sql('text')}, {fold_sql('quote')}), 0) AS position FROM quotes")
def b_quotes_in_passage(spark: SparkSession, d: str) -> DataFrame:
    f = B.containment_by_key(quotes(spark, d))
    return f.select("n", F.col("group_no").cast("long").alias("group_no"), F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("position", F.lit(0)).cast("long").alias("position"))


_FOUND = f"""{QUOTES}, ft AS (SELECT n AS text_id, {fold_sql('passagem_texto')} AS t FROM qs), fq AS (SELECT DISTINCT quote, {fold_sql('quote')} AS q FROM quotes WHERE {fold_sql('quote')} <> ''),
found AS (SELECT quote AS quote_id, text_id, instr(t, q) AS position FROM fq JOIN ft ON contains(t, q))"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    q = quotes(spark, d).select(F.col("quote").alias("quote_id"), "quote").filter("quote IS NOT NULL").distinct()
    return B.containment(q, questions(spark, d).select(F.col("n").alias("text_id"), F.col("passagem_texto").alias("text")))


@query(f"WITH {_FOUND} SELECT quote_id, text_id, position FROM found")
def b_containment(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).withColumn("position", F.col("position").cast("long"))


@query(f"WITH {_FOUND}, c AS (SELECT quote_id, count(DISTINCT text_id) AS texts FROM found GROUP BY 1), q AS (SELECT DISTINCT quote AS quote_id FROM quotes WHERE quote IS NOT NULL) SELECT quote_id, coalesce(texts, 0) AS texts, CASE WHEN texts IS NULL THEN 'lost' WHEN texts = 1 THEN 'found' ELSE 'ambiguous' END AS outcome FROM q LEFT JOIN c USING (quote_id)")
def b_citation_outcomes(spark: SparkSession, d: str) -> DataFrame:
    q = quotes(spark, d).select(F.col("quote").alias("quote_id")).filter("quote_id IS NOT NULL")
    return B.citation_outcomes(_found(spark, d), q)


@query(f"WITH {_FOUND} SELECT n AS qid, group_no, string_agg(DISTINCT text_id, ',' ORDER BY text_id) AS ids FROM found JOIN quotes ON quote = quote_id GROUP BY ALL")
def b_citation_groups(spark: SparkSession, d: str) -> DataFrame:
    q = quotes(spark, d).select(F.col("quote").alias("quote_id"), F.col("n").alias("qid"), F.col("group_no").cast("long").alias("group_no"))
    return B.citation_groups(_found(spark, d), q).withColumn("ids", F.array_join("ids", ","))


_SEP = f"{QUOTES}, ps AS (SELECT n, nullif(instr({fold_sql('text')}, {fold_sql('quote')}), 0) AS start, length({fold_sql('quote')}) AS l FROM quotes), sp AS (SELECT n AS qid, CASE WHEN NOT bool_or(start IS NULL) THEN max(start + l) - min(start) END AS chars, count(*) AS k FROM ps GROUP BY 1)"


def _separation(spark: SparkSession, d: str) -> DataFrame:
    f = B.containment_by_key(quotes(spark, d)).withColumn("start", F.when(F.col("position") > 0, F.col("position").cast("long")))
    return f.select(F.col("n").alias("qid"), "start", (F.col("start") + F.length(T.fold(F.col("quote")))).alias("stop"))


@query(f"WITH {_SEP} SELECT qid, chars FROM sp")
def b_separation(spark: SparkSession, d: str) -> DataFrame:
    return B.separation(_separation(spark, d))


@query(f"WITH {_SEP} SELECT n AS qid, CASE WHEN coalesce(k, 0) = 0 THEN 'unanswerable' WHEN k = 1 OR chars <= 200 THEN 'factual' ELSE 'multi_hop' END AS type FROM qs LEFT JOIN sp ON n = qid")
def b_retype(spark: SparkSession, d: str) -> DataFrame:
    s = _separation(spark, d)
    n = s.groupBy("qid").agg(F.count("*").alias("k")).join(B.separation(s), "qid")
    q = questions(spark, d).select(F.col("n").alias("qid")).join(n, "qid", "left")
    return q.select("qid", B.retype(F.coalesce("k", F.lit(0)), F.col("chars")).alias("type"))


@query(f"WITH {QUESTIONS}, f AS (SELECT n, question, row_number() OVER (PARTITION BY regexp_replace({fold_sql('question')}, '[^a-z0-9 ]+', '', 'g') ORDER BY n) AS k FROM qs) SELECT n, question FROM f WHERE k = 1")
def b_dedupe_questions(spark: SparkSession, d: str) -> DataFrame:
    return B.dedupe_questions(questions(spark, d).select("n", "question"), "question", ["n"])


@query(
    f"""WITH {CHUNKS}, c AS (SELECT id, metadata.document_id AS source, CAST(metadata.page AS INT) AS page FROM chunks WHERE metadata.page IS NOT NULL), a AS (SELECT source AS qid, id, 2 AS grade, page, source FROM c WHERE left(sha256(id), 1) = '0'),
u AS (SELECT qid, id, grade FROM a UNION ALL SELECT a.qid, c.id, 1 FROM a JOIN c ON a.source = c.source AND abs(a.page - c.page) <= 1) SELECT qid, id, max(grade) AS grade FROM u GROUP BY ALL"""
)
def b_neighbours(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "document_id", "page").filter("metadata.page IS NOT NULL").select("id", F.col("metadata.document_id").alias("source"), F.col("metadata.page").cast("int").alias("page"))
    a = c.filter(F.left(T.content_hash(F.col("id")), F.lit(1)) == "0").select(F.col("source").alias("qid"), "id", F.lit(2).alias("grade"))
    return B.neighbours(a, c)


@query("WITH c AS (SELECT coalesce(source, '') AS cell, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT *, 100 * n / CAST(sum(n) OVER () AS DOUBLE) AS exact FROM c), b AS (SELECT *, greatest(1, floor(exact)) AS base FROM e), k AS (SELECT *, 100 - sum(base) OVER () AS lft, row_number() OVER (ORDER BY exact - floor(exact) DESC, cell) AS k FROM b) SELECT cell, n, CAST(least(n, base + CASE WHEN k <= lft THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM k")
def b_proportional_quotas(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("")).alias("cell")).agg(F.count("*").alias("n"))
    return B.proportional_quotas(c, 100).withColumn("quota", F.col("quota").cast("long"))


@query(
    f"""WITH m AS (SELECT DISTINCT filename AS document, coalesce(document_type, '') AS form, coalesce(left(trim(split_part(author, ';', 1)), 40), '') AS issuer FROM corpus_manifest), h AS (SELECT *, {draw_sql("'7'", 'document')} AS h FROM m),
x AS (SELECT *, row_number() OVER (PARTITION BY form, issuer ORDER BY h, document) AS nth FROM h), y AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY nth, h, document) AS k FROM x) SELECT document, form, issuer, nth, k FROM y WHERE k <= 4"""
)
def b_documents_by_issuer(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "corpus_manifest").select(F.col("filename").alias("document"), F.coalesce("document_type", F.lit("")).alias("form"), F.coalesce(T.issuer(F.col("author")), F.lit("")).alias("issuer")).distinct()
    return B.documents_by_issuer(m, 4)


@query(f"""WITH u AS (SELECT DISTINCT documento AS x FROM perguntas_lote01), {CHUNKS}, ok AS (SELECT id, length(text) AS chars, {draw_sql("'7'", 'id')} AS h FROM chunks WHERE length(text) >= 400 AND id NOT IN (SELECT id FROM chunks WHERE left(sha256(id), 1) < '8')) SELECT id, chars FROM ok ORDER BY h, id LIMIT 50""")
def b_draw_batch(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).select("id", "text")
    used = c.filter(F.left(T.content_hash(F.col("id")), F.lit(1)) < "8").select("id")
    return B.draw_batch(c, used, 50)


@query(
    f"""WITH {QUESTIONS} SELECT n, CASE WHEN question IS NULL OR trim(question) = '' THEN 'no_question' WHEN answer IS NULL OR trim(answer) = '' THEN 'no_answer' WHEN length(trim(question)) < 15 THEN 'short_question' WHEN NOT ends_with(trim(question), '?') THEN 'no_question_mark'
WHEN coalesce(len(evidencia), 0) = 0 THEN 'no_quote' WHEN passagem_texto IS NULL OR trim(passagem_texto) = '' THEN 'no_passage' WHEN len(list_filter(evidencia, lambda q: length(q) < 20)) > 0 THEN 'short_quote'
WHEN len(list_filter(evidencia, lambda q: NOT contains({fold_sql('passagem_texto')}, {fold_sql('q')}))) > 0 THEN 'quote_not_found' END AS reason FROM qs"""
)
def b_rejections(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("n", B.rejection(F.col("question"), F.col("answer"), F.col("evidencia"), F.col("passagem_texto")).alias("reason"))


@query()
def b_reanchor(spark: SparkSession, d: str) -> DataFrame:
    # Deliveries of an id have one text, and a row may come more than once: no text is shuffled to drop the later ones.
    c = table(spark, d, "pdf_chunks").filter("text IS NOT NULL").select("id", F.col("metadata.document_id").alias("document"), "text")
    new = c.withColumn("new", T.chunk_id(F.col("document"), F.col("text")))
    return B.reanchor(c, new.select(F.col("new").alias("id"), "document", F.when(F.length("text") > 300, F.substring("text", 51, 1_000_000)).otherwise(F.col("text")).alias("text")))


@query()
def b_best_sentence(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d).filter("passagem_texto IS NOT NULL")
    return B.best_sentence(q.select(F.col("n").alias("key"), F.col("passagem_texto").alias("text")), q.select(F.col("n").alias("key"), F.col("answer").alias("target")))


@query(f"WITH {CHUNKS} SELECT id, instr(lower(text), 'vedado') AS position, substr(text, greatest(instr(lower(text), 'vedado') - 60, 1), 126) AS context FROM chunks WHERE instr(lower(text), 'vedado') > 0")
def b_phrase_search(spark: SparkSession, d: str) -> DataFrame:
    return B.phrase_search(chunks(spark, d).select("id", "text"), "vedado").withColumn("position", F.col("position").cast("long"))


@query(f"WITH {_SEP} SELECT n AS qid, n AS text_id, min(start) AS start, max(start + l) AS stop, count(*) AS quotes FROM ps WHERE start IS NOT NULL GROUP BY n")
def b_smallest_window(spark: SparkSession, d: str) -> DataFrame:
    s = _separation(spark, d).filter("start IS NOT NULL").withColumn("text_id", F.col("qid"))
    return B.smallest_window(s)


@query(
    "WITH p AS (SELECT DISTINCT user_id AS key, epoch_us(ts) // 1000000 AS x FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT user_id AS key, epoch_us(ts) // 1000000 AS a FROM events WHERE event_id % 2 = 1) SELECT key, x, arg_min(a, row(abs(x - a), a)) AS at FROM p LEFT JOIN b USING (key) GROUP BY key, x"
)
def j_nearest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("x"), "event_id")
    points, bounds = e.filter("event_id % 2 = 0").select("key", "x").distinct(), e.filter("event_id % 2 = 1").select("key", F.col("x").alias("at")).distinct()
    return B.nearest_boundary(points, bounds)


@query("SELECT count(*) AS pairs FROM orders JOIN customer ON o_custkey = c_custkey")
def j_equi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).agg(F.count("*").alias("pairs"))


@query("SELECT c_custkey, 'none' AS orders FROM customer ANTI JOIN orders ON o_custkey = c_custkey UNION ALL SELECT c_custkey, 'some' FROM customer SEMI JOIN orders ON o_custkey = c_custkey")
def j_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    return c.join(o, on, "left_anti").select("c_custkey", F.lit("none").alias("orders")).union(c.join(o, on, "left_semi").select("c_custkey", F.lit("some").alias("orders")))


@query("SELECT coalesce(p, s) AS key, p IS NULL AS only_supplied, s IS NULL AS only_listed FROM (SELECT p_partkey AS p FROM part) FULL JOIN (SELECT DISTINCT l_partkey AS s FROM lineitem) ON p = s WHERE p IS NULL OR s IS NULL")
def j_reconcile(spark: SparkSession, d: str) -> DataFrame:
    p, s = table(spark, d, "part").select(F.col("p_partkey").alias("p")), table(spark, d, "lineitem").select(F.col("l_partkey").alias("s")).distinct()
    j = p.join(s, F.col("p") == F.col("s"), "full").filter("p IS NULL OR s IS NULL")
    return j.select(F.coalesce("p", "s").alias("key"), F.col("p").isNull().alias("only_supplied"), F.col("s").isNull().alias("only_listed"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders))")
def j_common_keys(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    n = o.agg(F.count_distinct("o_orderpriority").alias("n"))
    full = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct("o_orderpriority").alias("k")).join(n).filter("k = n")  # one row
    return full.join(table(spark, d, "customer").select("c_custkey"), "c_custkey").select("c_custkey")


@query(f"WITH {CHUNKS}, o AS (SELECT sha256(coalesce(text, '')) AS h, id FROM chunks WHERE left(sha256(id), 1) < '8'), w AS (SELECT sha256(coalesce(text, '')) AS h, id FROM chunks) SELECT w.id, min(o.id) AS reused FROM w LEFT JOIN o USING (h) GROUP BY w.id")
def j_reuse_by_text(spark: SparkSession, d: str) -> DataFrame:
    h = T.content_hash(F.coalesce("text", F.lit("")))
    c = chunks(spark, d).select("id", h.alias("h"))
    old = c.filter(F.left(T.content_hash(F.col("id")), F.lit(1)) < "8").groupBy("h").agg(F.min("id").alias("reused"))
    return c.join(old, "h", "left").select("id", "reused")
