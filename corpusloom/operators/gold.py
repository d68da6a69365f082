"""Building and checking gold sets: citations found in passages, groups, samples, re-anchoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import fold, signals
from corpusloom.operators.statistics import draw
from corpusloom.operators.substrings import held_in, marks
from corpusloom.session import keep

#: Words in a row that join a quotation to the texts that may hold it: quotations of ten words and more, shorter ones.
LONG_GRAM, SHORT_GRAM = 8, 3
#: Characters of a word that join a quotation of one to four words to the words that may hold it.
PART = 8
#: Most hashes of quotations, 8 bytes each, that are sent to the workers to drop other runs before they are shuffled.
FEW_GRAMS = 500_000


def _gram(words: Column) -> Column:
    return F.xxhash64(F.array_join(words, " "))


def _grams(t: DataFrame, n: int) -> DataFrame:
    """Columns (text_id, gram): the hash of every run of n words of each text, once."""
    w = F.col("w")
    return t.select("text_id", F.split("t", " ").alias("w")).select("text_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: _gram(F.slice(w, i, n))))).alias("gram"))


def _sent_if_few(keys: DataFrame, most: int = FEW_GRAMS) -> DataFrame:
    """Keys marked to be sent to every worker if there are at most so many; else as they are."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def _word_hits(t: DataFrame, q: DataFrame) -> DataFrame:
    """Columns (text_id, quote_id, q): texts that have a word which holds the quote's longest word.

    A word of a quote never spans two words of a text.  Only the sizes that quotes have are cut from the
    words, each different word once, whatever the number of texts.
    """
    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("l"), x.alias("x"))))["x"]
    own = q.select("quote_id", "q", longest.alias("piece")).withColumn("size", F.least(F.length("piece"), F.lit(PART))).withColumn("gram", F.col("piece").substr(F.lit(1), F.col("size")))
    words = t.select("text_id", F.explode(F.array_distinct(F.split("t", " "))).alias("word")).filter("word <> ''")
    sized = words.select("word").distinct().select("word", F.explode(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(PART)))).alias("size")).join(own.select("size").distinct(), "size")
    cut = F.transform(F.sequence(F.lit(1), F.length("word") - F.col("size") + 1), lambda i: F.col("word").substr(i, F.col("size")))
    near = sized.select("word", F.explode(F.array_distinct(cut)).alias("gram")).join(own, "gram").filter(F.col("word").contains(F.col("piece"))).select("word", "quote_id", "q")
    return words.join(near, "word").select("text_id", "quote_id", "q")


def containment(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (quote_id, text_id, position) where the folded text holds the folded quote; empty quotes never match.

    quotes: (quote_id, quote); texts: (text_id, text).  The ends of a quote may lie inside longer words of a
    text, its inner words may not; so a quote joins on its inner words from the second on, eight of them if
    it has ten words, else three, to the texts that hold them in a row.  Quotes of one to four words join by
    the characters of their longest word.  Only such pairs are compared.  The position of the first place
    counts from 1 in the folded text.
    """
    q = quotes.select("quote_id", fold(F.col("quote")).alias("q")).filter("q <> ''").withColumn("w", F.split("q", " "))
    t = texts.select("text_id", fold(F.col("text")).alias("t")).filter("t <> ''")
    long, few = F.size("w") >= LONG_GRAM + 2, F.size("w") < SHORT_GRAM + 2
    hits = [_word_hits(t, q.filter(few))]
    for n, which in ((LONG_GRAM, long), (SHORT_GRAM, ~long & ~few)):
        own = q.filter(which).select("quote_id", "q", _gram(F.slice("w", 2, n)).alias("gram"))
        met = _grams(t, n).join(_sent_if_few(own.select("gram").distinct()), "gram", "left_semi")
        hits.append(met.join(own, "gram").select("text_id", "quote_id", "q"))
    return hits[0].union(hits[1]).union(hits[2]).join(t, "text_id").filter(F.col("t").contains(F.col("q"))).select("quote_id", "text_id", F.instr("t", F.col("q")).alias("position")).distinct()


def containment_by_key(pairs: DataFrame, quote: str = "quote", text: str = "text") -> DataFrame:
    """The pairs of one table whose folded text holds the folded quote: the text is known, no join."""
    q, t = fold(F.col(quote)), fold(F.col(text))
    return pairs.withColumn("found", (q != "") & t.contains(q)).withColumn("position", F.instr(t, q))


def citation_outcomes(found: DataFrame, quotes: DataFrame) -> DataFrame:
    """For each quotation how many texts hold it: found once, ambiguous or lost."""
    n = found.groupBy("quote_id").agg(F.count_distinct("text_id").alias("texts"))
    j = quotes.select("quote_id").distinct().join(n, "quote_id", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    return j.withColumn("outcome", F.when(F.col("texts") == 0, "lost").when(F.col("texts") == 1, "found").otherwise("ambiguous"))


def citation_groups(found: DataFrame, quotes: DataFrame) -> DataFrame:
    """Columns (qid, group_no, ids): the texts that hold each quotation of a question; quotes: (quote_id, qid, group_no)."""
    return found.join(quotes, "quote_id").groupBy("qid", "group_no").agg(F.array_sort(F.collect_set("text_id")).alias("ids"))


def separation(positions: DataFrame) -> DataFrame:
    """Of (qid, start, stop) with null where a quotation is missing: characters from the first start to the last end, null if any is missing."""
    missing = F.max(F.col("start").isNull())
    return positions.groupBy("qid").agg(F.when(~missing, F.max("stop") - F.min("start")).alias("chars"))


def retype(n_quotes: Column, spread: Column) -> Column:
    """factual with one quotation or close ones, multi_hop otherwise, unanswerable without any."""
    return F.when(n_quotes == 0, "unanswerable").when((n_quotes == 1) | (spread <= 200), "factual").otherwise("multi_hop")


def dedupe_questions(rows: DataFrame, question: str, order: list[str]) -> DataFrame:
    """The first row of each question, read without case, accents and punctuation."""
    form = F.regexp_replace(fold(F.col(question)), r"[^a-z0-9 ]+", "")
    return rows.withColumn("form", form).withColumn("k", F.row_number().over(Window.partitionBy("form").orderBy(*order))).filter("k = 1").drop("k", "form")


def neighbours(anchors: DataFrame, chunks: DataFrame, width: int = 1) -> DataFrame:
    """Chunks of an anchor's source at most `width` pages away get grade 1 unless they are anchors: an equi-join on source and page.

    anchors: (qid, id, grade); chunks: (id, source, page).
    """
    at = anchors.join(chunks, "id").select("qid", "source", F.explode(F.sequence(F.col("page") - width, F.col("page") + width)).alias("page"))
    near = at.join(chunks.select("id", "source", "page"), ["source", "page"]).select("qid", "id", F.lit(1).alias("grade"))
    return anchors.select("qid", "id", "grade").union(near).groupBy("qid", "id").agg(F.max("grade").alias("grade"))


def proportional_quotas(counts: DataFrame, size: int) -> DataFrame:
    """Of (cell, n): integer quotas in proportion, at least 1, what is left to the largest remainders; the list of cells is small."""
    w = Window.partitionBy()
    exact = F.lit(size) * F.col("n") / F.sum("n").over(w)
    c = counts.withColumn("exact", exact).withColumn("base", F.greatest(F.lit(1), F.floor("exact")))
    c = c.withColumn("left", F.lit(size) - F.sum("base").over(w)).withColumn("k", F.row_number().over(Window.orderBy((F.col("exact") - F.floor("exact")).desc(), "cell")))
    return c.select("cell", "n", F.least(F.col("n"), F.col("base") + F.when(F.col("k") <= F.col("left"), 1).otherwise(0)).alias("quota"))


def documents_by_issuer(documents: DataFrame, quota: int, seed: str = "7") -> DataFrame:
    """Of (document, form, issuer): `quota` documents of each form, different issuers first."""
    h = draw(F.lit(seed), F.col("document"))
    d = documents.withColumn("nth", F.row_number().over(Window.partitionBy("form", "issuer").orderBy(h, "document")))
    return d.withColumn("k", F.row_number().over(Window.partitionBy("form").orderBy("nth", h, "document"))).filter(F.col("k") <= quota).select("document", "form", "issuer", "nth", "k")


def draw_batch(passages: DataFrame, used: DataFrame, size: int, least_chars: int = 400, seed: str = "7") -> DataFrame:
    """Passages (id, text) not used yet and long enough, `size` of them by seeded hash."""
    ok = passages.filter(F.length("text") >= least_chars).join(used, "id", "left_anti")
    return ok.select("id", F.length("text").alias("chars"), draw(F.lit(seed), F.col("id")).alias("h")).orderBy("h", "id").limit(size).select("id", "chars")


def rejection(question: Column, answer: Column, quotes: Column, passage: Column) -> Column:
    """The first reason in order why a made question is refused, null if none."""
    folded = fold(passage)
    return (
        F.when(question.isNull() | (F.trim(question) == ""), "no_question")
        .when(answer.isNull() | (F.trim(answer) == ""), "no_answer")
        .when(F.length(F.trim(question)) < 15, "short_question")
        .when(~F.trim(question).endswith("?"), "no_question_mark")
        .when(F.coalesce(F.size(quotes), F.lit(0)) <= 0, "no_quote")
        .when(passage.isNull() | (F.trim(passage) == ""), "no_passage")
        .when(F.exists(quotes, lambda q: F.length(q) < 20), "short_quote")
        .when(F.exists(quotes, lambda q: ~folded.contains(fold(q))), "quote_not_found")
    )


def reanchor(old: DataFrame, new: DataFrame) -> DataFrame:
    """Where each old chunk (id, document, text) lies in a new corpus: by id, by equal text, by being contained, by containing; else lost.

    Only what a stage leaves reaches the next.  Texts stand as digests in all joins, so a row may come more
    than once; texts that contain others of their document are met by `held_in`.  No stage compares all pairs
    of a document.
    """
    o = keep(marks(old).distinct())
    n = keep(marks(new).distinct()).withColumnRenamed("id", "new_id")
    same = o.join(n.select(F.col("new_id").alias("id"), "h").distinct(), ["id", "h"]).select("id", F.col("id").alias("new_id"), F.lit("id").alias("how"))
    rest = o.filter("size > 0").join(same, "id", "left_anti")
    equal = keep(rest.join(n.select("new_id", "h"), "h").select("id", "new_id", F.lit("text").alias("how")).distinct())
    rest = keep(rest.join(equal, "id", "left_anti"))
    # Different texts of each document, under their digests.
    left, right = rest.drop("id").distinct(), n.filter("size > 0").drop("new_id").distinct()
    contained = held_in(left, new).select("document", F.col("in_h").alias("h"), F.col("out_h").alias("new_h"), F.lit("contained").alias("how"))
    contains = held_in(right, old).select("document", F.col("out_h").alias("h"), F.col("in_h").alias("new_h"), F.lit("contains").alias("how"))
    within = contained.union(contains).join(n.select("document", "new_id", F.col("h").alias("new_h")), ["document", "new_h"]).join(rest.select("id", "document", "h"), ["document", "h"]).select("id", "new_id", "how")
    rank = F.when(F.col("how") == "contained", 0).otherwise(1)
    best = within.withColumn("r", F.dense_rank().over(Window.partitionBy("id").orderBy(rank))).filter("r = 1").drop("r")
    found = same.union(equal).union(best).groupBy("id").agg(F.min("new_id").alias("new_id"), F.min("how").alias("how"), F.count_distinct("new_id").alias("candidates"))
    j = old.select("id").distinct().join(found, "id", "left")
    return j.select("id", "new_id", F.coalesce("how", F.lit("lost")).alias("how"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def best_sentence(passages: DataFrame, targets: DataFrame) -> DataFrame:
    """The sentence of each passage (key, text) that shares most signals with its target (key, target), the longer, then the earlier of equals."""
    s = passages.select("key", F.posexplode(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\x01"), "\x01|\n+")).alias("pos", "sentence")).filter("length(trim(sentence)) > 0")
    t = targets.select("key", signals(F.col("target")).alias("want"))
    m = s.join(t, "key").withColumn("shared", F.size(F.array_intersect(signals(F.col("sentence")), "want")))
    best = F.max(F.struct("shared", F.length("sentence").alias("l"), (-F.col("pos")).alias("p"), "sentence"))
    return m.groupBy("key").agg(best.alias("b")).select("key", F.col("b.sentence").alias("sentence"), F.col("b.shared").alias("shared"))


def phrase_search(texts: DataFrame, phrase: str, around: int = 60) -> DataFrame:
    """Texts (id, text) that hold a phrase, without case, with its first place and what stands around it."""
    spot = F.instr(F.lower("text"), phrase.lower())
    return texts.withColumn("position", spot).filter("position > 0").select("id", "position", F.substring("text", F.greatest(F.col("position") - around, F.lit(1)), F.lit(2 * around + len(phrase))).alias("context"))


def smallest_window(positions: DataFrame) -> DataFrame:
    """Of (qid, text_id, start, stop), one row a quotation: the span that holds all of a question's quotations in one text."""
    return positions.groupBy("qid", "text_id").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("quotes"))


def nearest_boundary(points: DataFrame, boundaries: DataFrame) -> DataFrame:
    """The boundary (key, at) nearest to each point (key, x), the earlier of equals: one sorted pass over both, no pairs.

    Points and boundaries of a key are sorted together; the last boundary before and the first after are
    carried to each point by two window functions.
    """
    u = points.select("key", F.col("x").alias("spot"), F.col("x"), F.lit(None).cast("long").alias("b")).unionByName(boundaries.select("key", F.col("at").cast("long").alias("spot"), F.lit(None).cast("long").alias("x"), F.col("at").cast("long").alias("b")))
    w = Window.partitionBy("key").orderBy("spot", F.col("b").isNull())
    before = F.last("b", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("b", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = u.withColumns({"before": before, "after": after}).filter("x IS NOT NULL")
    pick = F.when(F.col("after").isNull(), F.col("before")).when(F.col("before").isNull(), F.col("after")).when(F.col("x") - F.col("before") <= F.col("after") - F.col("x"), F.col("before")).otherwise(F.col("after"))
    return near.select("key", "x", pick.alias("at")).distinct()
