"""Reports over rankings and gold sets: contexts, wide sheets, ceilings, false negatives, name matches, migrations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import fold, signals
from corpusloom.operators.statistics import draw

LOOSE_NUMBER = re.compile(r"(?<!\S)(\d{1,5})(?!\S)")


def contexts(ranked: DataFrame, texts: DataFrame, k: int = 5) -> DataFrame:
    """Columns (qid, context): the first k whole texts of each query in order, numbered.

    Where texts have a title and url, each is followed by a line with both, the title as ? if it is missing
    and the address only if there is one.  A text that is not among texts keeps its number.
    """
    cited = {"title", "url"} <= set(texts.columns)
    t = texts.select("id", "text", *(["title", "url"] if cited else []))
    j = ranked.filter(F.col("rank") <= k).join(t, "id", "left")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("text", F.lit("")))
    if cited:
        line = F.concat(line, F.lit("\n"), F.coalesce(F.nullif("title", F.lit("")), F.lit("?")), F.coalesce(F.concat(F.lit(" — "), F.nullif("url", F.lit(""))), F.lit("")))
    return j.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))


def context_coverage(ranked: DataFrame, groups: DataFrame, k: int = 5) -> DataFrame:
    """Columns (qid, required, arrived, complete): how many of a query's groups (qid, group_no, id) have an id in its first k, and whether all have.

    Queries with fewer than k results are left out, as from the original's sheets.
    """
    full = ranked.filter(F.col("rank") <= k).groupBy("qid").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("qid")
    hit = ranked.filter(F.col("rank") <= k).select("qid", "id", F.lit(1).alias("hit"))
    g = groups.select("qid", "group_no", "id").join(hit, ["qid", "id"], "left").groupBy("qid", "group_no").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return g.join(full, "qid").groupBy("qid").agg(F.count("*").alias("required"), F.sum("hit").alias("arrived"), (F.min("hit") == 1).alias("complete"))


def wide_ranking(ranked: DataFrame, qrels: DataFrame, k: int = 3) -> DataFrame:
    """One row a query with id and grade of each of its first k places."""
    g = ranked.filter(F.col("rank") <= k).join(qrels, ["qid", "id"], "left")
    cols = []
    for i in range(1, k + 1):
        cols += [F.max(F.when(F.col("rank") == i, F.col("id"))).alias(f"id{i}"), F.max(F.when(F.col("rank") == i, F.coalesce("grade", F.lit(0)))).alias(f"grade{i}")]
    return g.groupBy("qid").agg(*cols)


def ideal_order(ranked: DataFrame, qrels: DataFrame, pool: int) -> DataFrame:
    """The ranking with its first `pool` in the best order there is: what a perfect reranker would give."""
    j = ranked.join(qrels, ["qid", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    inside = F.col("rank") <= pool
    w = Window.partitionBy("system", "qid").orderBy((~inside).cast("int"), F.when(inside, -F.col("grade")), "rank")
    return j.withColumn("rank", F.row_number().over(w)).select("system", "qid", "id", "rank")


def false_negatives(scored: DataFrame, shares: list[float]) -> DataFrame:
    """Of (qid, score, relevant, shared): by each share of signals, unjudged rows that score as the least relevant one and share as much."""
    least = scored.filter("relevant").groupBy("qid").agg(F.min("score").alias("least"))
    j = scored.filter("NOT relevant").join(least, "qid").filter("score >= least")
    grid = j.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    return grid.groupBy("share").agg(F.count_if(F.col("shared") >= F.col("share")).alias("rows"), F.count_distinct(F.when(F.col("shared") >= F.col("share"), F.col("qid"))).alias("queries"))


def signal_share(target: Column, text: Column) -> Column:
    """Share of the target's signals that a text holds."""
    t = signals(target)
    return F.when(F.size(t) > 0, F.size(F.array_intersect(t, signals(text))) / F.size(t)).otherwise(0.0)


def names_documents(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Of (qid, question) and (document, alias): how many documents a question names: both, one or none.

    Aliases join on their first word to the words of the questions; only those are looked up whole.
    """
    q = questions.select("qid", fold(F.col("question")).alias("q"))
    words = q.select("qid", "q", F.explode(F.array_distinct(F.split("q", r"[^a-z0-9]+"))).alias("w"))
    a = aliases.select("document", fold(F.col("alias")).alias("a")).filter("a <> ''").withColumn("w", F.split("a", r"[^a-z0-9]+")[0]).filter("w <> ''")
    hits = words.join(a, "w").filter(F.col("q").contains(F.col("a"))).groupBy("qid").agg(F.count_distinct("document").alias("n"))
    j = q.select("qid").join(hits, "qid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select("qid", "n", F.when(F.col("n") >= 2, "both").when(F.col("n") == 1, "one").otherwise("none").alias("names"))


def id_migration(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of (id, new_id) maps applied to judgments (qid, id, grade): rewritten rows, with whether the id was known."""
    j = old.join(new, "id", "left")
    return j.select("qid", F.coalesce("new_id", "id").alias("id"), "grade", F.col("new_id").isNotNull().alias("known"))


def examples(rows: DataFrame, n: int) -> DataFrame:
    """For each question the text of its best grade, the first by id of equals; the first n questions."""
    best = rows.groupBy("qid").agg(F.min(F.struct(-F.col("grade"), "id")).alias("b")).select("qid", F.col("b.id").alias("id"))
    return best.orderBy("qid").limit(n)


def two_orders(items: DataFrame, key: str, name: str, seed: str) -> DataFrame:
    """An annotator's sheet: all share one order of questions by `seed`, each has an own order of what a question shows."""
    shared, own = draw(F.lit(seed), F.col("qid")), draw(F.lit(f"{seed}/{name}"), F.col("qid"), F.col(key))
    return items.withColumn("question_key", shared).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(own, key))).select("qid", key, "question_key", "place")


def pilot_sample(items: DataFrame, key: str, size: int, seed: str = "7") -> DataFrame:
    """Half anchors, half others, by seeded hash."""
    w = Window.partitionBy("anchor").orderBy(draw(F.lit(seed), F.col(key)), key)
    return items.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= size // 2).select(key, "anchor", "k")


def outcome_matrix(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two outcomes of the same questions against each other: (first, second, n)."""
    return a.select("qid", F.col("outcome").alias("first")).join(b.select("qid", F.col("outcome").alias("second")), "qid").groupBy("first", "second").agg(F.count("*").alias("n"))


def distinct_texts(rows: DataFrame, text: str) -> DataFrame:
    """Each text once with its hash and how many rows have it: what is sent to a model."""
    return rows.filter(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text).cast("binary"), 256).alias("hash")).agg(F.first(text).alias(text), F.count("*").alias("rows"))


def inflation(per_scenario: DataFrame, overall: float, margin: float = 0.02) -> DataFrame:
    """Whether an agreement over all scenarios is above every scenario's own by more than the margin."""
    return per_scenario.agg(F.max("alpha").alias("best")).withColumn("overall", F.lit(overall)).withColumn("inflated", F.col("overall") > F.col("best") + margin)


def strip_line_numbers(text: str, passes: int = 6, least: int = 4, step: int = 15) -> tuple[str, int]:
    """A text without the numbers of its lines: longest rising run of loose numbers first, until none is long enough."""
    removed = 0
    for _ in range(passes):
        found = list(LOOSE_NUMBER.finditer(text))
        best: list[re.Match] = []
        run: list[re.Match] = []
        for m in found:
            run = [*run, m] if run and 1 <= int(m[1]) - int(run[-1][1]) <= step else [m]
            if len(run) > len(best):
                best = run
        if len(best) < least:
            break
        keep, end = [], 0
        for m in best:
            keep.append(text[end : m.start()])
            end = m.end()
        text = "".join(keep) + text[end:]
        removed += len(best)
    return text, removed


def without_line_numbers(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Columns (key, text, removed) of every row; a null text stays null."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [strip_line_numbers(t) if t else (t, 0) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in done], type=pa.string()), pa.array([n for _, n in done], type=pa.int32())], names=["key", "text", "removed"])

    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, text string, removed int").withColumnRenamed("key", key)


def requeue_blocked(pages: DataFrame, blocked: Column, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages that are content, errors with the blocked pages' addresses added once)."""
    bad = pages.filter(blocked).select("url", F.lit("blocked").alias("reason")).join(errors.select("url"), "url", "left_anti").distinct()
    return pages.filter(~blocked), errors.select("url", "reason").union(bad)
