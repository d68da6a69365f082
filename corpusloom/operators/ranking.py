"""Fusion, reranking, diversification and budgeted selection of ranked lists (qid, id, rank, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING = -1e9


def rerank_numbers(df: DataFrame, *order: Column, by: str = "qid") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def reciprocal_fusion(lists: DataFrame, constant: int = 30, k: int = 100) -> DataFrame:
    """Of (system, qid, id, rank): each id's sum of 1 / (constant + rank) over the systems; ties by id."""
    s = lists.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), 9).alias("score"))
    return rerank_numbers(s, F.col("score").desc(), F.col("id")).filter(F.col("rank") <= k)


def best_of_families(lists: DataFrame, quality: DataFrame, constant: int = 30, k: int = 100) -> DataFrame:
    """Fuses the system of each family with the best mean quality (system, family, value); ties by name."""
    best = quality.groupBy("family").agg(F.min(F.struct(-F.col("value"), F.col("system"))).alias("b")).select(F.col("b.system").alias("system"))
    return reciprocal_fusion(lists.join(best, "system", "left_semi"), constant, k)


def rerank_pool(ranked: DataFrame, scores: DataFrame, pool: int) -> DataFrame:
    """The first `pool` reordered by an external score (missing ones last), the tail as it was."""
    j = ranked.select("qid", "id", "rank").join(scores.select("qid", "id", F.col("score").alias("given")), ["qid", "id"], "left")
    inside = F.col("rank") <= pool
    j = j.withColumn("given", F.coalesce("given", F.lit(MISSING))).withColumn("old", F.col("rank"))
    return rerank_numbers(j, (~inside).cast("int"), F.when(inside, -F.col("given")), F.col("old")).select("qid", "id", "rank", "old")


def cap_reorder(ranked: DataFrame, cap: int) -> DataFrame:
    """At most `cap` of a document in order, what is over comes after all else in order."""
    nth = F.row_number().over(Window.partitionBy("qid", "document").orderBy("rank"))
    r = ranked.withColumn("over", (nth > cap).cast("int")).withColumn("old", F.col("rank"))
    return rerank_numbers(r, F.col("over"), F.col("old")).select("qid", "id", "document", "rank", "old")


def cap_select(ranked: DataFrame, cap: int, k: int = 5, backfill: bool = True) -> DataFrame:
    """k of each query with at most `cap` of a document; places left are filled in order unless told otherwise."""
    r = cap_reorder(ranked, cap)
    if not backfill:
        nth = F.row_number().over(Window.partitionBy("qid", "document").orderBy("old"))
        r = rerank_numbers(r.withColumn("nth", nth).filter(F.col("nth") <= cap), F.col("old")).drop("nth")
    return r.filter(F.col("rank") <= k)


def _pool(ranked: DataFrame, pool: int, *extra: str) -> DataFrame:
    return ranked.filter(F.col("rank") <= pool).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", *extra))).alias("c"))


def _places(df: DataFrame, picked: Column) -> DataFrame:
    return df.select("qid", F.posexplode(picked).alias("i", "id")).select("qid", "id", (F.col("i") + 1).alias("rank"))


def diverse(ranked: DataFrame, vectors: DataFrame, weight: float = 0.7, k: int = 5, pool: int = 30) -> DataFrame:
    """Greedy choice by weight x relevance - (1 - weight) x largest cosine to what is chosen.

    Relevance falls evenly from 1 to 0 over the pool.  The fold runs over at most `pool` candidates of a
    query; earlier ones win ties.
    """
    from corpusloom.operators.dense import dot

    size = F.sqrt(dot(F.col("vector"), F.col("vector")))
    unit = vectors.select("id", F.transform("vector", lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double"))).alias("v"))
    # Equal ranks cannot occur in a ranking, so sorting never looks at the vectors.
    p = _pool(ranked.filter(F.col("rank") <= pool).join(unit, "id"), pool, "v")
    n = F.greatest(F.size("c") - 1, F.lit(1))
    all_ = F.transform("c", lambda x, i: F.struct((1.0 - i / n).alias("rel"), x["id"].alias("id"), x["v"].alias("v"), i.alias("i")))
    p = p.select("qid", all_.alias("c"))
    empty = F.filter("c", lambda x: F.lit(False))

    def choose(chosen: Column, _: Column) -> Column:
        left = F.filter("c", lambda x: ~F.exists(chosen, lambda e: e["i"] == x["i"]))
        mark = lambda x: weight * x["rel"] - (1 - weight) * F.coalesce(F.array_max(F.transform(chosen, lambda e: dot(x["v"], e["v"]))), F.lit(0.0))
        best = F.array_min(F.transform(left, lambda x: F.struct((-F.round(mark(x), 9)).alias("m"), x["i"].alias("i"))))
        return F.when(F.size(left) > 0, F.concat(chosen, F.filter("c", lambda x: x["i"] == best["i"]))).otherwise(chosen)

    picked = F.aggregate(F.sequence(F.lit(1), F.lit(k)), empty, choose)
    return _places(p, F.transform(picked, lambda x: x["id"]))


def apart(ranked: DataFrame, distance: int, k: int = 5, pool: int = 100) -> DataFrame:
    """The first k no two of which lie under `distance` apart in one document; places left are filled in order."""
    p = _pool(ranked, pool, "document", "position")
    empty = F.filter("c", lambda x: F.lit(False))

    def add(chosen: Column, x: Column) -> Column:
        near = F.exists(chosen, lambda e: (e["document"] == x["document"]) & (F.abs(e["position"] - x["position"]) < distance))
        return F.when((F.size(chosen) < k) & ~near, F.concat(chosen, F.array(x))).otherwise(chosen)

    picked = F.transform(F.aggregate("c", empty, add), lambda x: x["id"])
    rest = F.filter(F.transform("c", lambda x: x["id"]), lambda i: ~F.array_contains(picked, i))
    return _places(p, F.slice(F.concat(picked, rest), 1, k))


def within_budget(ranked: DataFrame, budget: int, size: str = "chars") -> DataFrame:
    """Whole units in order until the budget is reached; the last may pass it."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0))).filter(F.col("before") < budget)


def best_score(sides: DataFrame, k: int) -> DataFrame:
    """Of (qid, side, id, score): ids by their best score on any side."""
    s = sides.groupBy("qid", "id").agg(F.max("score").alias("score"))
    return rerank_numbers(s, F.col("score").desc(), F.col("id")).filter(F.col("rank") <= k)


def _ordered(sides: DataFrame) -> DataFrame:
    return sides.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "side").orderBy(F.col("score").desc(), "id")))


def _lists(sides: DataFrame, pool: int) -> DataFrame:
    r = _ordered(sides).filter(F.col("rank") <= pool)
    side = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == n, F.struct("rank", "id")))), lambda x: x["id"])
    return r.groupBy("qid").agg(side(1).alias("a"), side(2).alias("b"))


def reserve_best(sides: DataFrame, k: int, pool: int = 100) -> DataFrame:
    """The best of each side first (the second side's best that is not taken yet), then by best score."""
    l = _lists(sides, pool)
    first = F.slice("a", 1, 1)
    second = F.slice(F.filter("b", lambda x: ~F.array_contains(first, x)), 1, 1)
    held = l.select("qid", F.posexplode(F.concat(first, second)).alias("slot", "id"))
    rest = best_score(sides, 1_000_000).join(held, ["qid", "id"], "left")
    return rerank_numbers(rest, F.coalesce("slot", F.lit(9)), F.col("rank")).filter(F.col("rank") <= k).select("qid", "id", "rank")


def interleave(sides: DataFrame, k: int, pool: int = 100) -> DataFrame:
    """Sides take turns, each with its best that is not out yet; a side that has run out is passed over."""
    l = _lists(sides, pool)
    empty = F.filter("a", lambda x: F.lit(False))

    def turn(out: Column, t: Column) -> Column:
        pick = lambda c: F.slice(F.filter(c, lambda x: ~F.array_contains(out, x)), 1, 1)
        mine = F.when(t % 2 == 0, pick("a")).otherwise(pick("b"))
        return F.when(F.size(out) < k, F.concat(out, mine)).otherwise(out)

    return _places(l, F.aggregate(F.sequence(F.lit(0), F.lit(2 * pool - 1)), empty, turn))


def partition(sides: DataFrame, k1: int, k2: int, pool: int = 100) -> DataFrame:
    """k1 of one side and k2 of the other without competition; places lost to repeats are filled in turns from deeper ranks."""
    l = _lists(sides, pool)
    fixed = F.array_distinct(F.concat(F.slice("a", 1, k1), F.slice("b", 1, k2)))
    turns = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(pool)), lambda i: F.concat(F.slice("a", k1 + i, F.lit(1)), F.slice("b", k2 + i, F.lit(1)))))
    return _places(l, F.slice(F.array_distinct(F.concat(fixed, turns)), 1, k1 + k2))


def union_by_need(sides: DataFrame, each: int) -> DataFrame:
    """The first `each` of every side, once each, in interleaved order, with no cap."""
    r = _ordered(sides).filter(F.col("rank") <= each)
    first = r.groupBy("qid", "id").agg(F.min(2 * F.col("rank") + F.col("side")).alias("place"))
    return rerank_numbers(first, F.col("place"), F.col("id")).select("qid", "id", "rank")


def first_parents(ranked: DataFrame, k: int = 3, pool: int = 12) -> DataFrame:
    """The first k parents met in a ranking of children (qid, id, parent, rank)."""
    p = ranked.filter(F.col("rank") <= pool).groupBy("qid", "parent").agg(F.min("rank").alias("first"))
    return rerank_numbers(p, F.col("first")).filter(F.col("rank") <= k).select("qid", "parent", "rank")


def judging_pool(lists: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """What to judge: the first k of every system and all anchors, with the systems that brought each."""
    pooled = lists.filter(F.col("rank") <= k).select("qid", "id", F.col("system").alias("origin")).union(anchors.select("qid", "id", F.lit("anchor").alias("origin")))
    return pooled.groupBy("qid", "id").agg(F.array_sort(F.collect_set("origin")).alias("origins")).withColumn("anchor", F.array_contains("origins", "anchor"))


def complete_rankings(have: DataFrame, new: DataFrame) -> DataFrame:
    """Rankings of `have`, and those of `new` for queries it lacks."""
    missing = new.join(have.select("system", "qid").distinct(), ["system", "qid"], "left_anti")
    return have.unionByName(missing)


def living_systems(lists: DataFrame, corpus_ids: DataFrame, depth: int = 20, share: float = 0.95) -> DataFrame:
    """Columns (system, known, alive): whether enough of a system's first ids still exist."""
    ids = lists.filter(F.col("rank") <= depth).select("system", "id").distinct()
    j = ids.join(corpus_ids.select("id", F.lit(1).alias("there")), "id", "left")
    return j.groupBy("system").agg(F.avg(F.coalesce("there", F.lit(0)).cast("double")).alias("known")).withColumn("alive", F.col("known") >= share)


def ceiling_split(ranked: DataFrame, groups: DataFrame, k: int = 5, pool: int = 100) -> DataFrame:
    """For each query whether its groups are all in the first k (hit), only in the pool (order) or not (impossible)."""
    g = groups.select("qid", "group_no", "id").join(ranked.select("qid", "id", "rank"), ["qid", "id"], "left")
    best = g.groupBy("qid", "group_no").agg(F.min("rank").alias("best")).groupBy("qid").agg(F.max(F.coalesce("best", F.lit(10**9))).alias("worst"))
    return best.select("qid", F.when(F.col("worst") <= k, "hit").when(F.col("worst") <= pool, "order").otherwise("impossible").alias("outcome"))
