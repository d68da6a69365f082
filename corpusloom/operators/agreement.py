"""Judges' scores: parsing, majority, agreement coefficients from aggregates, refusals, audit samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import fold
from corpusloom.operators.statistics import draw

# Fixed values.
SCALE = {"s": 3, "sim": 3, "parcial": 2, "parc": 2, "parcialmente": 2, "n": 1, "nao": 1}
REFUSALS = [r"nao(?: +[a-z0-9_]+){1,3} +(?:informac[a-z]*|dados) +suficient", r"nao(?: +[a-z0-9_]+){0,3} +poss[a-z]* +responder +com +seguranca", r"nao +consig[a-z]* +responder"]


def read_scale(c: Column) -> Column:
    """A typed answer as a score, null if it is none."""
    plain = F.regexp_replace(fold(c), "[^a-z]", "")
    out = F.lit(None).cast("int")
    for word, score in SCALE.items():
        out = F.when(plain == word, score).otherwise(out)
    return out


def parse_score(raw: Column, low: int, high: int) -> Column:
    """A score with halves to even, null if out of scale or no number; see is_na for what does not apply."""
    n = F.bround(raw.try_cast("double"), 0).cast("int")
    return F.when(n.between(low, high), n)


def is_na(raw: Column) -> Column:
    return F.lower(F.trim(raw)) == "na"


def applies(criterion: Column, reference: Column, context: Column) -> Column:
    """Correctness and completeness need a reference, faithfulness and hallucination a context."""
    has = lambda c: c.isNotNull() & (F.trim(c) != "")
    return F.when(criterion.isin("correctness", "completeness"), has(reference)).when(criterion.isin("faithfulness", "hallucination"), has(context)).otherwise(True)


def same_model(judge: Column, generator: Column) -> Column:
    return F.lower(F.trim(judge)) == F.lower(F.trim(generator))


def last_scores(rows: DataFrame, item: str, judge: str, score: Column, time: str) -> DataFrame:
    """Columns (item, judge, score): each judge's latest score of an item, by time and then the greater."""
    s = rows.select(F.col(item).alias("item"), F.col(judge).alias("judge"), score.alias("score"), F.col(time).alias("at")).filter("score IS NOT NULL AND item IS NOT NULL AND judge IS NOT NULL")
    return s.groupBy("item", "judge").agg(F.max(F.struct("at", "score"))["score"].alias("score"))


def dominant(rows: DataFrame, key: str) -> DataFrame:
    """Rows with the commonest value of key; ties go to the least value."""
    best = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).agg(F.min(F.struct(-F.col("n"), F.col(key).alias("v"))).alias("b")).select(F.col("b.v").alias(key))
    return rows.join(F.broadcast(best), key, "left_semi")  # one row


def dominant_panel(scores: DataFrame) -> DataFrame:
    """Scores of the items whose judges include the commonest panel, and of its judges alone."""
    panels = scores.groupBy("item").agg(F.array_sort(F.collect_set("judge")).alias("panel"))
    best = panels.groupBy("panel").agg(F.count("*").alias("n")).agg(F.min(F.struct(-F.col("n"), F.col("panel"))).alias("b")).select(F.col("b.panel").alias("best"))
    held = panels.join(F.broadcast(best)).filter(F.size(F.array_except("best", "panel")) == 0).select("item", "best")  # one row
    return scores.join(held, "item").filter(F.array_contains("best", F.col("judge"))).select("item", "judge", "score")


def pairs(scores: DataFrame) -> DataFrame:
    """One row (a, b, item, x, y) for each item two judges scored; an item has at most one score of a judge."""
    left = scores.select("item", F.col("judge").alias("a"), F.col("score").alias("x"))
    right = scores.select("item", F.col("judge").alias("b"), F.col("score").alias("y"))
    return left.join(right, "item").filter("a < b")


def _mid_ranks(p: DataFrame, value: str) -> DataFrame:
    c = p.groupBy("a", "b", value).agg(F.count("*").alias("n"))
    w = Window.partitionBy("a", "b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return c.select("a", "b", value, (F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2).alias(f"r{value}"))


def pair_agreement(scores: DataFrame) -> DataFrame:
    """For each pair of judges: n, exact, within one, quadratic kappa, rank correlation and ordinal alpha.

    Kappa needs only means and variances; rank correlation is the correlation of mid-ranks; ordinal alpha is
    interval alpha on mid-ranks of both judges' scores together.  Nothing but sums is shuffled for them.
    """
    p = pairs(scores)
    ranked = p.join(_mid_ranks(p, "x"), ["a", "b", "x"]).join(_mid_ranks(p, "y"), ["a", "b", "y"])
    d = F.col("x") - F.col("y")
    base = ranked.groupBy("a", "b").agg(
        F.count("*").alias("n"), F.avg((d == 0).cast("double")).alias("exact"), F.avg((F.abs(d) <= 1).cast("double")).alias("within1"), F.avg(d * d).alias("sq"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("rx").alias("wx"), F.var_pop("ry").alias("wy"), F.covar_pop("rx", "ry").alias("cxy")
    )
    both = p.select("a", "b", F.explode(F.array("x", "y")).alias("v")).groupBy("a", "b", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("a", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    mid = both.select("a", "b", "v", (F.coalesce(F.sum("n").over(w), F.lit(0)) + F.col("n") / 2).alias("m"), F.col("n").alias("k"))
    spread = mid.groupBy("a", "b").agg(F.sum("k").alias("t"), (F.sum(F.col("k") * F.col("m") * F.col("m")) / F.sum("k") - F.pow(F.sum(F.col("k") * F.col("m")) / F.sum("k"), F.lit(2))).alias("var"))
    mx, my = mid.select("a", "b", F.col("v").alias("x"), F.col("m").alias("px")), mid.select("a", "b", F.col("v").alias("y"), F.col("m").alias("py"))
    apart = p.join(mx, ["a", "b", "x"]).join(my, ["a", "b", "y"]).groupBy("a", "b").agg(F.sum(F.pow(F.col("px") - F.col("py"), F.lit(2))).alias("apart"))
    expected = F.col("vx") + F.col("vy") + F.pow(F.col("mx") - F.col("my"), F.lit(2))
    j = base.join(spread, ["a", "b"]).join(apart, ["a", "b"])
    return j.select(
        "a",
        "b",
        "n",
        "exact",
        "within1",
        F.when(expected > 0, 1 - F.col("sq") / expected).alias("kappa_w"),
        F.when((F.col("wx") > 0) & (F.col("wy") > 0), F.col("cxy") / F.sqrt(F.col("wx") * F.col("wy"))).alias("spearman"),
        F.when(F.col("var") > 1e-12, 1 - (F.col("t") - 1) * F.col("apart") / (F.col("t") * F.col("t") * F.col("var"))).alias("alpha"),
    )


def ordinal_alpha(scores: DataFrame, least: int = 2) -> DataFrame:
    """One row (items, scores, alpha): ordinal alpha over items with at least `least` scores, whoever gave them."""
    units = scores.withColumn("m", F.count("*").over(Window.partitionBy("item"))).filter(F.col("m") >= max(2, least))
    c = units.groupBy("score").agg(F.count("*").alias("n"))
    w = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)  # one row a level of the scale
    mid = c.select("score", (F.coalesce(F.sum("n").over(w), F.lit(0)) + F.col("n") / 2).alias("mid"))
    u = units.join(F.broadcast(mid), "score").groupBy("item").agg(F.count("*").alias("m"), F.var_pop("mid").alias("v"), F.sum("mid").alias("s1"), F.sum(F.col("mid") * F.col("mid")).alias("s2"))
    t = u.agg(F.count("*").alias("items"), F.sum("m").alias("scores"), F.sum(F.col("m") * F.col("m") * F.col("v") / (F.col("m") - 1)).alias("within"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    n = F.col("scores")
    var = F.col("s2") / n - F.pow(F.col("s1") / n, F.lit(2))
    return t.select("items", F.coalesce(n, F.lit(0)).alias("scores"), F.when(var > 1e-12, 1 - (n - 1) * F.col("within") / (n * n * var)).alias("alpha"))


def nominal_kappa(scores: DataFrame) -> DataFrame:
    """Cohen's kappa of each pair of judges on unordered classes, with the usual word for it."""
    p = pairs(scores)
    n = p.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("po"))
    x = p.groupBy("a", "b", F.col("x").alias("v")).agg(F.count("*").alias("nx"))
    y = p.groupBy("a", "b", F.col("y").alias("v")).agg(F.count("*").alias("ny"))
    e = x.join(y, ["a", "b", "v"]).groupBy("a", "b").agg(F.sum(F.col("nx") * F.col("ny")).alias("e"))
    pe = F.coalesce("e", F.lit(0)) / (F.col("n") * F.col("n"))
    k = n.join(e, ["a", "b"], "left").select("a", "b", "n", F.when(pe < 1, (F.col("po") - pe) / (1 - pe)).otherwise(1.0).alias("kappa"))
    word = F.when(F.col("kappa") < 0.2, "poor").when(F.col("kappa") < 0.4, "fair").when(F.col("kappa") < 0.6, "moderate").when(F.col("kappa") < 0.8, "good").otherwise("very good")
    return k.withColumn("word", word)


def majority(scores: DataFrame) -> DataFrame:
    """Columns (item, judges, vote, votes, amplitude): the commonest score, the lowest of equals."""
    c = scores.groupBy("item", "score").agg(F.count("*").alias("n"))
    return c.groupBy("item").agg(F.sum("n").alias("judges"), F.min(F.struct(-F.col("n"), "score")).alias("b"), (F.max("score") - F.min("score")).alias("amplitude")).select("item", "judges", F.col("b.score").alias("vote"), (-F.col("b.col1")).alias("votes"), "amplitude")


def chance_of_majority(judges: int, levels: int) -> float:
    """Chance that two of so many judges agree if they score at random."""
    apart = 1.0
    for i in range(judges):
        apart *= max(0, levels - i) / levels
    return 1.0 - apart


def coverage(scores: DataFrame, levels: int) -> DataFrame:
    """By number of judges: items, share with a majority of two, mean amplitude, and the share chance would give."""
    m = majority(scores).groupBy("judges").agg(F.count("*").alias("items"), F.avg((F.col("votes") >= 2).cast("double")).alias("covered"), F.avg("amplitude").alias("amplitude"))
    apart = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("judges") - 1), F.lit(1.0), lambda a, i: a * F.greatest(F.lit(0), F.lit(levels) - i) / levels)
    return m.withColumn("chance", 1 - apart)


def strong_disagreements(scores: DataFrame, least: int = 2) -> DataFrame:
    return majority(scores).filter(F.col("amplitude") >= least).select("item", "judges", "amplitude")


def is_refusal(answer: Column) -> Column:
    plain = fold(F.coalesce(answer, F.lit("")))
    out = F.lit(False)
    for p in REFUSALS:
        out = out | plain.rlike(p)
    return out


def refusal_rates(answers: DataFrame) -> DataFrame:
    """Of (answer, should_answer): refusals where right and where wrong, shares to four places, null without a base."""
    r = answers.select(is_refusal(F.col("answer")).alias("r"), F.coalesce("should_answer", F.lit(False)).alias("s"))
    t = r.agg(F.count_if(~F.col("s")).alias("unanswerable"), F.count_if(~F.col("s") & F.col("r")).alias("right"), F.count_if("s").alias("answerable"), F.count_if(F.col("s") & F.col("r")).alias("wrong"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4))
    return t.select("unanswerable", "right", share("right", "unanswerable").alias("right_share"), "answerable", "wrong", share("wrong", "answerable").alias("wrong_share"))


def quality_matrix(scores: DataFrame, top: int) -> DataFrame:
    """By (generator, scenario, criterion): answers, mean score, share at the top of the scale."""
    return scores.groupBy("generator", "scenario", "criterion").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.avg((F.col("score") == top).cast("double")).alias("ok"))


def wide_scores(scores: DataFrame, judges: list[str]) -> DataFrame:
    """One row an item, one column a judge, and the mean to two places."""
    return scores.groupBy("item").pivot("judge", judges).agg(F.first("score")).join(scores.groupBy("item").agg(F.round(F.avg("score"), 2).alias("mean")), "item")


def complete_judge(have: DataFrame, new: DataFrame) -> DataFrame:
    """Scores with what one more run gave: new where there was none, the old kept."""
    return have.alias("h").join(new.alias("n"), ["item", "judge"], "full").select("item", "judge", F.coalesce("h.score", "n.score").alias("score"))


def audit_sample(rows: DataFrame, key: str, cell: list[str], per_cell: int, seed: str = "7", lot: int = 30) -> DataFrame:
    """Up to `per_cell` rows of each cell by seeded hash, in a shuffled order that tells nothing of the cell, in lots.

    Ranking is by hash within a cell and a slice of the hash first, so a cell is never sorted whole in one task.
    """
    h = draw(F.lit(seed), F.col(key))
    slices = rows.withColumn("h", h).withColumn("slice", F.col("h") % 64)
    first = slices.withColumn("r", F.row_number().over(Window.partitionBy(*cell, "slice").orderBy("h", key))).filter(F.col("r") <= per_cell)
    taken = first.withColumn("r", F.row_number().over(Window.partitionBy(*cell).orderBy("h", key))).filter(F.col("r") <= per_cell)
    place = F.row_number().over(Window.orderBy(draw(F.lit(seed + "/show"), F.col(key)), key))  # a sample of stated size
    return taken.withColumn("place", place).select(key, *cell, "place", (F.floor((F.col("place") - 1) / lot) + 1).alias("lot"))


def discordant_first(rows: DataFrame, size: int, seed: str = "7") -> DataFrame:
    """Of (item, x, y): all discordant rows first, then those both affirm, then the rest, in seeded order, up to size."""
    kind = F.when(F.col("x") != F.col("y"), 0).when(F.col("x") == 3, 1).otherwise(2)
    return rows.withColumn("kind", kind).withColumn("h", draw(F.lit(seed), F.col("item"))).orderBy("kind", "h", "item").limit(size).select("item", "x", "y", "kind")
