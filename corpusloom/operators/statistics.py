"""Paired tests, resampling with reproducible draws, effect sizes, corrections and threshold choices."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.metrics import normal_cdf
from corpusloom.session import cut_lineage


def draw(*parts: Column | str) -> Column:
    """A whole number from 0 to 2^32 - 1 that depends on the parts alone: the first eight hex digits of their MD5."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("long")


#: Bits of one MD5, and draws of 16 bits in it.
BITS, DRAWS = 128, 8
#: A draw of 16 bits counts as many as there are bounds up to it: 65,536 times the cumulated Poisson chances of mean 1.
POISSON_BOUNDS = [round(65_536 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(8)]
#: Rows drawn at a time for all rounds.
DRAW_ROWS = 64


def _digests(keys: list, seed: str, groups: int) -> np.ndarray:
    """MD5 of seed, group and key, as bytes: rows x groups x 16."""
    raw = b"".join(hashlib.md5(f"{seed}|{g}|{k}".encode()).digest() for k in keys for g in range(groups))
    return np.frombuffer(raw, dtype=np.uint8).reshape(len(keys), groups, 16)


def _summed(rows: DataFrame, rounds: int, sums: Callable[[list, np.ndarray], list[np.ndarray]], names: list[str]) -> DataFrame:
    """Of (key, x): for each round the named sums, added up where the rows lie before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(rounds) for _ in names]
        met = False
        for whole in batches:
            for at in range(0, whole.num_rows, DRAW_ROWS):
                part = whole.slice(at, DRAW_ROWS)
                for t, s in zip(total, sums(part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False).astype(float))):
                    t += s
                met = True
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds)), *[pa.array(t) for t in total]], names=["round", *names])

    parts = rows.mapInArrow(run, "round bigint, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy("round").agg(*[F.sum(n).alias(n) for n in names])


def paired_randomization(diffs: DataFrame, rounds: int = 10_000, seed: str = "7") -> DataFrame:
    """Of (key, diff): mean, rounds at least as far from 0 with signs drawn anew, p = (count + 1) / (rounds + 1); 1 if all are 0.

    The sign of a round is a bit of the MD5 of seed, block of BITS rounds and key.  Rows without a difference do not count.
    """
    rows = diffs.select(F.col("key").cast("string").alias("key"), F.col("diff").cast("double").alias("diff")).filter("diff IS NOT NULL")

    def sums(keys: list, x: np.ndarray) -> list[np.ndarray]:
        minus = np.unpackbits(_digests(keys, seed, -(-rounds // BITS)), axis=2).reshape(len(keys), -1)[:, :rounds]
        return [x.sum() - 2 * (x @ minus)]

    own = rows.agg(F.avg("diff").alias("mean"), F.max(F.abs("diff")).alias("most"), F.count("*").alias("n"))
    signed = _summed(rows, rounds, sums, ["s"]).join(own)  # one row
    return signed.groupBy("mean", "most", "n").agg(F.count_if(F.round(F.abs(F.col("s") / F.col("n")), 9) >= F.round(F.abs("mean"), 9)).alias("c")).select("n", "mean", F.when(F.col("most") == 0, 1.0).otherwise((F.col("c") + 1) / (rounds + 1)).alias("p"))


def before(rows: DataFrame, by: list[str], sums: dict[str, str]) -> DataFrame:
    """Rows with the sums of columns over all rows before them in the order of `by`, which tells every row apart; sums: new name -> column.

    Rows are spread by ranges of the order, summed in each range, and moved on by what the ranges before hold;
    only one row a range meets in one task.
    """
    ranged = cut_lineage(rows.repartitionByRange(*[F.col(c) for c in by]).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    moved = totals.select("_range", *[F.coalesce(F.sum(f"_{n}").over(ahead), F.lit(0)).alias(f"_{n}") for n in sums])
    own = ranged.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    return own.join(F.broadcast(moved), "_range").withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_range", *[f"_{n}" for n in sums])


def signed_ranks(diffs: DataFrame) -> DataFrame:
    """Wilcoxon's test of (key, diff): zeros dropped, mean ranks for ties, two-sided normal approximation with tie correction."""
    d = diffs.filter("diff <> 0").withColumn("a", F.round(F.abs("diff"), 9))
    sizes = d.groupBy("a").agg(F.count("*").alias("t"), F.count_if(F.col("diff") > 0).alias("up"))
    r = before(sizes, ["a"], {"upto": "t"}).withColumn("rank", F.col("upto") + (F.col("t") + 1) / 2)
    s = r.agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n = F.col("n")
    sd = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    z = (F.col("w") - n * (n + 1) / 4) / sd
    return s.select("n", "w", z.alias("z"), F.when(sd > 0, 2 * normal_cdf(-F.abs(z))).otherwise(1.0).alias("p"))


def bootstrap_interval(values: DataFrame, rounds: int = 10_000, seed: str = "7", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Of (key, x): the mean and its percentile interval over resamples.

    How often a row is in a resample is drawn for itself, as a Poisson count of mean 1, from 16 bits of the MD5 of
    seed, block of DRAWS rounds and key; so no round needs to know the rows, only sums are shuffled.
    """
    rows = values.select(F.col("key").cast("string").alias("key"), F.col("x").cast("double").alias("x")).filter("x IS NOT NULL")
    bounds = np.array(POISSON_BOUNDS)

    def sums(keys: list, x: np.ndarray) -> list[np.ndarray]:
        pairs = _digests(keys, seed, -(-rounds // DRAWS)).reshape(len(keys), -1, 2)[:, :rounds].astype(np.int64)
        times = np.searchsorted(bounds, pairs[..., 0] * 256 + pairs[..., 1], side="right").astype(float)
        return [x @ times, times.sum(axis=0)]

    means = _summed(rows, rounds, sums, ["s", "n"]).filter("n > 0").select((F.col("s") / F.col("n")).alias("m"))
    own = rows.agg(F.avg("x").alias("mean"))
    return means.agg(F.percentile("m", low).alias("low"), F.percentile("m", high).alias("high")).join(own)  # one row


def cliffs_delta(rows: DataFrame) -> DataFrame:
    """Of (side, x) with sides a and b: the share of pairs a > b less that of a < b, by cumulated counts instead of pairs."""
    c = rows.groupBy("x").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    below = before(c, ["x"], {"under": "b"})
    s = below.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(F.col("a") * (2 * F.col("under") + F.col("b"))).alias("s"))
    return s.select("na", "nb", (F.col("s") / (F.col("na") * F.col("nb")) - 1).alias("delta"))


def auc(rows: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """Chance that a positive scores over a negative, ties half; null without either."""
    r = rows.select(F.when(F.col(positive), "a").otherwise("b").alias("side"), F.col(score).alias("x"))
    d = cliffs_delta(r)
    return d.select(F.col("na").alias("positives"), F.col("nb").alias("negatives"), ((F.col("delta") + 1) / 2).alias("auc"))


def corrections(tests: DataFrame, by: str | None = None) -> DataFrame:
    """Of (name, p): Bonferroni, Holm and Benjamini-Hochberg adjusted values within each family; ties by name."""
    parts = [by] if by else []
    w = Window.partitionBy(*parts)
    up = w.orderBy("p", "name")
    m, i = F.count("*").over(w), F.row_number().over(up)
    t = tests.withColumns({"m": m, "i": i})
    holm = F.least(F.lit(1.0), F.max((F.col("m") - F.col("i") + 1) * F.col("p")).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    bh = F.least(F.lit(1.0), F.min(F.col("p") * F.col("m") / F.col("i")).over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    return t.select(*parts, "name", "p", F.least(F.lit(1.0), F.col("p") * F.col("m")).alias("bonferroni"), holm.alias("holm"), bh.alias("bh"))


def step_up_cutoff(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """How many tests the step-up rule rejects, the largest p among them, and Bonferroni's threshold."""
    placed = before(tests.withColumn("one", F.lit(1).cast("long")), ["p", "name"], {"i": "one"}).withColumn("i", F.col("i") + 1)
    t = placed.crossJoin(F.broadcast(tests.agg(F.count("*").alias("m"))))  # one row
    ok = F.col("p") <= F.col("i") / F.col("m") * alpha
    return t.agg(F.coalesce(F.max(F.when(ok, F.col("i"))), F.lit(0)).alias("rejected"), F.max(F.when(ok, F.col("p"))).alias("cutoff"), (F.lit(alpha) / F.max("m")).alias("bonferroni"))


def exact_mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact p of discordant counts: twice the binomial tail up to the smaller, at most 1; summed in logarithms."""
    n, k = b + c, F.least(b, c)
    start = F.struct(F.lit(0.0).alias("log"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def add(a: Column, i: Column) -> Column:
        log = a["log"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log - n * F.log(F.lit(2.0)))).alias("sum"))

    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>")), start, add)["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def threshold_sweep(rows: DataFrame, steps: int = 100) -> DataFrame:
    """Of (score, positive): what refusing below each of `steps` thresholds gets: (threshold, refused_negatives, refused_positives).

    Rows are counted by the step they fall in first, so each threshold costs one row, not one pass.
    """
    band = F.least(F.greatest(F.floor(F.col("score") * steps), F.lit(0)), F.lit(steps)).cast("long")
    counts = rows.groupBy(band.alias("k")).agg(F.count_if(~F.col("positive")).alias("neg"), F.count_if(F.col("positive")).alias("pos"))
    grid = rows.sparkSession.range(1, steps).select(F.col("id").alias("k0"))
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    full = grid.join(counts, F.col("k0") == F.col("k"), "full").select(F.coalesce("k0", "k").alias("k"), F.coalesce("neg", F.lit(0)).alias("neg"), F.coalesce("pos", F.lit(0)).alias("pos"))
    run = full.withColumns({"refused_negatives": F.coalesce(F.sum("neg").over(w), F.lit(0)), "refused_positives": F.coalesce(F.sum("pos").over(w), F.lit(0))})
    return run.filter(F.col("k").between(1, steps - 1)).select((F.col("k") / steps).alias("threshold"), "refused_negatives", "refused_positives")


def split_threshold(rows: DataFrame, loss: float = 0.1, steps: int = 1_000) -> DataFrame:
    """Chooses on half A the threshold with most negatives refused at a loss of positives up to `loss`; measures it on half B."""
    half = (draw(F.lit("half"), F.col("key")) % 2).alias("half")
    r = rows.select("score", "positive", half)
    a, b = r.filter("half = 0"), r.filter("half = 1")
    positives = a.agg(F.count_if("positive").alias("p"))
    ok = threshold_sweep(a, steps).join(positives).filter(F.col("refused_positives") <= loss * F.col("p"))  # one row
    chosen = ok.agg(F.max(F.struct("refused_negatives", -F.col("threshold"))).alias("c")).select((-F.col("c.col2")).alias("threshold"))
    low = F.floor(F.col("score") * steps) < F.round(F.col("threshold") * steps)
    return b.join(chosen).groupBy("threshold").agg(F.avg(F.when(~F.col("positive"), low.cast("double"))).alias("refused"), F.avg(F.when(F.col("positive"), low.cast("double"))).alias("lost"))  # one row


def upper_median(name: str) -> Column:
    """Of a column: the element in the middle of the sorted values, the upper of two; values are counted, not collected."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)")


def noninferior(low: Column, margin: float = 0.03) -> Column:
    return low > -margin
