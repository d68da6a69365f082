"""Problem 3: consensus of several annotators' labels by regularised minimax conditional entropy.

An annotator i who judges item j of true class c gives label k with probability proportional to
exp(s_i(c, k) + t_j(c, k)); s tilts by annotator, t by item.  The regularised dual is climbed by
coordinates: given s, each item's t and its label posterior are found together, item by item; given the
posteriors, every s_i takes a damped Newton step from gradients and curvatures summed over all items,
until no tilt moves by more than SETTLED.  Items judged alike by the same annotators are one row with a
count.  Only the sums, 18 numbers an annotator, reach the driver, from each task those of the annotators it
met; items stay distributed in a checkpoint and carry no state from one round to the next, so lost
executors cost a task.

Defined cases: rows whose label is none of the spellings of a class, or whose item or annotator is null,
are no judgments; one judgment counts per annotator and item, the latest, ties by arrival and label;
an item needs `at_least` judgments for a row; ties of the posterior go to the class first in `classes`;
an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage

#: Folded spellings of the classes.
SPELLINGS = {"S": ["s", "sim", "si", "yes", "suficiente"], "PARCIAL": ["parcial", "parcialmente", "parc", "p", "partial"], "N": ["n", "nao", "no", "insuficiente"]}
#: Tilts are sent to every worker, 72 bytes an annotator.
MAX_ANNOTATORS = 1_000_000
#: Most rounds, and the move of a tilt under which the model has settled.
ROUNDS, INNER, SETTLED = 60, 6, 0.03
#: Weights of the squared tilts of annotators and of items.
ANNOTATOR_WEIGHT, ITEM_WEIGHT = 2.0, 4.0


def read_label(c: Column) -> Column:
    """The class a typed label means, or null."""
    folded = F.lower(F.regexp_replace(F.translate(F.lower(c), "áàâãäéêíóôõúüç", "aaaaaeeiooouuc"), r"[^a-z]+", ""))
    out = F.lit(None).cast("string")
    for name, forms in SPELLINGS.items():
        out = F.when(folded.isin(forms), F.lit(name)).otherwise(out)
    return out


def judgments(rows: DataFrame, item: str, annotator: str, label: str, time: str, arrival: str) -> DataFrame:
    """Columns (item, annotator, label): one judgment per annotator and item."""
    read = rows.select(F.col(item).cast("string").alias("item"), F.col(annotator).cast("string").alias("annotator"), read_label(F.col(label)).alias("label"), F.col(time).alias("at"), F.col(arrival).alias("came"))
    valid = read.filter(F.col("item").isNotNull() & F.col("annotator").isNotNull() & F.col("label").isNotNull())
    last = valid.groupBy("item", "annotator").agg(F.max(F.struct("at", "came", "label")).alias("last"))
    return last.select("item", "annotator", F.col("last.label").alias("label"))


def posteriors(owner: np.ndarray, who: np.ndarray, label: np.ndarray, items: int, s: np.ndarray, prior: np.ndarray, inner: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each item's class, probability of every label for each judgment and class) given the annotators' tilts.

    owner is in ascending order and every item has a judgment.
    """
    n, classes = len(owner), len(prior)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    given = np.zeros((n, 1, classes))
    given[np.arange(n), 0, label] = 1.0
    pick = (np.arange(n)[:, None], np.arange(classes)[None, :], label[:, None])
    own, log_prior = s[who], np.log(prior)

    def judge(p: np.ndarray) -> np.ndarray:
        return _softmax(np.add.reduceat(np.log(np.maximum(p[pick], 1e-12)), first, axis=0) + log_prior)

    # First posteriors from the annotators' tilts alone; later ones with the items' tilts.
    t = np.zeros((items, classes, classes))
    p = _softmax(own)
    q = judge(p)
    for _ in range(inner):
        weight = q[owner][:, :, None]
        slope = np.add.reduceat(weight * (given - p), first, axis=0)
        bend = np.add.reduceat(weight * p * (1 - p), first, axis=0) + ITEM_WEIGHT
        t = t + (slope - ITEM_WEIGHT * t) / bend
        p = _softmax(own + t[owner])
        q = judge(p)
    return q, p


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _unpack(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    code = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(lists)), sizes)
    return owner, code // 3, code % 3, len(lists)


class Consensus:
    """A fitted model: annotators, their tilts and the class prior."""

    def __init__(self, judged: DataFrame, rounds: int = ROUNDS):
        self.classes = list(SPELLINGS)
        names = [r[0] for r in judged.select("annotator").distinct().limit(MAX_ANNOTATORS + 1).collect()]
        if len(names) > MAX_ANNOTATORS:
            raise ValueError(f"more than {MAX_ANNOTATORS} annotators")
        self.annotators = sorted(names)
        spark = judged.sparkSession
        index = spark.createDataFrame([(a, i) for i, a in enumerate(self.annotators)], "annotator string, who int")
        number = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col("label")) - 1
        # An item has at most one judgment of each annotator, whose number is bounded by MAX_ANNOTATORS.
        coded = judged.join(index, "annotator").select("item", (F.col("who") * 3 + number.cast("int")).cast("int").alias("code"))
        self.items = cut_lineage(coded.groupBy("item").agg(F.sort_array(F.collect_list("code")).alias("codes")))
        # Spread by hash over all cores, whatever size the engine thinks best for so few bytes.
        self.kinds = cut_lineage(self.items.groupBy("codes").agg(F.count("*").alias("items")).repartition(spark.sparkContext.defaultParallelism, "codes"))
        w, c = len(self.annotators), len(self.classes)
        # At the start everyone is held to be right more often than not.
        self.s = np.tile(np.log(np.where(np.eye(c) > 0, 0.6, 0.4 / (c - 1))), (max(w, 1), 1, 1)) if w else np.zeros((0, c, c))
        self.s -= self.s.mean(axis=-1, keepdims=True)
        self.prior = np.full(c, 1.0 / c)
        self.centre = self.s.copy()
        self.rounds = 0
        while w and self.rounds < rounds and self._step(1.0 if self.rounds < 5 else 0.7) > SETTLED:
            self.rounds += 1

    def _sums(self) -> np.ndarray:
        s, prior, w, c = self.s, self.prior, len(self.annotators), len(self.classes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, values, mass = [], [], np.zeros(c)
            for batch in batches:
                if not batch.num_rows:
                    continue
                owner, who, label, items = _unpack(batch.column(0))
                times = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                q, p = posteriors(owner, who, label, items, s, prior)
                given = np.zeros((len(owner), 1, c))
                given[np.arange(len(owner)), 0, label] = 1.0
                weight = (q * times[:, None])[owner][:, :, None]
                # Sums by annotator, for those of the batch only.
                order = np.argsort(who, kind="stable")
                seen, first = np.unique(who[order], return_index=True)
                sums = [np.add.reduceat(x.reshape(len(owner), c * c)[order], first, axis=0) for x in (weight * (given - p), weight * p * (1 - p))]
                at.append((seen[:, None] * 2 * c * c + np.arange(2 * c * c)[None, :]).ravel())
                values.append(np.concatenate(sums, axis=1).ravel())
                mass += (q * times[:, None]).sum(axis=0)
            if at:
                at.append(w * 2 * c * c + np.arange(c))
                values.append(mass)
                spots, back = np.unique(np.concatenate(at), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(spots.astype(np.int64)), pa.array(np.bincount(back, weights=np.concatenate(values)))], names=["at", "value"])

        flat = np.zeros(2 * w * c * c + c)
        for r in self.kinds.mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
            flat[r["at"]] = r["value"]
        return flat

    def _step(self, pace: float) -> float:
        """Moves the tilts; how far the one moved that moved most."""
        w, c = len(self.annotators), len(self.classes)
        flat = self._sums()
        both = flat[: 2 * w * c * c].reshape(w, 2, c, c)
        slope, bend = both[:, 0], both[:, 1]
        move = pace * np.clip((slope - ANNOTATOR_WEIGHT * (self.s - self.centre)) / (bend + ANNOTATOR_WEIGHT), -1.5, 1.5)
        self.s = self.s + move
        mass = flat[2 * w * c * c :] + 1.0
        self.prior = mass / mass.sum()
        return float(np.abs(move).max())

    def labels(self, at_least: int = 3) -> DataFrame:
        """Columns (item, label, confidence, judgments) of each item with enough judgments."""
        s, prior, classes = self.s, self.prior, self.classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                owner, who, label, items = _unpack(batch.column(1))
                q, _ = posteriors(owner, who, label, items, s, prior)
                best = np.argmax(np.round(q, 12), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([classes[i] for i in best]), pa.array(q[np.arange(items), best]), pa.array(np.bincount(owner, minlength=items).astype(np.int32))],
                    names=["item", "label", "confidence", "judgments"],
                )

        return self.items.filter(F.size("codes") >= at_least).mapInArrow(run, "item string, label string, confidence double, judgments int")

    def reliability(self) -> list[tuple[str, float]]:
        """For each annotator the chance of giving the true class, over the classes' shares."""
        p = _softmax(self.s)
        return [(a, float((self.prior * np.diagonal(p[i])).sum())) for i, a in enumerate(self.annotators)]


def agreement(judged: DataFrame) -> DataFrame:
    """One row: items with two judgments or more, pairable judgments, observed and expected disagreement, nominal alpha (null if undefined)."""
    sizes = judged.groupBy("item", "label").agg(F.count("*").alias("n"))
    items = sizes.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("squares")).filter("m >= 2")
    observed = items.agg(F.count("*").alias("items"), F.sum("m").alias("judgments"), F.sum((F.col("m") * F.col("m") - F.col("squares")) / (F.col("m") - 1)).alias("apart"))
    shares = sizes.join(items.select("item"), "item").groupBy("label").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    both = observed.crossJoin(shares)  # one row each
    do = F.col("apart") / F.col("judgments")
    de = (F.col("total") * F.col("total") - F.col("squares")) / (F.col("total") * (F.col("total") - 1))
    return both.select("items", F.coalesce("judgments", F.lit(0)).alias("judgments"), do.alias("observed"), F.when(F.col("total") > 1, de).alias("expected"), F.when((F.col("total") > 1) & (de > 0), 1 - do / de).alias("alpha"))
