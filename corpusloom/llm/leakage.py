"""Problem 7: evaluation passages inside a training corpus, by winnowed fingerprints.

Every k-word window of a text is hashed and of each w neighbouring hashes the least is kept, the rightmost
on ties.  Two texts that share at least t = w + k - 1 consecutive words share a kept hash, so joining the
fingerprints of corpus and items misses no such span.  A hit carries the hashes of the t - k words on
either side of its window; the span reaches t words exactly if enough of them agree, so hits are extended
without reading a text again.

Defined cases: null, empty and blank texts and texts under t words have no fingerprints and no rows.
Repeated rows with the same ids count once.  Columns besides the key and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import gram_hashes, word_hashes

SPAN_WORDS = 12
GRAM_WORDS = 9
#: Most item fingerprints sent to the workers to drop other hashes at once: their hashes take 1.6 MB, with the
#: words around them under 20 MB; with more, all fingerprints of the corpus are shuffled and joined, where the
#: engine splits a hash that is met too often.
FILTER_LIMIT = 200_000
SLICE_ROWS = 1_000


def winnow(hashes: np.ndarray, w: int, whole: np.ndarray | None = None) -> np.ndarray:
    """Positions of the least of every w neighbouring hashes, the rightmost on ties; whole: which windows count."""
    n = len(hashes) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least, at = hashes[w - 1 :].copy(), np.arange(w - 1, w - 1 + n)
    for j in range(w - 2, -1, -1):
        lower = hashes[j : j + n] < least
        least = np.where(lower, hashes[j : j + n], least)
        at = np.where(lower, np.arange(j, j + n), at)
    return np.unique(at if whole is None else at[whole])


def fingerprints(texts: DataFrame, key: str, text: str, k: int, t: int, only: np.ndarray | None = None) -> DataFrame:
    """Columns (key, gram, around): each kept hash and the t - k word hashes before and after its window, 0 beyond the text."""
    side = t - k
    wanted = None if only is None else texts.sparkSession.sparkContext.broadcast(np.sort(only))
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(start, SLICE_ROWS)
                words, offsets = word_hashes(batch.column(1).to_pylist())
                sizes = np.diff(offsets)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                grams = gram_hashes(words, k)
                # Only windows of grams that lie in one text count.
                at = winnow(grams, side + 1, owner[: max(0, len(owner) - t + 1)] == owner[t - 1 :])
                if wanted is not None and len(at):
                    keys = wanted.value
                    if not len(keys):
                        continue
                    spot = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
                    at = at[keys[spot] == grams[at]]
                if not len(at):
                    continue
                own = owner[at]
                reach = np.concatenate([np.arange(-side, 0), np.arange(k, k + side)])
                spots = at[:, None] + reach[None, :]
                inside = (spots >= offsets[own][:, None]) & (spots < offsets[own + 1][:, None])
                around = np.where(inside, words[np.clip(spots, 0, len(words) - 1)], 0).astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(own)),
                        pa.array(grams[at].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(reach)), pa.array(around.ravel())),
                    ],
                    names=["key", "gram", "around"],
                )

    return texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, gram bigint, around array<bigint>")


def _agreeing(a: Column, b: Column, spots: list[int]) -> Column:
    """How many of the word hashes at spots, from the first on, agree without a gap."""
    total, so_far = F.lit(0), F.lit(True)
    for i in spots:
        so_far = so_far & (a[i] == b[i]) & (a[i] != 0)
        total = total + so_far.cast("int")
    return total


def find_leaks(
    corpus: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", span: int = SPAN_WORDS, gram: int = GRAM_WORDS
) -> DataFrame:
    """Each (document, item) that share at least `span` consecutive words, once.

    items must be a held-out set; up to FILTER_LIMIT of its fingerprints filter the corpus in the workers.
    """
    if not 0 < gram <= span:
        raise ValueError("gram must be from 1 to span")
    side = span - gram
    tests = fingerprints(items, item_key, item_text, gram, span).select(F.col("key").alias("item"), "gram", F.col("around").alias("item_around")).dropDuplicates(["item", "gram", "item_around"])
    first = [r[0] for r in tests.select("gram").limit(FILTER_LIMIT + 1).collect()]
    only = np.unique(np.array(first, dtype=np.int64).view(np.uint64)) if len(first) <= FILTER_LIMIT else None
    hits = fingerprints(corpus, doc_key, doc_text, gram, span, only)
    joined = hits.join(F.broadcast(tests) if only is not None else tests, "gram")
    before = _agreeing(F.col("around"), F.col("item_around"), list(range(side - 1, -1, -1)))
    after = _agreeing(F.col("around"), F.col("item_around"), list(range(side, 2 * side)))
    return (
        joined.filter(before + after + gram >= span)
        .select(F.col("key").alias(doc_key), F.col("item").alias(item_key))
        .filter(F.col(doc_key).isNotNull() & F.col(item_key).isNotNull())
        .distinct()
    )
