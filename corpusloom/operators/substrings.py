"""Texts that stand inside other texts of their group, met by hashes of spans that both choose alike.

A text of s to 2s bytes (s a power of two) looks at its first s/2 places, takes the one whose next bytes hash
least and keys itself by the s/2 bytes from there on.  A text that holds it has the same bytes in the same
window, so it chooses the same place, wherever the window lies: it takes the least place of every window of
s/2 places.  Keys of holders leave the workers only if a bitmap of all keys sought has them.  A pair that
shares a key is read: the bytes at the place that the key implies must have the digest of the whole text.
Texts are folded in the workers, all of a slice at once, and read from their source again for each pass; only
those with candidates are shuffled, once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import MARKED, PLAIN
from corpusloom.session import keep

#: Bytes whose hash decides which place of a window is taken.
GRAM = 8
#: Bytes worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 18
#: Bits of the bitmap of keys: so many a key, at least and at most.
KEY_BITS, LEAST_BITS, MOST_BITS = 64, 1 << 27, 1 << 31
#: Parts in which the bitmap is made.
PARTS = 64
#: Most holders whose candidates are sent to the workers instead of shuffling texts.
FEW_HOLDERS = 20_000

_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)
_powers: list[np.ndarray] = []


_BLANKS = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_GONE, _SIGMA = 0xFFFFFFFF, 0x3A3
_table: list[np.ndarray] = []


def _folding() -> np.ndarray:
    """What each code point becomes; _GONE where nothing."""
    if not _table:
        t = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (low := chr(c).lower()) != chr(c):
                t[c] = ord(low[0])  # what follows the first is a mark
        marked = dict(zip(map(ord, MARKED), map(ord, PLAIN)))
        for c, x in marked.items():
            t[t == c] = x
        t[[0xAD, *range(0x300, 0x370)]] = _GONE
        t[_BLANKS] = 0x20
        _table.append(t)
    return _table[0]


def fold_slice(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded texts (as `functions.text.fold`) of a buffer and where each begins."""
    read = data.tobytes().decode("utf-8", errors="replace")
    points = np.frombuffer(read.encode("utf-32-le"), dtype=np.uint32)
    if len(read) == len(data):
        sizes = np.diff(bounds)
    else:
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        sizes = np.diff(begins[bounds])
        if sizes.sum() != len(points):  # broken bytes
            parts = [data[a:b].tobytes().decode("utf-8", errors="replace") for a, b in zip(bounds, bounds[1:])]
            sizes, points = np.array([len(x) for x in parts], dtype=np.int64), np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
    new = _folding()[points]
    if (points == _SIGMA).any():  # the letter whose small form depends on its place
        ends = np.cumsum(sizes)
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(points == _SIGMA), side="right")).tolist():
            a, b = ends[i] - sizes[i], ends[i]
            low = points[a:b][points[a:b] != 0xAD].tobytes().decode("utf-32-le").replace("\u0130", "i").lower()
            new[a:b][points[a:b] != 0xAD] = _folding()[np.frombuffer(low.encode("utf-32-le"), dtype=np.uint32)]
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    live = new != _GONE
    if not live.all():
        new, owner = new[live], owner[live]
    blank = new == 0x20
    if len(new):
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        drop = blank & (first | np.concatenate([[False], blank[:-1]]))
        if drop.any():
            new, owner, blank = new[~drop], owner[~drop], blank[~drop]
        if len(new):
            last = blank & np.concatenate([owner[1:] != owner[:-1], [True]])
            if last.any():
                new, owner = new[~last], owner[~last]
    wide = 1 + (new >= 0x80) + (new >= 0x800).astype(np.int64) + (new >= 0x10000)
    sizes = np.bincount(owner, weights=wide, minlength=len(sizes)).astype(np.int64) if len(new) else np.zeros(len(sizes), dtype=np.int64)
    out = np.frombuffer(new.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), dtype=np.uint8)
    return out, np.concatenate([[0], np.cumsum(sizes)])


def _digests(data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """16 bytes that stand for each text."""
    raw = data.tobytes()
    return [hashlib.sha256(raw[a:b]).digest()[:16] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n at least."""
    if not _powers or len(_powers[0]) < n:
        one = np.ones(1, dtype=np.uint64)
        _powers[:] = [np.concatenate([one, np.cumprod(np.full(n, b, dtype=np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of the spans of texts that lie one behind the other in a buffer."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, groups: np.ndarray):
        self.n, self.starts, self.sizes = len(data), bounds[:-1], np.diff(bounds)
        power, self.inverse = _power_tables(self.n + 1)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * power[: self.n], out=self.sums[1:])
        self.groups = groups.astype(np.int64).view(np.uint64)

    def _hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        return _mix((self.sums[at + size] - self.sums[at]) * self.inverse[at])

    def places(self, k: int) -> np.ndarray:
        """Of every place the hash of the next k bytes above, the place itself below."""
        n = self.n - k + 1
        return (_mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n]) & ~_LOW) | np.arange(n, dtype=np.uint64)

    def _keys(self, at: np.ndarray, owner: np.ndarray, s: int) -> np.ndarray:
        return _mix(self._hashes(at, max(1, s // 2)) ^ _mix(self.groups[owner] + np.uint64(s))).view(np.int64)

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every text its key and the place in it; 0 for empty texts."""
        keys, where = np.zeros(len(self.sizes), dtype=np.int64), np.zeros(len(self.sizes), dtype=np.int64)
        level = _level(self.sizes)
        kept: dict[int, np.ndarray] = {}
        for j in np.unique(level[self.sizes > 0]).tolist():
            s, which = 1 << j, np.flatnonzero((level == j) & (self.sizes > 0))
            half = max(1, s // 2)
            k = min(GRAM, half)
            if k not in kept:
                # The last entry stops the last window where it would reach the end of the array.
                kept[k] = np.append(self.places(k), ~np.uint64(0))
            cuts = np.stack([self.starts[which], self.starts[which] + half], axis=1).ravel()
            at = (np.minimum.reduceat(kept[k], cuts)[::2] & _LOW).astype(np.int64)
            keys[which], where[which] = self._keys(at, which, s), at - self.starts[which]
        return keys, where

    def held(self, levels: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, place in it, key) of every window of these levels."""
        room = np.repeat(self.starts + self.sizes, self.sizes) - np.arange(self.n)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        least, width, gram = np.empty(0, dtype=np.uint64), 0, 0
        most = int(self.sizes.max()) if len(self.sizes) else 0
        for j in levels:
            s = 1 << j
            if s > most:
                break
            half = max(1, s // 2)
            k = min(GRAM, half)
            if k != gram:
                least, width, gram = self.places(k), 1, k
            while width < half:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            whole = np.flatnonzero(room[: len(least)] >= s)
            at = (least[whole] & _LOW).astype(np.int64)
            at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
            if len(at):
                yield owner[at], at - self.starts[owner[at]], self._keys(at, owner[at], s)


def _level(sizes: np.ndarray) -> np.ndarray:
    """The power of two that a size reaches."""
    return np.frexp(np.maximum(sizes, 1).astype(np.float64))[1] - 1


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts and where each begins."""
    a = texts.cast(pa.large_binary())
    bounds = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    held = a.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.empty(0, dtype=np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with their folded texts."""
    data, bounds = _buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, side="right")) - 1)
        yield batch.slice(at, to - at), *fold_slice(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        at = to


def marks(texts: DataFrame) -> DataFrame:
    """Columns (id, document, h, size, key, place) of texts (id, document, text): digest and bytes of the folded text, the key with its place; null texts give no row."""
    kinds = [texts.schema[c].dataType.simpleString() for c in ("id", "document")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, bounds in _slices(whole, 3):
                keys, where = Spans(data, bounds, batch.column(2).to_numpy()).own()
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(_digests(data, bounds), type=pa.binary()), pa.array(np.diff(bounds)), pa.array(keys), pa.array(where)], names=["id", "document", "h", "size", "key", "place"])

    rows = texts.filter("text IS NOT NULL").select("id", "document", F.xxhash64("document").alias("g"), "text")
    return rows.mapInArrow(run, f"id {kinds[0]}, document {kinds[1]}, h binary, size bigint, key bigint, place bigint")


def _bitmap(keys: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bit for every key's low bits, made in parts, and the number of bits."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, n * KEY_BITS):
        bits *= 2
    each = bits // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = batch.column(1).to_numpy()
            for p in np.unique(bit // each).tolist():
                mine = bit[bit // each == p] - p * each
                np.bitwise_or.at(parts.setdefault(p, np.zeros(each // 8, dtype=np.uint8)), mine >> 3, (1 << (mine & 7)).astype(np.uint8))
        for p, part in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([zlib.compress(part.tobytes(), 1)])], names=["p", "bits"])

    bit = keys.select(F.col("key").bitwiseAND(bits - 1).alias("bit")).select(F.floor(F.col("bit") / each).alias("p"), "bit")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in bit.repartition("p").mapInArrow(run, "p bigint, bits binary").collect():
        out[r.p * each // 8 : (r.p + 1) * each // 8] = np.frombuffer(zlib.decompress(bytes(r.bits)), dtype=np.uint8)
    return out, bits


def held_in(sought: DataFrame, holders: DataFrame) -> DataFrame:
    """Columns (document, in_h, out_h): texts that stand in others of their document, all folded.

    sought: `marks`, kept, without equal rows or empty texts; holders: texts (document, text).  Rows without a document meet none.
    """
    spark = sought.sparkSession
    sought = sought.filter("document IS NOT NULL").select("document", F.col("h").alias("in_h"), "size", "key", "place")
    levels = sorted(r.j for r in sought.select((F.length(F.bin("size")) - 1).alias("j")).distinct().collect())
    bitmap, bits = _bitmap(sought.select("key"), sought.count())
    shared = spark.sparkContext.broadcast(bitmap)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for batch, data, bounds in _slices(whole, 3):
                for owner, place, key in Spans(data, bounds, batch.column(2).to_numpy()).held(levels):
                    bit = key & (bits - 1)
                    hit = np.flatnonzero((known[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                    if len(hit):
                        rows = batch.select([0, 1]).take(pa.array(owner[hit]))
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.diff(bounds)[owner[hit]]), pa.array(place[hit]), pa.array(key[hit])], names=["document", "raw", "out_size", "out_place", "key"])

    # Until it is read a holder is known by the hash of its text as it stands.
    texts = holders.filter("text IS NOT NULL AND document IS NOT NULL").select("document", F.xxhash64("text").alias("raw"), "text")
    spots = texts.select("document", "raw", F.xxhash64("document").alias("g"), "text").mapInArrow(find, "document string, raw bigint, out_size bigint, out_place bigint, key bigint")
    start = F.col("out_place") - F.col("place")
    near = spots.join(sought, ["document", "key"]).filter((start >= 0) & (start + F.col("size") <= F.col("out_size")))
    wanted = keep(near.groupBy("document", "raw").agg(F.collect_set(F.struct(start.alias("start"), "size", "in_h")).alias("wanted")))
    if wanted.limit(FEW_HOLDERS + 1).count() <= FEW_HOLDERS:
        wanted = F.broadcast(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, bounds in _slices(whole, 1):
                raw, out = data.tobytes(), []
                for document, h, at, spots in zip(batch.column(0).to_pylist(), _digests(data, bounds), bounds.tolist(), batch.column(2).to_pylist()):
                    out += [(document, w["in_h"], h) for w in spots if hashlib.sha256(raw[at + w["start"] : at + w["start"] + w["size"]]).digest()[:16] == w["in_h"]]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], type=t) for k, t in enumerate((pa.string(), pa.binary(), pa.binary()))], names=["document", "in_h", "out_h"])

    return texts.join(wanted, ["document", "raw"]).select("document", "text", "wanted").mapInArrow(read, "document string, in_h binary, out_h binary").distinct()
