"""Problem 6: encode a corpus with a public byte-level BPE vocabulary by speculation and verification.

Words come from the vocabulary's public split pattern.  For the distinct words of a batch, a greedy
longest-match walk over the vocabulary proposes tokens for all words at once; the proposal equals the
merge result exactly when every adjacent token pair could stand unmerged side by side, which is tested
for all pairs at once; only words with a failing pair go through exact merging.

Defined cases: null, empty -> an empty list of ids, never null.  Blank text is text and has ids.  Rows are
never dropped; repeated rows give repeated results.  Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words kept per Python worker; beyond it the memory starts anew, results are the same.
MEMORY_WORDS = 400_000
#: Bytes of a word from which it is merged exactly at once, and all bytes of the words that are kept.
LONG_WORD, MEMORY_BYTES = 4_096, 64 << 20
#: Rows handled at a time in a worker.
SLICE_ROWS = 1_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a public vocabulary file lies on this machine."""
    spec = importlib.util.find_spec("public_tokenizers")
    home = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(home, name)


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a rank file."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ids of the vocabulary have gaps")
    return [ranks[i] for i in range(len(ranks))]


def merge_exactly(word: bytes, ids: dict[bytes, int], below: int | None = None) -> list[int]:
    """Byte-pair merging, lowest rank first, leftmost on ties; ranks at or above `below` are not used.

    Candidate pairs wait in a heap and parts are linked to their neighbours, so a word costs its length times
    the logarithm of its length.
    """
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    if n < 2:
        return [ids[p] for p in parts]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    most = len(ids) if below is None else below
    # A pair waits as its rank and its left part's place in one number.
    heap = [r * n + i for i in range(n - 1) if (r := ids.get(word[i : i + 2], most)) < most]
    heapq.heapify(heap)
    while heap:
        rank, i = divmod(heapq.heappop(heap), n)
        j = after[i] if parts[i] is not None else n
        if j >= n or ids.get(parts[i] + parts[j]) != rank:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ids.get(parts[i] + parts[k], most)) < most:
                heapq.heappush(heap, r * n + i)
        h = before[i]
        if h >= 0 and (r := ids.get(parts[h] + parts[i], most)) < most:
            heapq.heappush(heap, r * n + h)
    return [ids[p] for p in parts if p is not None]


class SpeculativeEncoder:
    """Encodes words in bulk with one vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        n = len(tokens)
        # The two tokens each token is merged from; a byte is merged from itself.
        left, right, odd = np.arange(n), np.arange(n), np.zeros(n, dtype=bool)
        for i, t in enumerate(tokens):
            if len(t) > 1:
                parts = merge_exactly(t, self.ids, below=i)
                if len(parts) == 2:
                    left[i], right[i] = parts
                else:
                    odd[i] = True
        self.left, self.right, self.odd = left, right, odd
        pairs = [(int(left[i]) * n + int(right[i]), i) for i in range(n) if len(tokens[i]) > 1 and not odd[i]]
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs], dtype=np.int64)
        self.pair_ids = np.array([i for _, i in pairs], dtype=np.int64)
        self._trie()

    def _trie(self) -> None:
        edges: dict[int, int] = {}
        accept = [-1]
        for i, t in enumerate(self.tokens):
            node = 0
            for b in t:
                key = node * 256 + b
                nxt = edges.get(key)
                if nxt is None:
                    nxt = edges[key] = len(accept)
                    accept.append(-1)
                node = nxt
            accept[node] = i
        keys = np.fromiter(edges.keys(), dtype=np.int64, count=len(edges))
        order = np.argsort(keys)
        self.edge_keys = keys[order]
        self.edge_to = np.fromiter(edges.values(), dtype=np.int64, count=len(edges))[order]
        self.accept = np.array(accept, dtype=np.int64)
        self.token_len = np.array([len(t) for t in self.tokens], dtype=np.int64)

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """values at wanted keys, -1 where a key is missing."""
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], -1)

    def propose(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words at once: (word number, token) in reading order."""
        pos = start.copy()
        live = np.flatnonzero(pos < end)
        words, found, step = [], [], []
        turn = 0
        while len(live):
            node = np.zeros(len(live), dtype=np.int64)
            at, best = pos[live].copy(), np.full(len(live), -1, dtype=np.int64)
            walking = np.arange(len(live))
            while len(walking):
                key = node[walking] * 256 + data[at[walking]]
                nxt = self._find(self.edge_keys, self.edge_to, key)
                walking = walking[nxt >= 0]
                nxt = nxt[nxt >= 0]
                node[walking] = nxt
                at[walking] += 1
                hit = self.accept[nxt]
                best[walking] = np.where(hit >= 0, hit, best[walking])
                walking = walking[at[walking] < end[live[walking]]]
            words.append(live)
            found.append(best)
            step.append(np.full(len(live), turn))
            pos[live] += self.token_len[best]
            live = live[pos[live] < end[live]]
            turn += 1
        if not words:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        word, token, order = np.concatenate(words), np.concatenate(found), np.concatenate(step)
        by = np.lexsort((order, word))
        return word[by], token[by]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging would leave them side by side.

        The last merges of the two tokens are undone in reverse order of rank; the pair fails as soon
        as tokens on either side of the seam could have been merged before the merge last undone.
        """
        n = len(self.tokens)
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit = np.full(len(a), n + 1, dtype=np.int64)
        while len(live):
            joined = self._find(self.pair_keys, self.pair_ids, a * n + b)
            bad = (joined >= 0) & (joined < limit)
            ok[live[bad]] = False
            keep = ~bad
            a, b, limit, live = a[keep], b[keep], limit[keep], live[keep]
            # Undo the later of the two merges; on equal ranks the right one, made leftmost first.
            undo_left = a > b
            cut_a, cut_b = self.right[a], self.left[b]
            whole_a, whole_b = cut_a == a, cut_b == b
            first = np.where(undo_left, ~whole_a, whole_b & ~whole_a)
            second = np.where(undo_left, whole_a & ~whole_b, ~whole_b)
            limit = np.where(first, a, np.where(second, b + 1, limit))
            a, b = np.where(first, cut_a, a), np.where(second, cut_b, b)
            more = first | second
            a, b, limit, live = a[more], b[more], limit[more], live[more]
        return ok

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """(flat ids, number of ids of each word, number of words merged exactly)."""
        # One walk serves all words at once; words of LONG_WORD bytes or more would keep it walking alone.
        long = [i for i, w in enumerate(words) if len(w) >= LONG_WORD]
        whole, words = words, [b"" if len(w) >= LONG_WORD else w for w in words] if long else words
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        end = np.cumsum(lens)
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        word, token = self.propose(data, end - lens, end)
        failed = np.zeros(len(words), dtype=bool)
        failed[long] = True
        failed[word[self.odd[token]]] = True
        seam = np.flatnonzero(word[1:] == word[:-1])
        failed[word[seam[~self.compatible(token[seam], token[seam + 1])]]] = True
        counts = np.bincount(word, minlength=len(words)).astype(np.int64)
        if not failed.any():
            return token.astype(np.int32), counts, 0
        fixed = {int(w): merge_exactly(whole[w], self.ids) for w in np.flatnonzero(failed)}
        bounds = np.cumsum(counts) - counts
        parts = [fixed[i] if i in fixed else token[bounds[i] : bounds[i] + counts[i]] for i in range(len(words))]
        counts = np.array([len(p) for p in parts], dtype=np.int64)
        return np.concatenate([np.asarray(p, dtype=np.int64) for p in parts]).astype(np.int32), counts, len(fixed)


class TextEncoder:
    """Encodes texts; words met before are looked up."""

    def __init__(self, encoder: SpeculativeEncoder):
        import regex

        self.split = regex.compile(SPLIT_PATTERN).findall
        self.encoder = encoder
        self.merged_exactly = 0
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.begin = np.zeros(1 << 15, dtype=np.int64)
        self.count = np.zeros(1 << 15, dtype=np.int64)
        self.words = self.used = self.bytes = 0

    def _learn(self, fresh: list[str]) -> None:
        raw = [w.encode("utf-8") for w in fresh]
        self.bytes += sum(map(len, raw))
        flat, counts, exact = self.encoder.encode_words(raw)
        self.merged_exactly += exact
        while self.words + len(fresh) > len(self.begin):
            self.begin, self.count = np.concatenate([self.begin, self.begin * 0]), np.concatenate([self.count, self.count * 0])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat * 0])
        own = slice(self.words, self.words + len(fresh))
        self.begin[own] = self.used + np.cumsum(counts) - counts
        self.count[own] = counts
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known.update(zip(fresh, range(self.words, self.words + len(fresh))))
        self.words += len(fresh)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets of the texts, one more than texts)."""
        if self.words > MEMORY_WORDS or self.bytes > MEMORY_BYTES:
            self._forget()
        split = [self.split(t) if t else [] for t in texts]
        fresh = set().union(*split).difference(self.known) if split else set()
        if fresh:
            self._learn(sorted(fresh))
        known = self.known
        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        index = np.fromiter((known[w] for words in split for w in words), dtype=np.int64, count=int(sizes.sum()))
        count = self.count[index]
        stop = np.cumsum(count)
        flat = self.flat[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.begin[index] - (stop - count), count)]
        word_ends = np.concatenate([[0], stop])
        offsets = word_ends[np.concatenate([[0], np.cumsum(sizes)])]
        return flat, offsets


#: One encoder for each vocabulary a worker has met lately; workers serve many tasks.
_ENCODERS: dict[str, TextEncoder] = {}


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Columns (key, ids) for every row of docs; other columns are not read, whatever their names.

    vocabulary: path of a rank file on the driver; its bytes, under 1 MB, are broadcast.
    """
    spark = docs.sparkSession
    tokens = read_ranks(vocabulary or vocabulary_path())
    mark = hashlib.md5(b"\n".join(tokens)).hexdigest()
    shared = spark.sparkContext.broadcast(tokens)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[mark] = TextEncoder(SpeculativeEncoder(shared.value))
        encoder = _ENCODERS[mark]
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                flat, offsets = encoder.encode(batch.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(flat, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)
