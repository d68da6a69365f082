"""Problem 4: languages of documents and of their segments, by a bidirectional gated recurrent network over bytes.

The network labels every byte; a sentence pools the log-probabilities of its bytes, leaving out quoted
terms, and neighbouring sentences of one language form a segment; a document pools all its bytes, and its
confidence is the pooled probability of its language, or languages.  The
network is trained in numpy by backpropagation through time on a bounded sample of labelled passages (the
TRAIN_PASSAGES least by hash of each language), with windows that change language half way, lost accents
and lost case mixed in; after the first half of the steps windows that contradict their label are left out,
since labels may be wrong.

Defined cases: null and blank texts give no rows; a text without a sentence of MIN_WORDS words is judged
whole; a language for which no labelled passage exists is not learnt and never assigned (with none at all,
ValueError); of several deliveries the latest counts; ties go to the language first in `LANGUAGES`.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ("pt", "en", "es")
#: Folded spellings and regional forms of language labels.
NAMES = {
    "pt": ["pt", "por", "portugues", "portuguese", "ptbr", "ptpt", "ptao", "ptmz", "brazilianportuguese", "portuguesbr", "portuguesbrasil"],
    "en": ["en", "eng", "english", "ingles", "enus", "engb", "enuk", "enca", "enau", "enie", "enin"],
    "es": ["es", "spa", "espanol", "spanish", "castellano", "castelhano", "espanhol", "es419", "eses", "esmx", "esar", "esco", "escl", "espe", "esuy", "esus"],
    "mixed": ["mixed", "mix", "misto", "mixto", "mul", "multi", "multiple", "varios", "multilingual"],
}
TRAIN_PASSAGES = 300
WIDTH, SPAN, STEPS, BATCH = 16, 80, 240, 96
WINDOW, CONTEXT, STEP, AT_ONCE = 256, 16, 32, 512
SLICE_ROWS = 512
MIN_WORDS, MIN_LETTERS = 4, 18
#: By how much a byte, on average, another language must be likelier than the text's own for a sentence to leave it.
MARGIN = 1.2
SENTENCE_END = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+(?!\d)|[\r\n]+")
QUOTED = re.compile(r"“[^”]{1,200}”|\"[^\"]{1,200}\"|«[^»]{1,200}»|‘[^’]{1,200}’")


def read_language(c: Column) -> Column:
    """pt, en, es or mixed if the label names it in any spelling, else null."""
    plain = F.regexp_replace(F.translate(F.lower(c), "áàâãäéêèíóôõúüçñ", "aaaaaeeeiooouucn"), r"[^a-z0-9]+", "")
    out = F.lit(None).cast("string")
    for name, forms in NAMES.items():
        out = F.when(plain.isin(forms), F.lit(name)).otherwise(out)
    return out


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteNetwork:
    """Two gated recurrent layers, one in each direction, and a softmax over the languages at every byte."""

    def __init__(self, classes: int, width: int = WIDTH, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.width = width
        self.w: dict[str, np.ndarray] = {"out": rng.normal(0, 0.2, (2 * width, classes)), "bias": np.zeros(classes)}
        for d in "fb":
            self.w[f"in{d}"] = rng.normal(0, 0.3, (256, 3 * width))
            self.w[f"rec{d}"] = rng.normal(0, 1 / np.sqrt(width), (width, 3 * width))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: bytes, time first.  The states in the order of x, whatever the direction."""
        steps, n = x.shape
        h, c = np.zeros((n, self.width), dtype=np.float32), self.width
        states, saved = np.empty((steps, n, c), dtype=np.float32), []
        table, rec = self.w[f"in{d}"], self.w[f"rec{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = table[x[t]]
            u = h @ rec
            gates = _gate(a[:, : 2 * c] + u[:, : 2 * c])
            z, r = gates[:, :c], gates[:, c:]
            cand = np.tanh(a[:, 2 * c :] + r * u[:, 2 * c :])
            new = cand + z * (h - cand)
            if keep:
                saved.append((t, h, z, r, cand, u[:, 2 * c :]))
            h = states[t] = new
        return states, saved

    def _states(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What _run gives in both directions, without what learning needs: both at once, nothing allocated in between."""
        steps, n = x.shape
        c = self.width
        # A logistic gate is half a hyperbolic tangent of half its input.
        halves = (np.float32(0.5), np.float32(0.5), np.float32(1))
        table = [np.concatenate([self.w[f"in{d}"][:, i * c : (i + 1) * c] * k for d in "fb"]) for i, k in enumerate(halves)]
        rec = [np.stack([self.w[f"rec{d}"][:, i * c : (i + 1) * c] * k for d in "fb"]) for i, k in enumerate(halves)]
        at = np.concatenate([x, x[::-1] + 256], axis=1).astype(np.intp)
        kind = table[0].dtype
        states, last = np.empty((steps, 2, n, c), dtype=kind), np.zeros((2, n, c), dtype=kind)
        z, r, u, a = (np.empty((2, n, c), dtype=kind) for _ in range(4))
        flat = a.reshape(2 * n, c)
        for t in range(steps):
            for gate, i in ((z, 0), (r, 1)):
                table[i].take(at[t], axis=0, out=flat, mode="clip")
                np.matmul(last, rec[i], out=gate)
                gate += a
                np.tanh(gate, out=gate)
                gate += 1
            z *= 0.5
            np.matmul(last, rec[2], out=u)
            r *= u
            r *= 0.5
            table[2].take(at[t], axis=0, out=flat, mode="clip")
            r += a
            np.tanh(r, out=r)
            new = states[t]
            np.subtract(last, r, out=new)
            new *= z
            new += r
            last = new
        return states[:, 0], states[::-1, 1]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """x: bytes, time first -> log-probabilities of the languages at each byte."""
        f, b = self._states(x.astype(np.int64))
        c = self.width
        # Class by class: there are few, and many bytes.
        parts = [f @ self.w["out"][:c, k] + b @ self.w["out"][c:, k] + self.w["bias"][k] for k in range(len(self.w["bias"]))]
        most = functools.reduce(np.maximum, parts)
        total = np.log(sum(np.exp(p - most) for p in parts)) + most
        return np.stack([p - total for p in parts], axis=-1)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of labels y at every byte of x, and its gradients by backpropagation through time."""
        c = self.width
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        runs = {d: self._run(x, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=-1)
        o = both @ self.w["out"] + self.w["bias"]
        o = np.exp(o - o.max(axis=-1, keepdims=True))
        p = o / o.sum(axis=-1, keepdims=True)
        hit = np.take_along_axis(p, y[..., None], axis=-1)
        loss = float(-np.log(np.maximum(hit, 1e-9)).mean())
        e = p
        np.put_along_axis(e, y[..., None], hit - 1, axis=-1)
        e /= y.size
        g["out"] = both.reshape(-1, 2 * c).T @ e.reshape(-1, e.shape[-1])
        g["bias"] = e.sum(axis=(0, 1))
        back = e @ self.w["out"].T
        # Bytes in order, so that the inputs of each are summed in one run.
        order = np.argsort(x.ravel(), kind="stable")
        seen, first = np.unique(x.ravel()[order], return_index=True)
        for d, part in (("f", back[..., :c]), ("b", back[..., c:])):
            rec = self.w[f"rec{d}"]
            dh = np.zeros_like(part[0])
            inputs, moves, hidden = np.empty((*x.shape, 3 * c), dtype=part.dtype), np.empty((*x.shape, 3 * c), dtype=part.dtype), np.empty((*x.shape, c), dtype=part.dtype)
            for t, h, z, r, cand, un in reversed(runs[d][1]):
                dh = dh + part[t]
                own, du = inputs[t], moves[t]
                dn = dh * (1 - z) * (1 - cand * cand)
                own[:, :c] = dh * (h - cand) * z * (1 - z)
                own[:, c : 2 * c] = dn * un * r * (1 - r)
                own[:, 2 * c :] = dn
                du[:, : 2 * c] = own[:, : 2 * c]
                du[:, 2 * c :] = dn * r
                hidden[t] = h
                dh = dh * z + du @ rec.T
            g[f"rec{d}"] = hidden.reshape(-1, c).T @ moves.reshape(-1, 3 * c)
            g[f"in{d}"][seen] = np.add.reduceat(inputs.reshape(-1, 3 * c)[order], first, axis=0)
        return loss, g


def _variant(text: str, rng: np.random.Generator) -> str:
    luck = rng.random()
    if luck < 0.25:
        text = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))
    luck = rng.random()
    return text.lower() if luck < 0.12 else text.upper() if luck < 0.24 else text


def train(passages: list[tuple[str, int]], classes: int, steps: int = STEPS, seed: int = 5) -> ByteNetwork:
    """A network fitted to (text, language number) pairs, some of which may be wrong."""
    rng = np.random.default_rng(seed)
    net = ByteNetwork(classes, seed=seed)
    blank = b" " * SPAN
    pools: list[list[bytes]] = [[] for _ in range(classes)]
    for text, label in passages:
        for _ in range(2):
            raw = _variant(unicodedata.normalize("NFC", text), rng).encode("utf-8")
            for at in range(0, max(1, len(raw) - SPAN // 2), SPAN):
                pools[label].append((raw[at : at + SPAN] + blank)[:SPAN])
    present = [k for k in range(classes) if pools[k]]
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    for step in range(1, steps + 1):
        if step == steps // 2:  # what contradicts its label is left out from here on
            for k in present:
                x = np.frombuffer(b"".join(pools[k]), dtype=np.uint8).reshape(-1, SPAN).T
                good = net.probabilities(x).mean(axis=0).argmax(axis=1) == k
                if good.sum() >= len(good) // 2:
                    pools[k] = [w for w, ok in zip(pools[k], good) if ok]
        x, y = np.empty((SPAN, BATCH), dtype=np.uint8), np.empty((SPAN, BATCH), dtype=np.int64)
        for i in range(BATCH):
            a = present[rng.integers(len(present))]
            one = pools[a][rng.integers(len(pools[a]))]
            line, marks = np.frombuffer(one, dtype=np.uint8), np.full(SPAN, a)
            if i % 2:
                b = present[rng.integers(len(present))]
                other = np.frombuffer(pools[b][rng.integers(len(pools[b]))], dtype=np.uint8)
                cut = rng.integers(SPAN // 4, 3 * SPAN // 4)
                line = np.concatenate([line[:cut], other[cut:]])
                marks = np.concatenate([marks[:cut], np.full(SPAN - cut, b)])
            x[:, i], y[:, i] = line, marks
        _, g = net.gradients(x, y)
        pace = 0.012 * (1.0 if step < 0.7 * steps else 0.3)
        for k in net.w:
            d = np.clip(g[k], -0.5, 0.5)
            first[k] += 0.1 * (d - first[k])
            second[k] += 0.01 * (d * d - second[k])
            net.w[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def byte_labels(net: ByteNetwork, raws: list[bytes]) -> np.ndarray:
    """Log-probabilities at every byte of the texts one after another; windows overlap by CONTEXT on either side."""
    inner = WINDOW - 2 * CONTEXT
    sizes = np.array([len(r) for r in raws], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    parts = -(-sizes // inner)
    owner = np.repeat(np.arange(len(raws)), parts)
    at = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * inner
    width = np.minimum(inner, sizes[owner] - at)
    out = np.empty((int(sizes.sum()), net.w["bias"].shape[0]), dtype=net.w["bias"].dtype)
    # Each text stands between blanks, so that no window sees another text.
    pad = b" " * WINDOW
    data = np.frombuffer(pad + pad.join(raws) + pad, dtype=np.uint8)
    begin = starts + WINDOW * (np.arange(len(raws)) + 1)
    # Windows go together by length in steps of STEP, so that neighbours do not change what a window sees.
    grade = -(-width // STEP)
    for g in np.unique(grade):
        same, span = np.flatnonzero(grade == g), int(g) * STEP + 2 * CONTEXT
        for low in range(0, len(same), AT_ONCE):
            part = same[low : low + AT_ONCE]
            spots = (begin[owner[part]] + at[part] - CONTEXT)[None, :] + np.arange(span)[:, None]
            p = net.probabilities(data[spots])[CONTEXT:]
            keep = np.arange(span - CONTEXT)[:, None] < width[part][None, :]
            to = (starts[owner[part]] + at[part])[None, :] + np.arange(span - CONTEXT)[:, None]
            out[to[keep]] = p[keep]
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    edges = [0, *(m.end() for m in SENTENCE_END.finditer(text)), len(text)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def segments(net: ByteNetwork, texts: list[str]) -> tuple[list[list[tuple[int, int, int, float, bool]]], np.ndarray]:
    """For each text its segments, (start, end, language number, confidence, whether it has a whole sentence) in code points, and its pooled probabilities."""
    plain = [unicodedata.normalize("NFC", t) if not unicodedata.is_normalized("NFC", t) else t for t in texts]
    if not any(plain):
        return [[] for _ in texts], np.zeros((len(texts), net.w["bias"].shape[0]))
    labels = byte_labels(net, [t.encode("utf-8") for t in plain])
    points = np.frombuffer("".join(plain).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.array([len(t) for t in plain], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    bytes_each = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(bytes_each)])
    letter = _letters()[points]
    bare = letter.copy()
    spans = []
    for text, start in zip(plain, starts.tolist()):
        for m in QUOTED.finditer(text):
            bare[start + m.start() : start + m.end()] = False
        spans.append(sentences(text))
    # Sums up to each code point: letters and bare letters in bytes, words begun, pooled log-probabilities.
    first = letter & ~np.concatenate([[False], letter[:-1]])
    first[starts[sizes > 0]] = letter[starts[sizes > 0]]
    opens = np.array([s + a for own, s in zip(spans, starts.tolist()) for a, _ in own], dtype=np.int64)
    totals = {}
    for name, use in (("letters", letter), ("bare", bare)):
        byte = np.repeat(use, bytes_each)
        totals[name] = np.add.reduceat(use * bytes_each, opens).tolist()
        totals[f"{name} pooled"] = np.add.reduceat(labels * byte[:, None], at[opens], axis=0, dtype=np.float64)
    begun = np.add.reduceat(first.astype(np.int64), opens).tolist()
    out, pooled_all, k = [], np.zeros((len(texts), labels.shape[1])), 0
    for which, (given, text, own_spans) in enumerate(zip(texts, plain, spans)):
        units = []
        for a, b in own_spans:
            name = "bare" if totals["bare"][k] >= 8 else "letters"
            n = totals[name][k]
            if n:
                units.append([a, b, totals[f"{name} pooled"][k], n, begun[k] >= MIN_WORDS and n >= MIN_LETTERS])
            elif units:
                units[-1][1] = b
            k += 1
        if any(u[4] for u in units):
            # Short units go with the sentence before, those at the start with the one after.
            joined: list[list] = []
            for u in units:
                if u[4] or not joined:
                    joined.append(u)
                else:
                    joined[-1][1] = u[1]
            if len(joined) > 1 and not joined[0][4]:
                joined[1][0] = joined[0][0]
                del joined[0]
            units = joined
        elif units:
            units = [[0, len(text), np.sum([u[2] for u in units], axis=0), sum(u[3] for u in units), True]]
        found: list[list] = []
        whole = np.sum([u[2] for u in units], axis=0) if units else np.zeros(labels.shape[1])
        own = int(np.argmax(whole))
        for a, b, pooled, n, enough in units:
            lang = int(np.argmax(pooled))
            if pooled[lang] - pooled[own] < MARGIN * n:
                lang = own
            if found and found[-1][2] == lang:
                found[-1][1], found[-1][3], found[-1][4], found[-1][5] = b, found[-1][3] + pooled, found[-1][4] + n, found[-1][5] or enough
            else:
                found.append([a, b, lang, pooled, n, enough])
        scale = len(given) / max(1, len(text))
        out.append([(int(a * scale), int(b * scale) if b < len(text) else len(given), lang, float(_mean_chances(pooled, n)[lang]), bool(enough)) for a, b, lang, pooled, n, enough in found])
        if units:
            pooled_all[which] = _mean_chances(whole, sum(u[3] for u in units))
    return out, pooled_all


def _mean_chances(pooled: np.ndarray, n: int) -> np.ndarray:
    e = np.exp(pooled / n - (pooled / n).max())
    return e / e.sum()


def latest_passages(rows: DataFrame, key: str, text: str, label: str, time: str) -> DataFrame:
    """Columns (key, text, label): the latest delivery of each key."""
    picked = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.struct(F.col(time).alias("at"), F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text")).alias("r"))
    return picked.groupBy("key").agg(F.max("r").alias("r")).select("key", "r.text", "r.label")


def train_on(passages: DataFrame, limit: int = TRAIN_PASSAGES) -> ByteNetwork:
    """Fits a network to at most `limit` labelled passages of each language, the least by hash."""
    named = passages.select("text", read_language(F.col("label")).alias("named")).filter(F.col("named").isin(*LANGUAGES) & (F.length(F.trim("text")) >= SPAN))
    # One pass: each partition keeps its least of every language before anything is shuffled.
    rank = F.row_number().over(Window.partitionBy("named").orderBy(F.xxhash64("text"), "text"))
    rows = named.withColumn("rank", rank).filter(F.col("rank") <= limit).collect()
    sample = [(r["text"], LANGUAGES.index(r["named"])) for r in sorted(rows, key=lambda r: (LANGUAGES.index(r["named"]), r["rank"]))]
    if not sample:
        raise ValueError("no labelled passage to learn from")
    return train(sample, len(LANGUAGES))


def label_segments(passages: DataFrame, net: ByteNetwork) -> DataFrame:
    """Columns (key, label, segment, start, stop, lang, confidence, whole, chances): the segments of each passage that is not blank; chances are the document's."""
    shared = passages.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                found, pooled = segments(shared.value, batch.column(2).to_pylist())
                rows = [(i, k, *s) for i, own in enumerate(found) for k, s in enumerate(own)]
                if not rows:
                    continue
                owner, k, start, stop, lang, sure, enough = zip(*rows)
                spots = pa.array(owner, type=pa.int64())
                chances = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * pooled.shape[1]), pa.array(pooled[list(owner)].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(spots), batch.column(1).take(spots), pa.array(k, type=pa.int32()), pa.array(start, type=pa.int32()), pa.array(stop, type=pa.int32()), pa.array([LANGUAGES[x] for x in lang]), pa.array(sure), pa.array(enough), chances],
                    names=["key", "label", "segment", "start", "stop", "lang", "confidence", "whole", "chances"],
                )

    base = passages.select("key", "label", "text").filter(F.col("text").rlike(r"[\p{L}\p{N}]"))
    return base.mapInArrow(run, "key string, label string, segment int, start int, stop int, lang string, confidence double, whole boolean, chances array<double>")


def label_documents(labelled: DataFrame) -> DataFrame:
    """Columns (key, label, langs, lang, confidence): lang is the language or mixed, confidence the pooled probability of langs."""
    per = labelled.groupBy("key").agg(F.first("label").alias("label"), F.sort_array(F.collect_set(F.when(F.col("whole"), F.col("lang")))).alias("langs"), F.first("chances").alias("chances"))
    share = [F.when(F.array_contains("langs", lang), F.col("chances")[i]).otherwise(0.0) for i, lang in enumerate(LANGUAGES)]
    return per.select("key", "label", "langs", F.when(F.size("langs") > 1, "mixed").otherwise(F.col("langs")[0]).alias("lang"), sum(share[1:], share[0]).alias("confidence"))


def wrong_labels(documents: DataFrame) -> DataFrame:
    """Columns (key, lang): the languages of each document whose label names none or not the right one."""
    wrong = documents.filter(~read_language(F.col("label")).eqNullSafe(F.col("lang")) & F.col("lang").isNotNull())
    return wrong.select("key", F.explode("langs").alias("lang"))
