"""Vectorised word splitting and hashing over code points, shared by the corpus operators.

A word is a maximal run of letters and digits after case, accents, invisible characters and line-end
hyphens are dropped; everything else separates words.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

SEPARATOR, DROPPED, SEVERAL = 0, 1, 2
#: A hyphen that ends a line inside a word, with the line break and the blanks around it.
LINE_END_HYPHEN = re.compile(r"(?<=\w)[-‐‑­¬][ \t​]*(?:\r\n?|\n)\s*(?=\w)")
_P = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
_Q = np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1)
_TABLE: list[np.ndarray] = []
_POWERS: list[np.ndarray] = []


def _fold(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", char).casefold()) if unicodedata.category(c) not in ("Mn", "Me", "Cf"))


def code_point_table() -> np.ndarray:
    """For every code point its folded letter or digit, SEPARATOR, DROPPED, or SEVERAL if it folds to many."""
    if not _TABLE:
        table = np.zeros(0x110000, dtype=np.int32)
        # Ideographs and syllables fold to themselves; beyond them there are only private and unassigned ones.
        plain = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7B0), (0x20000, 0x32000))
        for low, high in plain:
            table[low:high] = np.arange(low, high)
        for cp in (c for a, b in zip((0, *(h for _, h in plain[:-1])), (low for low, _ in plain)) for c in range(a, b)):
            if 0xD800 <= cp < 0xE000:
                continue
            char = chr(cp)
            kind = unicodedata.category(char)
            if kind in ("Mn", "Me", "Cf"):
                table[cp] = DROPPED
            elif kind[0] in "LNMS" or kind == "Mc":
                folded = _fold(char)
                if len(folded) == 1 and folded.isalnum():
                    table[cp] = ord(folded)
                elif len(folded) > 1:
                    table[cp] = SEVERAL
        _TABLE.append(table)
    return _TABLE[0]


def powers(n: int) -> np.ndarray:
    """At least n powers of the base of word hashes."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1024, 2 * n)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size, _P)]))]
    return _POWERS[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in reading order, offsets of the texts); null counts as empty."""
    table = code_point_table()
    clean = [LINE_END_HYPHEN.sub("", t) if t and ("\n" in t or "\r" in t) else t or "" for t in texts]
    points = np.frombuffer("\n".join([*clean, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    mapped = table[points]
    many = np.flatnonzero(mapped == SEVERAL)
    if len(many):
        bounds = np.cumsum(np.fromiter(map(len, clean), dtype=np.int64, count=len(clean)) + 1)
        for i in np.unique(np.searchsorted(bounds, many, side="right")):
            clean[i] = _fold(clean[i])
        points = np.frombuffer("\n".join([*clean, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        mapped = table[points]
        mapped = np.where(mapped == SEVERAL, SEPARATOR, mapped)
    lengths = np.fromiter(map(len, clean), dtype=np.int64, count=len(clean)) + 1
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    kept = mapped != DROPPED
    kept_before = np.concatenate([[0], np.cumsum(kept)])
    letters = mapped[kept]
    inside = letters != SEPARATOR
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    at = np.flatnonzero(inside)
    place = at - np.repeat(starts, ends - starts)
    with np.errstate(over="ignore"):
        terms = letters[at].astype(np.uint64) * powers(int(place.max()) + 1)[place]
        hashes = mix(np.add.reduceat(terms, np.concatenate([[0], np.cumsum(ends - starts)[:-1]])))
    offsets = np.searchsorted(starts, kept_before[bounds])
    return hashes, offsets


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; len(words) - k + 1 of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * _Q + words[j : j + n]
        return mix(h)
