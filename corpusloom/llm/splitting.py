"""Problem 5: cut oversized texts at natural boundaries, with overlap, by agglomerative merging.

A text starts as atoms and every two neighbouring atoms are a candidate pair in a heap, ordered by the
strength of the boundary between them (hard cut, blank, comma, clause, sentence, line, paragraph), then by
combined size, then by position.  The weakest boundary is merged away first, as long as the combined size
plus the overlap it will carry fits the limit.  A unit that fits whole would always be merged whole before
any boundary around it, so atoms are taken as the largest such units.

Defined cases: null, empty and blank texts and texts of at most `limit` code points are not oversized and
give no rows; unbroken strings are cut hard, never inside a combining sequence unless it is longer than a
piece; the pieces without their overlaps are the exact text again.  Of several deliveries of a key the
latest counts, whatever its length; at equal times, and without a time column, an oversized text counts
before others, the greatest of several.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1_200, 200
HARD, BLANK, COMMA, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(7)
#: Where an atom may begin, strongest first; each match ends where the next atom begins.
BOUNDARIES = {
    PARAGRAPH: re.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:\r\n?|\n)\s*"),
    LINE: re.compile(r"(?:\r\n?|\n)[^\S\r\n]*|[\x0b\x0c\x85  ]+"),
    SENTENCE: re.compile(r"[.!?…]['\")\]”’»]*\s+(?=[^\W\d_a-zà-öø-ÿ]|[\d(\[“‘«\"'¿¡])"),
    CLAUSE: re.compile(r"[;:]\s+|\s[–—]\s"),
    COMMA: re.compile(r"[,|)]\s+"),
    BLANK: re.compile(r"\s+"),
}
#: Before a number these end no sentence.
ABBREVIATION = re.compile(r"(?:\b(?:art|arts|inc|núm|num|n|no|nos|fl|fls|p|pp|cf|vol|sr|sra|dr|dra)|n\.º)\.\s+$", re.I)
BATCH_ROWS = 500
#: The joiner of emoji and the mark that chooses a form.
JOINERS = "\u200d\ufe0f"


def _bounds(text: str, start: int, end: int, strength: int) -> list[int]:
    found = []
    for m in BOUNDARIES[strength].finditer(text, start, end):
        at = m.end()
        if start < at < end and not (strength == SENTENCE and ABBREVIATION.search(text, max(start, at - 12), at)):
            found.append(at)
    return found


def _hard(text: str, at: int, floor: int) -> int:
    """at, or the next place before it that splits no combining sequence, if there is one after floor."""
    spot = at
    while spot > floor + 1 and (unicodedata.combining(text[spot]) or text[spot] in JOINERS or text[spot - 1] == JOINERS[0]):
        spot -= 1
    return spot if spot > floor + 1 else at


def atoms(text: str, size: int) -> tuple[list[int], list[int]]:
    """(starts of the atoms, strength of the boundary before each); no atom is longer than size."""
    starts, strengths = [], []

    def cut(start: int, end: int, level: int, before: int) -> None:
        if end - start <= size:
            starts.append(start)
            strengths.append(before)
        elif level == HARD:
            while end - start > size:
                starts.append(start)
                strengths.append(before)
                start, before = _hard(text, start + size, start), HARD
            starts.append(start)
            strengths.append(before)
        else:
            edges = [start, *_bounds(text, start, end, level), end]
            for i in range(len(edges) - 1):
                cut(edges[i], edges[i + 1], level - 1, before if i == 0 else level)

    cut(0, len(text), PARAGRAPH, PARAGRAPH)
    return starts, strengths


def merge(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Starts of the pieces, each without its overlap."""
    starts, strengths = atoms(text, limit - overlap)
    n = len(starts)
    ends = [*starts[1:], len(text)]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def room(i: int) -> int:
        return limit if starts[i] == 0 else limit - overlap

    heap = [(strengths[j], ends[j] - starts[j - 1], j - 1, j) for j in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or ends[j] - starts[i] != size or size > room(i):
            continue
        ends[i], alive[j] = ends[j], False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            heapq.heappush(heap, (strengths[after[i]], ends[after[i]] - starts[i], i, after[i]))
        if before[i] >= 0:
            heapq.heappush(heap, (strengths[i], ends[i] - starts[before[i]], before[i], i))
    return [starts[i] for i in range(n) if alive[i]]


def overlap_start(text: str, previous: int, own: int, overlap: int) -> int:
    """Where a piece begins that starts at own and repeats the end of the piece before, from a natural place on."""
    low = max(previous, own - overlap)
    if low == own:
        return own
    for strength in (PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK):
        found = _bounds(text, max(0, low - 1), own, strength)
        found = [f for f in found if low <= f < own]
        if found:
            return found[0]
    while low < own and low and (unicodedata.combining(text[low]) or text[low] in JOINERS or text[low - 1] == JOINERS[0]):
        low += 1
    return low


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start with overlap, start, end) of each piece of a text, in order."""
    own = merge(text, limit, overlap)
    ends = [*own[1:], len(text)]
    out = []
    for i, (start, end) in enumerate(zip(own, ends)):
        out.append((max(overlap_start(text, own[i - 1], start, overlap), end - limit) if i else start, start, end))
    return out


def split_oversized(
    items: DataFrame, key: str, text: str, item_table: str, time: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True
) -> DataFrame:
    """Columns (item_table, item_key, piece_no, start, own_start, stop, text): the pieces of each oversized item.

    Positions count code points from 0; text is null unless asked for.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be from 0 to under limit")
    when = F.col(time).alias("at") if time else F.lit(None).cast("timestamp").alias("at")
    # Texts within the limit take part without their text, so that only oversized ones are shuffled.
    rows = items.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item_key"), F.col(text).cast("string").alias("text"), when)
    kept = rows.select("item_key", F.struct("at", F.when(F.length("text") > limit, F.col("text")).alias("text")).alias("r"))
    latest = kept.groupBy("item_key").agg(F.max("r").alias("last")).select("item_key", F.col("last.text").alias("text")).filter("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                rows: list[tuple] = []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    rows += [(k, i, a, b, c, t[a:c] if with_text else None) for i, (a, b, c) in enumerate(pieces(t, limit, overlap))]
                if rows:
                    cols = list(zip(*rows))
                    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=x) for c, x in zip(cols, kinds)], names=["item_key", "piece_no", "start", "own_start", "stop", "text"])

    out = latest.mapInArrow(run, "item_key string, piece_no int, start int, own_start int, stop int, text string")
    return out.select(F.lit(item_table).alias("item_table"), "item_key", "piece_no", "start", "own_start", "stop", "text")


def oversized_items(cut: DataFrame) -> DataFrame:
    """Each item that was cut, once."""
    return cut.filter("piece_no = 0").select("item_table", "item_key")
