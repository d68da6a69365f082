"""Problem 8: texts cut off by field limits or in transfer.

For each source and unit of length (code points, UTF-8 bytes) the discrete hazard of a length is the share
of the texts at least that long that stop there.  Window functions pool the hazards of the neighbouring
lengths, leaving out the nearest, which a cut at a word end may reach; each length is tested against them
(Chernoff bound of the Poisson tail) and the false-discovery rate is held within each source and unit.
An ending that may be none is then weighed by three likelihood ratios, of a text cut there against one that
ends there: its length (at a significant length the stops beyond the expected ones against those, elsewhere
the odds of a transfer broken off), its form (a mark of omission, a text fragment without an end, a line
that may as well be whole) and its last word (how often the corpus has it inside a line against at its end).
A text is reported if the product is over 1: at significant lengths on weak evidence, elsewhere, where only
a transfer can have broken off, on strong evidence alone.

Defined cases: null, empty and blank texts are no cases; a null source is a source of its own; repeated
rows are judged one by one.  Columns besides the three named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.words import SEPARATOR, code_point_table, mix, powers
from corpusloom.session import cut_lineage

NEAR, WIDE = 12, 150
FALSE_DISCOVERIES = 0.01
#: Odds that a text was cut: at most at a significant length, and by a broken transfer at any other.
LIMIT_ODDS, TRANSFER_ODDS = 50.0, 0.01
#: How much likelier a cut text has an ending of a form than a whole one.
FORM_RATIOS = {"mark": 10_000.0, "fragment": 1_200.0, "line": 0.1}
#: Bounds of the last word's ratio, and the ratio of a word that stands nowhere else.
WORD_LEAST, WORD_MOST, WORD_NEW = 0.1, 300.0, 150.0
SLICE_ROWS = 1_000
#: Words of more letters are counted under their digest.
LONG_WORD = 40
NOT_BLANK = r"[^\s\u00a0\u00ad\u1680\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff\u0085]"

# The forms of endings in Portuguese, English and Spanish.
OMISSION = regex.compile(r"(?:\[\s*(?:\.{2,}|…)\s*\]|\(\s*(?:\.{2,}|…)\s*\)|\.{3,}|…|�+|[\[(](?i:trunca\p{L}*|cortad[oa]|texto trunca\p{L}*|continua|continued|continúa)[^\])]*[\])]|(?i:leia mais|ler mais|read more|leer más))$")
CLOSED_OMISSION = regex.compile(r"(?i)(?:\betc|sucess?ivamente|assim por diante|and so on|and so forth)\s*(?:\.{3,}|…)$")
TERMINAL = regex.compile(r"[.!?。][)\]\"'”’»*_]*$")
ABBREVIATED = regex.compile(r"(?:^|[\s(])(?:[Aa]rt|[Aa]rts|[Ii]nc|[Nn]úm|[Ff]ls|n\.º)\.$")
ARTICLE_ALONE = regex.compile(r"^(?:(?i:art(?:igo|ículo|icle)?)\.?\s*\d+\s*[.ºo°]?\.?|§\s*\d+\s*[.ºo°]?\.?|[IVXLC]+\s*[-–]?|[a-z]\)|\(?\d+[.)])$")
MONTHS = "janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro|enero|febrero|marzo|mayo|junio|julio|septiembre|setiembre|octubre|noviembre|diciembre|january|february|march|april|may|june|july|august|september|october|november|december"
CLOSED_LINES = [
    regex.compile(r"(?:https?://|www\.)\S+$"),
    regex.compile(rf"(?:^|[\s,(])(?:\d{{1,2}}º?(?:\s+de)?\s+(?i:{MONTHS})(?:\s+de)?\s+\d{{4}}|\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}})$"),
    regex.compile(r"^(?i:processo|process|expediente|file|protocolo|protocol|ofício|oficio|docket|case|autos|ref)\b[^.]{0,12}(?:n\.?\s*[ºo°]\.?|no\.?|n\.|:)?\s*[\d.-]+/\d{4}$"),
    regex.compile(r"^(?i:vers[aã]o|version|versión|revis[aã]o|revision|revisión)\s+\d+(?:\.\d+)*$"),
    regex.compile(r"^(?:(?i:anexo|annex|appendix|apêndice|apéndice|capítulo|chapter|seção|section|sección|título|title|parte|part)\s+(?:[IVXLC]+|\d+|[A-Z]|única|único)|\p{Lu}{2}[\p{Lu}\p{N}\s,–-]{4,80})$"),
    regex.compile(r"\|\s*[+-]?[\d.,]+\s*%?$"),
]
OPEN_LINES = regex.compile(r"^\s*[-•*–—▪·]\s+\S|;[^;]*;|\||^(?i:palavras-chave|keywords|palabras clave)\b|^(?i:relatoria|relatora?|signed|firma|firmado|assinado|assinatura|assina|fdo|rapporteur|ponente)\b[^:]{0,20}:\s*\S")
BLANKS = "".join(chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0xAD, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF))


_CLASS = "".join(f"\\u{ord(c):04x}" for c in BLANKS)
_BREAK_CLASS = "\\n\\r\\x0b\\x0c\\x85\\u2028\\u2029"
FOOTNOTES = regex.compile(r"(?:\s*\[\d{1,3}\])+$")


def judge_line(line: str) -> str:
    """end, mark (an omission is marked), line (a list item, row or the like that may have lost its end) or fragment."""
    if line[-1] == "]":
        line = FOOTNOTES.sub("", line) or line
    if line[-1] in "….])�" or line.endswith("..") or line[-1].isalpha():
        if CLOSED_OMISSION.search(line):
            return "end"
        if OMISSION.search(line):
            return "mark"
    if ARTICLE_ALONE.search(line) or ABBREVIATED.search(line):
        return "fragment"
    if TERMINAL.search(line) or any(p.search(line) for p in CLOSED_LINES):
        return "end"
    return "line" if OPEN_LINES.search(line) else "fragment"


def last_line(text: Column) -> Column:
    """The last line that is not blank, whole, without blanks at its ends; read backwards, so that it costs no more than the text's length."""
    return F.reverse(F.regexp_extract(F.reverse(text), rf"^[{_CLASS}]*([^{_BREAK_CLASS}]*)", 1))


def last_word(line: str) -> str:
    found = regex.match(r"[^\w\p{M}]*?(-*[\w\p{M}][\w\p{M}-]*)", line[::-1])
    return found.group(1)[::-1].lstrip("-_").lower() if found else ""


def word_key(word: Column) -> Column:
    """What closing_words calls a word: itself, or its digest if it is long."""
    return F.when(F.length(word) > LONG_WORD, F.md5(word)).otherwise(word)


def closing_words(texts: DataFrame, text: str) -> DataFrame:
    """Columns (word, places, closing): how often each word stands in the corpus and how often it closes a line or clause there.

    The last word of a text counts as neither.  Counts are summed in the workers before they are shuffled;
    words of over LONG_WORD letters go under their digest.
    """

    def name(word: str) -> str:
        return word if len(word) <= LONG_WORD else hashlib.md5(word.encode("utf-8")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = code_point_table()
        closers = np.zeros(0x110000, dtype=bool)
        closers[[ord(c) for c in ".;,:!?|\n\r"]] = True
        totals: dict[str, list[int]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                joined = "\x00".join([t.lower() for t in whole.slice(at, SLICE_ROWS).column(0).to_pylist() if t] + [""])
                points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                inside = (table[points] != SEPARATOR) | (points == ord("-"))
                edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
                starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                last = points[np.minimum(ends, len(points) - 1)] == 0
                if not len(starts):
                    continue
                closes = closers[points[np.minimum(ends, len(points) - 1)]]
                # A blank before a bar or a dash closes as well.
                follow = np.minimum(ends + 1, len(points) - 1)
                closes |= (points[np.minimum(ends, len(points) - 1)] == 32) & ((points[follow] == ord("|")) | (points[follow] == ord("—")) | (points[follow] == ord("\n")))
                keep = ~last
                # Words are told apart by 64-bit hashes; only one of each is cut out of the text.
                letters = np.flatnonzero(inside)
                terms = points[letters].astype(np.uint64) * powers(int((ends - starts).max()))[letters - np.repeat(starts, ends - starts)]
                hashes = mix(np.add.reduceat(terms, np.concatenate([[0], np.cumsum(ends - starts)[:-1]])))
                _, first, group = np.unique(hashes[keep], return_index=True, return_inverse=True)
                places, closing = np.bincount(group), np.bincount(group, weights=closes[keep])
                a, b = starts[keep][first].tolist(), ends[keep][first].tolist()
                for i, j, n, c in zip(a, b, places.tolist(), closing.tolist()):
                    t = totals.setdefault(name(joined[i:j]), [0, 0])
                    t[0] += n
                    t[1] += int(c)
                if len(totals) > 200_000:
                    yield _counts(totals)
                    totals = {}
        if totals:
            yield _counts(totals)

    def _counts(totals: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array([v[0] for v in totals.values()], type=pa.int64()), pa.array([v[1] for v in totals.values()], type=pa.int64())], names=["word", "places", "closing"])

    part = texts.select(F.col(text).cast("string").alias("text")).filter(F.length("text") > 0).mapInArrow(run, "word string, places bigint, closing bigint")
    return part.groupBy("word").agg(F.sum("places").alias("places"), F.sum("closing").alias("closing"))


def length_hazards(lengths: DataFrame, near: int = NEAR, wide: int = WIDE, fdr: float = FALSE_DISCOVERIES) -> DataFrame:
    """From (source, unit, length) of each text: one row a length with its hazard, the neighbours', p and whether significant.

    A window holds the distinct lengths of one source and unit, a number bounded by the longest text.
    """
    counts = lengths.groupBy("source", "unit", "length").agg(F.count("*").alias("texts"))
    own = Window.partitionBy("source", "unit")
    down = own.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    around = own.orderBy("length").rangeBetween(-wide, wide)
    core = own.orderBy("length").rangeBetween(-near, near)
    risk = counts.withColumn("at_risk", F.sum("texts").over(down))
    # Stops near a length, against the texts that passed them; lengths without a text have a hazard of 0.
    pooled = risk.withColumn("near_stops", F.sum("texts").over(around) - F.sum("texts").over(core)).withColumn("span", F.least(F.col("length"), F.lit(wide)) + wide + 1 - (2 * near + 1))
    tested = (
        pooled.withColumn("hazard", F.col("texts") / F.col("at_risk"))
        .withColumn("near_hazard", (F.col("near_stops") + 1) / (F.greatest(F.col("span"), F.lit(1)) * F.col("at_risk")))
        .withColumn("expected", F.col("near_hazard") * F.col("at_risk"))
        .withColumn("p", F.when(F.col("texts") > F.col("expected"), F.exp(F.col("texts") - F.col("expected") - F.col("texts") * F.log(F.col("texts") / F.col("expected")))).otherwise(1.0))
    )
    up = own.orderBy(F.col("p").desc(), F.col("length"))
    total = F.count("*").over(own)
    adjusted = tested.withColumn("q_raw", F.col("p") * total / (total - F.row_number().over(up) + 1)).withColumn(
        "q", F.min("q_raw").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return adjusted.select("source", "unit", "length", "texts", "at_risk", "hazard", "near_hazard", "p", "q", ((F.col("q") <= fdr) & (F.col("texts") >= 3)).alias("significant"))


def lengths_of(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    body = docs.filter(F.length(text) > 0)
    both = F.array(F.struct(F.lit("chars").alias("unit"), F.length(text).alias("length")), F.struct(F.lit("bytes").alias("unit"), F.octet_length(text).alias("length")))
    return body.select(F.col(source).cast("string").alias("source"), F.explode(both).alias("m")).select("source", "m.unit", "m.length")


def judge_endings(docs: DataFrame) -> DataFrame:
    """From (key, source, text): each text whose ending may be none, with chars, bytes, the ending's form and last word."""
    kind = docs.schema["key"].dataType.simpleString()
    base = docs.select("key", "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), last_line(F.col("text")).alias("line")).filter("chars > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, forms, words = [], [], []
            for i, line in enumerate(batch.column(4).to_pylist()):
                line = line.strip(BLANKS)
                form = judge_line(line) if line else "end"
                if form != "end":
                    word = last_word(line)
                    at.append(i)
                    forms.append(form)
                    words.append(word if len(word) <= LONG_WORD else hashlib.md5(word.encode("utf-8")).hexdigest())
            spots = pa.array(at, type=pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(spots) for i in range(4)), pa.array(forms, type=pa.string()), pa.array(words, type=pa.string())], names=["key", "source", "chars", "bytes", "form", "word"])

    return base.mapInArrow(run, f"key {kind}, source string, chars int, bytes int, form string, word string")


def truncated_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", fdr: float = FALSE_DISCOVERIES) -> DataFrame:
    """Columns (key, source, chars, evidence, at_limit, odds) of each text that breaks off."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(source).cast("string").alias("source"))
    excess = F.least(F.lit(LIMIT_ODDS), (F.col("texts") - F.col("expected")) / F.col("expected"))
    limits = length_hazards(lengths_of(docs), fdr=fdr).filter("significant").withColumn("expected", F.col("near_hazard") * F.col("at_risk")).select(F.col("source").alias("s"), "unit", "length", excess.alias("excess"))
    judged = judge_endings(docs)
    # Of each source its few significant lengths; the odds by length are the greater of those of code points and bytes.
    by_source = limits.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("unit", F.lit(":"), "length"), "excess"))).alias("limits"))
    judged = judged.join(by_source, F.col("source").eqNullSafe(F.col("s")), "left")
    by_length = F.greatest(*[F.try_element_at("limits", F.concat(F.lit(f"{unit}:"), F.col(unit))) for unit in ("chars", "bytes")])
    # Texts without a last word meet none, each under a key of its own.
    spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("key"), F.lit(100_000)).cast("string"))
    at = judged.select("key", "source", "chars", "form", F.when(F.col("word") != "", F.col("word")).otherwise(spread).alias("word"), by_length.isNotNull().alias("at_limit"), F.coalesce(F.greatest(by_length, F.lit(TRANSFER_ODDS)), F.lit(TRANSFER_ODDS)).alias("by_length"))
    counts = cut_lineage(closing_words(docs, "text"))
    whole = counts.agg((F.sum("closing") / F.sum("places")).alias("base"))  # one row
    known = at.join(counts, "word", "left").crossJoin(F.broadcast(whole))
    inside = F.col("base") * (F.col("places") + 0.5) / (F.col("closing") + 0.5 * F.col("base"))
    by_word = F.when(F.col("word").startswith("\x00"), 1.0).when(F.col("places").isNull() | (F.col("places") == 0), WORD_NEW).otherwise(F.greatest(F.lit(WORD_LEAST), F.least(F.lit(WORD_MOST), F.coalesce(inside, F.lit(1.0)))))
    by_form = F.element_at(F.create_map(*[F.lit(x) for pair in FORM_RATIOS.items() for x in pair]), F.col("form"))
    weighed = known.withColumn("odds", F.col("by_length") * by_form * by_word)
    return weighed.filter("odds > 1").select(F.col("key").alias(key), "source", "chars", F.col("form").alias("evidence"), "at_limit", "odds")


def truncation_by_source(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Columns (source, texts, truncated, share) of each source with a text that is not blank."""
    all_texts = docs.filter(F.col(text).rlike(NOT_BLANK)).groupBy(F.col(source).cast("string").alias("source")).agg(F.count("*").alias("texts"))
    cut = truncated_texts(docs, key, text, source).groupBy(F.col("source").alias("s")).agg(F.count("*").alias("truncated"))
    joined = all_texts.join(cut, all_texts["source"].eqNullSafe(cut["s"]), "left")
    return joined.select("source", "texts", F.coalesce("truncated", F.lit(0)).alias("truncated"), (F.coalesce("truncated", F.lit(0)) / F.col("texts")).alias("share"))
