"""Structural units of documents: kinds, levels, section paths, tables, packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse

# How articles and headings begin.
ARTICLE = r"(?i)^(?:art\.?|artigo|article|artículo)\s*[0-9]+"
HEADING = r"(?i)^(?:t[ií]tulo|cap[ií]tulo|se[cç][aã]o|subse[cç][aã]o|anexo|annex|chapter|section|part)(?:\s+[IVXLC0-9]+|\s*$)"
LEVELS = [(1, r"(?i)^t[ií]tulo"), (2, r"(?i)^(?:cap[ií]tulo|chapter)"), (3, r"(?i)^(?:se[cç][aã]o|section)"), (4, r"(?i)^subse[cç][aã]o")]
GENERIC_HEADER = r"^Coluna\s*[0-9]+$"
PROSE_SIZE, TABLE_SIZE, LEAST = 1_200, 2_500, 300


def text_kind(text: Column, bold: Column | None = None) -> Column:
    """article, heading or text; a bold line of at most 90 characters and ten words without a stop is a heading."""
    t = collapse(text)
    short = (F.length(t) > 0) & (F.length(t) <= 90) & (F.size(F.split(t, " ")) <= 10) & ~t.rlike(r"[.;:?!]$")
    label = F.coalesce(bold, F.lit(False)) & short if bold is not None else F.lit(False)
    return F.when(t.rlike(ARTICLE), "article").when(t.rlike(HEADING) | label, "heading").otherwise("text")


def heading_level(text: Column) -> Column:
    out = F.lit(5)
    for level, pattern in reversed(LEVELS):
        out = F.when(collapse(text).rlike(pattern), level).otherwise(out)
    return out


def section_paths(units: DataFrame) -> DataFrame:
    """Of (key, pos, kind, text): the units with the path of open headings and the article they stand in.

    For each level the last heading so far counts if no heading of a smaller level came after it; that is
    a comparison of positions, so one window over a document's units gives every path.
    """
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = units.withColumn("level", F.when(F.col("kind") == "heading", heading_level(F.col("text"))))
    label = collapse(F.col("text"))
    last = {n: F.max(F.when(F.col("level") == n, F.struct("pos", label.alias("label")))).over(w) for n in range(1, 6)}
    u = u.withColumns({f"h{n}": c for n, c in last.items()})
    u = u.withColumn("head", F.max(F.when(F.col("kind") == "heading", F.col("pos"))).over(w)).withColumn("art", F.max(F.when(F.col("kind") == "article", F.struct("pos", F.regexp_extract(label, ARTICLE, 0).alias("label")))).over(w))
    parts = []
    for n in range(1, 6):
        above = F.array_max(F.array(F.lit(-1).cast("long"), *[F.coalesce(F.col(f"h{m}.pos"), F.lit(-1)).cast("long") for m in range(1, n)]))
        parts.append(F.when(F.col(f"h{n}.pos") > above, F.col(f"h{n}.label")))
    parts.append(F.when((F.col("kind") != "heading") & (F.col("art.pos") > F.coalesce("head", F.lit(-1))), F.col("art.label")))
    return u.select("key", "pos", "kind", "text", F.nullif(F.concat_ws(" > ", *parts), F.lit("")).alias("path"))


def generic_headers(headers: Column) -> Column:
    return (F.size(headers) > 0) & F.forall(headers, lambda h: F.trim(h).rlike(GENERIC_HEADER))


def serialize_row(headers: Column, cells: Column) -> Column:
    """`header: cell` lines with two real headers or more, else the cells that are not empty between bars."""
    clean = F.transform(cells, lambda c: F.coalesce(collapse(c), F.lit("")))
    plain = F.array_join(F.filter(clean, lambda c: c != ""), " | ")
    n = F.least(F.size(headers), F.size(cells))
    named = F.array_join(F.zip_with(F.slice(headers, F.lit(1), n), F.slice(clean, F.lit(1), n), lambda h, c: F.concat(h, F.lit(": "), c)), "\n")
    return F.when((F.size(headers) < 2) | generic_headers(headers), plain).otherwise(named)


def table_rows(text: Column) -> Column:
    """Rows of cells of a table written with bars, without blank rows."""
    lines = F.filter(F.split(F.regexp_replace(text, r"\[/?TABELA\] ?", ""), "\n"), lambda x: x.contains("|"))
    return F.filter(F.transform(lines, lambda x: F.transform(F.split(x, r"\|"), lambda c: F.trim(c))), lambda r: F.exists(r, lambda c: c != ""))


def supported(cells: Column, page: Column) -> Column:
    """Whether any cell of a table stands in the page's text."""
    return F.exists(cells, lambda c: (F.length(c) > 3) & F.contains(page, c))


def overlap_share(a: Column, b: Column) -> Column:
    """Shared area of two boxes (x0, y0, x1, y1) over the smaller one's, 0 if it has none."""
    width = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    height = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    least = F.least(area(a), area(b))
    return F.when(least > 0, width * height / least).otherwise(0.0)


def duplicate_tables(tables: DataFrame, share: float = 0.9) -> DataFrame:
    """Of (page_key, table_id, signature, box): tables that repeat an earlier one of the page, by signature and overlap."""
    a, b = tables.alias("a"), tables.alias("b")
    j = a.join(b, (F.col("a.page_key") == F.col("b.page_key")) & (F.col("a.signature") == F.col("b.signature")) & (F.col("a.table_id") < F.col("b.table_id")))
    return j.filter(overlap_share(F.col("a.box"), F.col("b.box")) >= share).select(F.col("b.page_key").alias("page_key"), F.col("b.table_id").alias("table_id")).distinct()


def _prose(text: str, size: int) -> list[str]:
    """Pieces of at most `size`, cut at the last sentence mark or blank of the second half."""
    out = []
    while len(text) > size:
        half = text[size // 2 : size]
        mark = max(half.rfind(s) for s in (". ", "; ", ": ", "? ", "! "))
        cut = size // 2 + mark + 1 if mark >= 0 else size // 2 + half.rfind(" ") if " " in half else size
        out.append(text[:cut].strip())
        text = text[cut:].strip()
    return [*out, text] if text else out


def _table(head: str, rows: list[str], size: int) -> list[str]:
    """Chunks of whole rows, each under the repeated head; a row too large by itself is cut."""
    close = "\n[/TABELA]"
    wrap = lambda body: f"{head}\n\n" + "\n\n".join(body) + close if body else head + close
    out, held = [], []
    for row in rows:
        for part in [row] if len(wrap([row])) <= size else _prose(row, max(LEAST, size - len(wrap([""])))):
            if held and len(wrap([*held, part])) > size:
                out.append(wrap(held))
                held = []
            held.append(part)
    return [*out, wrap(held)] if held or not out else out


def pack_page(kinds: list[str], texts: list[str], paths: list[str | None], size: int = PROSE_SIZE, table_size: int = TABLE_SIZE, least: int = LEAST) -> list[tuple[str, str | None]]:
    """Chunks (text, path) of one page's units in order: prose within a path, tables whole, headings with what follows them."""
    out: list[tuple[str, str | None]] = []
    parts: list[str] = []
    path: str | None = None
    heading: list[str] = []

    def flush() -> None:
        if parts:
            out.append(("\n\n".join(parts), path))
            parts.clear()

    i = 0
    while i < len(kinds):
        if kinds[i] == "heading":
            flush()
            heading.append(texts[i])
            path = paths[i]
        elif kinds[i] == "table":
            flush()
            j = i + 1
            while j < len(kinds) and kinds[j] == "table_row":
                j += 1
            head = "\n\n".join([*heading, texts[i]])
            heading.clear()
            out += [(t, paths[i]) for t in _table(head, texts[i + 1 : j], table_size)]
            i = j
            continue
        else:
            lead = "\n\n".join(heading)
            heading.clear()
            text = f"{lead}\n\n{texts[i]}" if lead else texts[i]
            if parts and (paths[i] != path or len("\n\n".join([*parts, text])) > size):
                flush()
            path = paths[i]
            if len(text) > size:
                flush()
                out += [(p, path) for p in _prose(text, size)]
            else:
                parts.append(text)
        i += 1
    if heading:
        flush()
        out.append(("\n\n".join(heading), path))
    flush()
    # A chunk too small joins the next of its page, the last one the one before.
    merged: list[tuple[str, str | None]] = []
    carry: tuple[str, str | None] | None = None
    for text, p in out:
        if carry:
            text, p, carry = carry[0] + "\n\n" + text, p or carry[1], None
        if len(text) < least:
            carry = (text, p)
        else:
            merged.append((text, p))
    if carry:
        merged = [*merged[:-1], (merged[-1][0] + "\n\n" + carry[0], merged[-1][1] or carry[1])] if merged else [carry]
    return merged


def pack_units(units: DataFrame) -> DataFrame:
    """Of (page_key, pos, kind, text, path): chunks of each page; a page is the unit of work, never a document."""
    kind = units.schema["page_key"].dataType.simpleString()

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("pos")
        packed = pack_page(page["kind"].tolist(), page["text"].fillna("").tolist(), [p if isinstance(p, str) else None for p in page["path"]])
        return pd.DataFrame({"page_key": [page["page_key"].iloc[0]] * len(packed), "chunk": range(len(packed)), "text": [t for t, _ in packed], "path": [p for _, p in packed]})

    return units.groupBy("page_key").applyInPandas(run, f"page_key {kind}, chunk int, text string, path string")

