"""Chunkers as higher-order functions: a fold over at most as many steps as a text can have windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse
from corpusloom.operators.gold import nearest_boundary
from corpusloom.session import cut_lineage

SIZE, OVERLAP, LEAST = 1_200, 200, 300
SEPARATORS = ["\n\n", "\n", ". ", "; ", ", ", " "]


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def fold_windows(text: Column, cut: Callable[[Column, Column], Column], follow: Callable[[Column, Column], Column], steps: Column) -> Column:
    """Spans (start, end) in code points: cut gives each window's end, follow the next start."""
    n = F.length(text)
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def step(state: Column, _: Column) -> Column:
        def close(end: Column) -> Column:
            return F.struct(F.when(end >= n, n).otherwise(follow(state["at"], end)).cast("int").alias("at"), F.concat(state["spans"], F.array(F.struct(state["at"].alias("start"), end.cast("int").alias("stop")))).alias("spans"))

        return F.when(state["at"] >= n, state).otherwise(bind(cut(text, state["at"]), close))

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(steps.cast("int"), F.lit(1))), F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)
    return F.when(n > 0, folded["spans"]).otherwise(empty)


def sliding_cut(size: int, overlap: int, least: int) -> Callable[[Column, Column], Column]:
    """Ends a window after the last sentence mark of its last `overlap` characters, else at the last blank, else at its full size."""

    def cut(text: Column, start: Column) -> Column:
        raw = start + size
        low = F.greatest(start + least, raw - overlap)
        inside = lambda back: F.coalesce(F.nullif(F.regexp_instr(back, F.lit(" [.;:?!]")), F.lit(0)), F.nullif(F.instr(back, " "), F.lit(0)), F.lit(0))
        return F.when(raw >= F.length(text), F.length(text)).otherwise(raw - bind(F.reverse(F.substring(text, low + 1, raw - low)), inside))

    return cut


def sliding_spans(text: Column, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """Overlapping windows over a collapsed text; a short text is one span."""
    progress = max(1, least, size - 2 * overlap)
    follow = lambda start, end: F.least(F.greatest(end - overlap, start + progress), end)
    n = F.length(text)
    one = F.array(F.struct(F.lit(0).alias("start"), n.cast("int").alias("stop")))
    return F.when((n > 0) & (n <= size), one).otherwise(fold_windows(text, sliding_cut(size, overlap, least), follow, n / progress + 2))


def sliding_chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """Chunk texts; a last chunk under `least` joins the one before, with its overlap."""
    parts = F.transform(sliding_spans(text, size, overlap, least), lambda s: F.trim(F.substring(text, s["start"] + 1, s["stop"] - s["start"])))

    def join_tail(p: Column) -> Column:
        k, last = F.size(p), F.element_at(p, -1)
        merged = F.concat(F.slice(p, F.lit(1), F.greatest(k - 2, F.lit(0))), F.array(F.trim(F.concat(F.element_at(p, -2), F.lit(" "), last))))
        return F.when((k >= 2) & (F.length(last) < least), merged).otherwise(p)

    return bind(parts, join_tail)


def separator_spans(text: Column, size: int = 1_000, overlap: int = 200, separators: list[str] | None = None) -> Column:
    """Windows that end after the strongest separator found in their second half."""

    def cut(t: Column, start: Column) -> Column:
        raw = start + size

        def strongest(half: Column) -> Column:
            return F.coalesce(*[F.nullif(F.instr(half, sep[::-1]), F.lit(0)) for sep in separators or SEPARATORS], F.lit(1))

        return F.when(raw >= F.length(t), F.length(t)).otherwise(raw + 1 - bind(F.reverse(F.substring(t, start + size // 2 + 1, size - size // 2)), strongest))

    follow = lambda start, end: F.greatest(end - overlap, start + 1)
    return fold_windows(text, cut, follow, F.length(text) / max(1, size // 2 - overlap) + 2)


def pieces_of(text: Column, spans: Column) -> Column:
    return F.filter(F.transform(spans, lambda s: F.trim(F.substring(text, s["start"] + 1, s["stop"] - s["start"]))), lambda x: x != "")


def merge_small(parts: Column, least: int = LEAST, glue: str = "\n") -> Column:
    """Adds each part under `least` characters to the part before."""
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.length(x) < least), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit(glue), x)))).otherwise(F.concat(done, F.array(x))),
    )


def legal_units(text: Column, least_articles: int = 5) -> Column:
    """Cuts before each article if there are at least so many, else null."""
    marker = r"(?m)^[ \t]*(?:Art\.|Artigo|Article|Artículo) *[0-9]+"
    units = F.filter(F.transform(F.split(F.regexp_replace(text, f"({marker})", "\x01$1"), "\x01"), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")
    return F.when(F.regexp_count(text, F.lit(marker)) >= least_articles, units)


def parent_child(rows: DataFrame, key: str, text: str, parent: int = 3_500, child: int = 400, share: float = 0.2) -> DataFrame:
    """Columns (key, parent_no, child_no, child): children that point at the parent window they lie in."""
    base = rows.select(F.col(key).alias("key"), collapse(F.col(text)).alias("t")).filter("t <> ''")
    up = base.select("key", F.posexplode(pieces_of(F.col("t"), separator_spans(F.col("t"), parent, int(parent * share)))).alias("parent_no", "parent"))
    return up.select("key", "parent_no", F.posexplode(pieces_of(F.col("parent"), separator_spans(F.col("parent"), child, int(child * share)))).alias("child_no", "child"))


def rejoin(parts: Column, least: int = 21, most: int = 400) -> Column:
    """One text from overlapping parts: the longest end of the text so far that begins the next part is written once."""

    def add(done: Column, x: Column) -> Column:
        ends = F.struct(F.right(done, F.lit(most)).alias("end"), F.left(x, F.lit(most)).alias("begin"))
        fits = lambda e, n: (n <= F.length(e["end"])) & (n <= F.length(e["begin"])) & (F.right(e["end"], n) == F.left(e["begin"], n))
        shared = bind(ends, lambda e: F.coalesce(F.array_max(F.filter(F.sequence(F.lit(least), F.lit(most)), lambda n: fits(e, n))), F.lit(0)))
        glued = bind(shared, lambda k: F.when(k > 0, F.concat(done, F.substring(x, k + 1, F.length(x)))).otherwise(F.concat(done, F.lit("\n"), x)))
        return F.when(done == "", x).otherwise(glued)

    return F.aggregate(parts, F.lit(""), add)


def semantic_breaks(sentences: DataFrame, share: float = 0.25, least: int = 300, most: int = 2_500) -> DataFrame:
    """Of (key, pos, chars, vector): the sentences with their chunk number; a chunk ends where neighbours differ most.

    A break comes where the cosine to the sentence before is under the document's percentile; runs between
    breaks then close once they have `least` characters, or before they pass `most`.
    """
    w = Window.partitionBy("key").orderBy("pos")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v, p = F.col("vector"), F.lag("vector").over(w)
    s = sentences.withColumn("previous", p).withColumn("near", F.when(p.isNotNull(), dot(v, F.col("previous")) / F.sqrt(dot(v, v) * dot(F.col("previous"), F.col("previous")))))
    cut = s.groupBy("key").agg(F.percentile("near", share).alias("limit"))
    row = F.struct("pos", "chars", (F.col("near") < F.col("limit")).alias("far"))
    folded = s.join(cut, "key").groupBy("key").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("size"), F.array().cast("array<struct<pos:bigint,chunk:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = (a["size"] > 0) & ((x["far"] & (a["size"] >= least)) | (a["size"] + x["chars"] > most))
        chunk = a["chunk"] + F.when(new, 1).otherwise(0)
        return F.struct(chunk.alias("chunk"), (F.when(new, F.lit(0).cast("long")).otherwise(a["size"]) + x["chars"]).alias("size"), F.concat(a["out"], F.array(F.struct(x["pos"].cast("long").alias("pos"), chunk.alias("chunk")))).alias("out"))

    return folded.select("key", F.explode(F.aggregate("rows", start, step)["out"]).alias("o")).select("key", "o.pos", "o.chunk")


def neutral_windows(rows: DataFrame, key: str, text: str, target: int = 2_600, seed: str = "0") -> DataFrame:
    """Columns (key, start, stop): windows of about `target` characters from a seeded offset, moved to the nearest sentence ends.

    Planned edges and sentence ends of a text meet in one sorted pass; neither carries the text.
    """
    base = rows.select(F.col(key).alias("key"), collapse(F.col(text)).alias("t")).filter(F.length("t") > target)
    sizes = F.transform(F.split(F.regexp_replace("t", r"([.!?]) ", "$1 \x01"), "\x01"), lambda x: F.length(x))
    offset = F.conv(F.left(F.md5(F.concat(F.lit(seed), F.lit("|"), F.col("key").cast("string"))), F.lit(7)), 16, 10).cast("long") % F.lit(target)
    light = cut_lineage(base.select("key", F.length("t").cast("long").alias("n"), offset.alias("offset"), sizes.alias("sizes")))
    ends = light.select("key", F.posexplode("sizes").alias("i", "size"))
    ends = ends.select("key", F.sum("size").over(Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("at"))
    boundaries = ends.union(light.select("key", F.lit(0).cast("long")))
    planned = light.select("key", F.explode(F.sequence("offset", "n", F.lit(target).cast("long"))).alias("a"), "n").select("key", "a", F.least(F.col("a") + target, "n").alias("b")).distinct()
    near = cut_lineage(nearest_boundary(planned.select("key", F.col("a").alias("x")).union(planned.select("key", "b")), boundaries))
    start = near.select("key", F.col("x").alias("a"), F.col("at").alias("start"))
    stop = near.select("key", F.col("x").alias("b"), F.col("at").alias("stop"))
    return planned.join(start, ["key", "a"]).join(stop, ["key", "b"]).filter("stop > start").select("key", "start", "stop").distinct()


def size_statistics(chunks: DataFrame, by: str, chars: str = "chars") -> DataFrame:
    c = F.col(chars)
    return chunks.groupBy(by).agg(F.count("*").alias("chunks"), F.median(c).alias("median"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"), F.count_if(c < 300).alias("under_300"), F.count_if(c > 2500).alias("over_2500"))
