"""Vector search: exact top-k in blocks, reranking of candidates, feedback, comparisons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.lexical import top

#: Vectors in a block of queries; a block of 4,096 of 1,024 numbers takes 32 MB.
QUERY_BLOCK, CORPUS_BLOCK = 4_096, 8_192


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if either is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def blocks(vectors: DataFrame, key: str, vector: str, rows: int, prefix: str, more: list[str] | None = None) -> DataFrame:
    """Vectors packed in arrays of at most `rows` where they lie, without a shuffle; `more` columns are packed beside them."""
    more = more or []
    packed = vectors.select(F.col(key).alias(f"{prefix}k"), F.col(vector).cast("array<double>").alias(f"{prefix}v"), *more).filter(f"{prefix}v IS NOT NULL")
    kinds = {n: t for n, t in packed.dtypes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(part: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(part).combine_chunks()
            out = []
            for c in t.itercolumns():
                flat = c.chunk(0) if c.num_chunks else pa.array([], type=c.type)
                out.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], type=pa.int32()), flat))
            # The vectors of a block are one long array.
            out[1] = pa.ListArray.from_arrays(pa.array([0, len(out[1].values.flatten())], type=pa.int32()), out[1].values.flatten())
            return pa.RecordBatch.from_arrays(out, names=t.column_names)

        kept, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                if size and size + part.num_rows > rows:
                    yield one(kept)
                    kept, size = [], 0
                kept.append(part)
                size += part.num_rows
        if size:
            yield one(kept)

    schema = ", ".join(f"{n} " + (t if n == f"{prefix}v" else f"array<{t}>") for n, t in kinds.items())
    return packed.mapInArrow(run, schema)


def _unit(flat: pa.Array, n: int) -> np.ndarray:
    m = flat.to_numpy(zero_copy_only=False).reshape(n, -1)
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def search(queries: DataFrame, corpus: DataFrame, k: int = 100, qid: str = "qid", key: str = "id", vector: str = "vector", digits: int = 6, query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK) -> DataFrame:
    """Columns (qid, id, score, rank): the k nearest by cosine of a stated query set against all rows, ties by id.

    Blocks of queries meet blocks of the corpus; each meeting is one matrix product whose k best leave the
    worker, and a ranked cut over those gives the result.  Zero vectors score 0.
    """
    q_kind, c_kind = queries.schema[qid].dataType.simpleString(), corpus.schema[key].dataType.simpleString()
    left = blocks(queries, qid, vector, query_block, "q")
    right = blocks(corpus, key, vector, corpus_block, "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qk, qv, ck, cv = (batch.column(j)[i].values for j in range(4))
                scores = np.round(_unit(qv, len(qk)) @ _unit(cv, len(ck)).T, digits) + 0.0
                keys = np.array(ck.to_pylist())
                order = np.argsort(keys, kind="stable")
                best = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]]
                rows = np.repeat(np.arange(len(qk)), best.shape[1])
                flat = best.ravel()
                yield pa.RecordBatch.from_arrays([qk.take(pa.array(rows)), ck.take(pa.array(flat)), pa.array(scores[rows, flat])], names=[qid, "id", "score"])

    # Blocks, not rows, are crossed: a stated query set against all rows.
    met = left.crossJoin(right).select("qk", "qv", "ck", "cv")
    found = met.mapInArrow(run, f"{qid} {q_kind}, id {c_kind}, score double")
    return top(found, k, qid)


def score_candidates(candidates: DataFrame, queries: DataFrame, corpus: DataFrame, qid: str = "qid", key: str = "id", vector: str = "vector") -> DataFrame:
    """Candidates (qid, id) scored by cosine and ranked; unknown ids are left out."""
    q = queries.select(qid, F.col(vector).alias("a"))
    c = corpus.select(F.col(key).alias("id"), F.col(vector).alias("b"))
    scored = candidates.join(c, "id").join(q, qid).select(qid, "id", F.round(cosine(F.col("a"), F.col("b")), 6).alias("score"))
    w = Window.partitionBy(qid).orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w))


def mean_vectors(rows: DataFrame, by: str, vector: str = "vector") -> DataFrame:
    """Columns (by, vector): the mean of each group's vectors, element by element."""
    e = rows.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return e.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


def feedback(queries: DataFrame, ranked: DataFrame, corpus: DataFrame, k: int = 5, beta: float = 0.5, qid: str = "qid", key: str = "id", vector: str = "vector") -> DataFrame:
    """Queries moved towards the mean of their k best and brought to length 1."""
    best = ranked.filter(F.col("rank") <= k).join(corpus.select(F.col(key).alias("id"), F.col(vector).alias("vector")), "id").select(qid, "vector")
    mean = mean_vectors(best, qid).withColumnRenamed("vector", "m")
    moved = queries.join(mean, qid).select(qid, F.zip_with(F.col(vector), F.col("m"), lambda x, y: x.cast("double") + beta * y).alias("v"))
    size = F.sqrt(dot(F.col("v"), F.col("v")))
    return moved.select(qid, F.transform("v", lambda x: F.when(size > 0, x / size).otherwise(x)).alias(vector))


def compare_top(a: DataFrame, b: DataFrame, near: int = 5, far: int = 100, qid: str = "qid") -> DataFrame:
    """For each query of both: equal order and equal set of the first `near`, overlap of sets to `far`."""

    def lists(r: DataFrame, n: str) -> DataFrame:
        x = r.filter(F.col("rank") <= far).groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("l"))
        return x.select(qid, F.transform("l", lambda s: s["id"]).alias(n))

    both = lists(a, "a").join(lists(b, "b"), qid)
    first = lambda c: F.slice(c, 1, near)
    return both.select(qid, (first("a") == first("b")).alias("same_order"), (F.array_sort(first("a")) == F.array_sort(first("b"))).alias("same_set"), (F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).alias("jaccard"))


def places(asked: DataFrame, queries: DataFrame, corpus: DataFrame, qid: str = "qid", key: str = "id", vector: str = "vector", digits: int = 6, query_block: int = 512, corpus_block: int = CORPUS_BLOCK) -> DataFrame:
    """Of asked (qid, id): columns (qid, id, score, higher, rank), where each asked row stands among all rows of the corpus.

    higher counts the rows with a greater score, rank also those of equal score and lesser id, and itself.  Blocks of
    queries, each with its asked rows, meet blocks of the corpus; only counts leave the workers.
    """
    scored = score_candidates(asked.select(qid, "id").distinct(), queries, corpus, qid, key, vector).drop("rank")
    own = scored.groupBy(qid).agg(F.collect_list(F.struct("score", "id")).alias("l"))
    left = blocks(queries.join(own, qid), qid, vector, query_block, "q", ["l"])
    right = blocks(corpus, key, vector, corpus_block, "c")
    q_kind, c_kind = queries.schema[qid].dataType.simpleString(), corpus.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qk, qv, lists, ck, cv = (batch.column(j)[i].values for j in range(5))
                scores = np.round(_unit(qv, len(qk)) @ _unit(cv, len(ck)).T, digits) + 0.0
                keys = np.array(ck.to_pylist())
                owner, ids, higher, before = [], [], [], []
                for row, own_list in enumerate(lists.to_pylist()):
                    ordered = np.sort(scores[row])
                    for x in own_list:
                        s = round(x["score"], digits) + 0.0
                        above = len(ordered) - np.searchsorted(ordered, s, side="right")
                        same = above < len(ordered) - np.searchsorted(ordered, s, side="left")
                        owner.append(row)
                        ids.append(x["id"])
                        higher.append(int(above))
                        before.append(int((keys[scores[row] == s] < x["id"]).sum()) if same else 0)
                yield pa.RecordBatch.from_arrays([qk.take(pa.array(owner, type=pa.int64())), pa.array(ids, type=ck.type), pa.array(higher, type=pa.int64()), pa.array(before, type=pa.int64())], names=[qid, "id", "higher", "before"])

    met = left.crossJoin(right).select("qk", "qv", "l", "ck", "cv")
    counts = met.mapInArrow(run, f"{qid} {q_kind}, id {c_kind}, higher bigint, before bigint").groupBy(qid, "id").agg(F.sum("higher").alias("higher"), F.sum("before").alias("before"))
    return scored.join(counts, [qid, "id"]).select(qid, "id", "score", "higher", (F.col("higher") + F.col("before") + 1).alias("rank"))


def routed(queries: DataFrame, corpus: DataFrame, required: DataFrame, k: int = 5, qid: str = "qid", key: str = "id", vector: str = "vector") -> DataFrame:
    """The k best inside each required document of (qid, document), with their rank among all rows: (qid, document, id, inside, rank).

    Every row of a required document is scored; corpus has a column document.
    """
    within = required.join(corpus.select(F.col(key).alias("id"), "document", F.col(vector).alias("b")), "document").join(queries.select(qid, F.col(vector).alias("a")), qid)
    w = Window.partitionBy(qid, "document").orderBy(F.col("score").desc(), "id")
    scored = within.select(qid, "document", "id", F.round(cosine(F.col("a"), F.col("b")), 6).alias("score"))
    best = scored.withColumn("inside", F.row_number().over(w)).filter(F.col("inside") <= k).drop("score")
    return best.join(places(best, queries, corpus, qid, key, vector).select(qid, "id", "rank"), [qid, "id"]).select(qid, "document", "id", "inside", "rank")
