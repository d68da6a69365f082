"""Approximate vector search over an inverted file of cells, with its recall against the exact search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.lexical import top

#: Vectors the centres are fitted on, at most; every vector is indexed.
SAMPLE = 20_000


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def fit_centres(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Spherical k-means centres of the `sample` vectors least by hash."""
    rows = vectors.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    x = _unit(np.array([r.vector for r in rows], dtype=np.float64)) if rows else np.zeros((1, 1))
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(axis=0)
        centres = _unit(centres)
    return centres


def assign(vectors: DataFrame, centres: np.ndarray, probes: int, key: str = "id") -> DataFrame:
    """Columns (key, vector, cell): each vector with its `probes` nearest cells."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _unit(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1))
            near = np.argsort(-(m @ shared.value.T), axis=1, kind="stable")[:, :probes]
            rows = np.repeat(np.arange(b.num_rows), near.shape[1])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * m.shape[1]), pa.array(m[rows].ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), flat, pa.array(near.ravel().astype(np.int32))], names=["key", "vector", "cell"])

    out = vectors.select(F.col(key).alias("key"), F.col("vector").cast("array<double>").alias("vector")).filter("vector IS NOT NULL")
    return out.mapInArrow(run, f"key {kind}, vector array<double>, cell int")


def search_cells(queries: DataFrame, vectors: DataFrame, k: int, cells: int = 16, probes: int = 8) -> DataFrame:
    """Columns (qid, id, score, rank): the k nearest among the vectors of each query's nearest cells.

    Queries and vectors meet by an equi-join on the cell; a crowded cell is spread by adaptive skew handling.
    """
    from corpusloom.operators.dense import dot

    centres = fit_centres(vectors, cells)
    index = assign(vectors, centres, 1).select(F.col("key").alias("id"), F.col("vector").alias("b"), "cell")
    asked = assign(queries, centres, probes, "qid").select(F.col("key").alias("qid"), F.col("vector").alias("a"), "cell")
    return top(asked.join(index, "cell").select("qid", "id", F.round(dot(F.col("a"), F.col("b")), 6).alias("score")), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact search's hits that were found."""
    hit = exact.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
