"""Content-derived ids, fingerprints and page ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import chunk_id, content_hash


def unique_chunk_ids(chunks: DataFrame) -> DataFrame:
    """Columns (id, new_id): document and content hash, with -2, -3 and so on for repeats inside a document."""
    made = chunks.select("id", chunk_id(F.col("document_id"), F.col("text")).alias("base"))
    k = F.row_number().over(Window.partitionBy("base").orderBy("id"))
    return made.withColumn("k", k).select("id", F.when(F.col("k") > 1, F.concat("base", F.lit("-"), "k")).otherwise(F.col("base")).alias("new_id"))


def corpus_fingerprint(records: DataFrame, key: str = "id", text: str = "text", digits: int = 4) -> DataFrame:
    """One row: a hash that changes with any id or text and the number of buckets.

    Records are hashed in buckets by the first digits of their id's hash, in the order of ids, and the
    buckets' hashes in order; no task sees more than a bucket, digits sets how many there are.
    """
    r = records.select(F.col(key).alias("k"), content_hash(F.concat(F.length(key).cast("string"), F.lit(":"), F.col(key), F.coalesce(text, F.lit("")))).alias("h")).withColumn("bucket", F.left(content_hash(F.col("k")), F.lit(digits)))
    b = r.groupBy("bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "").alias("all"))
    hashed = b.select("bucket", content_hash(F.col("all")).alias("h"))
    return hashed.agg(content_hash(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), "")).alias("fingerprint"), F.count("*").alias("buckets"))


def page_ranges(pages: DataFrame) -> DataFrame:
    """Columns (document_id, pages) with pages such as 1-3, 6: islands of consecutive numbers."""
    one = pages.filter(F.col("page").isNotNull()).distinct()
    island = F.col("page") - F.row_number().over(Window.partitionBy("document_id").orderBy("page"))
    runs = one.withColumn("island", island).groupBy("document_id", "island").agg(F.min("page").cast("int").alias("a"), F.max("page").cast("int").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat("a", F.lit("-"), "b"))
    return runs.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))).alias("r")).select("document_id", F.array_join(F.transform("r", lambda x: x["t"]), ", ").alias("pages"))
