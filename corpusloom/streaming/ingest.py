"""Structured streaming: chunk ingestion without repeats, and windowed counts of late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import chunk_id


def distinct_chunks(stream: DataFrame, time: str, document: str, text: str, delay: str = "7 days") -> DataFrame:
    """A stream of chunks with content ids, each id once within the delay; state is dropped with the watermark."""
    made = stream.withWatermark(time, delay).withColumn("chunk_id", chunk_id(F.col(document), F.col(text)))
    return made.dropDuplicatesWithinWatermark(["chunk_id"])


def windowed_counts(stream: DataFrame, time: str, by: str, size: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    w = F.window(time, size, slide) if slide else F.window(time, size)
    counts = stream.withWatermark(time, delay).groupBy(w.alias("w"), by).agg(F.count("*").alias("events"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), by, "events")


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Writes each batch's rows whose key the target lacks; a batch that is tried again adds nothing."""
    from pyspark.errors import AnalysisException

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates([key])
        try:
            rows = rows.join(batch.sparkSession.read.parquet(path).select(key), key, "left_anti")
        except AnalysisException:
            pass  # nothing is stored yet
        rows.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
