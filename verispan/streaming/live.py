"""Structured Streaming around the batch operators: uploads chunked as they arrive, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verispan.operators.ingest import chunk_uploads


def stream_uploads(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Chunk each new *.md file of a folder and append it as Parquet. A batch that is tried again writes the same folder again."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").schema("value string").load(folder)
    named = files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"))

    def put(batch: DataFrame, number: int) -> None:
        chunk_uploads(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return named.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events by type in tumbling windows; rows later than the watermark are left out, as a stream has it."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")
