"""Ingest as a stream of files: evidence rules are stateless and run unchanged; ids are deduplicated in a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_parquet(spark: SparkSession, folder: str, schema, files_per_batch: int = 16) -> DataFrame:
    """New parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_seen(rows: DataFrame, id_col: str, time_col: str, delay: str) -> DataFrame:
    """Each id once within the watermark; the state is dropped behind it."""
    x = rows.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay)
    return x.dropDuplicatesWithinWatermark([id_col])


def windowed_counts(rows: DataFrame, time_col: str, key: str, width: str, delay: str) -> DataFrame:
    """(window_start, key, n) per tumbling window; late rows beyond the delay are dropped by the watermark."""
    x = rows.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay)
    return x.groupBy(F.window(time_col, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def ingest_available(rows: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there to a parquet table, exactly once, and ends; a restart goes on where it stopped."""
    return transform(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
