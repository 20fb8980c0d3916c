"""Streams of timed rows: resume without repeats, sessions by silence, carried maxima. Each takes a batch or a streaming frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(rows: DataFrame, at: str, lateness: str) -> DataFrame:
    """``at`` as a timestamp with a zone, and a watermark on streams: rows later than ``lateness`` may be dropped there."""
    rows = rows.withColumn(at, F.col(at).cast("timestamp"))
    return rows.withWatermark(at, lateness) if rows.isStreaming else rows


def first_seen(rows: DataFrame, keys: list[str], at: str, lateness: str = "1 hour") -> DataFrame:
    """One row for each key. On a stream, repeats within ``lateness`` are dropped and the state of older keys is let go."""
    rows = timed(rows, at, lateness)
    return rows.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def sessions(rows: DataFrame, keys: list[str], at: str, gap: str, lateness: str = "1 hour") -> DataFrame:
    """Runs of rows of a key with no silence over ``gap``: keys, start, end, n."""
    window = F.session_window(at, gap)
    return timed(rows, at, lateness).groupBy(*keys, window.alias("w")).agg(F.count("*").alias("n"), F.max(at).alias("end")).select(*keys, F.col("w.start").alias("start"), "end", "n")


def peaks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The greatest value so far of each key: on a stream, in update mode, the carried state is one number a key."""
    return rows.groupBy(*keys).agg(F.max(value).alias("peak"), F.count("*").alias("n"))


def append_new(stream: DataFrame, table: str, keys: list[str], checkpoint: str, **trigger):
    """Append rows whose key the Parquet table at ``table`` doesn't hold yet: a restart, or a repeated batch, adds nothing twice."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        try:
            have = spark.read.parquet(table).select(*keys)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        else:
            new = new.join(have, keys, "left_anti")
        new.write.mode("append").parquet(table)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(merge).start()
