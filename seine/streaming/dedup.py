"""Streams: first of each key within a time to live, running budgets, changes between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_within(stream: DataFrame, keys: list[str], at: str, ttl: str) -> DataFrame:
    """Rows whose key wasn't seen within `ttl`; state older than that goes, so it stays bounded."""
    return stream.withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, by: str, width: str, late: str) -> DataFrame:
    """(window start, by, n) of event-time windows, closed once the watermark has passed them."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def budget_left(stream: DataFrame, at: str, by: str, cap: int, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Calls used and left for each provider and day."""
    return windowed_counts(stream, at, by, width, late).withColumn("remaining", F.greatest(F.lit(0), F.lit(cap) - F.col("n")))


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Everything there is now, through the stream, as Parquet in a new folder; rows go from the tasks to the files.

    update: each batch's changed rows are written under its number, and for each key the last batch's row counts, so
    that windows still open at the end are in the result. See `latest`.
    """
    out = f"{folder}/rows"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema if mode == "append" else stream.schema.add("batch", "long")).parquet(out)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of run_once's rows in update mode the last for each key."""
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(*keys, "last.*")
