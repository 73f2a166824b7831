"""Structured Streaming forms of the live operators.

Sources are folders of feed snapshots or tables; every query can run with ``availableNow`` (catch up and
stop) or on a timer. Checkpoints and outputs live in the shared folder.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.catalogs import latest_per_key
from riskweave.sources import schemas
from riskweave.sources.files import feed_rows
from riskweave.session import small
from riskweave.sources.sinks import ledger_append_once


def table_stream(spark: SparkSession, folder: str, name: str, schema: str, time: str | None = None, max_files: int | None = None) -> DataFrame:
    """A Parquet table of a folder as a stream; *time* is cast so that it can carry a watermark."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    df = r.parquet(folder)
    return df.withColumn(time, F.col(time).cast("timestamp")) if time else df


def feed_stream(spark: SparkSession, folder: str, max_files: int = 1) -> DataFrame:
    """Overlapping feed snapshots (FeatureCollection documents) as catalog rows."""
    docs = spark.readStream.schema(schemas.FEED).option("maxFilesPerTrigger", max_files).json(folder)
    rows = feed_rows(docs)
    return rows.withColumns({"time": F.col("time").cast("timestamp"), "updated": F.col("updated").cast("timestamp")})


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process everything available and stop.

    Append mode writes Parquet through the file sink. Other modes, or *each*, go through foreachBatch;
    a batch is written to its own folder, so a replayed batch overwrites itself.
    """
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append" and each is None:
        w = w.format("parquet").option("path", out)
    else:
        def write(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch}"))
        w = w.foreachBatch(each or write)
    w.start().awaitTermination()


def latest_revisions(rows: DataFrame, delay: str = "7 days") -> DataFrame:
    """Newest revision per event as the feed repeats itself; older revisions change nothing.

    A partial aggregation in state: copies of one event merge inside each task. The day of the event is
    part of the key, so state older than the overlap of the feed is dropped by the watermark.
    """
    rest = [c for c in rows.columns if c != "id"]
    order = F.struct(F.coalesce("updated", F.lit("1970-01-01").cast("timestamp")), "time")
    g = rows.withWatermark("time", delay).groupBy("id", F.window("time", "1 day")).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return g.select("id", *[F.col(f"r.{c}").alias(c) for c in rest])


def settle(updates: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """Final state from the update log of a stream."""
    return latest_per_key(updates, keys, *order)


def tumbling_counts(rows: DataFrame, keys: Sequence[str], time: str, delay: str = "1 hour", size: str = "1 day") -> DataFrame:
    g = rows.withWatermark(time, delay).groupBy(*keys, F.window(time, size)).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.col("window.start").alias("start"), "n")


def rolling_counts(rows: DataFrame, keys: Sequence[str], time: str, size: str = "30 days", step: str = "1 day", delay: str = "1 hour") -> DataFrame:
    g = rows.withWatermark(time, delay).groupBy(*keys, F.window(time, size, step)).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def ledger_stream(records: DataFrame, path: str, checkpoint: str, minutes: int = 60) -> None:
    """One ledger record per slot; a replayed batch finds its slots taken."""
    def each(df: DataFrame, batch: int) -> None:
        ledger_append_once(df, path, minutes=minutes)

    drain(records, path, checkpoint, each=each)


def available_intervals(releases: DataFrame, available: str, value: str) -> DataFrame:
    """Validity interval of every release: from its publication to the next one (one row per release)."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy(available)
    return releases.select(F.col(available).alias("valid_from"), F.coalesce(F.lead(available).over(w), F.lit("9999-12-31").cast("date")).alias("valid_to"), value)


def late_available_join(rows: DataFrame, intervals: DataFrame, day: str) -> DataFrame:
    """Value known on each day: a release is visible from its publication on."""
    hit = (F.col(day) >= F.col("valid_from")) & (F.col(day) < F.col("valid_to"))
    return rows.join(small(intervals), hit, "left").drop("valid_to")
