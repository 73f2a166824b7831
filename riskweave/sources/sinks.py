"""Sinks: partitioned tables, JSON documents, the append-once ledger, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_series(df: DataFrame, path: str, partition_by: Sequence[str] = ("segment",), mode: str = "overwrite") -> None:
    """Partitioned Parquet; rows are clustered by partition so that tasks do not open every folder.

    A rebalancing exchange clusters them: adaptive execution splits a busy partition by its measured
    size, so it is written by as many tasks as it needs, and merges small ones.
    """
    df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)


def json_documents(df: DataFrame, chunk: str, fields: Sequence[str], header: dict[str, Column]) -> DataFrame:
    """One JSON document per *chunk*: header values, field names and the rows as arrays.

    A document holds one chunk (such as a latitude band of cells), never the whole table.
    """
    row = F.array(*[F.col(c).cast("double") for c in fields])
    docs = df.groupBy(chunk).agg(F.sort_array(F.collect_list(row)).alias("cells"))
    doc = F.struct(*[c.alias(k) for k, c in header.items()], F.array(*[F.lit(f) for f in fields]).alias("fields"),
                   F.size("cells").alias("n_cells"), F.col("cells"))
    return docs.select(F.col(chunk), F.to_json(doc).alias("value"))


def slot_of(issued: str | Column, minutes: int = 60) -> Column:
    """Start of the interval that contains a time; intervals above an hour start on the hour."""
    t = F.col(issued) if isinstance(issued, str) else issued
    hour = F.date_trunc("HOUR", t.cast("timestamp"))
    if minutes > 60:
        return hour.cast("timestamp_ntz")
    step = F.floor(F.minute(t) / minutes) * minutes
    return F.timestamp_add("MINUTE", step.cast("int"), hour).cast("timestamp_ntz")


def ledger_append_once(records: DataFrame, path: str, issued: str = "issued_at", minutes: int = 60, order: str | None = None) -> DataFrame:
    """Append the slots that the ledger does not hold yet; existing slots are never rewritten.

    Within one call the first record of a slot (by *order*, then issue time) is taken. One writer per
    ledger. Returns the appended slots.
    """
    spark = records.sparkSession
    stamped = records.withColumn("slot", slot_of(issued, minutes))
    rest = [c for c in stamped.columns if c != "slot"]
    first = stamped.groupBy("slot").agg(
        F.min_by(F.struct(*rest), F.struct(*([order] if order else []), issued)).alias("__r"))
    fresh = first.select("slot", *[F.col(f"__r.{c}").alias(c) for c in rest])
    held = ledger_slots(spark, path)
    if held is not None:
        fresh = fresh.join(held, "slot", "left_anti")
    fresh = fresh.withColumns({"immutable": F.lit(True), "slot_date": F.to_date("slot")})
    fresh.write.mode("append").partitionBy("slot_date").parquet(path)
    return fresh.select("slot")


def ledger_slots(spark: SparkSession, path: str) -> DataFrame | None:
    """Slots in a ledger, or None before its first write."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    return spark.read.parquet(path).select("slot").distinct()


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free fingerprint of a table: xor of row digests and the row count."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    digest = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")
    return df.agg(F.bit_xor(digest).alias("fingerprint"), F.count(F.lit(1)).alias("n_rows"))
