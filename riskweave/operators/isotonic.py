"""Isotonic calibration as a table of pooled blocks, fitted and applied without a model on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.quantiles import bucket_of, split_points
from riskweave.session import cut_lineage, small

FAN_IN = 16
POINTS_PER_BUCKET = 256
BLOCK = "lo double, hi double, s double, n double"


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a sorted part: a block that does not exceed the one before is merged into it."""
    stack: list[list[float]] = []
    for batch in batches:
        for lo, hi, s, n in zip(*[batch.column(c).to_pylist() for c in ("lo", "hi", "s", "n")]):
            while stack and stack[-1][2] * n >= s * stack[-1][3]:
                before = stack.pop()
                lo, s, n = before[0], s + before[2], n + before[3]
            stack.append([lo, hi, s, n])
    if stack:
        yield pa.record_batch([pa.array(c, pa.float64()) for c in zip(*stack)], names=["lo", "hi", "s", "n"])


def fit_blocks(df: DataFrame, p: str, y: str, weight: str | None = None) -> DataFrame:
    """(lo, hi, n, rate): pooled scores from lo to hi, their weight and rate, rising with the score.

    Equal scores are merged first. Each range of scores is pooled by itself; as pooling pooled blocks gives the
    same as pooling their rows, the parts are merged by sixteen until one is left, and the later merges see
    blocks only. Null scores, labels and weights do not count; the result is empty if none are left.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(p).cast("double").alias("lo"), (F.col(y).cast("double") * w).alias("s"), w.alias("n")).dropna()
    merged = rows.groupBy("lo").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).filter("n > 0").withColumn("hi", F.col("lo")).select("lo", "hi", "s", "n")
    blocks = cut_lineage(merged.repartitionByRange("lo").sortWithinPartitions("lo").mapInArrow(_pool, BLOCK).withColumn("part", F.spark_partition_id()))
    parts = blocks.agg(F.max("part")).first()[0] or 0
    while parts:
        parts = parts // FAN_IN
        # whole neighbouring parts meet, in their order
        up = blocks.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int"))
        blocks = cut_lineage(up.groupBy("part").applyInArrow(_pool_group, BLOCK + ", part int"))
    return blocks.select("lo", "hi", "n", (F.col("s") / F.col("n")).alias("rate"))


def _pool_group(table: pa.Table) -> pa.Table:
    part = table.column("part")[0].as_py()
    out = pa.Table.from_batches(list(_pool(iter(table.sort_by("lo").combine_chunks().to_batches()))))
    return out.append_column("part", pa.array([part] * out.num_rows, pa.int32()))


def apply_blocks(df: DataFrame, blocks: DataFrame, p: str, out: str = "p_cal") -> DataFrame:
    """*df* with the calibrated score: linear between the ends of blocks, constant beyond the first and the last.

    The ends lie in sorted arrays of a few hundred, one for each range of scores, with the nearest end on either
    side; a row meets the array of its range. Null scores, and all scores under an empty fit, give null.
    """
    ends = blocks.select(F.explode(F.array(F.struct(F.col("lo").alias("x"), F.col("rate").alias("v")), F.struct(F.col("hi").alias("x"), F.col("rate").alias("v")))).alias("e"))
    ends = cut_lineage(ends.select("e.x", "e.v").distinct())
    count = ends.count()
    edges = split_points(ends, "x", min(4096, -(-count // POINTS_PER_BUCKET)))[1] if count > POINTS_PER_BUCKET else []
    held = ends.withColumn("b", bucket_of("x", edges)).groupBy("b").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("ends"))
    every = df.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("b")).join(held, "b", "left")
    w = Window.orderBy("b")  # at most 4,097 rows
    every = every.select(F.col("b").alias("__b"), F.coalesce("ends", F.array().cast("array<struct<x: double, v: double>>")).alias("__ends"),
                         F.last(F.element_at("ends", -1), True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
                         F.first(F.element_at("ends", 1), True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
    x = F.col("__x")
    below = F.coalesce(F.array_max(F.filter("__ends", lambda e: e["x"] <= x)), F.col("__before"))
    above = F.coalesce(F.array_min(F.filter("__ends", lambda e: e["x"] >= x)), F.col("__after"))
    met = df.withColumn("__x", F.col(p).cast("double")).withColumn("__b", bucket_of("__x", edges)).join(small(every), "__b", "left")
    met = met.withColumns({"__lo": below, "__hi": above})
    between = F.col("__lo.v") + (x - F.col("__lo.x")) * (F.col("__hi.v") - F.col("__lo.v")) / F.nullif(F.col("__hi.x") - F.col("__lo.x"), F.lit(0.0))
    value = F.when(F.col("__lo").isNull(), F.col("__hi.v")).when(F.col("__hi").isNull(), F.col("__lo.v")).otherwise(F.coalesce(between, F.col("__lo.v")))
    return met.withColumn("__value", F.when(x.isNotNull(), value)).select(*[c for c in df.columns if c != out], F.col("__value").alias(out))
