"""Stress-transfer edges between segments and their roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.probability import delta_stress
from riskweave.session import small


def stress_edges(events: DataFrame, nodes: DataFrame, source: str = "segment", mag: str = "mag",
                 lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Every event against every other segment (nodes: segment, lat, lon, strike, regime).

    The node table is one row per configured segment, so the expansion is a broadcast.
    """
    src = nodes.select(F.col("segment").alias(source), F.col("strike").alias("__ss"), F.col("regime").alias("__sr"))
    dst = nodes.select(F.col("segment").alias("receiver"), F.col("lat").alias("__rla"), F.col("lon").alias("__rlo"),
                       F.col("strike").alias("__rs"), F.col("regime").alias("__rr"))
    pairs = events.join(small(src), source).join(small(dst), F.col(source) != F.col("receiver"))
    step = delta_stress(mag, lat, lon, "__ss", "__sr", "__rla", "__rlo", "__rs", "__rr")
    return pairs.select(*events.columns, "receiver", step.alias("delta_cfs_bar"))


def step_series(edges: DataFrame, day: str = "day") -> DataFrame:
    """Stress step per (receiver, day)."""
    return edges.groupBy("receiver", day).agg(F.sum("delta_cfs_bar").alias("delta_cfs_bar"))


def transfer_rollup(edges: DataFrame, source: str = "segment") -> DataFrame:
    """Net stress and event count per receiver, and per (receiver, source) with the rank of the source."""
    r = edges.rollup("receiver", source).agg(
        F.sum("delta_cfs_bar").alias("net_cfs_bar"), F.count(F.lit(1)).alias("n_events")).filter("receiver is not null")
    w = Window.partitionBy("receiver", F.col(source).isNull()).orderBy(F.abs("net_cfs_bar").desc(), source)
    r = r.withColumn("source_rank", F.when(F.col(source).isNotNull(), F.row_number().over(w)))
    return r.filter(F.col("source_rank").isNull() | (F.col("source_rank") <= 3))
