"""Top-k, recency and staleness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.geo import col, haversine_km
from riskweave.session import cut_lineage


def topk_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First *k* rows per key; the rank filter lets Spark keep k rows per task before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def diversified_topk(cells: DataFrame, score: str, n: int = 8, min_km: float = 300.0, la: str = "la", lo: str = "lo") -> DataFrame:
    """Greedy best cells that lie at least *min_km* apart (cell centres).

    Every pick is a distributed top-1 among the cells far from the earlier picks, so only *n* rows
    ever reach the driver and no candidate is cut off.
    """
    spark = cells.sparkSession
    # every pick reads the scores again, so they start from files
    cells = cut_lineage(cells.select(la, lo, F.col(score).cast("double").alias(score)))
    picks, rest = [], cells
    for i in range(n):
        best = rest.orderBy(F.desc(score), la, lo).limit(1).first()
        if best is None:
            break
        picks.append((i + 1, best[la], best[lo], best[score]))
        d = haversine_km(F.col(la) + 0.5, F.col(lo).cast("double"), F.lit(best[la] + 0.5), F.lit(float(best[lo])))
        rest = rest.filter(d >= min_km)
    types = cells.schema
    return spark.createDataFrame(picks, f"pick int, {la} {types[la].dataType.simpleString()}, {lo} {types[lo].dataType.simpleString()}, {score} double")


def recent_events(events: DataFrame, as_of: Column, days: int = 7, time: str = "time") -> DataFrame:
    """Events of the last *days* with their age in hours at a fixed instant."""
    start = F.timestamp_add("DAY", F.lit(-days), as_of)
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))) / F.lit(3600e6)
    return events.filter(F.col(time) >= start).withColumn("age_hours", age)


def stale(generated, as_of: Column, minutes: int = 20) -> Column:
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(col(generated).cast("timestamp"))
    return age > minutes * 60_000_000
