"""Profiles: standardised features, summaries, pairwise distances, clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / (std + 1e-9) with missing values at 0; the statistics are one row."""
    stats = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))
    z = {c: F.coalesce((F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + 1e-9), F.lit(0.0)) for c in columns}
    return out.withColumns(z).select(*df.columns)


def summary_stats(frame: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Mean, deviation, share above median + half a deviation, and change per decade of a daily frame."""
    known = F.col(value).isNotNull()
    at = F.when(known, F.col(day))
    s = frame.groupBy(*keys).agg(
        F.percentile(value, 0.5).alias("__med"), F.stddev_samp(value).alias("std"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("__n"),
        F.min_by(value, at).alias("__first"), F.max_by(value, at).alias("__last"))
    decades = F.greatest(F.col("__n") / 365.25 / 10, F.lit(0.1))
    high = F.when(known, (F.col(value) > F.col("__med") + 0.5 * F.col("std")).cast("double"))
    return frame.join(s, list(keys)).groupBy(*keys).agg(
        F.first("mean").alias("mean"), F.first("std").alias("std"), F.avg(high).alias("frac_high"),
        F.first((F.col("__last") - F.col("__first")) / decades).alias("trend_per_decade"))


def pairwise_distance(profiles: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Euclidean distance of every two standardised profiles.

    Profiles are one row per configured segment or station, so the table is short however many rows
    it was aggregated from.
    """
    z = standardize(profiles.select(key, *columns), columns)
    a = z.select(F.col(key).alias("a"), *[F.col(c).alias(f"__a_{c}") for c in columns])
    b = z.select(F.col(key).alias("b"), *[F.col(c).alias(f"__b_{c}") for c in columns])
    d = sum((F.pow(F.col(f"__a_{c}") - F.col(f"__b_{c}"), 2) for c in columns), F.lit(0.0))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.sqrt(d).alias("distance"))
