"""Binned calibration tables: quantile edges, empirical rates per bin, lookup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.operators.quantiles import bucket_of, quantile_sets, quantiles


def interior_shares(n: int) -> list[float]:
    """Shares of the n - 1 inner edges of n equal-count bins."""
    return [i / n for i in range(1, n)]


def quantile_edges(df: DataFrame, column: str, n: int, positive_only: bool = False) -> list[float]:
    """Inner edges of n bins. With *positive_only* zero has bin 0 for itself and the low values, and the
    n - 1 bins come from the positive values."""
    if positive_only:
        return quantiles(df.filter(F.col(column) > 0), column, [i / (n - 1) for i in range(1, n - 1)])
    return quantiles(df, column, interior_shares(n))


def edge_sets(df: DataFrame, axes: Mapping[str, tuple[str, int, bool]]) -> dict[str, list[float]]:
    """Inner edges of several axes: name -> (column, bins, positive values only)."""
    wanted = {}
    for name, (column, n, positive) in axes.items():
        wanted[name] = ((f"CASE WHEN `{column}` > 0 THEN `{column}` END", [i / (n - 1) for i in range(1, n - 1)]) if positive
                        else (f"`{column}`", interior_shares(n)))
    return quantile_sets(df, wanted)


def bin_of(column: str, edges: Sequence[float]) -> Column:
    """Bin number: inner edges at or below the value."""
    return bucket_of(column, list(edges))


def binned_rate(df: DataFrame, bins: Sequence[tuple[str, int]], y: str, min_count: int, monotone: bool = True,
                fill: str = "row") -> DataFrame:
    """Empirical rate per bin combination, complete over all bins.

    Bins below *min_count* take the mean of their row (fixed leading axes), then of their slab (fixed first
    axis), then of all bins (``fill="grid"`` takes the mean of all bins at once), and at last the overall
    rate. With *monotone* rates are accumulated along the last axis. The table has a fixed number of rows.
    """
    spark: SparkSession = df.sparkSession
    names = [b for b, _ in bins]
    spine = spark.range(1).select(*[F.lit(0).alias("__z")])
    for b, n in bins:
        spine = spine.withColumn(b, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    got = df.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"))
    t = spine.drop("__z").join(got, names, "left")
    whole = Window.partitionBy(F.lit(0))
    t = t.withColumns({
        "n": F.coalesce("n", F.lit(0)),
        "__raw": F.when(F.col("n") >= min_count, F.col("s") / F.col("n")),
        "__base": F.sum("s").over(whole) / F.sum("n").over(whole)})
    steps = [F.col("__raw")]
    if fill == "row" and len(names) > 1:
        steps.append(F.avg("__raw").over(Window.partitionBy(*names[:-1])))
        t = t.withColumn("__row", F.coalesce(*steps))
        steps = [F.col("__row")] + ([F.avg("__row").over(Window.partitionBy(names[0]))] if len(names) > 2 else [])
    else:
        steps.append(F.avg("__raw").over(whole))
    t = t.withColumn("p", F.coalesce(*steps, F.col("__base")))
    if monotone:
        along = Window.partitionBy(*(names[:-1] or [F.lit(0)])).orderBy(names[-1]).rowsBetween(Window.unboundedPreceding, 0)
        t = t.withColumn("p", F.max("p").over(along))
    return t.select(*names, "n", "p")


def apply_binned(df: DataFrame, table: DataFrame, bins: Sequence[str], out: str = "p") -> DataFrame:
    """Look up the rate of each row's bins; the table has one row per bin, so it is broadcast."""
    return df.join(F.broadcast(table.select(*bins, F.col("p").alias(out))), list(bins))


def quantile_knots(df: DataFrame, column: str, n: int = 5, step: float = 1e-4) -> list[float]:
    """Strictly increasing knots at the 2/25/50/75/98 % quantiles, or n equal shares of 2..98 %."""
    shares = [0.02, 0.25, 0.50, 0.75, 0.98] if n == 5 else [0.02 + 0.96 * i / (n - 1) for i in range(n)]
    knots = quantiles(df, column, shares)
    for i in range(1, n):
        if knots[i] <= knots[i - 1]:
            knots[i] = knots[i - 1] + step
    return knots
