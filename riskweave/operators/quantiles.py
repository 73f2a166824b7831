"""Exact order statistics and ordered running totals of large unpartitioned sets.

``percentile`` keeps every distinct value of a group in one buffer, and a window without a partition
sorts everything in one task. Here a sketch gives split points (a bounded list on the driver), rows
are counted per split bucket, and only inside a bucket are values ordered. The result is exact
whatever the sketch returned: the split points only decide where the buckets end.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_points(df: DataFrame, column: str, buckets: int = 256) -> tuple[int, list[float]]:
    """(number of non-null rows, increasing split points) from one aggregation."""
    shares = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.count(column).alias("n"),
                 F.percentile_approx(column, shares, 10 * buckets).alias("q")).first()
    return row["n"], sorted({float(v) for v in (row["q"] or [])})


def bucket_of(column: str, points: Sequence[float]) -> Column:
    """Number of split points at or below the value of a column (null for null).

    The points are a constant array of blocks: the block is found by its last points, then only that
    block is counted, so 4096 points cost about 128 comparisons.
    """
    if not points:
        return F.lit(0)
    block = math.isqrt(len(points) - 1) + 1
    def array(values):
        return f"array({', '.join(values)})"
    blocks = [[f"{float(p)!r}D" for p in points[i:i + block]] for i in range(0, len(points), block)]
    passed = f"size(filter({array([b[-1] for b in blocks])}, e -> e <= `{column}`))"
    inside = f"coalesce(size(filter(get({array([array(b) for b in blocks])}, {passed}), e -> e <= `{column}`)), 0)"
    last = f"least({passed} * {block}, {len(points)})"
    return F.expr(f"CASE WHEN `{column}` IS NOT NULL THEN {last} + CASE WHEN {passed} < {len(blocks)} THEN {inside} ELSE 0 END END")


def bucket_points(df: DataFrame, column: str, rows_per_bucket: int = 1_000_000, most: int = 4096) -> list[float]:
    """Split points for buckets of about *rows_per_bucket* rows; none when one bucket is enough."""
    buckets = min(most, df.count() // rows_per_bucket)
    return split_points(df, column, buckets)[1] if buckets > 1 else []


def ordered_totals(df: DataFrame, keys: Sequence[str], column: str, sums: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Distinct (keys, value) with each sum and ``<sum>_below``, the total of smaller values."""
    merged = df.groupBy(*keys, column).agg(*[F.sum(s).alias(s) for s in sums])
    points = split_points(df, column, buckets)[1] if buckets else bucket_points(df, column)
    merged = merged.withColumn("__b", bucket_of(column, points))
    inside = Window.partitionBy(*keys, "__b").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = merged.groupBy(*keys, "__b").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    totals = totals.select(*keys, "__b", *[F.coalesce(F.sum(f"__t_{s}").over(across), F.lit(0)).alias(f"__c_{s}") for s in sums])
    local = merged.withColumns({f"__l_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    return local.join(totals, [*keys, "__b"]).select(
        *keys, column, *sums, *[(F.col(f"__l_{s}") + F.col(f"__c_{s}")).alias(f"{s}_below") for s in sums])


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Linear-interpolated quantiles of a column as a list, one per share."""
    return quantile_sets(df, {"v": (f"`{column}`", shares)})["v"]


def quantile_sets(df: DataFrame, wanted: Mapping[str, tuple[str, Sequence[float]]]) -> dict[str, list[float]]:
    """Quantiles of several SQL expressions: name -> (expression, shares). Null results are left out.

    All expressions stand below each other as (name, value) and share one search by totals over
    distinct values; a name without a value has NaN.
    """
    from riskweave.operators.evaluation import grouped_quantiles

    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.expr(f"CAST({e} AS double)").alias("v")) for n, (e, _) in wanted.items()])
    long = df.select(F.explode(pairs).alias("p")).select("p.name", "p.v").filter("v IS NOT NULL")
    every = sorted({float(s) for _, shares in wanted.values() for s in shares})
    rows = grouped_quantiles(long, ["name"], "v", {f"q{i}": s for i, s in enumerate(every)}).collect()
    found = {r["name"]: {s: r[f"q{i}"] for i, s in enumerate(every)} for r in rows}
    return {n: [found[n][float(s)] if n in found else float("nan") for s in shares] for n, (_, shares) in wanted.items()}
