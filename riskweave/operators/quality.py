"""Data-quality operators: channel health, ranges, distributions, partitions, rule references."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.fuzzy import domain_for, membership


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "channel", value: str = "x") -> DataFrame:
    """Long form of double columns."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), name, value)


def channel_health(df: DataFrame, keys: Sequence[str], channels: Sequence[str], count_channel: str | None = None,
                   saturation: float = 0.95, flag_share: float = 0.05) -> DataFrame:
    """Non-zero rows, saturated share of them, share of zero-count rows, and a flag per (entity, channel)."""
    extra = list(dict.fromkeys([*channels, *([count_channel] if count_channel else [])]))
    zero = (F.avg((F.col(count_channel) == 0).cast("double")) if count_channel else F.lit(None).cast("double"))
    base = df.groupBy(*keys).agg(zero.alias("zero_share")) if count_channel else None
    live = melt(df, keys, channels).filter("x is not null and x <> 0")
    out = live.groupBy(*keys, "channel").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.abs("x") > saturation).cast("double")).alias("saturated"))
    out = out.withColumn("flagged", F.col("saturated") > flag_share)
    return out.join(base, list(keys)) if base is not None else out


def range_audit(df: DataFrame, channels: Sequence[str], domains: Mapping[str, tuple[float, float]] | None = None,
                slack: float = 1e-4, max_null: float = 0.05) -> DataFrame:
    """Min, max, mean, null share and verdict per channel; one pass."""
    long = melt(df, [], channels)
    stats = long.groupBy("channel").agg(
        F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"),
        F.avg(F.col("x").isNull().cast("double")).alias("null_rate"))
    lo, hi = F.lit(-1.0), F.lit(1.0)
    for c in channels:
        low, high = (domains or {}).get(c, domain_for(c))
        lo, hi = F.when(F.col("channel") == c, low).otherwise(lo), F.when(F.col("channel") == c, high).otherwise(hi)
    outside = F.coalesce((F.col("min") < lo - slack) | (F.col("max") > hi + slack), F.lit(False))
    return stats.withColumn("status", F.when(outside, "FAIL").when(F.col("null_rate") > max_null, "WARN").otherwise("PASS"))


def reference_check(rules: DataFrame, variables: Mapping[str, Sequence[str]], outputs: Sequence[str]) -> DataFrame:
    """Antecedents that name an unknown variable, term or output (the vocabularies are configuration)."""
    known_var = F.col("var").isin(*variables)
    terms = sorted({(v, t) for v, ts in variables.items() for t in ts})
    known_term = F.concat_ws("|", "var", "term").isin(*[f"{v}|{t}" for v, t in terms])
    problem = (F.when(~known_var, "unknown variable").when(~known_term, "unknown term")
               .when(~F.col("output").isin(*outputs), "unknown output"))
    return rules.select("rule_id", "var", "term", problem.alias("problem")).filter("problem is not null")


def partition_coverage(df: DataFrame, column: str, sets: Mapping[str, Sequence[float]], tol: float = 1e-3) -> DataFrame:
    """How far the degrees of a value add up to one, over the values of a column."""
    total = sum((membership(column, p) for p in sets.values()), F.lit(0.0))
    s = df.filter(F.col(column).isNotNull()).select(total.alias("s"))
    return s.agg(F.min("s").alias("min_sum"), F.max("s").alias("max_sum"), F.max(F.abs(F.col("s") - 1)).alias("max_error"),
                 F.count(F.when(F.col("s") <= tol, 1)).alias("holes"), F.count(F.when(F.col("s") < 1 - tol, 1)).alias("below"),
                 F.count(F.when(F.col("s") > 1 + tol, 1)).alias("above"))


def distribution(df: DataFrame, channels: Sequence[str], sets: Mapping[str, Sequence[float]], saturation: float = 0.95,
                 span_ok: float = 0.15, span_warn: float = 0.05) -> DataFrame:
    """Quantiles, saturated and zero share, share of rows above 0.5 per term, and a verdict on the spread."""
    from riskweave.operators.evaluation import grouped_quantiles

    long = melt(df, [], channels)
    stats = long.groupBy("channel").agg(
        F.min("x").alias("q0"), F.max("x").alias("q100"), F.avg((F.abs("x") > saturation).cast("double")).alias("saturated"),
        F.avg((F.col("x") == 0).cast("double")).alias("zero_share"),
        *[F.avg((membership("x", p) > 0.5).cast("double")).alias(f"share_{t}") for t, p in sets.items()])
    stats = stats.join(grouped_quantiles(long, ["channel"], "x", {"q5": 0.05, "q50": 0.5, "q95": 0.95}), "channel")
    span = F.col("q95") - F.col("q5")
    return stats.withColumn("verdict", F.when(span > span_ok, "PASS").when(span > span_warn, "WARN").otherwise("FAIL"))
