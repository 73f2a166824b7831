"""Rules for the outputs beyond occurrence: magnitude, timing and place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.fuzzy import clip
from riskweave.operators.mining import nearest_output_term, support_lift, term_targets


def magnitude_rules(df: DataFrame, channel: str, target: str, output_sets: Mapping[str, Sequence[float]], min_support: float = 20.0, sets=None) -> DataFrame:
    """Output term nearest to the mean magnitude in each term of one static channel."""
    return nearest_output_term(term_targets(df, [channel], target, min_support, sets), output_sets)


def timing_rules(df: DataFrame, channels: Sequence[str], delta_days: str, soon_days: float = 10.0, min_support: float = 20.0, min_lift: float = 1.15, sets=None) -> DataFrame:
    """High terms in which the event comes soon more often than on average."""
    d = df.filter(F.col(delta_days).isNotNull()).withColumns({"__soon": (F.col(delta_days) <= soon_days).cast("int"), "__e": F.lit("fit")})
    base = d.agg(F.avg("__soon").alias("base"))
    s = support_lift(d, channels, "__soon", "__e", sets).filter((F.col("support") >= min_support) & F.col("term").isin("high", "very_high") & (F.col("lift") >= min_lift))
    w = clip((F.col("rate") - F.col("base")) / (1 - F.col("base")), 0.0, 1.0)
    return s.crossJoin(F.broadcast(base)).select("channel", "term", "support", "rate", "lift", F.lit("imminent").alias("out_term"), w.alias("weight"))


def directional_rules(df: DataFrame, channels: Sequence[str], target: str, below: str, above: str, min_support: float = 30.0, min_lift: float = 1.10, sets=None) -> DataFrame:
    """Outer terms whose mean target lies clearly below or above the overall mean."""
    base = df.agg(F.avg(target).alias("base"))
    m, b = F.col("mean_target"), F.col("base")
    t = term_targets(df, channels, target, min_support, sets).filter(F.col("term") != "normal").crossJoin(F.broadcast(base))
    t = t.withColumns({"out_term": F.when(m < b, below).otherwise(above), "lift": F.when(m < b, b / (m + 1e-9)).otherwise(m / (b + 1e-9)),
                       "weight": clip(F.abs(m - b) / (b + 1e-9), 0.0, 1.0)})
    return t.filter(F.col("lift") >= min_lift).drop("base")
