"""Rule mining: membership-weighted support and lift of single terms and of pairs of terms."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.fuzzy import centroid, clip, degree0, membership_sql, sets_for

SINGLE, PAIR = ["channel", "term"], ["channel_a", "term_a", "channel_b", "term_b"]
Sets = Mapping[str, Mapping[str, Sequence[float]]]


def active_terms(channels: Sequence[str], sets: Sets | None = None) -> Column:
    """array<struct<channel, term, mu>> of the terms with a positive degree.

    Overlapping partitions give at most two active terms per channel, so the array is short; a missing
    value is in no term.
    """
    items = [f"named_struct('channel', '{c}', 'term', '{term}', 'mu', coalesce({membership_sql(c, params)}, 0D))"
             for c in channels for term, params in ((sets or {}).get(c) or sets_for(c)).items()]
    return F.expr(f"filter(array({', '.join(items)}), t -> t.mu > 0)")


def _pair_sums(rows: DataFrame, terms: Sequence[tuple[str, str]], epoch: str) -> DataFrame:
    """Sums of the smaller degree of every pair of terms of two channels, per epoch.

    An Arrow batch is one matrix of degrees, so a pair costs one vector minimum; a batch hands on one row
    per epoch and pair, which the following aggregation adds up. (Expanding a row to its active pairs
    writes tens of rows per input row.)
    """
    pairs = [(i, j) for i, a in enumerate(terms) for j, b in enumerate(terms) if j > i and a[0] != b[0]]
    columns = [f"__mu_{i}" for i in range(len(terms))]
    left, right = np.array([i for i, _ in pairs]), np.array([j for _, j in pairs])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mu = pdf[columns].to_numpy().T
            for name, rows_of in pdf.groupby("e").indices.items():
                m, y = mu[:, rows_of], pdf["y"].to_numpy()[rows_of]
                support, hits = np.empty(len(pairs)), np.empty(len(pairs))
                for i in np.unique(left):
                    at = np.flatnonzero(left == i)
                    low = np.minimum(m[i], m[right[at]])
                    support[at], hits[at] = low.sum(axis=1), low @ y
                yield pd.DataFrame({"e": name, "pair": np.arange(len(pairs)), "support": support, "hits": hits})

    sums = rows.select(F.col(epoch).cast("string").alias("e"), "y", *columns).mapInPandas(partial, "e string, pair long, support double, hits double").groupBy("e", "pair").agg(F.sum("support").alias("support"), F.sum("hits").alias("hits"))
    values = ", ".join(f"({n}L, '{terms[i][0]}', '{terms[i][1]}', '{terms[j][0]}', '{terms[j][1]}')" for n, (i, j) in enumerate(pairs))
    names = rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(pair, channel_a, term_a, channel_b, term_b)")
    named = sums.join(F.broadcast(names), "pair").filter("support > 0")
    return named.select(F.col("e").alias(epoch), "channel_a", "term_a", "channel_b", "term_b", "support", "hits")


def support_lift(df: DataFrame, channels: Sequence[str], y: str, epoch: str, sets: Sets | None = None, pairs: bool = False) -> DataFrame:
    """Support, rate and lift over the epoch's base rate per term (or pair of terms) and epoch.

    One pass over the data per call; the exchange carries one row per task, epoch and term (or pair).
    """
    base = df.groupBy(epoch).agg(F.avg(y).alias("base"))
    names = PAIR if pairs else SINGLE
    g = support_sums(df, channels, y, epoch, sets, pairs)
    return g.join(F.broadcast(base), epoch).select(epoch, *names, "support", (F.col("hits") / F.col("support")).alias("rate"),
                                                   (F.col("hits") / F.col("support") / (F.col("base") + 1e-12)).alias("lift"))


def support_sums(df: DataFrame, channels: Sequence[str], y: str, epoch: str, sets: Sets | None = None, pairs: bool = False) -> DataFrame:
    """Summed degrees, and those of the rows with the label, per epoch and term (or pair of terms)."""
    if pairs:
        terms = [(c, t) for c in channels for t in ((sets or {}).get(c) or sets_for(c))]
        degrees = {f"__mu_{i}": degree0(c, ((sets or {}).get(c) or sets_for(c))[t]) for i, (c, t) in enumerate(terms)}
        return _pair_sums(df.select(F.col(epoch), F.col(y).cast("double").alias("y"), *[v.alias(k) for k, v in degrees.items()]), terms, epoch)
    rows = df.select(F.col(epoch), F.col(y).cast("double").alias("y"), F.explode(active_terms(channels, sets)).alias("t"))
    return rows.groupBy(epoch, F.col("t.channel").alias("channel"), F.col("t.term").alias("term")).agg(
        F.sum("t.mu").alias("support"), F.sum(F.col("t.mu") * F.col("y")).alias("hits"))


def two_epochs(stats: DataFrame, names: Sequence[str], epoch: str, min_fit: float, min_val: float, retain: float = 0.5) -> DataFrame:
    """Fit and validation lift side by side; ``ok`` when the excess keeps its sign and *retain* of its size."""
    g = stats.groupBy(*names).agg(
        F.max(F.when(F.col(epoch) == "fit", F.col("support"))).alias("support"), F.max(F.when(F.col(epoch) == "fit", F.col("lift"))).alias("lift_fit"),
        F.max(F.when(F.col(epoch) == "val", F.col("support"))).alias("support_val"), F.max(F.when(F.col(epoch) == "val", F.col("lift"))).alias("lift_val"))
    g = g.filter((F.col("support") >= min_fit) & (F.col("support_val") >= min_val))
    ef, evv = F.col("lift_fit") - 1, F.col("lift_val") - 1
    ret = F.when(F.abs(ef) > 1e-6, evv / ef).otherwise(0.0)
    return g.withColumns({"retention": ret, "ok": (ef * evv > 0) & (ret >= retain)})


def channel_influence(singles: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Mean clipped retention per channel, in [0.2, 1]; 0.3 for a channel without supported terms."""
    g = singles.groupBy("channel").agg(F.avg(clip("retention", 0.0, 1.0)).alias("m"))
    every = singles.sparkSession.createDataFrame([(c,) for c in channels], "channel string")
    return every.join(g, "channel", "left").select("channel", clip(F.coalesce("m", F.lit(0.3)), 0.2, 1.0).alias("influence"))


def mine_rules(df: DataFrame, channels: Sequence[str], y: str, epoch: str, min_fit: float = 1000.0, min_val: float = 1000.0, retain: float = 0.5,
               min_gain: float = 1.15, sets: Sets | None = None) -> tuple[DataFrame, DataFrame]:
    """(rules, single-term table). Single terms must hold in both epochs; a pair must also beat both of its
    parts by *min_gain* (protective pairs are compared with the smaller part)."""
    singles = two_epochs(support_lift(df, channels, y, epoch, sets), SINGLE, epoch, min_fit, min_val, retain)
    pairs = two_epochs(support_lift(df, channels, y, epoch, sets, pairs=True), PAIR, epoch, min_fit, min_val, retain)
    return retained_rules(singles, pairs, min_gain), singles


def retained_rules(singles: DataFrame, pairs: DataFrame, min_gain: float, keys: Sequence[str] = ()) -> DataFrame:
    """Rules of two-epoch tables (of each group of *keys*)."""
    pairs = with_gain(pairs, singles, "lift_fit", keys)
    up = F.col("lift_fit") > 1
    genuine = F.when(up, F.col("gain") >= min_gain).otherwise(F.col("gain") <= 1 / min_gain)
    one = singles.filter("ok").select(*keys, F.lit(1).alias("arity"), F.col("channel").alias("channel_a"), F.col("term").alias("term_a"), F.lit(None).cast("string").alias("channel_b"),
                                      F.lit(None).cast("string").alias("term_b"), "support", "lift_fit", "lift_val", "retention", F.lit(None).cast("double").alias("gain"))
    two = pairs.filter(F.col("ok") & genuine).select(*keys, F.lit(2).alias("arity"), "channel_a", "term_a", "channel_b", "term_b", "support", "lift_fit", "lift_val", "retention", "gain")
    return one.unionByName(two)


def with_gain(pairs: DataFrame, singles: DataFrame, lift: str, keys: Sequence[str] = ()) -> DataFrame:
    """Ratio of a pair's lift to the larger (smaller, if protective) lift of its parts."""
    for side in ("a", "b"):
        part = singles.select(*keys, F.col("channel").alias(f"channel_{side}"), F.col("term").alias(f"term_{side}"), F.col(lift).alias(f"__l{side}"))
        pairs = pairs.join(F.broadcast(part), [*keys, f"channel_{side}", f"term_{side}"], "left")
    a, b = F.coalesce("__la", F.lit(1.0)), F.coalesce("__lb", F.lit(1.0))
    best = F.when(F.col(lift) > 1, F.greatest(a, b)).otherwise(F.least(a, b))
    return pairs.withColumn("gain", F.col(lift) / (best + 1e-12)).drop("__la", "__lb")


def mine_single_epoch(df: DataFrame, channels: Sequence[str], y: str, min_support: float = 40.0, min_lift: float = 1.15, min_gain: float = 1.12,
                      sets: Sets | None = None) -> DataFrame:
    """Single-epoch rules with direction and signed weight; pairs use the outer terms only."""
    d = df.withColumn("__e", F.lit("fit"))
    base = df.agg(F.avg(y).alias("base"))
    s = support_lift(d, channels, y, "__e", sets).filter(F.col("support") >= min_support)
    p = support_lift(d, channels, y, "__e", sets, pairs=True).filter((F.col("support") >= min_support) & (F.col("term_a") != "normal") & (F.col("term_b") != "normal"))
    p = with_gain(p, s, "lift").filter(F.abs(F.col("lift") - 1) >= min_lift - 1)
    p = p.filter(F.when(F.col("lift") > 1, F.col("gain") >= min_gain).otherwise(F.col("gain") <= 1 / min_gain))
    s = s.filter(F.abs(F.col("lift") - 1) >= min_lift - 1)
    one = s.select(F.col("channel").alias("channel_a"), F.col("term").alias("term_a"), F.lit(None).cast("string").alias("channel_b"), F.lit(None).cast("string").alias("term_b"),
                   "support", "rate", "lift", F.lit(None).cast("double").alias("gain"))
    out = one.unionByName(p.select("channel_a", "term_a", "channel_b", "term_b", "support", "rate", "lift", "gain")).crossJoin(F.broadcast(base))
    r, b = F.col("rate"), F.col("base")
    weight = clip(F.when(r > b, (r - b) / (1 - b)).otherwise((b - r) / (b + 1e-9)), 0.0, 1.0)
    out = out.withColumns({"direction": F.when(r > b, "yes").otherwise("no"), "weight": weight})
    return out.filter("weight > 0.05").drop("base")


def term_targets(df: DataFrame, channels: Sequence[str], target: str, min_support: float = 40.0, sets: Sets | None = None) -> DataFrame:
    """Degree-weighted mean of a numeric target per (channel, term)."""
    rows = df.filter(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("y"), F.explode(active_terms(channels, sets)).alias("t"))
    g = rows.groupBy("t.channel", "t.term").agg(F.sum("t.mu").alias("support"), F.sum(F.col("t.mu") * F.col("y")).alias("s"))
    return g.filter(F.col("support") >= min_support).select("channel", "term", "support", (F.col("s") / F.col("support")).alias("mean_target"))


def nearest_output_term(means: DataFrame, output_sets: Mapping[str, Sequence[float]], mean: str = "mean_target") -> DataFrame:
    """Output term whose centroid is nearest to the mean target (the first of equals)."""
    options = F.array(*[F.struct(F.abs(F.col(mean) - centroid(p)).alias("d"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, (t, p) in enumerate(output_sets.items())])
    return means.withColumn("out_term", F.array_min(options)["t"])

