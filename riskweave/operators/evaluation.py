"""Forecast evaluation: scores, reliability, rank statistics, likelihoods, paired tests."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.fuzzy import clip
from riskweave.functions.geo import col
from riskweave.functions.probability import chi2_upper_even, poisson_two_sided
from riskweave.operators.quantiles import ordered_totals
from riskweave.session import cut_lineage

EPS_P = 1e-5


def grouped_quantiles(df: DataFrame, keys: Sequence[str], column: str, shares: Mapping[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group (output column -> share) without holding a group in one buffer."""
    clean = df.filter(F.col(column).isNotNull()).withColumn("__one", F.lit(1))
    sizes = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    tot = ordered_totals(clean, keys, column, ["__one"]).join(sizes, list(keys))
    upper = F.col("__one_below") + F.col("__one")
    def holds(rank):
        return F.max(F.when((F.col("__one_below") <= rank) & (rank < upper), F.col(column)))
    aggs = []
    for out, share in shares.items():
        pos = share * (F.col("__n") - 1)
        aggs += [holds(F.floor(pos)).alias(f"__lo_{out}"), holds(F.ceil(pos)).alias(f"__hi_{out}"), F.first(pos - F.floor(pos)).alias(f"__f_{out}")]
    g = tot.groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[(F.col(f"__lo_{o}") + (F.col(f"__hi_{o}") - F.col(f"__lo_{o}")) * F.col(f"__f_{o}")).alias(o) for o in shares])


def grouped_quantile(df: DataFrame, keys: Sequence[str], column: str, share: float, out: str = "q") -> DataFrame:
    """One exact quantile per group."""
    return grouped_quantiles(df, keys, column, {out: share})


def forecast_metrics(df: DataFrame, keys: Sequence[str], p: str, y: str, p0: str | float) -> DataFrame:
    """Brier score, mean information gain over the reference rate and lift of the top decile, per group.

    A reference of 0 or 1 leaves no room for a gain: the ratio to it is infinite, and where that meets an outcome the
    reference is sure of, the mean gain is not a number, as in SQL.
    """
    q = df.withColumn("__p", clip(p, EPS_P, 1 - EPS_P))
    top = q.join(grouped_quantile(q, keys, "__p", 0.9, "__t"), list(keys)) if keys else None
    if top is None:
        q = q.withColumn("__k", F.lit(0))
        return forecast_metrics(q.drop("__p"), ["__k"], p, y, p0).drop("__k")
    yy, pp, r = F.col(y), F.col("__p"), col(p0)
    def ratio(a, b):
        return F.when(b == 0, float("inf")).otherwise(F.try_divide(a, b))
    gain = yy * F.log(ratio(pp, r)) + (1 - yy) * F.log(ratio(1 - pp, 1 - r))
    hit = F.avg(F.when(pp >= F.col("__t"), yy)) / F.nullif(F.avg(yy), F.lit(0.0))
    return top.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(pp - yy, 2)).alias("brier"),
                                  F.avg(gain).alias("info_gain"), hit.alias("lift_top10"))


def reliability(df: DataFrame, keys: Sequence[str], p: str, y: str, edges: Sequence[float], min_n: int = 0) -> DataFrame:
    """Mean forecast and observed rate per probability band with more than *min_n* rows."""
    band = sum(((col(p) >= e).cast("int") for e in edges), F.lit(0)) - 1
    t = df.withColumn("band", band).filter((F.col("band") >= 0) & (F.col("band") < len(edges) - 1))
    g = t.groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))
    return g.filter(F.col("n") > min_n).withColumn("gap", F.abs(F.col("mean_p") - F.col("mean_y")))


def rank_scores(df: DataFrame, keys: Sequence[str], p: str, y: str, weight: str | None = None) -> DataFrame:
    """Weighted ROC AUC and average precision per group from totals over distinct scores."""
    w = F.col(weight) if weight else F.lit(1.0)
    t = df.select(*keys, F.col(p).alias("__p"), (F.col(y) * w).cast("double").alias("pos"), ((1 - F.col(y)) * w).cast("double").alias("neg"))
    o = ordered_totals(t, keys, "__p", ["pos", "neg"])
    sums = t.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    o = o.join(sums, list(keys)) if keys else o.crossJoin(F.broadcast(sums))
    hits, alarms = F.col("P") - F.col("pos_below"), F.col("N") - F.col("neg_below")
    area = F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg")))
    g = o.groupBy(*keys).agg(area.alias("a"), F.sum(F.when(F.col("pos") > 0, F.col("pos") * hits / (hits + alarms))).alias("b"),
                             F.first("P").alias("P"), F.first("N").alias("N"))
    some = (F.col("P") > 0) & (F.col("N") > 0)
    return g.select(*keys, F.when(some, F.col("a") / (F.col("P") * F.col("N"))).alias("auc"), F.when(F.col("P") > 0, F.col("b") / F.col("P")).alias("avg_precision"))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks."""
    out = df
    for c in (x, y):
        tot = ordered_totals(df.withColumn("__one", F.lit(1)), keys, c, ["__one"])
        rank = F.col("__one_below") + (F.col("__one") + 1) / 2.0
        out = out.join(tot.select(*keys, c, rank.alias(f"__r_{c}")), [*keys, c])
    return out.groupBy(*keys).agg(F.corr(f"__r_{x}", f"__r_{y}").alias("rho"), F.count(F.lit(1)).alias("n"))


def point_process_loglik(at_events: Column, total: Column) -> Column:
    return at_events - total


def log_rate(c) -> Column:
    return F.log(F.greatest(col(c), F.lit(1e-9)))


# ---------------------------------------------------------------- paired comparison of two forecasts

def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if not math.isfinite(t):
        return 0.0 if math.isinf(t) else float("nan")
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def signed_rank_p(w: float, n: int, tie_term: float, has_ties: bool) -> float:
    """Two-sided p-value of the smaller signed-rank sum: exact up to 50 untied differences, else normal."""
    if n == 0:
        return float("nan")
    if n <= 50 and not has_ties:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return float(min(1.0, 2.0 * ways[: int(w) + 1].sum() / 2.0 ** n))
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - tie_term / 48.0
    return float(math.erfc(abs(w - mean) / math.sqrt(var) / math.sqrt(2.0))) if var > 0 else float("nan")


def paired_event_test(ratios: DataFrame, expected: DataFrame, keys: Sequence[str], ratio: str = "d",
                      min_events: int = 2, low_power: int = 20) -> DataFrame:
    """Compare two forecasts per group from the log ratios at the events.

    *expected* has the totals ``exp_a`` and ``exp_b`` per group. The mean ratio is corrected by the
    difference of expected counts per event; t and signed-rank statistics test the corrected mean.
    Ranks come from totals over distinct values, so a group may be of any size; only the last step, one
    row per group, turns statistics into p-values.
    """
    # one row per event, read four times below
    ratios, expected = cut_lineage(ratios.select(*keys, ratio)), cut_lineage(expected)
    counts = ratios.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.avg(ratio).alias("mean_log_ratio"), F.stddev_samp(ratio).alias("sd"))
    g = expected.join(counts, list(keys), "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    g = g.withColumn("count_correction", (F.col("exp_a") - F.col("exp_b")) / F.nullif(F.col("n_events"), F.lit(0)))
    c = ratios.join(g.select(*keys, "count_correction"), list(keys)).withColumn("__c", F.col(ratio) - F.col("count_correction"))
    c = c.filter("__c <> 0").select(*keys, F.abs("__c").alias("__a"), F.when(F.col("__c") > 0, 1).otherwise(0).alias("up"), F.lit(1).alias("one"))
    o = ordered_totals(c, keys, "__a", ["up", "one"])
    rank = F.col("one_below") + (F.col("one") + 1) / 2.0
    w = o.groupBy(*keys).agg(F.sum(rank * F.col("up")).alias("w_plus"), F.sum(rank * (F.col("one") - F.col("up"))).alias("w_minus"),
                             F.sum(F.pow(F.col("one"), 3) - F.col("one")).alias("tie_term"), F.sum("one").alias("n_ranked"), F.max("one").alias("most"))
    g = g.join(w, list(keys), "left")
    ok = F.col("n_events") >= min_events
    gain = F.col("mean_log_ratio") - F.col("count_correction")
    g = g.withColumns({
        "status": F.when(ok, "ok").otherwise("insufficient_events"),
        "info_gain": F.when(ok, gain), "t_stat": F.when(ok & (F.col("sd") > 0), gain / (F.col("sd") / F.sqrt("n_events"))),
        "w_stat": F.when(ok, F.least("w_plus", "w_minus")), "low_power": F.col("n_events") < low_power})
    return _p_values(g.select(*keys, "status", "n_events", "mean_log_ratio", "count_correction", "info_gain", "t_stat", "w_stat",
                              "low_power", "exp_a", "exp_b", "tie_term", "n_ranked", "most"))


def _p_values(g: DataFrame) -> DataFrame:
    from pyspark.sql import types as T

    @F.pandas_udf("t_p double, w_p double")
    def finish(t: pd.Series, n: pd.Series, w: pd.Series, ranked: pd.Series, tie: pd.Series, most: pd.Series) -> pd.DataFrame:
        tp = [t_two_sided(a, b - 1) if pd.notna(a) and b > 1 else None for a, b in zip(t, n)]
        wp = [signed_rank_p(a, int(b), c, d > 1) if pd.notna(a) and b > 0 else None for a, b, c, d in zip(w, ranked, tie, most)]
        return pd.DataFrame({"t_p": pd.Series(tp, dtype="float64"), "w_p": pd.Series(wp, dtype="float64")})

    out = g.withColumn("__p", finish("t_stat", "n_events", "w_stat", "n_ranked", "tie_term", "most"))
    def known(c):
        return F.nanvl(F.col(c), F.lit(None).cast(T.DoubleType()))
    return out.withColumns({"t_p": known("__p.t_p"), "w_p": known("__p.w_p"), "n_p_a": poisson_two_sided("n_events", "exp_a"),
                            "n_p_b": poisson_two_sided("n_events", "exp_b")}).drop("__p", "tie_term", "n_ranked", "most")


def fisher_combine(df: DataFrame, keys: Sequence[str], p: str, favours: str, alpha: float = 0.05) -> DataFrame:
    """Combine p-values per group; also counts of results in favour and significant ones on each side."""
    q = F.greatest(F.col(p), F.lit(1e-10))
    g = df.groupBy(*keys).agg(
        (-2 * F.sum(F.log(q))).alias("chi2"), F.count(F.lit(1)).alias("k"), F.sum(F.col(favours).cast("int")).alias("n_favour"),
        F.count(F.when(F.col(favours) & (F.col(p) < alpha), 1)).alias("n_favour_sig"),
        F.count(F.when(~F.col(favours) & (F.col(p) < alpha), 1)).alias("n_against_sig"))
    return g.withColumn("p_combined", chi2_upper_even("chi2", F.col("k")))


def promotion_gate(metrics: DataFrame, contract: Mapping[str, tuple[str, str, float]]) -> DataFrame:
    """Check each (metric, operator, limit) and promote only when all pass; missing metrics fail."""
    checks = {}
    for name, (metric, op, limit) in contract.items():
        m = F.col(metric)
        checks[name] = F.coalesce(m >= limit if op == ">=" else m <= limit, F.lit(False))
    out = metrics.withColumns(checks)
    every = None
    for name in contract:
        every = F.col(name) if every is None else every & F.col(name)
    return out.withColumns({"promoted": every, "status": F.when(every, "candidate").otherwise("shadow_research")})
