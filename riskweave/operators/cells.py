"""Point-in-time features and labels of grid cells with their halo."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import geo
from riskweave.functions.fuzzy import ANOMALY_SETS, clip_scale, log_scale, value_bucket
from riskweave.operators.spatial import halo

# Kernel of the activity sum, look-back windows, channels.
KERNEL_MAG, KERNEL_C, KERNEL_P, LOOKBACK = 4.5, 5.0, 1.1, 365.0
WINDOWS = (7, 30, 90, 365)
CHANNELS = ("a_seis", "a_swarm", "a_fore", "A_state", "C_state", "mag_scale", "a_tect")
CLASS_EDGES = (0.5, 2.0, 8.0)


def days(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86400e6)


def kernel(mag: Column, lag: Column) -> Column:
    return F.pow(F.lit(10.0), 0.5 * (mag - KERNEL_MAG)) / F.pow(lag + KERNEL_C, F.lit(KERNEL_P))


def own_cells(events: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    la, lo = geo.grid_cell(lat, lon)
    return events.withColumns({"la": la, "lo": lo})


def _month(t: Column) -> Column:
    return (F.year(t) * 12 + F.month(t) - 1).cast("int")


def _month_start(k: Column) -> Column:
    return F.make_date(F.floor(k / 12).cast("int"), (k % 12 + 1).cast("int"), F.lit(1))


def cell_months(events: DataFrame, first: str, last: str, origin: str, target_mag: float = 5.0, horizon: float = 30.0) -> DataFrame:
    """Features and forward labels per (cell, month start) from *first* to *last*.

    An event touches at most 26 snapshots: it is counted in those up to 365 days after it and labels
    those up to 365 days before it. Contributions are summed per own cell, then the (much fewer) cell
    rows are replicated to the halo and summed again; running totals over the snapshots of a cell give
    the all-time features. No sorted event list per cell is ever built. Of next events at one time that of the least
    magnitude counts.
    """
    k0, k1 = (int(d[:4]) * 12 + int(d[5:7]) - 1 for d in (first, last))
    e = own_cells(events).select("la", "lo", "time", "mag", _month(F.col("time")).alias("m"))
    lo_k = F.greatest(F.when(F.col("mag") >= target_mag, F.col("m") - 12).otherwise(F.col("m") + 1), F.lit(k0))
    hi_k = F.greatest(F.least(F.col("m") + 13, F.lit(k1)), F.greatest(F.col("m") + 1, F.lit(k0)))
    e = e.withColumn("k", F.explode(F.sequence(lo_k, F.greatest(lo_k, hi_k)))).filter(F.col("k") <= k1)
    lag = days(_month_start(F.col("k")), F.col("time"))
    e = e.withColumn("lag", lag)
    past, entry = F.col("k") > F.col("m"), F.col("k") == F.greatest(F.col("m") + 1, F.lit(k0))
    ahead, big = -F.col("lag"), F.col("mag") >= target_mag
    own = e.groupBy("la", "lo", "k").agg(
        F.sum(entry.cast("long")).alias("n"), F.max(F.when(entry, F.col("mag"))).alias("mag_max"), F.max(F.when(entry, F.col("time"))).alias("t_max"),
        *[F.sum((past & (F.col("lag") <= w)).cast("long")).alias(f"n{w}") for w in WINDOWS],
        F.sum(F.when(past & (F.col("lag") <= LOOKBACK), kernel(F.col("mag"), F.col("lag"))).otherwise(0.0)).alias("omori"),
        F.max((big & (ahead >= 0) & (ahead < horizon)).cast("int")).alias("y"),
        F.min(F.when(big & (ahead > 0) & (ahead <= LOOKBACK), F.struct("time", "mag"))).alias("next"))
    h = halo(own).groupBy("la", "lo", "k").agg(
        F.sum("n").alias("n"), F.max("mag_max").alias("mag_max"), F.max("t_max").alias("t_max"), *[F.sum(f"n{w}").alias(f"n{w}") for w in WINDOWS],
        F.sum("omori").alias("omori"), F.max("y").alias("y"), F.min("next").alias("next"))
    order = Window.partitionBy("la", "lo").orderBy("k")
    filled = h.withColumn("__stop", F.coalesce(F.lead("k").over(order) - 1, F.lit(k1)))
    filled = filled.withColumn("__k", F.explode(F.sequence("k", "__stop"))).drop("__stop")
    here = F.col("__k") == F.col("k")
    zero = {c: F.when(here, F.col(c)).otherwise(F.lit(0)) for c in ("n", *[f"n{w}" for w in WINDOWS], "y")}
    none = {c: F.when(here, F.col(c)) for c in ("mag_max", "t_max", "next")}
    filled = filled.withColumns(zero | none | {"omori": F.when(here, F.col("omori")).otherwise(0.0)}).drop("k").withColumnRenamed("__k", "k")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    f = filled.withColumns({"total": F.sum("n").over(upto), "mag_max": F.max("mag_max").over(upto), "t_max": F.max("t_max").over(upto)}).filter("total > 0")
    date = _month_start(F.col("k"))
    years = F.greatest(F.datediff(date, F.lit(origin).cast("date")) / 365.25, F.lit(1.0))
    return f.select("la", "lo", date.alias("date"), (F.col("total") / years).alias("rate_bg"), *[f"n{w}" for w in WINDOWS],
                    days(date, F.col("t_max")).alias("t_last"), "mag_max", "omori", F.col("y").cast("int").alias("y"),
                    F.col("next.mag").alias("mag_next"), days(F.col("next.time"), date).alias("days_next"))


def cell_state(events: DataFrame, cells: DataFrame, now: Column, origin: str) -> DataFrame:
    """The same features at one instant for every cell of a grid (la, lo, slip); quiet cells keep defaults."""
    e = own_cells(events.filter(F.col("time") < now))
    lag = days(now, F.col("time"))
    own = e.groupBy("la", "lo").agg(
        F.count(F.lit(1)).alias("n"), F.max("mag").alias("mag_max"), F.max("time").alias("t_max"),
        *[F.sum((lag <= w).cast("long")).alias(f"n{w}") for w in WINDOWS],
        F.sum(F.when(lag <= LOOKBACK, kernel(F.col("mag"), lag)).otherwise(0.0)).alias("omori"))
    return features_of_own(own, cells, now, origin)


def features_of_own(own: DataFrame, cells: DataFrame, now: Column, origin: str) -> DataFrame:
    """Features of a grid from the sums and extrema of each own cell: halo first, then the grid's defaults."""
    h = halo(own).groupBy("la", "lo").agg(F.sum("n").alias("n"), F.max("mag_max").alias("mag_max"), F.max("t_max").alias("t_max"),
                                          *[F.sum(f"n{w}").alias(f"n{w}") for w in WINDOWS], F.sum("omori").alias("omori"))
    years = F.greatest(days(now, F.lit(origin).cast("timestamp_ntz")) / 365.25, F.lit(1.0))
    g = cells.join(h, ["la", "lo"], "left")
    return g.select("la", "lo", "slip", (F.coalesce("n", F.lit(0)) / years).alias("rate_bg"), *[F.coalesce(f"n{w}", F.lit(0)).alias(f"n{w}") for w in WINDOWS],
                    F.coalesce(days(now, F.col("t_max")), F.lit(99999.0)).alias("t_last"), F.coalesce("mag_max", F.lit(0.0)).alias("mag_max"),
                    F.coalesce("omori", F.lit(0.0)).alias("omori"))


def raw_scores() -> dict[str, Column]:
    """Unscaled deviations behind the catalog-only channels."""
    rate, n7, n30, n90, n365 = (F.col(c) for c in ("rate_bg", "n7", "n30", "n90", "n365"))
    def surplus(seen, expected):
        return (seen - expected) / F.sqrt(expected + 0.5)
    return {"a_seis": surplus(n30, rate * 30 / 365.25), "a_swarm": surplus(n30, n365 * 30 / 365.0), "a_fore": surplus(n7, n30 * 7 / 30.0),
            "A_state": n90 / F.greatest(rate * 90 / 365.25, F.lit(0.25)) - 1.0, "C_state": F.col("t_last") / 365.25 * rate - 1.0}


# Scale of each deviation in the unclassed form.
SCALES = {"a_seis": 4.0, "a_swarm": 4.0, "a_fore": 4.0, "A_state": 2.0, "C_state": 2.0}


def _bounded(df: DataFrame) -> dict[str, Column]:
    out = {"mag_scale": clip_scale("mag_max", 4.5, 8.0)}
    return out | ({"a_tect": log_scale("slip", 50.0)} if "slip" in df.columns else {})


def derive_channels(df: DataFrame) -> DataFrame:
    """The catalog-only channels in [-1, 1]; without a slip column the last one is left out."""
    return df.withColumns({c: F.tanh(z / SCALES[c]) for c, z in raw_scores().items()} | _bounded(df))


def activity_class(rate: str = "rate_bg") -> Column:
    return value_bucket(rate, CLASS_EDGES, [0, 1, 2, 3], strict=True)


def class_taus(df: DataFrame, min_rows: int = 500) -> dict[tuple[str, int], float]:
    """Scale per (channel, activity class): 85 % quantile of the deviation maps to 0.7; 20 numbers."""
    from riskweave.operators.evaluation import grouped_quantile

    z = raw_scores()
    long = df.select(activity_class().alias("cls"), F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.abs(v).alias("z")) for c, v in z.items()])).alias("s"))
    long = long.select("cls", "s.channel", "s.z")
    n = long.groupBy("channel", "cls").agg(F.count(F.lit(1)).alias("n"))
    q = {(r["channel"], r["cls"]): (r["q"], r["n"]) for r in grouped_quantile(long, ["channel", "cls"], "z", 0.85).join(n, ["channel", "cls"]).collect()}
    def tau(key):
        value, count = q.get(key, (None, 0))
        return max(value if count > min_rows and value is not None else 1.0, 1e-3) / math.atanh(0.7)
    return {(c, k): tau((c, k)) for c in z for k in range(len(CLASS_EDGES) + 1)}


def derive_channels_classed(df: DataFrame, taus: Mapping[tuple[str, int], float]) -> DataFrame:
    """The channels with the scale of the cell's activity class."""
    df = df.withColumn("cls", activity_class())
    out = {}
    for c, z in raw_scores().items():
        tau = F.lit(1.0)
        for k in range(len(CLASS_EDGES) + 1):
            tau = F.when(F.col("cls") == k, taus[(c, k)]).otherwise(tau)
        out[c] = F.tanh(z / tau)
    return df.withColumns(out | _bounded(df))


def forecast_table(state: DataFrame, rules: Sequence, influence: Mapping[str, float], coef: Sequence[float], intercept: float,
                   mag_stats: DataFrame, alert_at: float, second_score: Column) -> DataFrame:
    """Live forecast per cell: probability, typical and largest magnitude, mean wait, fuzzy value, alert, inputs."""
    from riskweave.functions.probability import logistic_score, mean_wait_days
    from riskweave.operators.scoring import bipolar

    d = derive_channels(state)
    fz = bipolar(rules, influence, {c: ANOMALY_SETS for c in CHANNELS})
    d = d.withColumns({"mom": fz["mom"], "score": fz["score"], "p30": logistic_score(
        [F.log1p("omori"), (F.col("omori") > 0).cast("double"), F.log1p("rate_bg")], coef, intercept)})
    d = d.join(mag_stats.select("la", "lo", F.col("mag_mean").alias("__mean"), F.col("mag_max").alias("__max")), ["la", "lo"], "left")
    wait = mean_wait_days("p30")
    return d.select(
        "la", "lo", F.bround("p30", 5).alias("p30"), F.bround(F.coalesce("__mean", "mag_max"), 2).alias("mag_typical"), F.bround(F.coalesce("__max", "mag_max"), 1).alias("mag_top"),
        F.col("n365").cast("int").alias("n365"), F.floor(F.least("t_last", F.lit(99999.0))).cast("int").alias("t_last_d"),
        F.bround(F.least(wait, F.lit(36500.0)), 0).alias("poisson_mean_wait_days"), F.bround("mom", 3).alias("mom"), (second_score >= alert_at).cast("int").alias("alert"),
        *[F.bround(c, 3).alias(c) for c in CHANNELS], F.bround("omori", 3).alias("omori"), F.bround("rate_bg", 3).alias("rate_bg"), F.col("n30").cast("int").alias("n30"))

