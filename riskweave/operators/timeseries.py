"""Past-only operators on dense daily frames.

A daily frame has one row per (entity, day). It is made by a partial aggregation, so the rows of an
entity are bounded by the calendar however many events the entity has: windows and grouped folds
partitioned by entity stay small even when one entity holds most of the raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.fuzzy import clip, elevated
from riskweave.functions.geo import col


def daily_counts(events: DataFrame, keys: Sequence[str], day: str = "day", out: str = "n") -> DataFrame:
    return events.groupBy(*keys, day).agg(F.count(F.lit(1)).alias(out))


def date_spine(frame: DataFrame, keys: Sequence[str], day: str = "day", values: Sequence[str] = ("n",),
               end=None, start=None, fill=0) -> DataFrame:
    """Dense days from the first day of each entity to max(*end*, its last day).

    Gaps are filled from the next present day (``lead``), so the spine costs one exchange on the
    entity, which the windows that follow reuse.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    last = F.col(day) if end is None else F.greatest(F.col(day), F.lit(end).cast("date"))
    stop = F.coalesce(F.date_sub(F.lead(day).over(w), 1), last)
    out = frame.withColumn("__stop", stop)
    out = out.withColumn("__day", F.explode(F.sequence(F.col(day), F.col("__stop"))))
    if start is not None:
        out = out.filter(F.col("__day") >= F.lit(start).cast("date"))
    filled = [F.when(F.col("__day") == F.col(day), F.col(v)).otherwise(F.lit(fill)).alias(v) for v in values]
    return out.select(*keys, F.col("__day").alias(day), *filled)


@dataclass(frozen=True)
class Roll:
    """Rolling aggregate over *width* rows ending *shift* rows before the current one."""

    out: str
    source: str
    width: int
    kind: str = "sum"
    min_periods: int = 1
    shift: int = 1


def rolling(frame: DataFrame, keys: Sequence[str], day: str, rolls: Sequence[Roll]) -> DataFrame:
    """Rolling sums, means and counts from differences of running totals.

    A sliding SQL frame re-aggregates its width for every row; two lags of a running total do not,
    so the cost does not grow with the width.
    """
    order = Window.partitionBy(*keys).orderBy(day)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    sources = list(dict.fromkeys(r.source for r in rolls))
    cums = {}
    for s in sources:
        cums[f"__cum_s_{s}"] = F.sum(F.coalesce(F.col(s).cast("double"), F.lit(0.0))).over(upto)
        cums[f"__cum_n_{s}"] = F.count(F.col(s)).over(upto)
    out = frame.withColumns(cums)

    def diff(name, r):
        head = F.lag(name, r.shift).over(order) if r.shift else F.col(name)
        return F.coalesce(head, F.lit(0)) - F.coalesce(F.lag(name, r.shift + r.width).over(order), F.lit(0))

    results = {}
    for r in rolls:
        n, s = diff(f"__cum_n_{r.source}", r), diff(f"__cum_s_{r.source}", r)
        value = {"sum": s, "mean": s / n, "count": n.cast("double")}[r.kind]
        results[r.out] = F.when(n >= max(r.min_periods, 1), value)
    return out.withColumns(results).drop(*cums)


@dataclass(frozen=True)
class Robust:
    """Robust anomaly of *source*; tau None returns z, otherwise tanh(z / tau)."""

    out: str
    source: str
    baseline: int
    tau: float | None = None
    min_periods: int | None = None

    @property
    def needed(self) -> int:
        return self.baseline // 2 if self.min_periods is None else self.min_periods


def _known_before(x: np.ndarray) -> np.ndarray:
    """Values as they are known one row later."""
    return np.concatenate([[np.nan], x[:-1]])


def _robust_z(x: np.ndarray, width: int, needed: int) -> np.ndarray:
    """z of each row from earlier rows only: every residual uses the median known the day before."""
    def median(v):
        return pd.Series(v).rolling(width, min_periods=needed).median().to_numpy()

    residual = x - _known_before(median(x))
    spread = _known_before(median(np.abs(residual)))
    return _known_before(residual / (1.4826 * spread + 1e-9))


def robust_anomaly(frame: DataFrame, keys: Sequence[str], day: str, specs: Sequence[Robust]) -> DataFrame:
    """Median/MAD anomalies of several channels in one pass per entity.

    Running medians have no incremental SQL form, so each entity's daily rows (bounded by the
    calendar) are handled by one vectorised group function.
    """
    extra = [T.StructField(s.out, T.DoubleType()) for s in specs]
    schema = T.StructType([f for f in frame.schema.fields if f.name not in {s.out for s in specs}] + extra)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day, ignore_index=True)
        for s in specs:
            z = _robust_z(pdf[s.source].to_numpy(dtype=float), s.baseline, s.needed)
            pdf[s.out] = z if s.tau is None else np.tanh(z / s.tau)
        return pdf[[f.name for f in schema.fields]]

    return _null_nan(frame.groupBy(*keys).applyInPandas(one, schema), [s.out for s in specs])


def robust_anomaly_window(frame: DataFrame, keys, day: str, spec: Robust) -> DataFrame:
    """The same anomaly with stacked SQL windows; fits narrow baselines."""
    order = Window.partitionBy(*keys).orderBy(day)
    past = order.rowsBetween(-spec.baseline, -1)

    def median(c):
        return F.when(F.count(c).over(past) >= spec.needed, F.percentile(c, 0.5).over(past))

    out = frame.withColumn("__x", F.col(spec.source).cast("double")).withColumn("__m", median(F.col("__x")))
    out = out.withColumn("__d", F.abs(F.col("__x") - F.col("__m"))).withColumn("__s", median(F.col("__d")))
    z = F.lag((F.col("__x") - F.col("__m")) / (1.4826 * F.col("__s") + 1e-9)).over(order)
    z = z if spec.tau is None else F.tanh(z / spec.tau)
    return out.withColumn(spec.out, z).drop("__x", "__m", "__d", "__s")


def _null_nan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns})


def poisson_anomaly(frame: DataFrame, keys, day: str, source: str, out: str, baseline: int, tau: float | None,
                    obs_window: int = 14, min_periods: int | None = None) -> DataFrame:
    """Count anomaly against a regularised trailing Poisson rate (0.5 prior events)."""
    needed = baseline // 2 if min_periods is None else min_periods
    filled = frame.withColumn("__c", F.coalesce(F.col(source).cast("double"), F.lit(0.0)))
    rolled = rolling(filled, keys, day, [
        Roll("__base", "__c", baseline, "sum", needed), Roll("__days", "__c", baseline, "count", needed),
        Roll("__obs", "__c", obs_window, "sum", 1)])
    mu = (F.col("__base") + 0.5) / (F.col("__days") + 1.0) * obs_window
    z = (F.col("__obs") - mu) / F.sqrt(mu + 1e-9)
    return rolled.withColumn(out, z if tau is None else F.tanh(z / tau)).drop("__c", "__base", "__days", "__obs")


def trailing_slope(frame: DataFrame, keys, day: str, source: str, out: str, width: int,
                   min_share: float = 0.6, scale: float = 365.25) -> DataFrame:
    """Least-squares slope over the previous *width* rows, from running totals; null when
    less than *min_share* of the rows have a value or the history is shorter than *width*."""
    order = Window.partitionBy(*keys).orderBy(day)
    i = F.row_number().over(order).cast("double")
    base = frame.withColumn("__i", i)
    if width <= 64:
        # narrow frames: the direct aggregate is as fast and keeps all digits
        past = order.rowsBetween(-width, -1)
        fit = F.regr_slope(F.col(source).cast("double"), F.col("__i")).over(past)
        ok = (F.col("__i") > width) & (F.count(source).over(past) > width * min_share)
        return base.withColumn(out, F.when(ok, fit * scale)).drop("__i")
    y, x = F.col(source).cast("double"), F.when(F.col(source).isNotNull(), F.col("__i"))
    base = base.withColumns({"__y": y, "__x": x, "__xx": x * x, "__xy": x * y})
    base = rolling(base, keys, day, [Roll(f"__r{c}", f"__{c}", width) for c in ("y", "x", "xx", "xy")]
                   + [Roll("__rn", "__y", width, "count")])
    n, sx, sy = F.col("__rn"), F.col("__rx"), F.col("__ry")
    den = n * F.col("__rxx") - sx * sx
    slope = (n * F.col("__rxy") - sx * sy) / den
    ok = (F.col("__i") > width) & (n > width * min_share) & (den > 0)
    return base.withColumn(out, F.when(ok, slope * scale)).drop(
        "__i", "__y", "__x", "__xx", "__xy", "__ry", "__rx", "__rxx", "__rxy", "__rn")


def detrend_residual(frame: DataFrame, keys, day: str, source: str, out: str, width: int = 365,
                     min_periods: int = 200) -> DataFrame:
    rolled = rolling(frame, keys, day, [Roll("__m", source, width, "mean", min_periods)])
    return rolled.withColumn(out, F.col(source) - F.col("__m")).drop("__m")


def rate_ratios(frame: DataFrame, keys, day: str, source: str = "n") -> DataFrame:
    """Log ratios of short to long mean rates, null below a minimum number of events.

    Counts are shifted by one day and zero-filled before the windows. Adds ``swarm_ratio``,
    ``foreshock_ratio`` and ``slope14`` (change of the 30-day rate per day over 14 days).
    """
    order = Window.partitionBy(*keys).orderBy(day)
    prior = F.coalesce(F.lag(F.col(source).cast("double")).over(order), F.lit(0.0))
    out = rolling(frame.withColumn("__p", prior), keys, day, [
        Roll("__r7", "__p", 7, "mean", 4, 0), Roll("__r30", "__p", 30, "mean", 15, 0),
        Roll("__r180", "__p", 180, "mean", 90, 0)])
    r7, r30, r180 = F.col("__r7"), F.col("__r30"), F.col("__r180")
    return out.withColumns({
        "swarm_ratio": F.when(r180 * 180.0 >= 5.0 - 1e-9, F.log((r30 + 0.01) / (r180 + 0.01))),
        "foreshock_ratio": F.when(r30 * 30.0 >= 3.0 - 1e-9, F.log((r7 + 0.01) / (r30 + 0.01))),
        "slope14": lag_diff(r30, keys, day, 14),
    }).drop("__p", "__r7", "__r30", "__r180")


def lag_diff(c, keys, day: str, rows: int):
    """Mean change per row over the last *rows* rows."""
    return (col(c) - F.lag(col(c), rows).over(Window.partitionBy(*keys).orderBy(day))) / rows


def b_value(mean_mag, completeness: float):
    return 0.4342944819032518 / F.greatest(col(mean_mag) - completeness + 0.05, F.lit(0.05))


def regional_features(frame: DataFrame, keys, day: str, completeness: float) -> DataFrame:
    """Regional preparation features from daily n, mag_sum, dist_sum and cells; windows end the day before."""
    short = [Roll("n30", "n", 30), Roll("n90", "n", 90), Roll("n730", "n", 730, min_periods=90),
             Roll("__m30", "mag_sum", 30), Roll("__m730", "mag_sum", 730, min_periods=90),
             Roll("__d90", "dist_sum", 90), Roll("__c30", "cells", 30)]
    out = rolling(frame, keys, day, short)
    mag30 = F.col("__m30") / F.nullif(F.col("n30"), F.lit(0.0))
    mag730 = F.col("__m730") / F.nullif(F.col("n730"), F.lit(0.0))
    b_recent = F.when(mag30.isNotNull(), b_value(mag30, completeness))
    b_base = F.when(mag730.isNotNull(), b_value(mag730, completeness))
    return out.withColumns({
        "spread30": F.col("__c30") / F.sqrt(F.col("n30") + 1.0),
        "neg_radial90": -F.col("__d90") / F.nullif(F.col("n90"), F.lit(0.0)),
        "mag_accel": mag30 - mag730,
        "a_bvalue_drop": F.tanh(F.coalesce(clip(b_base - b_recent, -2.0, 2.0), F.lit(0.0)) / 0.35),
        "has_regional_catalog_data": F.coalesce(F.col("n730") > 0, F.lit(False)).cast("int"),
    }).drop("__m30", "__m730", "__d90", "__c30", "n90")


def regional_precursors(frame: DataFrame, keys, day: str, completeness: float, baseline: int = 365,
                        tau: float = 4.0) -> DataFrame:
    """The five regional channels and their availability flag."""
    out = regional_features(frame, keys, day, completeness)
    out = poisson_anomaly(out, keys, day, "n", "a_regional_rate", baseline, tau, obs_window=30)
    return robust_anomaly(out, keys, day, [
        Robust("a_regional_spread", "spread30", 730, 2.5, 90),
        Robust("a_fault_concentration", "neg_radial90", 730, 2.5, 90),
        Robust("a_mag_accel", "mag_accel", 730, 2.5, 90)])


@dataclass(frozen=True)
class Ewma:
    """Decayed state: keeps *lam* of yesterday's value; starts at 0 and ignores the first drive."""

    out: str
    drive: str
    lam: float | str

    def run(self, pdf: pd.DataFrame) -> np.ndarray:
        x = np.nan_to_num(pdf[self.drive].to_numpy(dtype=float))
        lam = pdf[self.lam].to_numpy(dtype=float) if isinstance(self.lam, str) else np.full(len(x), self.lam)
        state, out = 0.0, np.zeros(len(x))
        for i in range(1, len(x)):
            state = out[i] = state * lam[i] + (1.0 - lam[i]) * x[i]
        return out


@dataclass(frozen=True)
class Recurrent:
    """Asymmetric memory: fast attack when the input is above the state, slow release below."""

    out: str
    source: str
    attack: float = 0.65
    release: float = 0.06

    def run(self, pdf: pd.DataFrame) -> np.ndarray:
        x = np.clip(pdf[self.source].to_numpy(dtype=float), 0.0, 1.0)
        state, out = 0.0, np.zeros(len(x))
        for i in range(1, len(x)):
            gap = x[i] - state
            state = out[i] = state + gap * (self.attack if gap > 0 else self.release)
        return out


def fold_states(frame: DataFrame, keys, day: str, specs: Sequence[Ewma | Recurrent]) -> DataFrame:
    """Ordered recurrences per entity over its (calendar-bounded) daily rows."""
    names = [s.out for s in specs]
    schema = T.StructType([f for f in frame.schema.fields if f.name not in names]
                          + [T.StructField(n, T.DoubleType()) for n in names])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day, ignore_index=True)
        for s in specs:
            pdf[s.out] = s.run(pdf)
        return pdf[[f.name for f in schema.fields]]

    return frame.groupBy(*keys).applyInPandas(one, schema)


def load_accumulator(frame: DataFrame, keys, day: str, velocity: str, step: str, out: str, start, v_ref, t_rec,
                     stress_drop: float = 30.0, cap: float = 3.0) -> DataFrame:
    """Accumulated load: start + tectonic rate / recurrence + yesterday's positive stress steps."""
    order = Window.partitionBy(*keys).orderBy(day)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    v = F.coalesce(clip(col(velocity) / col(v_ref), 0.0, 3.0), F.lit(1.0))
    stepped = F.greatest(F.coalesce(F.lag(col(step)).over(order), F.lit(0.0)), F.lit(0.0)) / stress_drop
    out_df = frame.withColumns({"__dc": v / (col(t_rec) * 365.25), "__ds": stepped})
    total = col(start) + F.sum("__dc").over(upto) + F.sum("__ds").over(upto)
    return out_df.withColumn(out, clip(total, 0.0, cap)).drop("__dc", "__ds")


def fast_slow_trend(c: str, keys, day: str):
    """Trend in [-1, 1]: mean of 7 rows minus mean of 60 rows, current row included."""
    def mean(width, needed):
        w = Window.partitionBy(*keys).orderBy(day).rowsBetween(-(width - 1), 0)
        return F.when(F.count(c).over(w) >= needed, F.avg(c).over(w))

    gap = F.coalesce(mean(7, 3) - mean(60, 20), F.lit(0.0))
    return F.least(F.greatest(gap / 0.35, F.lit(-1.0)), F.lit(1.0))


def drive(c: str):
    return elevated(c)


def causal_ffill(source: DataFrame, spine: DataFrame, keys, time: str, value: str, limit: int | None = None) -> DataFrame:
    """Value known at each spine time: the last source value at or before it.

    *limit* is the number of consecutive rows of the union of both time axes that may be filled.
    """
    rows = (spine.select(*keys, time, F.lit(None).cast("double").alias(value), F.lit(1).alias("__target"))
            .unionByName(source.select(*keys, time, F.col(value).cast("double").alias(value), F.lit(0).alias("__target")))
            .groupBy(*keys, time).agg(F.max(value).alias("__v"), F.max("__target").alias("__target")))
    order = Window.partitionBy(*keys).orderBy(time)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__i", F.row_number().over(order))
    rows = rows.withColumns({
        "__last": F.last("__v", ignorenulls=True).over(upto),
        "__at": F.max(F.when(F.col("__v").isNotNull(), F.col("__i"))).over(upto)})
    filled = F.col("__last") if limit is None else F.when(F.col("__i") - F.col("__at") <= limit, F.col("__last"))
    return rows.filter("__target = 1").select(*keys, time, filled.alias(value))


def one_sided_difference(series: DataFrame, keys, day: str, side: str, value: str, out: str) -> DataFrame:
    """Mean of the stations on the negative side minus the mean on the positive side.

    Null on days on which one side has no value; 0 for an entity that has no pair of sides at all.
    """
    per_day = series.groupBy(*keys, day).agg(
        F.avg(F.when(F.col(side) < 0, F.col(value))).alias("__neg"),
        F.avg(F.when(F.col(side) > 0, F.col(value))).alias("__pos"))
    whole = Window.partitionBy(*keys)
    pair = F.max(F.col("__neg").isNotNull()).over(whole) & F.max(F.col("__pos").isNotNull()).over(whole)
    return per_day.withColumn(out, F.when(pair, F.col("__neg") - F.col("__pos")).otherwise(0.0)).drop("__neg", "__pos")


def latest_row(frame: DataFrame, keys, order: str) -> DataFrame:
    """Last row per entity as one partial aggregation."""
    rest = [c for c in frame.columns if c not in keys]
    return (frame.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r"))
            .select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]))


def tail_mean(frame: DataFrame, keys, day: str, columns: Sequence[str], rows: int = 90) -> DataFrame:
    """Mean of the last *rows* daily rows per entity."""
    w = Window.partitionBy(*keys).orderBy(F.col(day).desc())
    tail = frame.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= rows)
    return tail.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])
