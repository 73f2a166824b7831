"""Baseline and refined event intensities, likelihoods of parameter candidates, rolling evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.asof import neighbours
from riskweave.operators.episodes import event_count_epochs
from riskweave.operators.evaluation import paired_event_test
from riskweave.operators.kernel_sums import days_since, kernel_sums
from riskweave.operators.spatial import kernel_intensity, spatiotemporal_exclusion
from riskweave.session import cut_lineage


def baseline_intensity(catalog: DataFrame, spine: DataFrame, keys: Sequence[str], last_day, target_mag: float, ref_mag: float, trigger_mag: float,
                       b: float = 1.0, c: float = 0.02, p: float = 1.1, alpha: float = 0.9, big_mag: float = 5.0) -> DataFrame:
    """Daily intensity of target events: declustered background plus the scaled excitation of past events.

    The background is the rate of reference events outside aftershock zones, scaled to the target
    magnitude; the excitation is scaled to the observed number of target events.
    """
    ref = catalog.filter(F.col("mag") >= ref_mag)
    kept = spatiotemporal_exclusion(ref, catalog.filter(F.col("mag") >= big_mag), keys=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("kept"))
    span = catalog.groupBy(*keys).agg(
        F.floor((F.unix_micros(F.max("time").cast("timestamp")) - F.unix_micros(F.min("time").cast("timestamp"))) / F.lit(86400e6)).alias("span"),
        F.count(F.when(F.col("mag") >= target_mag, 1)).alias("n_obs"))
    mu = F.col("kept") / F.col("span") * 10.0 ** (-b * (target_mag - ref_mag))
    triggers = catalog.filter(F.col("mag") >= trigger_mag).withColumn("__w", F.pow(F.lit(10.0), alpha * (F.col("mag") - trigger_mag)))
    unit = kernel_intensity(triggers, keys, "time", "__w", c, p, last_day)
    days = spine.select(*keys, "day").join(unit, [*keys, "day"], "left").withColumn("u", F.coalesce("excitation", F.lit(0.0)))
    totals = days.groupBy(*keys).agg(F.sum("u").alias("total"), F.count(F.lit(1)).alias("n_days"))
    par = span.join(kept, list(keys), "left").join(totals, list(keys)).withColumn("mu", F.coalesce(mu, F.lit(0.0)))
    surplus = F.greatest(F.col("n_obs") - F.col("mu") * F.col("n_days"), 0.05 * F.greatest("n_obs", F.lit(1)))
    par = par.withColumn("k0", surplus / F.greatest("total", F.lit(1e-9))).select(*keys, "mu", "k0")
    return days.join(par, list(keys)).select(*keys, "day", (F.col("mu") + F.col("k0") * F.col("u")).alias("lam"))


def fitted_intensity(catalog: DataFrame, spine: DataFrame, keys: Sequence[str], last_day, params: dict, target_mag: float, b: float = 1.0) -> DataFrame:
    """Daily intensity with frozen parameters (Mc, mu, K, c, p, alpha), scaled to the target magnitude."""
    mc = params["Mc"]
    ev = catalog.filter(F.col("mag") >= mc).withColumn("__w", F.pow(F.lit(10.0), params["alpha"] * (F.col("mag") - mc)))
    unit = kernel_intensity(ev, keys, "time", "__w", params["c"], params["p"], last_day)
    lam = F.lit(params["mu"]) + params["K"] * F.coalesce("excitation", F.lit(0.0))
    return spine.select(*keys, "day").join(unit, [*keys, "day"], "left").select(*keys, "day", (lam * 10.0 ** (-b * (target_mag - mc))).alias("lam"))


def _timed(catalog: DataFrame, keys: Sequence[str], mc: float) -> DataFrame:
    """Events from *mc* on with t, the exact days since the first one of their entity, merged where equal."""
    ev = catalog.filter((F.col("mag") >= mc) & F.col("time").isNotNull()).select(*keys, "time", "mag")
    start = ev.groupBy(*keys).agg(F.min("time").alias("__t0"))
    ev = ev.join(start, list(keys)).withColumn("t", days_since(F.col("time"), F.col("__t0")))
    return ev.groupBy(*keys, "__t0", "t", "mag").agg(F.count(F.lit(1)).alias("n"))


def _weights(timed: DataFrame, candidates: DataFrame, keys: Sequence[str], mc: float) -> DataFrame:
    alphas = candidates.select("alpha").distinct()
    return timed.crossJoin(F.broadcast(alphas)).select(*keys, "alpha", "t", (F.col("n") * F.pow(F.lit(10.0), F.col("alpha") * (F.col("mag") - mc))).alias("w"))


def _bounds(timed: DataFrame, candidates: DataFrame) -> tuple[float, float]:
    """Length of the longest entity and the smallest c."""
    return (timed.agg(F.max("t")).first()[0] or 0.0), candidates.agg(F.min("c")).first()[0]


def _mass(candidates: DataFrame) -> DataFrame:
    """Kernels of the integrated rate: exponent p - 1; where p is 1 the integral is a logarithm."""
    return candidates.withColumn("q", F.col("p") - 1)


def _integrated(power: Column, log: Column, weight: Column) -> Column:
    """Integral of the excitation: from the summed powers (or logarithms) of the lags and the summed weights."""
    one = F.abs(F.col("p") - 1) < 1e-6
    rest = F.when(one, 1.0).otherwise(1 - F.col("p"))
    return F.when(one, log - F.log("c") * weight).otherwise((power - F.pow(F.col("c"), 1 - F.col("p")) * weight) / rest)


def event_rates(timed: DataFrame, candidates: DataFrame, keys: Sequence[str], mc: float, span: float, c_min: float) -> DataFrame:
    """(cand, keys, t, n, log_rate): logarithm of each candidate's intensity at every event time, strictly earlier events only."""
    k = list(keys)
    times = timed.groupBy(*k, "t").agg(F.sum("n").alias("n"))
    kernels = candidates.select("cand", "alpha", "c", F.col("p").alias("q"))
    sums = kernel_sums(_weights(timed, candidates, k, mc), times.withColumn("at", F.col("t")), kernels, k, span, c_min, out="__s")
    every = times.crossJoin(F.broadcast(candidates.select("cand", "mu", "K")))
    rate = F.col("mu") + F.col("K") * F.coalesce("__s", F.lit(0.0))
    return every.join(sums, ["cand", *k, "t"], "left").select("cand", *k, "t", "n", F.log(rate).alias("log_rate"))


def candidate_loglik(catalog: DataFrame, candidates: DataFrame, keys: Sequence[str], mc: float) -> DataFrame:
    """Log-likelihood of every parameter candidate (cand, mu, K, c, p, alpha) per entity on exact event times.

    Sum of the log rates at the events minus the integral of the rate up to one day after the last
    event. An event is triggered by all earlier ones, those of its own day included; events of equal times do not trigger one
    another. *candidates* is a short table and is broadcast.
    """
    k = list(keys)
    timed = cut_lineage(_timed(catalog, k, mc))
    span, c_min = _bounds(timed, candidates)
    at_events = event_rates(timed, candidates, k, mc, span, c_min).groupBy("cand", *k).agg(F.sum("n").alias("n_events"), F.sum(F.col("n") * F.col("log_rate")).alias("at"))
    ends = timed.groupBy(*k).agg((F.max("t") + 1.0).alias("end"))
    lag = F.col("end") - F.col("t") + F.col("c")
    mass = (timed.join(ends, k).crossJoin(F.broadcast(candidates))
            .withColumn("w", F.col("n") * F.pow(F.lit(10.0), F.col("alpha") * (F.col("mag") - mc))).withColumn(
                "mass", F.col("w") * _integrated(F.pow(lag, 1 - F.col("p")), F.log(lag), F.lit(1.0)))
            .groupBy("cand", *k).agg((F.first("mu") * F.first("end") + F.first("K") * F.sum("mass")).alias("integral")))
    return at_events.join(mass, ["cand", *k]).select("cand", *k, "n_events", (F.col("at") - F.col("integral")).alias("loglik"))


def best_candidate(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidate with the largest likelihood (minus ``penalty`` when there is one) per entity."""
    value = F.col("loglik") - (F.col("penalty") if "penalty" in scored.columns else F.lit(0.0))
    return scored.groupBy(*keys).agg(F.max_by(F.struct("cand", "loglik"), F.struct(value, (-F.col("cand")))).alias("__b")).select(*keys, "__b.cand", "__b.loglik")


def rolling_choice(timed: DataFrame, candidates: DataFrame, epochs: DataFrame, keys: Sequence[str], mc: float, span: float, c_min: float) -> DataFrame:
    """Best candidate of each epoch on the events strictly before its start: (keys, epoch, cand, loglik).

    Rates are causal, so the training likelihood of an epoch is a running total of the log rates, looked up at
    its start, minus an integral that is one kernel sum at the end of the training data.
    """
    k = list(keys)
    starts = epochs.join(timed.select(*k, "__t0").distinct(), k).select(*k, "epoch", days_since(F.col("start").cast("timestamp_ntz"), F.col("__t0")).alias("t"))
    rates = event_rates(timed, candidates, k, mc, span, c_min)
    marks = starts.crossJoin(F.broadcast(candidates.select("cand")))
    both = rates.select("cand", *k, "t", F.lit(1).alias("kind"), "n", (F.col("n") * F.col("log_rate")).alias("at"), F.lit(None).cast("long").alias("epoch")).unionByName(
        marks.select("cand", *k, "t", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("at"), F.col("epoch").cast("long").alias("epoch")))
    before = Window.partitionBy("cand", *k).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, -1)
    past = both.withColumns({"n": F.sum("n").over(before), "at": F.sum("at").over(before), "last": F.max(F.when(F.col("kind") == 1, F.col("t"))).over(before)}).filter("kind = 0 AND n >= 2")
    past = cut_lineage(past.select("cand", *k, "epoch", "t", "at", (F.col("last") + 1.0).alias("end")))
    ends = past.select(*k, F.least("t", "end").alias("t"), F.col("end").alias("at")).distinct()
    weights, mass = _weights(timed, candidates, k, mc), _mass(candidates)
    power = kernel_sums(weights, ends, mass, k, span + 1, c_min, out="power")
    logs = kernel_sums(weights, ends, mass.filter(F.abs(F.col("p") - 1) < 1e-6), k, span + 1, c_min, log=True, out="log")
    plain = kernel_sums(weights, ends, mass.withColumn("q", F.lit(0.0)), k, span + 1, c_min, out="weight")
    on = ["cand", *k, "t"]
    scored = past.withColumn("t", F.least("t", "end")).join(power, on).join(plain, on).join(logs, on, "left").join(F.broadcast(candidates), "cand")
    ll = F.col("at") - F.col("mu") * F.col("end") - F.col("K") * _integrated(F.col("power"), F.col("log"), F.col("weight"))
    return scored.groupBy(*k, "epoch").agg(F.max_by(F.struct("cand", ll.alias("loglik")), F.struct(ll, -F.col("cand"))).alias("b")).select(*k, "epoch", "b.cand", "b.loglik")


def first_origins(spine: DataFrame, keys: Sequence[str], day: str = "day", years: int = 5) -> DataFrame:
    """(keys, origin): the first day that has *years* years of the daily frame before it."""
    return spine.groupBy(*keys).agg(F.add_months(F.min(day), 12 * years).alias("origin"))


def rolling_origin(catalog: DataFrame, candidates: DataFrame, gains: DataFrame, keys: Sequence[str], mc: float, size: int = 5, years: int = 5,
                   min_events: int = 3, min_days: int = 60) -> DataFrame:
    """Per epoch: choose the baseline on strictly earlier events, compare it with the refined rates inside.

    *gains* is the daily frame (keys, day, G); epochs are *size* consecutive events after the first *years* years of
    it, each up to the day after its last event. Rates of all candidates on all days come from one kernel sum.
    Epochs with fewer than *min_events* events or *min_days* days of the frame have status ``skipped`` and no
    statistics; the others have the gain, t and signed-rank tests, and the count tests of both forecasts.
    """
    k = list(keys)
    gains = gains.select(*k, "day", "G")
    timed = cut_lineage(_timed(catalog, k, mc))
    span, c_min = _bounds(timed, candidates)
    events = timed.withColumn("day", F.to_date(F.timestamp_micros((F.unix_micros(F.col("__t0").cast("timestamp")) + F.round(F.col("t") * 86400e6)).cast("long"))))
    counts = events.groupBy(*k, "day").agg(F.sum("n").alias("n"))
    origins = first_origins(gains, k, years=years)
    late = counts.join(origins, k).filter(F.col("day") >= F.col("origin"))
    epochs = cut_lineage(event_count_epochs(late, k, "day", "n", size, F.col("origin")).filter(F.col("start") < F.col("end")).select(*k, "epoch", "start", "end"))
    chosen = rolling_choice(timed, candidates, epochs, k, mc, span, c_min)
    first = timed.groupBy(*k).agg(F.first("__t0").alias("__t0"))
    days = gains.join(first, k).withColumn("t", days_since(F.col("day").cast("timestamp_ntz"), F.col("__t0")))
    targets = days.filter("t > 0").select(*k, "t", F.col("t").alias("at"))
    longest = targets.agg(F.max("t")).first()[0] or 0.0
    sums = kernel_sums(_weights(timed, candidates, k, mc), targets, candidates.select("cand", "alpha", "c", F.col("p").alias("q")), k, max(span, longest), c_min, out="__s")
    # epochs of an entity do not overlap: the one that a day is in has the last start up to it
    inside = neighbours(days, epochs, k, "day", "start", ["epoch", "end"], bucket="YEAR", next=False)
    inside = inside.filter(F.col("day") < F.col("prev.end")).select(*days.columns, F.col("prev.epoch").alias("epoch"))
    series = (inside.join(chosen, [*k, "epoch"]).join(sums, ["cand", *k, "t"], "left").join(F.broadcast(candidates.select("cand", "mu", "K")), "cand")
              .withColumn("base", F.col("mu") + F.col("K") * F.coalesce("__s", F.lit(0.0))).withColumn("refined", F.col("base") * F.col("G")).join(counts, [*k, "day"], "left"))
    series = cut_lineage(series.select(*k, "epoch", "cand", "day", "base", "refined", F.coalesce("n", F.lit(0)).alias("n")))
    group = [*k, "epoch"]
    every = series.groupBy(*group).agg(F.first("cand").alias("cand"), F.sum("refined").alias("exp_a"), F.sum("base").alias("exp_b"), F.count(F.lit(1)).alias("n_days"), F.sum("n").alias("n_events"))
    used = (F.col("n_events") >= min_events) & (F.col("n_days") >= min_days)
    every = cut_lineage(every.withColumn("status", F.when(used, "ok").otherwise("skipped")))
    usable = every.filter("status = 'ok'")
    ratios = series.filter("n > 0").join(usable.select(*group), group).withColumn("d", F.log(F.col("refined") / F.col("base")))
    ratios = ratios.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    tests = paired_event_test(ratios.select(*group, "d"), usable.select(*group, "exp_a", "exp_b"), group)
    tests = tests.select(*group, "info_gain", "t_stat", "t_p", "w_stat", "w_p", "n_p_a", "n_p_b", (F.col("info_gain") > 0).alias("favours"))
    return every.join(tests, group, "left")


def window_loglik(series: DataFrame, events: DataFrame, keys: Sequence[str], day: str, models: Sequence[str], cutoff) -> DataFrame:
    """Log-likelihood of each model on the days before (train) and from (holdout) the cutoff."""
    counts = events.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("__n"))
    s = series.join(counts, [*keys, day], "left").withColumn("window", F.when(F.col(day) < F.lit(cutoff).cast("date"), "train").otherwise("holdout"))
    long = s.unpivot([*keys, "window", "__n"], list(models), "model", "lam").filter("lam is not null")
    lam = F.greatest("lam", F.lit(1e-9))
    return long.groupBy(*keys, "window", "model").agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_events"), (F.coalesce(F.sum(F.col("__n") * F.log(lam)), F.lit(0.0)) - F.sum(lam)).alias("loglik"))


def forecast_summary(series: DataFrame, keys: Sequence[str], day: str, lam: str, base: str, gain: str, rows: int = 90) -> DataFrame:
    """Trailing mean intensity and the probabilities it implies, per entity."""
    from riskweave.functions.fuzzy import value_bucket
    from riskweave.functions.probability import poisson_probability

    w = Window.partitionBy(*keys).orderBy(F.col(day).desc())
    tail = series.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= rows)
    g = tail.groupBy(*keys).agg(F.avg(lam).alias("lam"), F.avg(base).alias("lam_base"), F.avg(gain).alias("gain"), F.max(day).alias("as_of"))
    years = F.when(F.col("lam") > 0, 1 / F.col("lam") / 365.25)
    label = F.coalesce(value_bucket(years, [10, 50], ["years", "decades", "very long term"], strict=True), F.lit("undetermined"))
    return g.select(*keys, "as_of", "lam", "lam_base", F.bround("gain", 3).alias("gain_now"), F.bround(years, 1).alias("mean_years"), F.bround(poisson_probability("lam", 30), 5).alias("p_30d"),
                    F.bround(poisson_probability("lam", 365), 4).alias("p_1yr"), F.bround(poisson_probability("lam", 3652), 3).alias("p_10yr"), label.alias("wait_class"))
