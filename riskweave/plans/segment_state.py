"""Segment intensities, likelihoods and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.fuzzy import elevated
from riskweave.operators import gain as gn, intensity as it, timeseries as ts
from riskweave.operators.consequents import fit_consequents
from riskweave.operators.timeseries import Ewma, Robust, Roll
from riskweave.plans.joining import BIG
from riskweave.plans.series import DAILY_SQL, daily, daily_stats
from riskweave.plans.standins import CATALOG_SQL, after_last, catalog, literal_table, rounded, segments, sql_days, sql_round, values
from riskweave.registry import query
from riskweave.session import cut_lineage

BASE_SQL = DAILY_SQL + f""", kept AS (SELECT segment, count(*) AS kept FROM catalog e WHERE mag >= 5.3e0 AND NOT EXISTS (SELECT 1 FROM catalog g WHERE g.segment = e.segment AND g.mag >= 5.65e0 AND {sql_days('e.time', 'g.time')} > 0
   AND {sql_days('e.time', 'g.time')} < 30 AND sqrt(pow((e.latitude - g.latitude) * 110.6e0, 2) + pow((e.longitude - g.longitude) * 92.6e0, 2)) < 30) GROUP BY segment),
 sp AS (SELECT segment, floor({sql_days('max(time)', 'min(time)')}) AS span, count(*) FILTER (WHERE mag >= 5.69e0) AS n_obs FROM catalog GROUP BY segment),
 ex AS (SELECT d.segment, d.day, sum(pow(10e0, 0.9e0 * (e.mag - 5.5e0)) / pow({sql_days('d.day', 'e.time')} + 0.02e0, 1.1e0)) AS u FROM daily d JOIN catalog e ON e.segment = d.segment AND e.mag >= 5.5e0 AND CAST(d.day AS TIMESTAMP) > e.time GROUP BY 1, 2),
 un AS (SELECT segment, day, coalesce(u, 0e0) AS u FROM daily LEFT JOIN ex USING (segment, day)), tt AS (SELECT segment, sum(u) AS total, count(*) AS nd FROM un GROUP BY 1),
 par AS (SELECT segment, kept / span * pow(10e0, -(5.69e0 - 5.3e0)) AS mu, n_obs, total, nd FROM sp JOIN kept USING (segment) JOIN tt USING (segment)),
 lamb AS (SELECT segment, day, mu + greatest(n_obs - mu * nd, 0.05e0 * greatest(n_obs, 1)) / greatest(total, 1e-9) * u AS lam FROM un JOIN par USING (segment))"""


def baseline(spark, sf):
    return it.baseline_intensity(catalog(spark, sf), daily(spark, sf), ["segment"], after_last(spark, sf), 5.69, 5.3, 5.5, big_mag=5.65)


@query("intensity_baseline", f"WITH {BASE_SQL} SELECT segment, day, {sql_round('lam')} AS lam FROM lamb")
def _(spark, sf):
    return rounded(baseline(spark, sf))


FIT = {"Mc": 5.5, "mu": 0.05, "K": 0.02, "c": 0.02, "p": 1.1, "alpha": 0.9}


@query("intensity_fitted", f"""WITH {BASE_SQL} SELECT segment, day, {sql_round('(0.05e0 + 0.02e0 * u) * pow(10e0, -(5.69e0 - 5.5e0))')} AS lam FROM un""")
def _(spark, sf):
    return rounded(it.fitted_intensity(catalog(spark, sf), daily(spark, sf), ["segment"], after_last(spark, sf), FIT, 5.69))


SERIES_SQL = BASE_SQL + """, ser AS (SELECT segment, day, lam AS lam_base, CASE WHEN count(n) OVER w > 0 THEN pow(10e0, least(1.7e0, greatest(-1e0, (sum(n) OVER w - 7.5e0) / 20e0))) END AS G FROM lamb JOIN daily USING (segment, day) WINDOW w AS (PARTITION BY segment ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
 serx AS (SELECT *, lam_base * coalesce(G, 1e0) AS lam_refined FROM ser)"""


def series(spark, sf):
    """Baseline, gain and refined intensity; the gain here follows the 30-day count."""
    d = ts.rolling(daily(spark, sf), ["segment"], "day", [Roll("c30", "n", 30)])
    g = F.pow(F.lit(10.0), F.least(F.lit(1.7), F.greatest(F.lit(-1.0), (F.col("c30") - 7.5) / 20.0)))
    s = baseline(spark, sf).join(d.select("segment", "day", F.when(F.col("c30").isNotNull(), g).alias("G")), ["segment", "day"])
    return s.select("segment", "day", F.col("lam").alias("lam_base"), "G", (F.col("lam") * F.coalesce("G", F.lit(1.0))).alias("lam_refined"))


@query("refined_intensity", f"WITH {SERIES_SQL} SELECT segment, day, {sql_round('lam_refined')} AS lam_refined FROM serx")
def _(spark, sf):
    return rounded(series(spark, sf).select("segment", "day", "lam_refined"))


@query("segment_forecast_table", f"""WITH {SERIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY day DESC) AS r FROM serx), g AS (SELECT segment, max(day) AS as_of, avg(lam_refined) AS lam, avg(lam_base) AS lb, avg(G) AS gg FROM r WHERE r <= 90 GROUP BY segment),
 cut AS (SELECT segment, max(day) AS catalog_cutoff, count(*) FILTER (WHERE {BIG}) AS n_target_events FROM catalog GROUP BY segment)
 SELECT segment, as_of, {sql_round('lam')} AS lam, {sql_round('lb')} AS lam_base, round_even(gg, 3) AS gain_now, round_even(1 / lam / 365.25e0, 1) AS mean_years, round_even(1 - exp(-lam * 30), 5) AS p_30d, round_even(1 - exp(-lam * 365), 4) AS p_1yr, round_even(1 - exp(-lam * 3652), 3) AS p_10yr,
  CASE WHEN 1 / lam / 365.25e0 > 50 THEN 'very long term' WHEN 1 / lam / 365.25e0 > 10 THEN 'decades' ELSE 'years' END AS wait_class, catalog_cutoff, n_target_events, CASE segment WHEN 0 THEN 'T p=0.01' WHEN 3 THEN 'T p=0.2' ELSE 'no test' END AS verdict FROM g JOIN cut USING (segment)""")
def _(spark, sf):
    f = it.forecast_summary(series(spark, sf), ["segment"], "day", "lam_refined", "lam_base", "G")
    cut = catalog(spark, sf).groupBy("segment").agg(F.max("day").alias("catalog_cutoff"), F.count(F.when(F.expr(BIG), 1)).alias("n_target_events"))
    verdicts = literal_table(spark, [(0, "T p=0.01"), (3, "T p=0.2")], "segment, verdict")
    f = f.join(cut, "segment").join(F.broadcast(verdicts), "segment", "left").withColumn("verdict", F.coalesce("verdict", F.lit("no test")))
    return f.withColumns({"lam": F.round("lam", 6), "lam_base": F.round("lam_base", 6)})


@query("train_holdout_scoreboard", f"""WITH {SERIES_SQL}, ec AS (SELECT segment, day, count(*) AS n FROM catalog WHERE {BIG} GROUP BY 1, 2), l AS (SELECT segment, day, 'lam_base' AS model, lam_base AS lam FROM serx UNION ALL SELECT segment, day, 'lam_refined', lam_refined FROM serx)
 SELECT segment, CASE WHEN day < DATE '1999-06-01' THEN 'train' ELSE 'holdout' END AS window, model, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_events, {sql_round('coalesce(sum(n * ln(greatest(lam, 1e-9))), 0) - sum(greatest(lam, 1e-9))', 4)} AS loglik FROM l LEFT JOIN ec USING (segment, day) GROUP BY 1, 2, 3""")
def _(spark, sf):
    ev = catalog(spark, sf).filter(BIG)
    return rounded(it.window_loglik(series(spark, sf), ev, ["segment"], "day", ["lam_base", "lam_refined"], "1999-06-01"), 4)


CANDS = [(0, 0.01, 0.02, 0.02, 1.1, 0.9), (1, 0.05, 0.01, 0.1, 1.2, 0.5), (2, 0.1, 0.002, 0.02, 1.1, 1.5), (3, 0.14, 0.001, 0.5, 1.0, 0.9)]
CAND_COLS = "cand, mu, K, c, p, alpha"


def rates_sql(mc):
    """Events of the candidates: w (weight and count of each exact time), la (rate at each event)."""
    return f"""cd AS (SELECT * FROM (VALUES {values(CANDS)}) AS t({CAND_COLS})), t0 AS (SELECT segment, min(epoch_us(time)) AS t0 FROM catalog WHERE mag >= {mc}e0 GROUP BY 1),
 e AS (SELECT segment, (epoch_us(time) - t0) / 86400e6 AS t, mag FROM catalog JOIN t0 USING (segment) WHERE mag >= {mc}e0),
 w AS (SELECT cand, mu, K, c, p, segment, t, count(*) AS n, sum(pow(10e0, alpha * (mag - {mc}e0))) AS w FROM e, cd GROUP BY ALL),
 la AS (SELECT a.cand, a.segment, a.t, a.n, a.mu + a.K * coalesce(sum(b.w / pow(a.t - b.t + a.c, a.p)), 0) AS lam FROM w a LEFT JOIN w b ON a.cand = b.cand AND a.segment = b.segment AND b.t < a.t GROUP BY a.cand, a.segment, a.t, a.n, a.mu, a.K)"""


MASS = "w * CASE WHEN abs(p - 1) < 1e-6 THEN ln(tend - t + c) - ln(c) ELSE (pow(tend - t + c, 1 - p) - pow(c, 1 - p)) / (CASE WHEN p = 1 THEN 1 ELSE 1 - p END) END"
LL_SQL = CATALOG_SQL + f""", {rates_sql(5.6)},
 s1 AS (SELECT cand, segment, sum(n) AS n, sum(n * ln(lam)) AS s FROM la GROUP BY 1, 2), tm AS (SELECT segment, max(t) + 1e0 AS tend FROM e GROUP BY 1),
 s2 AS (SELECT cand, segment, any_value(mu) * any_value(tend) + any_value(K) * sum({MASS}) AS i FROM w JOIN tm USING (segment) GROUP BY 1, 2),
 ll AS (SELECT cand, segment, CAST(n AS BIGINT) AS n_events, s - i AS loglik FROM s1 JOIN s2 USING (cand, segment))"""


def scored(spark, sf):
    return it.candidate_loglik(catalog(spark, sf), literal_table(spark, CANDS, CAND_COLS), ["segment"], 5.6)


@query("etas_log_likelihood", f"WITH {LL_SQL} SELECT cand, segment, n_events, {sql_round('loglik', 5)} AS loglik FROM ll")
def _(spark, sf):
    return rounded(scored(spark, sf), 5)


@query("candidate_grid_likelihood", f"WITH {LL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY loglik - 2 * (0.1e0 * cand) DESC, cand) AS r FROM ll) SELECT segment, cand, {sql_round('loglik', 5)} AS loglik FROM r WHERE r = 1")
def _(spark, sf):
    s = scored(spark, sf).withColumn("penalty", 2 * (0.1 * F.col("cand")))
    return rounded(it.best_candidate(s, ["segment"]), 5)


def daily_state(spark, sf):
    """Channels, states and strengths of every segment-day in one chained frame."""
    k, d = ["segment"], "day"
    frame = ts.date_spine(daily_stats(spark, sf), k, values=["n", "mag_sum", "dist_sum", "cells"])
    frame = ts.regional_features(frame, k, d, 4.7)
    frame = ts.poisson_anomaly(frame, k, d, "n", "a_regional_rate", 365, 4.0, 30)
    frame = ts.poisson_anomaly(frame, k, d, "n", "a_seis", 365, 4.0, 14)
    frame = ts.rate_ratios(frame, k, d)
    frame = ts.robust_anomaly(frame, k, d, [
        Robust("a_regional_spread", "spread30", 730, 2.5, 90), Robust("a_fault_concentration", "neg_radial90", 730, 2.5, 90),
        Robust("a_mag_accel", "mag_accel", 730, 2.5, 90), Robust("__sw", "swarm_ratio", 365, 2.5), Robust("__fo", "foreshock_ratio", 365, 2.0)])
    frame = frame.withColumns({
        "a_swarm": F.when(F.col("slope14") >= -0.01, F.coalesce("__sw", F.lit(0.0))).otherwise(0.0), "a_foreshock": F.coalesce("__fo", F.lit(0.0)),
        "__da": elevated("a_seis")}).withColumn("__de", elevated("a_swarm")).drop("__sw", "__fo")
    frame = ts.fold_states(frame, k, d, [Ewma("A_state", "__da", 0.95), Ewma("E_state", "__de", 0.97)])
    seg = segments(spark).select("segment", "v_ref", "t_rec")
    frame = frame.join(F.broadcast(seg), "segment").withColumns({"__v": F.lit(None).cast("double"), "__s": F.lit(0.0)})
    frame = ts.load_accumulator(frame, k, d, "__v", "__s", "C_state", F.lit(0.4), "v_ref", "t_rec")
    return gn.with_strengths(frame)


@query("segment_daily_state")
def _(spark, sf):
    """Channels, states and gain of every segment-day."""
    frame = daily_state(spark, sf)
    cols = ["a_seis", "a_swarm", "a_foreshock", "a_regional_rate", "a_regional_spread", "a_bvalue_drop", "a_fault_concentration", "a_mag_accel", "A_state", "C_state", "E_state"]
    return frame.select("segment", "day", "n", *cols, gn.gain(frame).alias("G"))


@query("consequent_fit")
def _(spark, sf):
    """Consequents fitted to the refined rates of all segments under the sign order, beside their prior."""
    n = catalog(spark, sf).filter(BIG).groupBy("segment", "day").agg(F.count(F.lit(1)).alias("n_target"))
    state = daily_state(spark, sf)
    frame = state.select("segment", "day", *[c for c in state.columns if c.startswith("w_")]).join(baseline(spark, sf), ["segment", "day"]).join(n, ["segment", "day"], "left")
    fitted, info = fit_consequents(cut_lineage(frame), "lam", "n_target")
    rows = [(c, float(prior), float(fitted[c]), info["trained"]) for c, prior in gn.CONSEQUENTS.items()]
    return rounded(spark.createDataFrame(rows, "rule string, prior double, fitted double, trained boolean"), 4)
