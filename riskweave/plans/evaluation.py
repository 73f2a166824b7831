"""Calibration and evaluation plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.operators import asof, calibration as cal, evaluation as ev, timeseries as ts
from riskweave.operators.quantiles import quantiles
from riskweave.plans.joining import BIG
from riskweave.plans.series import DAILY_SQL, daily
from riskweave.plans.standins import SCORES_SQL, catalog, rounded, score_rows, sql_round
from riskweave.registry import query

def lit_list(name, n):
    return ", ".join(f"{i / n!r}" for i in range(1, n))


Q = lambda col, shares, where="": f"(SELECT quantile_cont({col}, [{shares}]) FROM scores {where})"
BIN = "CAST(len(list_filter({edges}, lambda e: e <= {x})) AS INTEGER)"


@query("binned_rate_1d", f"""WITH {SCORES_SQL}, ed AS (SELECT quantile_cont(value, [{lit_list('', 10)}]) AS e FROM scores), b AS (SELECT {BIN.format(edges='ed.e', x='value')} AS bin, y FROM scores, ed),
 g AS (SELECT bin, count(*) AS n, avg(y) AS r FROM b GROUP BY bin), s AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10)), f AS (SELECT bin, coalesce(n, 0) AS n, CASE WHEN n >= 300 THEN r END AS r FROM s LEFT JOIN g USING (bin))
 SELECT bin, n, {sql_round('max(coalesce(r, (SELECT avg(r) FROM f))) OVER (ORDER BY bin)')} AS p FROM f""")
def _(spark, sf):
    s = score_rows(spark, sf)
    edges = cal.quantile_edges(s, "value", 10)
    return rounded(cal.binned_rate(s.withColumn("bin", cal.bin_of("value", edges)), [("bin", 10)], "y", 300))


TWO_SQL = SCORES_SQL + f""", x AS (SELECT *, greatest(value - 30e0, 0e0) AS om FROM scores), e1 AS (SELECT quantile_cont(ln(1 + om), [{', '.join(repr(i / 7) for i in range(1, 7))}]) AS e FROM x WHERE om > 0), e2 AS (SELECT quantile_cont(p, [{lit_list('', 8)}]) AS e FROM x),
 b AS (SELECT id, {BIN.format(edges='e1.e', x='ln(1 + om)')} AS b1, {BIN.format(edges='e2.e', x='p')} AS b2, y FROM x, e1, e2), g AS (SELECT b1, b2, count(*) AS n, avg(y) AS r FROM b GROUP BY 1, 2),
 s AS (SELECT CAST(a.range AS INTEGER) AS b1, CAST(c.range AS INTEGER) AS b2 FROM range(7) a, range(8) c), f AS (SELECT b1, b2, coalesce(n, 0) AS n, CASE WHEN n >= 60 THEN r END AS r FROM s LEFT JOIN g USING (b1, b2)),
 w AS (SELECT b1, b2, n, coalesce(r, avg(r) OVER (PARTITION BY b1), (SELECT avg(y) FROM x)) AS r FROM f), t2 AS (SELECT b1, b2, n, max(r) OVER (PARTITION BY b1 ORDER BY b2) AS p FROM w)"""


def two_axis(spark, sf):
    s = score_rows(spark, sf).withColumn("lo", F.log1p(F.greatest(F.col("value") - 30.0, F.lit(0.0))))
    e = cal.edge_sets(s, {"b1": ("lo", 8, True), "b2": ("p", 8, False)})
    return s.withColumns({"b1": cal.bin_of("lo", e["b1"]), "b2": cal.bin_of("p", e["b2"])})


@query("binned_rate_2d", f"WITH {TWO_SQL} SELECT b1, b2, n, {sql_round('p')} AS p FROM t2")
def _(spark, sf):
    return rounded(cal.binned_rate(two_axis(spark, sf), [("b1", 7), ("b2", 8)], "y", 60))


@query("apply_binned_rate", f"WITH {TWO_SQL} SELECT b.id, {sql_round('t2.p')} AS p_cal FROM b JOIN t2 USING (b1, b2)")
def _(spark, sf):
    s = two_axis(spark, sf)
    t = cal.binned_rate(s, [("b1", 7), ("b2", 8)], "y", 60)
    return rounded(cal.apply_binned(s, t, ["b1", "b2"], "p_cal").select("id", "p_cal"))


@query("binned_rate_3d", f"""WITH {SCORES_SQL}, x AS (SELECT *, ln(1 + greatest(value - 30e0, 0e0)) AS lo FROM scores), e1 AS (SELECT quantile_cont(lo, [{', '.join(repr(i / 4) for i in range(1, 4))}]) AS e FROM x WHERE lo > 0), e2 AS (SELECT quantile_cont(p, [{lit_list('', 4)}]) AS e FROM x),
 e3 AS (SELECT quantile_cont(w * value, [{lit_list('', 4)}]) AS e FROM x), b AS (SELECT {BIN.format(edges='e1.e', x='lo')} AS b1, {BIN.format(edges='e2.e', x='p')} AS b2, {BIN.format(edges='e3.e', x='w * value')} AS b3, y FROM x, e1, e2, e3),
 g AS (SELECT b1, b2, b3, count(*) AS n, avg(y) AS r FROM b GROUP BY 1, 2, 3), s AS (SELECT CAST(a.range AS INTEGER) AS b1, CAST(c.range AS INTEGER) AS b2, CAST(d.range AS INTEGER) AS b3 FROM range(4) a, range(4) c, range(4) d),
 f AS (SELECT b1, b2, b3, coalesce(n, 0) AS n, CASE WHEN n >= 150 THEN r END AS r FROM s LEFT JOIN g USING (b1, b2, b3)), w1 AS (SELECT *, coalesce(r, avg(r) OVER (PARTITION BY b1, b2)) AS rr FROM f),
 w2 AS (SELECT b1, b2, b3, n, coalesce(rr, avg(rr) OVER (PARTITION BY b1), (SELECT avg(y) FROM x)) AS q FROM w1) SELECT b1, b2, b3, n, {sql_round('max(q) OVER (PARTITION BY b1, b2 ORDER BY b3)')} AS p FROM w2""")
def _(spark, sf):
    s = score_rows(spark, sf).withColumns({"lo": F.log1p(F.greatest(F.col("value") - 30.0, F.lit(0.0))), "z": F.col("w") * F.col("value")})
    axes = {"b1": ("lo", 5, True), "b2": ("p", 4, False), "b3": ("z", 4, False)}
    e = cal.edge_sets(s, axes)
    s = s.withColumns({b: cal.bin_of(c, e[b]) for b, (c, _, _) in axes.items()})
    return rounded(cal.binned_rate(s, [("b1", 4), ("b2", 4), ("b3", 4)], "y", 150))


@query("tau_by_class", f"""WITH {SCORES_SQL} SELECT grp, {sql_round('greatest(CASE WHEN count(*) > 500 THEN quantile_cont(abs(value - 50), 0.85) ELSE 1e0 END, 1e-3) / atanh(0.7e0)')} AS tau FROM scores GROUP BY grp""")
def _(spark, sf):
    s = score_rows(spark, sf).withColumn("z", F.abs(F.col("value") - 50))
    n = s.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    t = ev.grouped_quantile(s, ["grp"], "z", 0.85).join(n, "grp")
    return rounded(t.select("grp", (F.greatest(F.when(F.col("n") > 500, F.col("q")).otherwise(1.0), F.lit(1e-3)) / F.atanh(F.lit(0.7))).alias("tau")))


@query("quantile_knots", f"""WITH {SCORES_SQL}, q AS (SELECT quantile_cont(value, [0.02, 0.25, 0.5, 0.75, 0.98]) AS a, quantile_cont(CAST(w AS DOUBLE), [0.02, 0.25, 0.5, 0.75, 0.98]) AS b FROM scores)
 SELECT CAST(i AS INTEGER) AS i, {sql_round('a[i + 1]')} AS value_knot FROM q, range(5) t(i)""")
def _(spark, sf):
    knots = cal.quantile_knots(score_rows(spark, sf), "value")
    return rounded(spark.createDataFrame(list(enumerate(knots)), "i int, value_knot double"))


@query("strictly_increasing_knots", f"""WITH {SCORES_SQL}, q AS (SELECT grp, quantile_cont(w, [0.02, 0.25, 0.5, 0.75, 0.98]) AS b FROM scores GROUP BY grp),
 k1 AS (SELECT grp, b, b[1] AS k1 FROM q), k2 AS (SELECT *, CASE WHEN b[2] <= k1 THEN k1 + 1e-4 ELSE b[2] END AS k2 FROM k1), k3 AS (SELECT *, CASE WHEN b[3] <= k2 THEN k2 + 1e-4 ELSE b[3] END AS k3 FROM k2),
 k4 AS (SELECT *, CASE WHEN b[4] <= k3 THEN k3 + 1e-4 ELSE b[4] END AS k4 FROM k3), k5 AS (SELECT *, CASE WHEN b[5] <= k4 THEN k4 + 1e-4 ELSE b[5] END AS k5 FROM k4)
 SELECT grp, {sql_round('k1')} AS k1, {sql_round('k2')} AS k2, {sql_round('k3')} AS k3, {sql_round('k4')} AS k4, {sql_round('k5')} AS k5 FROM k5""")
def _(spark, sf):
    from riskweave.functions.fuzzy import strictly_increasing

    shares = {f"q{i}": x for i, x in enumerate((0.02, 0.25, 0.5, 0.75, 0.98))}
    q = ev.grouped_quantiles(score_rows(spark, sf), ["grp"], "w", shares)
    q = q.withColumn("k", strictly_increasing(F.array(*shares)))
    return rounded(q.select("grp", *[F.col("k")[i].alias(f"k{i + 1}") for i in range(5)]))


@query("brier_ig_lift", f"""WITH {SCORES_SQL}, c AS (SELECT grp, y, least(greatest(p, 1e-5), 1 - 1e-5) AS p FROM scores), t AS (SELECT grp, quantile_cont(p, 0.9) AS t FROM c GROUP BY grp)
 SELECT grp, count(*) AS n, {sql_round('avg(pow(p - y, 2))')} AS brier, {sql_round('avg(y * ln(p / 0.1e0) + (1 - y) * ln((1 - p) / 0.9e0))')} AS info_gain, {sql_round('avg(CASE WHEN p >= t THEN y END) / avg(y)')} AS lift_top10 FROM c JOIN t USING (grp) GROUP BY grp""")
def _(spark, sf):
    return rounded(ev.forecast_metrics(score_rows(spark, sf), ["grp"], "p", "y", 0.1))


BANDS = [0, .02, .05, .1, .2, .35, .5, 1.01]
BAND_SQL = "(" + " + ".join(f"(p >= {b})::INTEGER" for b in BANDS) + " - 1)"


@query("reliability_table", f"""WITH {SCORES_SQL} SELECT CAST({BAND_SQL} AS INTEGER) AS band, count(*) AS n, {sql_round('avg(p)')} AS mean_p, {sql_round('avg(y)')} AS mean_y, {sql_round('abs(avg(p) - avg(y))')} AS gap FROM scores GROUP BY 1 HAVING count(*) > 200""")
def _(spark, sf):
    return rounded(ev.reliability(score_rows(spark, sf), [], "p", "y", BANDS, 200))


@query("weighted_auc", f"""WITH {SCORES_SQL}, s AS (SELECT grp, p, sum(y * w) AS pos, sum((1 - y) * w) AS neg FROM scores GROUP BY 1, 2),
 c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY grp ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb, coalesce(sum(pos) OVER (PARTITION BY grp ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb,
   sum(pos) OVER (PARTITION BY grp) AS tp, sum(neg) OVER (PARTITION BY grp) AS tn FROM s)
 SELECT grp, {sql_round('sum(pos * (nb + 0.5e0 * neg)) / any_value(tp * tn)')} AS auc, {sql_round('sum(CASE WHEN pos > 0 THEN pos * (tp - pb) / ((tp - pb) + (tn - nb)) END) / any_value(tp)')} AS avg_precision FROM c GROUP BY grp""")
def _(spark, sf):
    return rounded(ev.rank_scores(score_rows(spark, sf), ["grp"], "p", "y", "w"))


@query("mae_vs_baseline", f"""WITH {SCORES_SQL}, tr AS (SELECT grp, quantile_cont(value, 0.5) AS m FROM scores WHERE day < DATE '2024-01-20' GROUP BY grp), g AS (SELECT quantile_cont(value, 0.5) AS m, avg(value) AS a FROM scores WHERE day < DATE '2024-01-20'),
 h AS (SELECT value, p * 100 AS pred, coalesce(tr.m, g.m) AS base, g.a AS const FROM scores LEFT JOIN tr USING (grp), g WHERE day >= DATE '2024-01-20')
 SELECT {sql_round('avg(abs(pred - value))')} AS mae_model, {sql_round('avg(abs(base - value))')} AS mae_conditioned, {sql_round('avg(abs(const - value))')} AS mae_constant, avg(abs(pred - value)) < avg(abs(base - value)) AS skill FROM h""")
def _(spark, sf):
    s = score_rows(spark, sf)
    cut = F.lit("2024-01-20").cast("date")
    train = s.filter(F.col("day") < cut)
    overall = quantiles(train, "value", [0.5])[0]
    med = ev.grouped_quantile(train, ["grp"], "value", 0.5, "m")
    const = train.agg(F.avg("value").alias("a"))
    h = s.filter(F.col("day") >= cut).join(med, "grp", "left").crossJoin(F.broadcast(const))
    def mae(c):
        return F.avg(F.abs(c - F.col("value")))
    out = h.agg(mae(F.col("p") * 100).alias("mae_model"), mae(F.coalesce("m", F.lit(overall))).alias("mae_conditioned"), mae(F.col("a")).alias("mae_constant"))
    return rounded(out.withColumn("skill", F.col("mae_model") < F.col("mae_conditioned")))


LAM_SQL = DAILY_SQL + f""", lam AS (SELECT segment, day, 0.02e0 + 0.05e0 * sum(n) OVER (PARTITION BY segment ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) / 30e0 AS lam_a, 0.02e0 + 0.0002e0 * (row_number() OVER (PARTITION BY segment ORDER BY day) % 7) AS lam_b FROM daily),
 bigd AS (SELECT segment, day, count(*) AS n_ev FROM catalog WHERE {BIG} GROUP BY 1, 2), lr AS (SELECT segment, day, n_ev, ln(lam_a / lam_b) AS d FROM lam JOIN bigd USING (segment, day) WHERE lam_a > 0 AND lam_b > 0 AND lam_a IS NOT NULL)"""


def lambdas(spark, sf):
    d = ts.rolling(daily(spark, sf), ["segment"], "day", [ts.Roll("r", "n", 30)])
    i = F.row_number().over(Window.partitionBy("segment").orderBy("day"))
    return d.select("segment", "day", (0.02 + 0.05 * F.col("r") / 30.0).alias("lam_a"), (0.02 + 0.0002 * (i % 7)).alias("lam_b"))


def log_ratios(spark, sf):
    """One log ratio per target event on the day of the series it falls on."""
    e = catalog(spark, sf).filter(BIG).select("id", "segment", F.col("day").alias("event_day"))
    near = asof.nearest(e, lambdas(spark, sf), ["segment"], "event_day", "day", ["lam_a", "lam_b"], bucket="YEAR")
    a, b = F.col("match.lam_a"), F.col("match.lam_b")
    return near.filter((a > 0) & (b > 0)).select("id", "segment", "event_day", a.alias("lam_a"), b.alias("lam_b"), F.log(a / b).alias("d"))


@query("log_ratio_events", f"WITH {LAM_SQL} SELECT id, segment, {sql_round('d')} AS d FROM lr JOIN catalog c USING (segment, day) WHERE {BIG}")
def _(spark, sf):
    return rounded(log_ratios(spark, sf).select("id", "segment", "d"))


@query("point_process_loglik", f"""WITH {LAM_SQL}, a AS (SELECT segment, sum(ln(greatest(lam_a, 1e-9)) * n_ev) AS s FROM lam JOIN bigd USING (segment, day) WHERE lam_a IS NOT NULL GROUP BY 1), t AS (SELECT segment, sum(greatest(lam_a, 1e-9)) AS tot FROM lam WHERE lam_a IS NOT NULL GROUP BY 1)
 SELECT segment, {sql_round('s - tot', 5)} AS loglik FROM a JOIN t USING (segment)""")
def _(spark, sf):
    at = log_ratios(spark, sf).groupBy("segment").agg(F.sum(ev.log_rate("lam_a")).alias("s"))
    tot = lambdas(spark, sf).groupBy("segment").agg(F.sum(F.greatest("lam_a", F.lit(1e-9))).alias("t"))
    return rounded(at.join(tot, "segment").select("segment", ev.point_process_loglik(F.col("s"), F.col("t")).alias("loglik")), 5)


PAIRED_SQL = LAM_SQL + """, e AS (SELECT segment, sum(lam_a) AS ea, sum(lam_b) AS eb FROM lam GROUP BY 1), r AS (SELECT segment, day, d FROM lr, range(n_ev)), st AS (SELECT segment, count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd FROM r GROUP BY 1),
 cc AS (SELECT st.*, (ea - eb) / n AS c, ea, eb FROM st JOIN e USING (segment)), ct AS (SELECT segment, d - c AS x FROM r JOIN cc USING (segment)), rk AS (SELECT *, rank() OVER (PARTITION BY segment ORDER BY abs(x)) + (count(*) OVER (PARTITION BY segment, abs(x)) - 1) / 2e0 AS q FROM ct WHERE x <> 0),
 ww AS (SELECT segment, coalesce(sum(q) FILTER (WHERE x > 0), 0) AS wp, coalesce(sum(q) FILTER (WHERE x < 0), 0) AS wm FROM rk GROUP BY 1)"""


def paired(spark, sf):
    exp = lambdas(spark, sf).groupBy("segment").agg(F.sum("lam_a").alias("exp_a"), F.sum("lam_b").alias("exp_b"))
    return ev.paired_event_test(log_ratios(spark, sf).select("segment", "d"), exp, ["segment"])


@query("paired_event_test", f"""WITH {PAIRED_SQL} SELECT segment, n AS n_events, {sql_round('m')} AS mean_log_ratio, {sql_round('c')} AS count_correction, {sql_round('m - c')} AS info_gain, {sql_round('(m - c) / (sd / sqrt(n))', 5)} AS t_stat,
 {sql_round('least(wp, wm)', 2)} AS w_stat, n < 20 AS low_power FROM cc JOIN ww USING (segment)""")
def _(spark, sf):
    p = paired(spark, sf)
    return rounded(p.select("segment", "n_events", "mean_log_ratio", "count_correction", "info_gain", F.round("t_stat", 5).alias("t_stat"), F.round("w_stat", 2).alias("w_stat"), "low_power"))


def sql_t_p(t, df):
    """Two-sided p-value of Student's t for whole degrees of freedom: the finite series in the angle."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    even = f"list_sum(list_transform(range(0, CAST({df} AS BIGINT) // 2), lambda j: exp(lgamma(j + 0.5e0) - lgamma(0.5e0) - lgamma(j + 1e0)) * pow(cos({angle}), 2 * j)))"
    odd = f"coalesce(list_sum(list_transform(range(0, (CAST({df} AS BIGINT) - 1) // 2), lambda j: exp(lgamma(j + 1e0) - lgamma(j + 1.5e0)) * sqrt(pi()) / 2 * pow(cos({angle}), 2 * j))), 0e0)"
    return f"1 - CASE WHEN {df} % 2 = 0 THEN sin({angle}) * {even} ELSE 2 / pi() * ({angle} + sin({angle}) * cos({angle}) * {odd}) END"


def sql_n_p(n, mean):
    """Two-sided Poisson p-value with inclusive tails."""
    def tail(k):
        return f"coalesce(list_sum(list_transform(range(0, CAST({k} AS BIGINT)), lambda i: exp(-{mean} + i * ln({mean}) - lgamma(i + 1e0)))), 0e0)"
    return f"least(1e0, 2 * least(least({tail(f'{n} + 1')}, 1e0), 1 - least({tail(n)}, 1e0)))"


@query("paired_event_p_values", f"""WITH {PAIRED_SQL}, q AS (SELECT segment, n, (m - c) / (sd / sqrt(n)) AS t, ea, eb FROM cc) SELECT segment, {sql_round(sql_t_p('t', '(n - 1)'))} AS t_p, {sql_round(sql_n_p('n', 'ea'))} AS n_p_a, {sql_round(sql_n_p('n', 'eb'))} AS n_p_b FROM q""")
def _(spark, sf):
    return rounded(paired(spark, sf).select("segment", "t_p", "n_p_a", "n_p_b"))


@query("paired_event_rank_p")
def _(spark, sf):
    """P-value of the signed ranks: exact up to 50 untied differences, else normal."""
    return rounded(paired(spark, sf).select("segment", "w_stat", "w_p"))


N_SQL = """ne AS (SELECT user_id, count(*) AS k, sum(value) / 50e0 AS m FROM events GROUP BY user_id), lw AS (SELECT user_id, any_value(k) AS k, any_value(m) AS m, sum(exp(-m + i * ln(m) - lgamma(i + 1))) AS lower, sum(CASE WHEN i < k THEN exp(-m + i * ln(m) - lgamma(i + 1)) END) AS below
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM ne) GROUP BY user_id)"""


@query("poisson_n_test", f"""WITH {N_SQL} SELECT user_id, k AS observed, {sql_round('m')} AS expected, {sql_round('least(1e0, 2 * least(least(lower, 1e0), 1 - least(coalesce(below, 0e0), 1e0)))')} AS p_two_sided FROM lw""")
def _(spark, sf):
    from riskweave.functions.probability import poisson_two_sided
    from riskweave.session import table

    g = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("observed"), (F.sum("value") / 50.0).alias("expected"))
    return rounded(g.withColumn("p_two_sided", poisson_two_sided("observed", "expected")))


@query("fisher_combine", f"""WITH {SCORES_SQL}, d AS (SELECT grp, day, avg(p) * 0.5e0 AS p, avg(value) > 50 AS f FROM scores GROUP BY 1, 2), g AS (SELECT grp, -2 * sum(ln(greatest(p, 1e-10))) AS chi2, count(*) AS k, count(*) FILTER (WHERE f) AS nf, count(*) FILTER (WHERE f AND p < 0.11) AS nfs, count(*) FILTER (WHERE NOT f AND p < 0.11) AS nas FROM d GROUP BY grp)
 SELECT grp, {sql_round('any_value(chi2)')} AS chi2, any_value(k) AS k, any_value(nf) AS n_favour, any_value(nfs) AS n_favour_sig, any_value(nas) AS n_against_sig, {sql_round('sum(exp(-chi2 / 2 + i * ln(chi2 / 2) - lgamma(i + 1)))')} AS p_combined FROM g, range(0, 400) t(i) WHERE i < k GROUP BY grp""")
def _(spark, sf):
    d = score_rows(spark, sf).groupBy("grp", "day").agg((F.avg("p") * 0.5).alias("p"), (F.avg("value") > 50).alias("f"))
    return rounded(ev.fisher_combine(d, ["grp"], "p", "f", 0.11))


THR_SQL = SCORES_SQL + ", thr AS (SELECT coalesce(quantile_cont(p, 0.95), 0.8e0) AS t FROM scores WHERE y = 0 AND day < DATE '2024-01-20')"


def control_threshold(spark, sf):
    controls = score_rows(spark, sf).filter((F.col("y") == 0) & (F.col("day") < F.lit("2024-01-20").cast("date")))
    t = quantiles(controls, "p", [0.95])[0]
    return 0.8 if t != t else t


@query("control_quantile_threshold", f"WITH {THR_SQL} SELECT {sql_round('t')} AS threshold, (SELECT count(*) FROM scores WHERE p >= t) AS n_above FROM thr")
def _(spark, sf):
    t = control_threshold(spark, sf)
    return rounded(score_rows(spark, sf).agg(F.lit(t).alias("threshold"), F.count(F.when(F.col("p") >= t, 1)).alias("n_above")))


@query("episode_max_score", f"""WITH {THR_SQL}, e AS (SELECT grp, episode, y, max(p) AS p FROM scores WHERE day >= DATE '2024-01-20' GROUP BY 1, 2, 3) SELECT grp, {sql_round('avg(CASE WHEN y = 1 THEN (p >= t)::INTEGER END)')} AS sensitivity, {sql_round('avg(CASE WHEN y = 0 THEN (p >= t)::INTEGER END)')} AS false_fraction FROM e, thr GROUP BY grp""")
def _(spark, sf):
    t = control_threshold(spark, sf)
    e = score_rows(spark, sf).filter(F.col("day") >= F.lit("2024-01-20").cast("date")).groupBy("grp", "episode", "y").agg(F.max("p").alias("p"))
    hit = (F.col("p") >= t).cast("int")
    return rounded(e.groupBy("grp").agg(F.avg(F.when(F.col("y") == 1, hit)).alias("sensitivity"), F.avg(F.when(F.col("y") == 0, hit)).alias("false_fraction")))


@query("episode_starts", f"""WITH {SCORES_SQL}, d AS (SELECT grp, day, max(y) AS y FROM scores GROUP BY 1, 2), l AS (SELECT *, lag(y) OVER (PARTITION BY grp ORDER BY day) AS py FROM (SELECT grp, day, CASE WHEN day_of = 0 THEN 0 ELSE y END AS y FROM (SELECT *, dayofmonth(day) % 3 AS day_of FROM d)))
 SELECT grp, count(*) FILTER (WHERE y = 1 AND py = 0) AS starts FROM l GROUP BY grp""")
def _(spark, sf):
    d = score_rows(spark, sf).groupBy("grp", "day").agg(F.max("y").alias("y"))
    d = d.withColumn("y", F.when(F.dayofmonth("day") % 3 == 0, 0).otherwise(F.col("y")))
    d = d.withColumn("py", F.lag("y").over(Window.partitionBy("grp").orderBy("day")))
    return d.groupBy("grp").agg(F.count(F.when((F.col("y") == 1) & (F.col("py") == 0), 1)).alias("starts"))


@query("promotion_gate", f"""WITH {SCORES_SQL}, m AS (SELECT grp, count(DISTINCT episode) AS events, avg(y) AS rate, 1 - avg(abs(p - y)) AS fit FROM scores GROUP BY grp)
 SELECT grp, events >= 20 AS enough_events, rate <= 0.16e0 AS rate_ok, fit >= 0.56e0 AS fit_ok, events >= 20 AND rate <= 0.16e0 AND fit >= 0.56e0 AS promoted, CASE WHEN events >= 20 AND rate <= 0.16e0 AND fit >= 0.56e0 THEN 'candidate' ELSE 'shadow_research' END AS status FROM m""")
def _(spark, sf):
    m = score_rows(spark, sf).groupBy("grp").agg(
        F.countDistinct("episode").alias("events"), F.avg("y").alias("rate"), (1 - F.avg(F.abs(F.col("p") - F.col("y")))).alias("fit"))
    out = ev.promotion_gate(m, {"enough_events": ("events", ">=", 20), "rate_ok": ("rate", "<=", 0.16), "fit_ok": ("fit", ">=", 0.56)})
    return out.drop("events", "rate", "fit")


@query("spearman_rank_correlation", f"""WITH {SCORES_SQL}, r AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY p) + (count(*) OVER (PARTITION BY grp, p) - 1) / 2e0 AS a, rank() OVER (PARTITION BY grp ORDER BY value) + (count(*) OVER (PARTITION BY grp, value) - 1) / 2e0 AS b FROM scores)
 SELECT grp, {sql_round('corr(a, b)')} AS rho, count(*) AS n FROM r GROUP BY grp""")
def _(spark, sf):
    return rounded(ev.spearman(score_rows(spark, sf).select("grp", "p", "value"), ["grp"], "p", "value"))


@query("binary_mutual_information", f"""WITH {SCORES_SQL}, e AS (SELECT quantile_cont(value, [{lit_list('', 8)}]) AS ve, quantile_cont(p, [{lit_list('', 8)}]) AS pe FROM scores), b AS (SELECT 'value' AS feature, {BIN.format(edges='ve', x='value')} AS b, y FROM scores, e UNION ALL SELECT 'p', {BIN.format(edges='pe', x='p')}, y FROM scores, e),
 c AS (SELECT feature, b, y, count(*) / CAST((SELECT count(*) FROM scores) AS DOUBLE) AS q FROM b GROUP BY 1, 2, 3), m AS (SELECT *, sum(q) OVER (PARTITION BY feature, b) AS qb, sum(q) OVER (PARTITION BY feature, y) AS qy FROM c)
 SELECT feature, {sql_round('sum(q * ln(q / (qb * qy)))')} AS mi FROM m GROUP BY feature""")
def _(spark, sf):
    from riskweave.operators.learning import mutual_information

    return rounded(mutual_information(score_rows(spark, sf), ["value", "p"], "y", 8))
