"""Backtest plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.fuzzy import ANOMALY_SETS
from riskweave.operators import backtest as bt, cells as ce, intensity as it, walkforward as wf
from riskweave.operators.evaluation import fisher_combine
from riskweave.plans.evaluation import BIN, sql_n_p, sql_t_p
from riskweave.plans.global_cells import CHAN_SQL, PIT_SQL, cell_months
from riskweave.plans.segment_state import CANDS, CAND_COLS, MASS, SERIES_SQL, rates_sql, series
from riskweave.plans.standins import catalog, literal_table, rounded, sql_degree0, sql_round
from riskweave.registry import query
from riskweave.session import cut_lineage

ORIGINS = ["1998-01-01", "1999-06-01", "2000-06-01"]
FOLD_SQL = PIT_SQL + f""", fo AS (SELECT unnest(['{"', '".join(ORIGINS)}']) AS fold), mid AS (SELECT fold, quantile_cont(CAST(s - DATE '1970-01-01' AS BIGINT), 0.55) AS mid FROM cm, fo WHERE s < CAST(fold AS DATE) GROUP BY fold),
 fr AS (SELECT cm.*, fold, CASE WHEN CAST(s - DATE '1970-01-01' AS BIGINT) < mid THEN 'fit' WHEN s < CAST(fold AS DATE) THEN 'val' WHEN CAST(s - CAST(fold AS DATE) AS BIGINT) < 365.25 THEN 'test' END AS role FROM cm, fo JOIN mid USING (fold))"""


@query("walk_forward_folds", f"WITH {FOLD_SQL} SELECT fold, role, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, min(s) AS first_day, max(s) AS last_day FROM fr WHERE role IS NOT NULL GROUP BY fold, role")
def _(spark, sf):
    f = bt.walk_forward(cell_months(spark, sf), "date", ORIGINS, years_test=1.0)
    return f.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


def q_list(n):
    return ", ".join(repr(i / n) for i in range(1, n))


def q_pos(n):
    return ", ".join(repr(i / (n - 1)) for i in range(1, n - 1))


def one_axis(name, src, n, need, edges):
    return f"""{name}b AS (SELECT {BIN.format(edges=edges, x=src)} AS b, y FROM tr, ed), {name}g AS (SELECT b, count(*) AS n, avg(y) AS r FROM {name}b GROUP BY b), {name}f AS (SELECT CAST(range AS INTEGER) AS b, CASE WHEN n >= {need} THEN r END AS r FROM range({n}) LEFT JOIN {name}g ON range = b),
 {name}t AS (SELECT b, max(coalesce(r, (SELECT avg(r) FROM {name}f), (SELECT avg(y) FROM tr))) OVER (ORDER BY b) AS p FROM {name}f)"""


def ladder_ctes(rows, cut):
    """Tables of the ladder fitted before *cut* on *rows* (date, y, rate_bg, omori, lo, lr, sc), up to the scored long form ln_ and th."""
    return f"""xx AS ({rows}), tr AS (SELECT * FROM xx WHERE date < DATE '{cut}'), te AS (SELECT row_number() OVER () AS rid, * FROM xx WHERE date >= DATE '{cut}'),
 ed AS (SELECT quantile_cont(rate_bg, [{q_list(10)}]) AS r1, quantile_cont(omori, [{q_list(10)}]) AS o1, quantile_cont(lo, [{q_pos(8)}]) FILTER (WHERE lo > 0) AS o2, quantile_cont(rate_bg, [{q_list(8)}]) AS r2, quantile_cont(lo, [{q_pos(7)}]) FILTER (WHERE lo > 0) AS o3, quantile_cont(lr, [{q_list(5)}]) AS r3, quantile_cont(sc, [{q_list(4)}]) AS s3 FROM tr),
 {one_axis('ra', 'rate_bg', 10, 300, 'r1')}, {one_axis('ac', 'omori', 10, 300, 'o1')},
 b2 AS (SELECT {BIN.format(edges='o2', x='lo')} AS i, {BIN.format(edges='r2', x='rate_bg')} AS j, y FROM tr, ed), g2 AS (SELECT i, j, count(*) AS n, avg(y) AS r FROM b2 GROUP BY 1, 2), f2 AS (SELECT CAST(a.range AS INTEGER) AS i, CAST(b.range AS INTEGER) AS j, CASE WHEN n >= 300 THEN r END AS r FROM range(7) a, range(8) b LEFT JOIN g2 ON i = a.range AND j = b.range),
 w2 AS (SELECT i, j, coalesce(r, avg(r) OVER (PARTITION BY i), (SELECT avg(y) FROM tr)) AS r FROM f2), t2 AS (SELECT i, j, max(r) OVER (PARTITION BY i ORDER BY j) AS p FROM w2),
 b3 AS (SELECT {BIN.format(edges='o3', x='lo')} AS i, {BIN.format(edges='r3', x='lr')} AS j, {BIN.format(edges='s3', x='sc')} AS k, y FROM tr, ed), g3 AS (SELECT i, j, k, count(*) AS n, avg(y) AS r FROM b3 GROUP BY 1, 2, 3),
 f3 AS (SELECT CAST(a.range AS INTEGER) AS i, CAST(b.range AS INTEGER) AS j, CAST(c.range AS INTEGER) AS k, CASE WHEN n >= 250 THEN r END AS r FROM range(6) a, range(5) b, range(4) c LEFT JOIN g3 ON i = a.range AND j = b.range AND k = c.range), u3 AS (SELECT i, j, k, coalesce(r, avg(r) OVER (PARTITION BY i, j)) AS r FROM f3),
 w3 AS (SELECT i, j, k, coalesce(r, avg(r) OVER (PARTITION BY i), (SELECT avg(y) FROM tr)) AS r FROM u3), t3 AS (SELECT i, j, k, max(r) OVER (PARTITION BY i, j ORDER BY k) AS p FROM w3),
 sc AS (SELECT te.y, (SELECT avg(y) FROM tr) AS constant, rat.p AS rate, act.p AS activity, t2.p AS activity_rate, t3.p AS full_ FROM te, ed, rat, act, t2, t3 WHERE rat.b = {BIN.format(edges='r1', x='te.rate_bg')} AND act.b = {BIN.format(edges='o1', x='te.omori')} AND t2.i = {BIN.format(edges='o2', x='te.lo')} AND t2.j = {BIN.format(edges='r2', x='te.rate_bg')}
   AND t3.i = {BIN.format(edges='o3', x='te.lo')} AND t3.j = {BIN.format(edges='r3', x='te.lr')} AND t3.k = {BIN.format(edges='s3', x='te.sc')}),
 ln_ AS (SELECT y, replace(model, 'full_', 'full') AS model, least(greatest(p, 1e-5), 1 - 1e-5) AS p FROM sc UNPIVOT (p FOR model IN (constant, rate, activity, activity_rate, full_))), th AS (SELECT model, quantile_cont(p, 0.9) AS t FROM ln_ GROUP BY model)"""


def metrics_sql():
    return f"""SELECT model, count(*) AS n, {sql_round('avg(pow(p - y, 2))')} AS brier, {sql_round('avg(y * ln(p / (SELECT avg(y) FROM tr)) + (1 - y) * ln((1 - p) / (1 - (SELECT avg(y) FROM tr))))')} AS info_gain, {sql_round('avg(CASE WHEN p >= t THEN y END) / avg(y)')} AS lift_top10 FROM ln_ JOIN th USING (model) GROUP BY model"""


LADDER_SQL = PIT_SQL + ", " + ladder_ctes("SELECT s AS date, y, rate_bg, omori, ln(1 + omori) AS lo, ln(1 + rate_bg) AS lr, tanh(n30 / 10e0) + n7 / 100e0 + t_last / 1000e0 AS sc FROM cm", "2000-06-01")


@query("benchmark_ladder", f"WITH {LADDER_SQL} {metrics_sql()}")
def _(spark, sf):
    c = cut_lineage(cell_months(spark, sf)).withColumn("sc", F.tanh(F.col("n30") / 10.0) + F.col("n7") / 100.0 + F.col("t_last") / 1000.0)
    cut = F.lit("2000-06-01").cast("date")
    return rounded(bt.ladder(c.filter(F.col("date") < cut), c.filter(F.col("date") >= cut), "y", "rate_bg", "omori", "sc"))


#: Channels whose rules are mined in every fold.
WALK = ["a_seis", "a_fore", "C_state"]
WALK_ORIGINS = ["1999-06-01", "2000-06-01"]
TERM_ORDER = "CASE channel " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(WALK)) + " END"


def _two_sql(src, names):
    cols = ", ".join(names)
    return f"""SELECT *, (lf - 1) * (lv - 1) > 0 AND ret >= 0.5 AS ok FROM (SELECT *, CASE WHEN abs(lf - 1) > 1e-6 THEN (lv - 1) / (lf - 1) ELSE 0 END AS ret FROM (
  SELECT fold, {cols}, max(support) FILTER (WHERE role = 'fit') AS sf, max(lift) FILTER (WHERE role = 'fit') AS lf, max(support) FILTER (WHERE role = 'val') AS sv, max(lift) FILTER (WHERE role = 'val') AS lv FROM {src} GROUP BY fold, {cols}) WHERE sf >= 100 AND sv >= 80)"""


WALK_SQL = PIT_SQL + f""", cc AS (SELECT row_number() OVER () AS rid, *, {CHAN_SQL.split(', greatest(')[0]} FROM cm), fo AS (SELECT unnest(['{"', '".join(WALK_ORIGINS)}']) AS fold), mid AS (SELECT fold, quantile_cont(CAST(s - DATE '1970-01-01' AS BIGINT), 0.55) AS mid FROM cc, fo WHERE s < CAST(fold AS DATE) GROUP BY fold),
 ro AS (SELECT rid, y, fold, CASE WHEN CAST(s - DATE '1970-01-01' AS BIGINT) < mid THEN 'fit' WHEN s < CAST(fold AS DATE) THEN 'val' WHEN CAST(s - CAST(fold AS DATE) AS BIGINT) < 365.25 THEN 'test' END AS role FROM cc, fo JOIN mid USING (fold)),
 mu AS ({' UNION ALL '.join(f"SELECT rid, '{c}' AS channel, '{t}' AS term, {sql_degree0(c, p)} AS mu FROM cc" for c in WALK for t, p in ANOMALY_SETS.items())}),
 pm AS (SELECT a.rid, a.channel AS channel_a, a.term AS term_a, b.channel AS channel_b, b.term AS term_b, least(a.mu, b.mu) AS mu FROM mu a JOIN mu b ON a.rid = b.rid AND a.mu > 0 AND b.mu > 0 AND {TERM_ORDER.replace('channel', 'a.channel', 1)} < {TERM_ORDER.replace('channel', 'b.channel', 1)}),
 ba AS (SELECT fold, role, avg(y) AS base FROM ro WHERE role IN ('fit', 'val') GROUP BY 1, 2),
 sl AS (SELECT fold, role, channel, term, sum(mu) AS support, sum(mu * y) / sum(mu) / (any_value(base) + 1e-12) AS lift FROM ro JOIN mu USING (rid) JOIN ba USING (fold, role) WHERE mu > 0 GROUP BY 1, 2, 3, 4),
 pl AS (SELECT fold, role, channel_a, term_a, channel_b, term_b, sum(mu) AS support, sum(mu * y) / sum(mu) / (any_value(base) + 1e-12) AS lift FROM ro JOIN pm USING (rid) JOIN ba USING (fold, role) GROUP BY 1, 2, 3, 4, 5, 6),
 s2 AS ({_two_sql('sl', ['channel', 'term'])}), p2 AS ({_two_sql('pl', ['channel_a', 'term_a', 'channel_b', 'term_b'])}),
 pg AS (SELECT p2.*, p2.lf / (CASE WHEN p2.lf > 1 THEN greatest(coalesce(a.lf, 1), coalesce(b.lf, 1)) ELSE least(coalesce(a.lf, 1), coalesce(b.lf, 1)) END + 1e-12) AS gain FROM p2 LEFT JOIN s2 a ON a.fold = p2.fold AND a.channel = p2.channel_a AND a.term = p2.term_a LEFT JOIN s2 b ON b.fold = p2.fold AND b.channel = p2.channel_b AND b.term = p2.term_b),
 ru AS (SELECT fold, CAST(1 AS INTEGER) AS arity, channel AS channel_a, term AS term_a, NULL::VARCHAR AS channel_b, NULL::VARCHAR AS term_b, sf, lf, lv FROM s2 WHERE ok
   UNION ALL SELECT fold, 2, channel_a, term_a, channel_b, term_b, sf, lf, lv FROM pg WHERE ok AND CASE WHEN lf > 1 THEN gain >= 1.15 ELSE gain <= 1 / 1.15 END),
 inf AS (SELECT fold, channel, least(1e0, greatest(0.2e0, avg(least(1e0, greatest(0e0, ret))))) AS m FROM s2 GROUP BY 1, 2),
 pw AS (SELECT ru.*, abs(lf - 1) / max(abs(lf - 1)) OVER (PARTITION BY ru.fold) * least(coalesce(a.m, 0.3e0), CASE WHEN arity = 2 THEN coalesce(b.m, 0.3e0) ELSE 9e0 END) AS power FROM ru LEFT JOIN inf a ON a.fold = ru.fold AND a.channel = ru.channel_a LEFT JOIN inf b ON b.fold = ru.fold AND b.channel = ru.channel_b),
 fi AS (SELECT rid, fold, coalesce(max(mu * power) FILTER (WHERE lf > 1), 0e0) - coalesce(max(mu * power) FILTER (WHERE lf < 1), 0e0) AS score FROM (
   SELECT rid, fold, mu, power, lf FROM mu JOIN pw ON arity = 1 AND channel = channel_a AND term = term_a UNION ALL SELECT rid, fold, mu, power, lf FROM pm JOIN pw ON arity = 2 AND pm.channel_a = pw.channel_a AND pm.term_a = pw.term_a AND pm.channel_b = pw.channel_b AND pm.term_b = pw.term_b) GROUP BY 1, 2),
 fs AS (SELECT ro.fold, cc.s AS date, cc.y, rate_bg, omori, ln(1 + omori) AS lo, ln(1 + rate_bg) AS lr, coalesce(score, 0e0) AS sc FROM ro JOIN cc USING (rid) LEFT JOIN fi USING (rid, fold) WHERE role IS NOT NULL)"""
FOLD_METRICS_SQL = " UNION ALL ".join(f"SELECT '{o}' AS fold, * FROM (WITH {ladder_ctes(f'SELECT * EXCLUDE (fold) FROM fs WHERE fold = ' + chr(39) + o + chr(39), o)} {metrics_sql()})" for o in WALK_ORIGINS)


def walk(spark, sf):
    c = ce.derive_channels(cell_months(spark, sf))
    return wf.run(c, "date", "y", "rate_bg", "omori", WALK, WALK_ORIGINS, 1.0, 100, 80, 1, {w: ANOMALY_SETS for w in WALK})


@query("walk_forward_rules", f"""WITH {WALK_SQL} SELECT fold, arity, channel_a, term_a, channel_b, term_b, {sql_round('sf', 4)} AS support, {sql_round('lf', 5)} AS lift_fit, {sql_round('lv', 5)} AS lift_val FROM ru""")
def _(spark, sf):
    r = walk(spark, sf)[0].select("fold", "arity", "channel_a", "term_a", "channel_b", "term_b", "support", "lift_fit", "lift_val")
    return r.withColumns({"support": F.round("support", 4), "lift_fit": F.round("lift_fit", 5), "lift_val": F.round("lift_val", 5)})


@query("walk_forward_metrics", f"""WITH {WALK_SQL} {FOLD_METRICS_SQL}""")
def _(spark, sf):
    return rounded(walk(spark, sf)[1].select("fold", "model", "n", "brier", "info_gain", "lift_top10"))


@query("materiality_selection", f"""WITH {WALK_SQL}, mt AS ({FOLD_METRICS_SQL.replace(sql_round('avg(pow(p - y, 2))'), 'avg(pow(p - y, 2))')}), d AS (SELECT fold, max(brier) FILTER (WHERE model = 'activity_rate') - max(brier) FILTER (WHERE model = 'full') AS delta FROM mt GROUP BY fold)
 SELECT {sql_round('avg(delta)')} AS mean_delta, {sql_round('max_by(delta, fold)')} AS last_delta, avg(delta) >= 1e-4 AND max_by(delta, fold) >= 1e-4 AS selected FROM d""")
def _(spark, sf):
    """Whether the mined score earns its place: the full model against activity and rate, over the folds."""
    return rounded(wf.fold_materiality(walk(spark, sf)[1]))


ROLL_SQL = SERIES_SQL + f""", {rates_sql(5.69)}, gn AS (SELECT segment, day, coalesce(G, 1e0) AS G FROM serx), fo AS (SELECT segment, CAST(min(day) + INTERVAL 60 MONTH AS DATE) AS origin FROM gn GROUP BY 1),
 be AS (SELECT segment, day, origin, row_number() OVER (PARTITION BY segment ORDER BY time, k) - 1 AS i FROM catalog JOIN fo USING (segment) WHERE mag >= 5.69e0 AND day >= origin),
 ee AS (SELECT segment, i // 5 AS epoch, any_value(origin) AS origin, CAST(max(day) + 1 AS DATE) AS e FROM be GROUP BY 1, 2), ew AS (SELECT segment, epoch, coalesce(lag(e) OVER (PARTITION BY segment ORDER BY epoch), origin) AS s, e FROM ee),
 ep AS (SELECT segment, epoch, s, e, (epoch_us(CAST(s AS TIMESTAMP)) - t0) / 86400e6 AS st FROM ew JOIN t0 USING (segment) WHERE s < e),
 tr AS (SELECT ep.segment, epoch, cand, any_value(st) AS st, sum(n * ln(lam)) AS lls, max(t) + 1 AS tend FROM ep JOIN la ON la.segment = ep.segment AND la.t < st GROUP BY ALL HAVING sum(n) >= 2),
 sc AS (SELECT tr.segment, epoch, tr.cand, any_value(lls) - any_value(mu) * any_value(tend) - any_value(K) * sum({MASS}) AS ll FROM tr JOIN w ON w.segment = tr.segment AND w.cand = tr.cand AND w.t < st GROUP BY ALL),
 ch AS (SELECT segment, epoch, arg_max(cand, (ll, -cand)) AS cand FROM sc GROUP BY 1, 2),
 dd AS (SELECT gn.segment, day, ep.epoch, ch.cand, G, (epoch_us(CAST(day AS TIMESTAMP)) - t0) / 86400e6 AS dt FROM gn JOIN ep ON gn.segment = ep.segment AND day >= s AND day < e JOIN ch ON ch.segment = ep.segment AND ch.epoch = ep.epoch JOIN t0 ON t0.segment = gn.segment),
 ds AS (SELECT dd.segment, dd.epoch, dd.day, dd.cand, dd.G, cd.mu + cd.K * coalesce(sum(w.w / pow(dt - t + cd.c, cd.p)), 0) AS base FROM dd JOIN cd USING (cand) LEFT JOIN w ON w.segment = dd.segment AND w.cand = dd.cand AND w.t < dt GROUP BY dd.segment, dd.epoch, dd.day, dd.cand, dd.G, cd.mu, cd.K),
 nd AS (SELECT segment, day, count(*) AS n FROM catalog WHERE mag >= 5.69e0 GROUP BY 1, 2), sr AS (SELECT ds.*, base * G AS refined, coalesce(n, 0) AS n FROM ds LEFT JOIN nd USING (segment, day)),
 ev AS (SELECT segment, epoch, any_value(cand) AS cand, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_days, sum(refined) AS ea, sum(base) AS eb FROM sr GROUP BY 1, 2),
 ok AS (SELECT *, (ea - eb) / n_events AS c FROM ev WHERE n_events >= 3 AND n_days >= 60), x AS (SELECT segment, epoch, ln(refined / base) AS d, ln(refined / base) - c AS z FROM sr JOIN ok USING (segment, epoch), range(sr.n)),
 rk AS (SELECT *, rank() OVER (PARTITION BY segment, epoch ORDER BY abs(z)) + (count(*) OVER (PARTITION BY segment, epoch, abs(z)) - 1) / 2e0 AS q FROM x WHERE z <> 0),
 wr AS (SELECT segment, epoch, least(coalesce(sum(q) FILTER (WHERE z > 0), 0), coalesce(sum(q) FILTER (WHERE z < 0), 0)) AS w_stat FROM rk GROUP BY 1, 2),
 ts AS (SELECT segment, epoch, avg(z) AS gain, CASE WHEN stddev_samp(d) > 0 THEN avg(z) / (stddev_samp(d) / sqrt(count(*))) END AS t FROM x GROUP BY 1, 2),
 res AS (SELECT ev.*, CASE WHEN ok.segment IS NULL THEN 'skipped' ELSE 'ok' END AS status, gain, t, w_stat, {sql_t_p('t', '(ev.n_events - 1)')} AS t_p, CASE WHEN ok.c IS NOT NULL THEN {sql_n_p('ok.n_events', 'ok.ea')} END AS n_p_a, CASE WHEN ok.c IS NOT NULL THEN {sql_n_p('ok.n_events', 'ok.eb')} END AS n_p_b
   FROM ev LEFT JOIN ok USING (segment, epoch) LEFT JOIN ts USING (segment, epoch) LEFT JOIN wr USING (segment, epoch))"""


def rolling(spark, sf):
    """Epochs of five events after five years: the best candidate before each, the refined rates tested inside."""
    g = series(spark, sf).select("segment", "day", F.coalesce("G", F.lit(1.0)).alias("G"))
    return it.rolling_origin(catalog(spark, sf), literal_table(spark, CANDS, CAND_COLS), cut_lineage(g), ["segment"], 5.69)


@query("rolling_origin_evaluation", f"""WITH {ROLL_SQL} SELECT segment, epoch, cand, status, n_events, n_days, {', '.join(f'{sql_round(a, 5)} AS {b}' for a, b in (('ea', 'exp_a'), ('eb', 'exp_b'), ('gain', 'info_gain'), ('t', 't_stat'), ('t_p', 't_p'), ('w_stat', 'w_stat'), ('n_p_a', 'n_p_a'), ('n_p_b', 'n_p_b')))}, gain > 0 AS favours FROM res""")
def _(spark, sf):
    r = rolling(spark, sf).select("segment", "epoch", "cand", "status", "n_events", "n_days", "exp_a", "exp_b", "info_gain", "t_stat", "t_p", "w_stat", "n_p_a", "n_p_b", "favours")
    return rounded(r, 5)


@query("rolling_origin_combined", f"""WITH {ROLL_SQL}, v AS (SELECT segment, greatest(t_p, 1e-10) AS p, gain > 0 AS f FROM res WHERE t_p IS NOT NULL), g AS (SELECT segment, -2 * sum(ln(p)) AS chi2, count(*) AS k, count(*) FILTER (WHERE f) AS n_favour, count(*) FILTER (WHERE f AND p < 0.05) AS n_favour_sig, count(*) FILTER (WHERE NOT f AND p < 0.05) AS n_against_sig FROM v GROUP BY 1)
 SELECT segment, {sql_round('chi2', 4)} AS chi2, k, n_favour, n_favour_sig, n_against_sig, {sql_round('list_sum(list_transform(range(0, k), lambda i: exp(-chi2 / 2 + i * ln(chi2 / 2) - lgamma(i + 1e0))))', 4)} AS p_combined FROM g""")
def _(spark, sf):
    return rounded(fisher_combine(rolling(spark, sf).filter("t_p IS NOT NULL"), ["segment"], "t_p", "favours"), 4)
