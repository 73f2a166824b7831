"""Grid-cell features, channels and the live forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.fuzzy import ANOMALY_SETS
from riskweave.operators import cells as ce
from riskweave.operators.scoring import Rule
from riskweave.operators.spatial import halo
from riskweave.plans.spatial import CELLS_SQL, SLIP_SQL, fault_cells, own_cells
from riskweave.plans.standins import AFTER_LAST_SQL, CATALOG_SQL, after_last, FAULTS_SQL, catalog, rounded, sql_days, sql_degree0, sql_round
from riskweave.registry import query

FIRST, LAST, ORIGIN, TARGET = "1996-01-01", "2001-08-01", "1995-01-01", 5.6
HALO_SQL = """offs9 AS (SELECT a.v AS da, b.v AS do_ FROM (VALUES (-1), (0), (1)) a(v), (VALUES (-1), (0), (1)) b(v)),
 h AS (SELECT CAST(CAST(floor(latitude) AS INTEGER) + da AS INTEGER) AS la, CAST(((CAST(floor(longitude) AS INTEGER) + do_ + 180) % 360 + 360) % 360 - 180 AS INTEGER) AS lo, time, mag FROM catalog, offs9)"""
LAG = sql_days("s", "time")
KER = f"pow(10e0, 0.5e0 * (mag - 4.5e0)) / pow({LAG} + 5e0, 1.1e0)"
FEATS = ", ".join(f"count(*) FILTER (WHERE {LAG} <= {w}) AS n{w}" for w in ce.WINDOWS) + f", max(time) AS t_max, max(mag) AS mag_max, coalesce(sum({KER}) FILTER (WHERE {LAG} <= 365), 0e0) AS omori"
PIT_SQL = CATALOG_SQL + f""", {HALO_SQL}, sn AS (SELECT CAST(unnest(generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL 1 MONTH)) AS DATE) AS s),
 p AS (SELECT la, lo, s, count(*) AS i, {FEATS} FROM h JOIN sn ON time < s GROUP BY la, lo, s),
 yl AS (SELECT DISTINCT la, lo, s FROM h JOIN sn ON mag >= {TARGET} AND time >= s AND {sql_days('time', 's')} < 30),
 nx AS (SELECT la, lo, s, min(time) AS t, min_by(mag, time) AS m FROM h JOIN sn ON mag >= {TARGET} AND time > s AND {sql_days('time', 's')} <= 365 GROUP BY la, lo, s),
 cm AS (SELECT p.*, i / greatest((s - DATE '{ORIGIN}') / 365.25e0, 1e0) AS rate_bg, {sql_days('s', 't_max')} AS t_last, CAST(yl.la IS NOT NULL AS INTEGER) AS y, nx.m AS mag_next, {sql_days('nx.t', 's')} AS days_next
   FROM p LEFT JOIN yl USING (la, lo, s) LEFT JOIN nx USING (la, lo, s))"""


def cell_months(spark, sf):
    return ce.cell_months(catalog(spark, sf), FIRST, LAST, ORIGIN, TARGET)


#: Of next events at one time that of the least magnitude counts.
NEXT_SQL = PIT_SQL.replace("min_by(mag, time)", "min_by(mag, (time, mag))")


@query("point_in_time_features", f"""WITH {NEXT_SQL} SELECT la, lo, s AS date, {sql_round('rate_bg')} AS rate_bg, n7, n30, n90, n365, {sql_round('t_last', 8)} AS t_last, {sql_round('mag_max')} AS mag_max, {sql_round('omori')} AS omori, y,
 {sql_round('mag_next')} AS mag_next, {sql_round('days_next', 8)} AS days_next FROM cm""")
def _(spark, sf):
    c = cell_months(spark, sf)
    return rounded(c, keep=("t_last", "days_next")).withColumns({"t_last": F.round("t_last", 8), "days_next": F.round("days_next", 8)})


GRID_SQL = CELLS_SQL + f""", {FAULTS_SQL}, sl AS (SELECT CAST(floor(lat) AS INTEGER) AS la, CAST(floor(lon) AS INTEGER) AS lo, max(coalesce({SLIP_SQL}, 0e0)) AS slip FROM fault_vertices WHERE pos % 3 = 0 GROUP BY 1, 2),
 grid AS (SELECT la, lo, coalesce(sl.slip, 0e0) AS slip FROM (SELECT la, lo FROM cells WHERE n >= 3) c FULL JOIN sl USING (la, lo)), {HALO_SQL}"""
LIVE_SQL = GRID_SQL + f""",
 lf AS (SELECT la, lo, count(*) AS i, {FEATS} FROM (SELECT *, {AFTER_LAST_SQL} AS s FROM h) WHERE time < s GROUP BY la, lo),
 live AS (SELECT la, lo, slip, coalesce(i, 0) / greatest({sql_days(AFTER_LAST_SQL, f"TIMESTAMP '{ORIGIN}'")} / 365.25e0, 1e0) AS rate_bg, {', '.join(f'coalesce(n{w}, 0) AS n{w}' for w in ce.WINDOWS)}, coalesce({sql_days(AFTER_LAST_SQL, 't_max')}, 99999e0) AS t_last,
   coalesce(mag_max, 0e0) AS mag_max, coalesce(omori, 0e0) AS omori FROM grid LEFT JOIN lf USING (la, lo))"""


def live(spark, sf):
    own = own_cells(spark, sf).filter("n >= 3").select("la", "lo", "n")
    grid = own.join(fault_cells(spark, sf), ["la", "lo"], "full").select("la", "lo", F.coalesce("slip", F.lit(0.0)).alias("slip"))
    return ce.cell_state(catalog(spark, sf), grid, F.lit(after_last(spark, sf)).cast("timestamp_ntz"), ORIGIN)


@query("live_cell_state", f"WITH {LIVE_SQL} SELECT la, lo, slip, {sql_round('rate_bg')} AS rate_bg, n7, n30, n90, n365, {sql_round('t_last', 8)} AS t_last, {sql_round('mag_max')} AS mag_max, {sql_round('omori')} AS omori FROM live")
def _(spark, sf):
    return rounded(live(spark, sf), keep=("t_last",)).withColumn("t_last", F.round("t_last", 8))


@query("omori_sum", f"WITH {LIVE_SQL} SELECT la, lo, {sql_round('omori')} AS omori FROM live WHERE omori > 0")
def _(spark, sf):
    return rounded(live(spark, sf).filter("omori > 0").select("la", "lo", "omori"))


RAW = {"a_seis": "(n30 - rate_bg * 30 / 365.25e0) / sqrt(rate_bg * 30 / 365.25e0 + 0.5e0)", "a_swarm": "(n30 - n365 * 30 / 365e0) / sqrt(n365 * 30 / 365e0 + 0.5e0)",
       "a_fore": "(n7 - n30 * 7 / 30e0) / sqrt(n30 * 7 / 30e0 + 0.5e0)", "A_state": "(n90 / greatest(rate_bg * 90 / 365.25e0, 0.25e0) - 1)", "C_state": "(t_last / 365.25e0 * rate_bg - 1)"}
BOUNDED = {"mag_scale": "greatest(-1e0, least(1e0, 2 * (mag_max - 4.5e0) / 3.5e0 - 1))", "a_tect": "greatest(-1e0, least(1e0, 2 * ln(1 + slip) / ln(51e0) - 1))"}
CHAN_SQL = ", ".join(f"tanh({z} / {ce.SCALES[c]}e0) AS {c}".replace(".0e0", "e0") for c, z in RAW.items()) + ", " + ", ".join(f"{e} AS {c}" for c, e in BOUNDED.items())


@query("derive_channels", f"WITH {LIVE_SQL}, ch AS (SELECT la, lo, {CHAN_SQL} FROM live) SELECT la, lo, {', '.join(sql_round(c) + f' AS {c}' for c in ce.CHANNELS)} FROM ch")
def _(spark, sf):
    return rounded(ce.derive_channels(live(spark, sf)).select("la", "lo", *ce.CHANNELS))


CLS = "CASE WHEN rate_bg > 8 THEN 3 WHEN rate_bg > 2 THEN 2 WHEN rate_bg > 0.5 THEN 1 ELSE 0 END"
TAU_SQL = ", tz AS (SELECT " + CLS + " AS cls, " + ", ".join(f"{z} AS {c}" for c, z in RAW.items()) + " FROM cm), ta AS (SELECT cls, " + ", ".join(
    f"greatest(CASE WHEN count(*) > 500 THEN quantile_cont(abs({c}), 0.85) ELSE 1e0 END, 1e-3) / atanh(0.7e0) AS t_{c}" for c in RAW) + " FROM tz GROUP BY cls)"


@query("derive_channels_classed", f"""WITH {PIT_SQL}{TAU_SQL}, z AS (SELECT la, lo, s, {CLS} AS cls, {', '.join(f'{z} AS {c}' for c, z in RAW.items())}, {BOUNDED['mag_scale']} AS mag_scale FROM cm)
 SELECT la, lo, s AS date, CAST(z.cls AS INTEGER) AS cls, {', '.join(sql_round(f'tanh({c} / coalesce(t_{c}, 1e0 / atanh(0.7e0)))') + f' AS {c}' for c in RAW)}, {sql_round('mag_scale')} AS mag_scale FROM z LEFT JOIN ta USING (cls)""")
def _(spark, sf):
    cm = cell_months(spark, sf)
    out = ce.derive_channels_classed(cm, ce.class_taus(cm))
    return rounded(out.select("la", "lo", "date", "cls", *RAW, "mag_scale"))


RULES = [Rule((("a_seis", "very_high"),), lift=3.1), Rule((("a_seis", "high"), ("a_fore", "high")), lift=2.2), Rule((("C_state", "very_high"), ("A_state", "low")), lift=0.6),
         Rule((("a_swarm", "very_low"),), lift=0.8), Rule((("mag_scale", "very_high"), ("a_tect", "high")), lift=1.7)]
INFLUENCE = {"a_seis": 0.9, "a_swarm": 0.7, "a_fore": 0.6, "A_state": 0.8, "C_state": 0.5, "mag_scale": 0.95, "a_tect": 0.4}
# Deployed coefficients of the occurrence model.
COEF, INTERCEPT = [1.4486419, 0.7057888, 0.9418450], -4.7280866


def sql_side(up):
    top = max(abs(r.lift - 1) for r in RULES)
    parts = []
    for r in RULES:
        if (r.lift > 1) == up:
            deg = [sql_degree0(v, ANOMALY_SETS[t]) for v, t in r.antecedent]
            low = f"least({', '.join(deg)})" if len(deg) > 1 else deg[0]
            parts.append(f"{low} * ({min(INFLUENCE[v] for v in r.variables) * abs(r.lift - 1) / top!r}::DOUBLE)")
    return f"greatest({', '.join(parts)}, 0e0)"


def live_table(spark, sf):
    stats = halo(own_cells(spark, sf)).groupBy("la", "lo").agg(F.sum("big_sum").alias("s"), F.sum("n_big").alias("c"), F.max("big_max").alias("mag_max"))
    stats = stats.filter("c > 0").select("la", "lo", (F.col("s") / F.col("c")).alias("mag_mean"), "mag_max")
    from riskweave.functions.probability import poisson_probability
    second = poisson_probability(F.col("rate_bg") / 365.25, 30)
    return ce.forecast_table(live(spark, sf), RULES, INFLUENCE, COEF, INTERCEPT, stats, 0.40, second)


LIVE_TABLE_SQL = f"""{LIVE_SQL}, chx AS (SELECT *, {CHAN_SQL} FROM live), sd AS (SELECT *, {sql_side(True)} AS ws, {sql_side(False)} AS wn FROM chx), ms AS (SELECT la, lo, sum(big_sum) / sum(n_big) AS mm, max(big_max) AS mx FROM halo GROUP BY 1, 2 HAVING sum(n_big) > 0),
 pr AS (SELECT *, 1 / (1 + exp(-({INTERCEPT} + {COEF[0]} * ln(1 + omori) + {COEF[1]} * (omori > 0)::INTEGER + {COEF[2]} * ln(1 + rate_bg)))) AS p, CASE WHEN abs(ws - wn) <= 1e-8 + 1e-5 * abs(wn) THEN 0e0 WHEN ws > wn THEN ws ELSE -wn END AS mom0 FROM sd)"""


@query("live_forecast_table", f"""WITH {LIVE_TABLE_SQL} SELECT la, lo, round_even(p, 5) + 0e0 AS p30, round_even(coalesce(mm, mag_max), 2) + 0e0 AS mag_typical, round_even(coalesce(mx, mag_max), 1) + 0e0 AS mag_top, CAST(n365 AS INTEGER) AS n365, CAST(floor(least(t_last, 99999e0)) AS INTEGER) AS t_last_d,
 round_even(least(30e0 / -ln(greatest(1 - p, 1e-9)), 36500e0), 0) + 0e0 AS poisson_mean_wait_days, round_even(mom0, 3) + 0e0 AS mom, CAST(1 - exp(-rate_bg / 365.25e0 * 30) >= 0.4 AS INTEGER) AS alert, {', '.join(f'round_even({c}, 3) + 0e0 AS {c}' for c in ce.CHANNELS)},
 round_even(omori, 3) + 0e0 AS omori, round_even(rate_bg, 3) + 0e0 AS rate_bg, CAST(n30 AS INTEGER) AS n30 FROM pr LEFT JOIN ms USING (la, lo)""")
def _(spark, sf):
    t = live_table(spark, sf)
    return t.select(*[(F.col(f.name) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in t.schema.fields])
