"""Daily frames, past-only windows and decayed states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.functions.fuzzy import ANOMALY_SETS, elevated
from riskweave.functions.geo import quarter_cell
from riskweave.operators import timeseries as ts
from riskweave.operators.timeseries import Ewma, Recurrent, Robust, Roll
from riskweave.plans.standins import (
    CATALOG_SQL, READINGS_SQL, SEGMENTS_SQL, catalog, readings, rounded, segments, sql_degree0, sql_round)
from riskweave.registry import query

DAILY_SQL = CATALOG_SQL + """,
counts AS (SELECT segment, day, count(*) AS n, sum(mag) AS mag_sum, sum(depth) AS dist_sum,
             count(DISTINCT CAST(CAST(round_even(latitude * 4, 0) AS INTEGER) AS VARCHAR) || '|' ||
                            CAST(CAST(round_even(longitude * 4, 0) AS INTEGER) AS VARCHAR)) AS cells
           FROM catalog GROUP BY segment, day),
bounds AS (SELECT segment, min(day) AS lo, max(day) AS hi FROM counts GROUP BY segment),
spine AS (SELECT segment, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM bounds),
daily AS (SELECT segment, day, coalesce(n, 0) AS n, coalesce(mag_sum, 0) AS mag_sum, coalesce(dist_sum, 0) AS dist_sum,
            coalesce(cells, 0) AS cells FROM spine LEFT JOIN counts USING (segment, day))"""

SENSOR_SQL = READINGS_SQL + """,
sday AS (SELECT station, day, avg(value) AS value FROM readings GROUP BY station, day),
sbounds AS (SELECT station, min(day) AS lo, max(day) AS hi FROM sday GROUP BY station),
sspine AS (SELECT station, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM sbounds),
sensor AS (SELECT station, day, value FROM sspine LEFT JOIN sday USING (station, day))"""


def counts(spark, sf):
    return ts.daily_counts(catalog(spark, sf), ["segment"])


def daily(spark, sf):
    return ts.date_spine(counts(spark, sf), ["segment"])


def daily_stats(spark, sf):
    return (catalog(spark, sf).withColumn("cell", quarter_cell("latitude", "longitude"))
            .groupBy("segment", "day").agg(
                F.count(F.lit(1)).alias("n"), F.sum("mag").alias("mag_sum"), F.sum("depth").alias("dist_sum"),
                F.countDistinct("cell").alias("cells")))


def sensor(spark, sf):
    s = readings(spark, sf).groupBy("station", "day").agg(F.avg("value").alias("value"))
    return ts.date_spine(s, ["station"], values=["value"], fill=None)


@query("daily_counts", f"WITH {CATALOG_SQL} SELECT segment, day, count(*) AS n FROM catalog GROUP BY segment, day")
def _(spark, sf):
    return counts(spark, sf)


@query("daily_catalog_stats", f"""WITH {DAILY_SQL} SELECT segment, day, n, {sql_round('mag_sum')} AS mag_sum,
  {sql_round('dist_sum')} AS dist_sum, cells FROM counts""")
def _(spark, sf):
    return rounded(daily_stats(spark, sf))


@query("date_spine", f"""WITH {CATALOG_SQL},
 c AS (SELECT segment, day, count(*) AS n FROM catalog GROUP BY segment, day),
 b AS (SELECT segment, greatest(min(day), DATE '1996-06-01') AS lo, greatest(max(day), DATE '2001-09-30') AS hi FROM c GROUP BY segment),
 s AS (SELECT segment, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM b)
 SELECT segment, day, CAST(coalesce(n, 0) AS BIGINT) AS n FROM s LEFT JOIN c USING (segment, day)""")
def _(spark, sf):
    return ts.date_spine(counts(spark, sf), ["segment"], end="2001-09-30", start="1996-06-01").withColumn(
        "n", F.col("n").cast("bigint"))


def _frame_sql(value, w, needed, kind):
    agg = f"{kind}({value}) OVER (PARTITION BY segment ORDER BY day ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    cnt = f"count({value}) OVER (PARTITION BY segment ORDER BY day ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN {cnt} >= {needed} THEN {agg} END"


ROLLS = [(7, 4, "avg"), (14, 1, "sum"), (30, 15, "avg"), (60, 20, "avg"), (90, 1, "sum"), (180, 90, "avg"),
         (365, 182, "sum"), (730, 90, "count")]


@query("rolling_sum_mean_count", f"WITH {DAILY_SQL} SELECT segment, day, " + ", ".join(
    sql_round(_frame_sql("n", w, m, k)) + f" AS {k}{w}" for w, m, k in ROLLS) + " FROM daily")
def _(spark, sf):
    kinds = {"avg": "mean", "sum": "sum", "count": "count"}
    rolls = [Roll(f"{k}{w}", "n", w, kinds[k], m) for w, m, k in ROLLS]
    return rounded(ts.rolling(daily(spark, sf), ["segment"], "day", rolls).drop("n"))


def robust_sql(source: str, key: str, b: int, m: int, prefix: str, cols: str, value: str = "value") -> str:
    """CTEs <prefix>1..3 ending in column z."""
    win = f"OVER (PARTITION BY {key} ORDER BY day ROWS BETWEEN {b} PRECEDING AND 1 PRECEDING)"
    return f"""
{prefix}1 AS (SELECT {cols}, {value} AS x, CASE WHEN count({value}) {win} >= {m} THEN quantile_cont({value}, 0.5) {win} END AS med FROM {source}),
{prefix}2 AS (SELECT *, CASE WHEN count(abs(x - med)) {win} >= {m} THEN quantile_cont(abs(x - med), 0.5) {win} END AS mad FROM {prefix}1),
{prefix}3 AS (SELECT {cols}, lag((x - med) / (1.4826e0 * mad + 1e-9)) OVER (PARTITION BY {key} ORDER BY day) AS z FROM {prefix}2)"""


@query("robust_anomaly", f"""WITH {SENSOR_SQL}, {robust_sql('sensor', 'station', 365, 182, 'a', 'station, day')},
 {robust_sql('sensor', 'station', 60, 20, 'b', 'station, day')}
 SELECT station, day, {sql_round('tanh(a3.z / 3e0)')} AS anomaly, {sql_round('b3.z', 4)} AS z60
 FROM a3 JOIN b3 USING (station, day)""")
def _(spark, sf):
    out = ts.robust_anomaly(sensor(spark, sf), ["station"], "day", [
        Robust("anomaly", "value", 365, 3.0), Robust("z60", "value", 60, None, 20)])
    return rounded(out.drop("value"), 6, keep=("z60",)).withColumn("z60", F.round("z60", 4) + F.lit(0.0))


def poisson_sql(source, key, value, b, m, tau, obs, cols):
    w = f"PARTITION BY {key} ORDER BY day ROWS BETWEEN"
    return f"""(SELECT {cols}, tanh((o - mu) / sqrt(mu + 1e-9) / {tau}) AS a FROM (
      SELECT {cols}, CASE WHEN c >= {m} THEN (s + 0.5e0) / (c + 1e0) * {obs} END AS mu, o FROM (
        SELECT {cols}, sum({value}) OVER ({w} {b} PRECEDING AND 1 PRECEDING) AS s,
          count({value}) OVER ({w} {b} PRECEDING AND 1 PRECEDING) AS c,
          sum({value}) OVER ({w} {obs} PRECEDING AND 1 PRECEDING) AS o FROM {source})))"""


@query("poisson_anomaly", f"""WITH {DAILY_SQL} SELECT segment, day, CAST(n AS BIGINT) AS n, {sql_round('a')} AS a_seis
  FROM {poisson_sql('daily', 'segment', 'n', 365, 182, '4e0', 14, 'segment, day, n')}""")
def _(spark, sf):
    out = ts.poisson_anomaly(daily(spark, sf), ["segment"], "day", "n", "a_seis", 365, 4.0)
    return rounded(out.withColumn("n", F.col("n").cast("bigint")))


@query("trailing_slope", f"""WITH {SENSOR_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY day) AS i FROM sensor)
 SELECT station, day, {sql_round('''CASE WHEN i > 365 AND count(value) OVER w365 > 219 THEN regr_slope(value, i) OVER w365 * 365.25e0 END''', 4)} AS slope365,
  {sql_round('''CASE WHEN i > 30 AND count(value) OVER w30 > 18 THEN regr_slope(value, i) OVER w30 * 365.25e0 END''', 4)} AS slope30 FROM i
 WINDOW w365 AS (PARTITION BY station ORDER BY day ROWS BETWEEN 365 PRECEDING AND 1 PRECEDING),
        w30 AS (PARTITION BY station ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    out = sensor(spark, sf)
    for width in (365, 30):
        out = ts.trailing_slope(out, ["station"], "day", "value", f"slope{width}", width)
    return rounded(out.drop("value"), 4)


@query("detrend_residual", f"""WITH {SENSOR_SQL} SELECT station, day, {sql_round('''value - CASE WHEN count(value) OVER w >= 200 THEN avg(value) OVER w END''')} AS resid
 FROM sensor WINDOW w AS (PARTITION BY station ORDER BY day ROWS BETWEEN 365 PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    return rounded(ts.detrend_residual(sensor(spark, sf), ["station"], "day", "value", "resid").drop("value"))


RATIO_SQL = DAILY_SQL + """, p AS (SELECT segment, day, n, coalesce(lag(n) OVER (PARTITION BY segment ORDER BY day), 0) AS p FROM daily),
r AS (SELECT segment, day, CASE WHEN count(p) OVER w7 >= 4 THEN sum(p) OVER w7 / 1e0 / count(p) OVER w7 END AS r7,
   CASE WHEN count(p) OVER w30 >= 15 THEN sum(p) OVER w30 / 1e0 / count(p) OVER w30 END AS r30,
   CASE WHEN count(p) OVER w180 >= 90 THEN sum(p) OVER w180 / 1e0 / count(p) OVER w180 END AS r180 FROM p
   WINDOW w7 AS (PARTITION BY segment ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
     w30 AS (PARTITION BY segment ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
     w180 AS (PARTITION BY segment ORDER BY day ROWS BETWEEN 179 PRECEDING AND CURRENT ROW)),
q AS (SELECT segment, day, CASE WHEN r180 * 180 >= 5 - 1e-9 THEN ln((r30 + 0.01e0) / (r180 + 0.01e0)) END AS swarm_ratio,
   CASE WHEN r30 * 30 >= 3 - 1e-9 THEN ln((r7 + 0.01e0) / (r30 + 0.01e0)) END AS foreshock_ratio,
   (r30 - lag(r30, 14) OVER (PARTITION BY segment ORDER BY day)) / 14e0 AS slope14 FROM r)"""


@query("rate_ratio_gate", f"""WITH {RATIO_SQL}, {robust_sql('q', 'segment', 365, 182, 's', 'segment, day', 'swarm_ratio')},
 {robust_sql('q', 'segment', 365, 182, 'f', 'segment, day', 'foreshock_ratio')}
 SELECT segment, day, {sql_round("CASE WHEN slope14 >= -0.01e0 THEN coalesce(tanh(s3.z / 2.5e0), 0e0) ELSE 0e0 END", 5)} AS a_swarm,
   {sql_round("coalesce(tanh(f3.z / 2e0), 0e0)", 5)} AS a_foreshock
 FROM q JOIN s3 USING (segment, day) JOIN f3 USING (segment, day)""")
def _(spark, sf):
    out = ts.rate_ratios(daily(spark, sf), ["segment"], "day")
    out = ts.robust_anomaly(out, ["segment"], "day", [
        Robust("__sw", "swarm_ratio", 365, 2.5), Robust("__fo", "foreshock_ratio", 365, 2.0)])
    return rounded(out.select(
        "segment", "day",
        F.when(F.col("slope14") >= -0.01, F.coalesce("__sw", F.lit(0.0))).otherwise(0.0).alias("a_swarm"),
        F.coalesce("__fo", F.lit(0.0)).alias("a_foreshock")), 5)


REG_W = "PARTITION BY segment ORDER BY day ROWS BETWEEN"
REG_SQL = DAILY_SQL + f""", g AS (SELECT segment, day, n, count(n) OVER ({REG_W} 730 PRECEDING AND 1 PRECEDING) AS c730,
  sum(n) OVER ({REG_W} 30 PRECEDING AND 1 PRECEDING) AS n30, sum(n) OVER ({REG_W} 90 PRECEDING AND 1 PRECEDING) AS n90,
  sum(n) OVER ({REG_W} 730 PRECEDING AND 1 PRECEDING) AS s730,
  sum(mag_sum) OVER ({REG_W} 30 PRECEDING AND 1 PRECEDING) AS m30, sum(mag_sum) OVER ({REG_W} 730 PRECEDING AND 1 PRECEDING) AS m730,
  sum(dist_sum) OVER ({REG_W} 90 PRECEDING AND 1 PRECEDING) AS d90, sum(cells) OVER ({REG_W} 30 PRECEDING AND 1 PRECEDING) AS c30 FROM daily),
h AS (SELECT segment, day, n, CASE WHEN c730 >= 90 THEN s730 END AS n730, n30, c30 / sqrt(n30 + 1e0) AS spread30, -(d90 / nullif(n90, 0)) AS neg_radial90,
  m30 / nullif(n30, 0) AS mag30, CASE WHEN c730 >= 90 THEN m730 / nullif(s730, 0) END AS mag730 FROM g),
b AS (SELECT *, mag30 - mag730 AS mag_accel, tanh(coalesce(CASE WHEN mag30 IS NULL OR mag730 IS NULL THEN NULL ELSE
  greatest(-2e0, least(2e0, log10(exp(1e0)) / greatest(mag730 - 4.7e0 + 0.05e0, 0.05e0) - log10(exp(1e0)) / greatest(mag30 - 4.7e0 + 0.05e0, 0.05e0))) END, 0e0) / 0.35e0) AS a_bvalue_drop,
  CAST(coalesce(n730 > 0, FALSE) AS INTEGER) AS has_regional_catalog_data FROM h)"""


@query("bvalue_drop", f"WITH {REG_SQL} SELECT segment, day, {sql_round('a_bvalue_drop')} AS a_bvalue_drop, has_regional_catalog_data FROM b")
def _(spark, sf):
    d = ts.date_spine(daily_stats(spark, sf), ["segment"], values=["n", "mag_sum", "dist_sum", "cells"])
    out = ts.regional_features(d, ["segment"], "day", 4.7)
    return rounded(out.select("segment", "day", "a_bvalue_drop", "has_regional_catalog_data"))


@query("regional_precursors", f"""WITH {REG_SQL}, {robust_sql('b', 'segment', 730, 90, 'u', 'segment, day', 'spread30')},
 {robust_sql('b', 'segment', 730, 90, 'v', 'segment, day', 'neg_radial90')}, {robust_sql('b', 'segment', 730, 90, 'x', 'segment, day', 'mag_accel')},
 pr AS {poisson_sql('daily', 'segment', 'n', 365, 182, '4e0', 30, 'segment, day')}
 SELECT segment, day, {sql_round('pr.a')} AS a_regional_rate, {sql_round('tanh(u3.z / 2.5e0)', 5)} AS a_regional_spread, {sql_round('b.a_bvalue_drop')} AS a_bvalue_drop,
  {sql_round('tanh(v3.z / 2.5e0)', 5)} AS a_fault_concentration, {sql_round('tanh(x3.z / 2.5e0)', 5)} AS a_mag_accel, b.has_regional_catalog_data
 FROM b JOIN u3 USING (segment, day) JOIN v3 USING (segment, day) JOIN x3 USING (segment, day) JOIN pr USING (segment, day)""")
def _(spark, sf):
    d = ts.date_spine(daily_stats(spark, sf), ["segment"], values=["n", "mag_sum", "dist_sum", "cells"])
    out = ts.regional_precursors(d, ["segment"], "day", 4.7)
    five = ("a_regional_spread", "a_fault_concentration", "a_mag_accel")
    out = out.select("segment", "day", "a_regional_rate", "a_bvalue_drop", "has_regional_catalog_data",
                     *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in five])
    return rounded(out, keep=five)


DRIVE_SQL = DAILY_SQL + f""", dr AS (SELECT segment, day, greatest({sql_degree0('a', ANOMALY_SETS['high'])}, {sql_degree0('a', ANOMALY_SETS['very_high'])}) AS x,
   row_number() OVER (PARTITION BY segment ORDER BY day) AS rn FROM {poisson_sql('daily', 'segment', 'n', 90, 45, '2e0', 14, 'segment, day')})"""


def drives(spark, sf):
    out = ts.poisson_anomaly(daily(spark, sf), ["segment"], "day", "n", "a", 90, 2.0)
    return out.select("segment", "day", elevated("a").alias("x"))


def fold_sql(step: str) -> str:
    return f""", f AS (SELECT segment, day, rn, 0e0 AS s FROM dr WHERE rn = 1 UNION ALL
  SELECT dr.segment, dr.day, dr.rn, {step} FROM f JOIN dr ON dr.segment = f.segment AND dr.rn = f.rn + 1)"""


@query("ewma_state", f"WITH RECURSIVE {DRIVE_SQL}{fold_sql('0.95e0 * f.s + (1e0 - 0.95e0) * dr.x')} SELECT segment, day, {sql_round('s')} AS A_state FROM f")
def _(spark, sf):
    return rounded(ts.fold_states(drives(spark, sf), ["segment"], "day", [Ewma("A_state", "x", 0.95)]).drop("x"))


@query("recurrent_state", f"""WITH RECURSIVE {DRIVE_SQL}{fold_sql('f.s + (dr.x - f.s) * CASE WHEN dr.x > f.s THEN 0.65e0 ELSE 0.06e0 END')}
 SELECT segment, day, {sql_round('s')} AS state FROM f""")
def _(spark, sf):
    return rounded(ts.fold_states(drives(spark, sf), ["segment"], "day", [Recurrent("state", "x")]).drop("x"))


@query("load_accumulator", f"""WITH {SENSOR_SQL}, {SEGMENTS_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY day) AS i FROM sensor),
 v AS (SELECT station, day, value, CASE WHEN i > 90 AND count(value) OVER w > 54 THEN regr_slope(value, i) OVER w * 365.25e0 END AS v FROM i
   WINDOW w AS (PARTITION BY station ORDER BY day ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING)),
 s AS (SELECT v.*, v_ref, t_rec, greatest(coalesce(lag(value - 30) OVER (PARTITION BY station ORDER BY day), 0e0), 0e0) / 30e0 AS ds
   FROM v JOIN segments ON segments.segment = v.station % 8)
 SELECT station, day, {sql_round('''least(3e0, greatest(0e0, 0.25e0 + sum(coalesce(greatest(0e0, least(3e0, CASE WHEN v IS NOT NULL THEN v / v_ref END)), 1e0) / (t_rec * 365.25e0)) OVER w
    + sum(ds / 50e0) OVER w))''', 5)} AS C_state FROM (SELECT station, day, v, v_ref, t_rec, ds FROM s) WINDOW w AS (PARTITION BY station ORDER BY day ROWS UNBOUNDED PRECEDING)"""
       .replace("coalesce(greatest(0e0, least(3e0, CASE WHEN v IS NOT NULL THEN v / v_ref END)), 1e0)",
                "(CASE WHEN v IS NULL THEN 1e0 ELSE greatest(0e0, least(3e0, v / v_ref)) END)"))
def _(spark, sf):
    s = ts.trailing_slope(sensor(spark, sf), ["station"], "day", "value", "v", 90)
    seg = segments(spark).select("segment", "v_ref", "t_rec")
    s = s.withColumn("segment", F.col("station") % 8).join(seg, "segment")
    s = s.withColumn("step", (F.col("value") - 30) / 50.0)
    out = ts.load_accumulator(s, ["station"], "day", "v", "step", "C_state", F.lit(0.25), "v_ref", "t_rec")
    return rounded(out.select("station", "day", "C_state"), 5)


@query("transient_excess", f"""WITH {SENSOR_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY day) AS i FROM sensor),
 e AS (SELECT station, day, CASE WHEN i > 30 AND count(value) OVER w30 > 18 THEN regr_slope(value, i) OVER w30 * 365.25e0 END
    - CASE WHEN i > 365 AND count(value) OVER w365 > 219 THEN regr_slope(value, i) OVER w365 * 365.25e0 END AS ex FROM i
  WINDOW w365 AS (PARTITION BY station ORDER BY day ROWS BETWEEN 365 PRECEDING AND 1 PRECEDING),
        w30 AS (PARTITION BY station ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
 {robust_sql('e', 'station', 180, 90, 'k', 'station, day', 'ex')}
 SELECT station, day, {sql_round("CASE WHEN station % 3 = 2 THEN 0e0 WHEN e.ex > 0 THEN tanh(k3.z / 3e0) ELSE 0e0 END", 4)} AS a_sse
 FROM e JOIN k3 USING (station, day)""")
def _(spark, sf):
    out = sensor(spark, sf)
    for width in (365, 30):
        out = ts.trailing_slope(out, ["station"], "day", "value", f"v{width}", width)
    out = out.withColumn("ex", F.col("v30") - F.col("v365"))
    out = ts.robust_anomaly(out, ["station"], "day", [Robust("raw", "ex", 180, 3.0)])
    induced = F.col("station") % 3 == 2
    a = F.when(induced, 0.0).when(F.col("ex") > 0, F.col("raw")).otherwise(0.0)
    return rounded(out.select("station", "day", a.alias("a_sse")), 4)


TREND_SQL = """coalesce((CASE WHEN count({v}) OVER w7 >= 3 THEN avg({v}) OVER w7 END) - (CASE WHEN count({v}) OVER w60 >= 20 THEN avg({v}) OVER w60 END), 0e0)"""


@query("fast_slow_trend", f"""WITH {SENSOR_SQL} SELECT station, day, {sql_round("least(1e0, greatest(-1e0, " + TREND_SQL.format(v="value") + " / 0.35e0))")} AS trend FROM sensor
 WINDOW w7 AS (PARTITION BY station ORDER BY day ROWS 6 PRECEDING), w60 AS (PARTITION BY station ORDER BY day ROWS 59 PRECEDING)""")
def _(spark, sf):
    return rounded(sensor(spark, sf).select("station", "day", ts.fast_slow_trend("value", ["station"], "day").alias("trend")))


@query("persistence", f"""WITH {DRIVE_SQL} SELECT segment, day, {sql_round('''coalesce(CASE WHEN count(x) OVER w >= 10 THEN avg(x) OVER w END, 0e0)''')} AS persistence
 FROM dr WINDOW w AS (PARTITION BY segment ORDER BY day ROWS 29 PRECEDING)""")
def _(spark, sf):
    out = ts.rolling(drives(spark, sf), ["segment"], "day", [Roll("p", "x", 30, "mean", 10, 0)])
    return rounded(out.select("segment", "day", F.coalesce("p", F.lit(0.0)).alias("persistence")))


@query("lag_diff", f"""WITH {DAILY_SQL}, r AS (SELECT segment, day, CASE WHEN count(n) OVER w >= 15 THEN avg(n) OVER w END AS r30 FROM daily
   WINDOW w AS (PARTITION BY segment ORDER BY day ROWS 29 PRECEDING))
 SELECT segment, day, {sql_round("(r30 - lag(r30, 14) OVER (PARTITION BY segment ORDER BY day)) / 14e0")} AS slope14 FROM r""")
def _(spark, sf):
    out = ts.rolling(daily(spark, sf), ["segment"], "day", [Roll("r30", "n", 30, "mean", 15, 0)])
    return rounded(out.select("segment", "day", ts.lag_diff("r30", ["segment"], "day", 14).alias("slope14")))


@query("causal_ffill_join", f"""WITH {READINGS_SQL}, src AS (SELECT station, day, avg(value) AS v FROM readings WHERE flag = 'A' GROUP BY 1, 2),
 sp AS (SELECT DISTINCT station, day FROM readings WHERE flag = 'R'),
 u AS (SELECT station, day, max(v) AS v, max(t) AS t FROM (SELECT station, day, v, 0 AS t FROM src UNION ALL SELECT station, day, NULL, 1 FROM sp) GROUP BY 1, 2),
 n AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY day) AS i FROM u),
 l AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS lv, max(CASE WHEN v IS NOT NULL THEN i END) OVER w AS seen FROM n
   WINDOW w AS (PARTITION BY station ORDER BY day ROWS UNBOUNDED PRECEDING))
 SELECT station, day, {sql_round('CASE WHEN i - seen <= 3 THEN lv END')} AS value FROM l WHERE t = 1""")
def _(spark, sf):
    r = readings(spark, sf)
    src = r.filter("flag = 'A'").groupBy("station", "day").agg(F.avg("value").alias("value"))
    spine = r.filter("flag = 'R'").select("station", "day").distinct()
    return rounded(ts.causal_ffill(src, spine, ["station"], "day", "value", limit=3))


@query("one_sided_difference", f"""WITH {READINGS_SQL}, d AS (SELECT segment, day, avg(CASE WHEN side < 0 THEN value END) AS a, avg(CASE WHEN side > 0 THEN value END) AS b
   FROM readings GROUP BY 1, 2)
 SELECT segment, day, {sql_round('''CASE WHEN bool_or(a IS NOT NULL) OVER w AND bool_or(b IS NOT NULL) OVER w THEN a - b ELSE 0e0 END''')} AS D_mm
 FROM d WINDOW w AS (PARTITION BY segment)""")
def _(spark, sf):
    return rounded(ts.one_sided_difference(readings(spark, sf), ["segment"], "day", "side", "value", "D_mm"))


@query("latest_row", f"""WITH {SENSOR_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY day DESC) AS r FROM sday)
 SELECT station, day, {sql_round('value')} AS value FROM l WHERE r = 1""")
def _(spark, sf):
    s = readings(spark, sf).groupBy("station", "day").agg(F.avg("value").alias("value"))
    return rounded(ts.latest_row(s, ["station"], "day"))


@query("tail_mean", f"""WITH {DAILY_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY day DESC) AS r FROM daily)
 SELECT segment, {sql_round('avg(n)')} AS n FROM l WHERE r <= 90 GROUP BY segment""")
def _(spark, sf):
    return rounded(ts.tail_mean(daily(spark, sf), ["segment"], "day", ["n"]))


@query("monotone_accumulate", f"""WITH {CATALOG_SQL}, b AS (SELECT segment, CAST(floor(mag * 10) AS INTEGER) AS bin, avg(depth) AS rate FROM catalog GROUP BY 1, 2)
 SELECT segment, bin, {sql_round('max(rate) OVER (PARTITION BY segment ORDER BY bin ROWS UNBOUNDED PRECEDING)')} AS rate FROM b""")
def _(spark, sf):
    b = catalog(spark, sf).groupBy("segment", F.floor(F.col("mag") * 10).cast("int").alias("bin")).agg(F.avg("depth").alias("rate"))
    w = Window.partitionBy("segment").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(b.withColumn("rate", F.max("rate").over(w)))


@query("missing_flags", f"""WITH {SENSOR_SQL} SELECT station, day, CAST(value IS NOT NULL AS INTEGER) AS has_data FROM sensor""")
def _(spark, sf):
    return sensor(spark, sf).select("station", "day", F.col("value").isNotNull().cast("int").alias("has_data"))
