"""Network, category, quality and profile aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.functions.fuzzy import ANOMALY_SETS, value_bucket
from riskweave.operators import quality, sensors
from riskweave.operators.profiles import standardize, summary_stats
from riskweave.operators.quantiles import quantiles
from riskweave.plans.series import DAILY_SQL, SENSOR_SQL, daily, sensor
from riskweave.plans.standins import CATALOG_SQL, READINGS_SQL, SCORES_SQL, catalog, readings, rounded, score_rows, sql_membership, sql_round
from riskweave.registry import query
from riskweave.session import table

Z_SQL = READINGS_SQL + """, sd AS (SELECT station, day, avg(value) AS v FROM readings GROUP BY 1, 2), m AS (SELECT station, quantile_cont(v, 0.5) AS m FROM sd GROUP BY 1),
 d AS (SELECT station, day, v, m, abs(v - m) AS d FROM sd JOIN m USING (station)), q AS (SELECT station, quantile_cont(d, 0.5) AS s FROM d GROUP BY 1), z AS (SELECT station, day, (v - m) / (1.4826e0 * s + 1e-6) AS z FROM d JOIN q USING (station))"""


def station_z(spark, sf):
    s = readings(spark, sf).groupBy("station", "day").agg(F.avg("value").alias("v"))
    return sensors.station_robust_z(s, "station", "v").select("station", "day", "z")


@query("station_robust_z", f"WITH {Z_SQL} SELECT station, day, {sql_round('z')} AS z FROM z")
def _(spark, sf):
    return rounded(station_z(spark, sf))


@query("network_daily_mean", f"WITH {Z_SQL} SELECT day, {sql_round('avg(z)')} AS mean_z, count(DISTINCT station) AS n_stations FROM z GROUP BY day")
def _(spark, sf):
    return rounded(sensors.network_daily_mean(station_z(spark, sf), "day", "station"))


MONTH_SQL = READINGS_SQL + """, mm AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, station, CASE WHEN flag <> 'N' THEN volume END AS vol, CASE WHEN flag <> 'R' THEN value END AS psi FROM readings),
 mo AS (SELECT month, sum(coalesce(vol, 0)) AS total_vol, sum(CASE WHEN psi IS NOT NULL AND vol > 0 THEN psi * vol END) / sum(CASE WHEN psi IS NOT NULL AND vol > 0 THEN vol END) AS psi, count(DISTINCT station) AS n_wells, make_date(year(month) + 1, 2, 15) AS available_at FROM mm GROUP BY month)"""


def monthly(spark, sf):
    r = readings(spark, sf)
    m = r.select(F.trunc("day", "MM").alias("month"), "station", F.when(F.col("flag") != "N", F.col("volume")).alias("vol"), F.when(F.col("flag") != "R", F.col("value")).alias("psi"))
    return sensors.volume_weighted_month(m, "month", "station", "vol", "psi")


@query("volume_weighted_month", f"WITH {MONTH_SQL} SELECT month, {sql_round('total_vol', 2)} AS total_vol, {sql_round('psi', 5)} AS vol_weighted_psi, n_wells, available_at FROM mo")
def _(spark, sf):
    return monthly(spark, sf).select("month", F.round("total_vol", 2).alias("total_vol"), F.round("vol_weighted_psi", 5).alias("vol_weighted_psi"), "n_wells", "available_at")


@query("latest_release_per_date", f"WITH {MONTH_SQL} SELECT available_at, {sql_round('max_by(total_vol, month)', 2)} AS total_vol FROM mo GROUP BY available_at")
def _(spark, sf):
    return rounded(sensors.latest_release(monthly(spark, sf), "available_at", "month", "total_vol"), 2)


@query("axial_circular_mean", f"""WITH {CATALOG_SQL}, t AS (SELECT segment, avg(cos(radians(depth * 6e0))) AS c, avg(sin(radians(depth * 6e0))) AS s, count(*) AS n FROM catalog GROUP BY segment)
 SELECT segment, {sql_round('((degrees(atan2(s, c)) / 2) % 180e0 + 180e0) % 180e0')} AS mean_azimuth, {sql_round('sqrt(c * c + s * s)')} AS concentration, n FROM t""")
def _(spark, sf):
    c = catalog(spark, sf).withColumn("azi", F.col("depth") * 3.0)
    return rounded(sensors.axial_mean(c, ["segment"], "azi"))


@query("dominant_category", """WITH c AS (SELECT c_nationkey AS nation, c_mktsegment AS cat, count(*) AS n FROM customer GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY n DESC, cat) AS r, sum(n) OVER (PARTITION BY nation) AS t, count(*) OVER (PARTITION BY nation) AS k FROM c)
 SELECT nation, cat AS dominant, n AS n_dominant, CAST(t AS BIGINT) AS n, k AS n_categories FROM r WHERE r = 1""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("cat"))
    return sensors.dominant_category(c, ["nation"], "cat")


CH_SQL = SENSOR_SQL + """, ch AS (SELECT station, day, CASE WHEN day < DATE '1995-06-01' THEN 0e0 ELSE tanh((value - 27e0) / 8e0) END AS a_strain, tanh((value - 30e0) / 30e0) AS a_water, coalesce(value, 0e0) AS n_seis FROM sensor)"""


def channels(spark, sf):
    s = sensor(spark, sf)
    early = F.col("day") < F.lit("1995-06-01").cast("date")
    return s.select("station", "day", F.when(early, 0.0).otherwise(F.tanh((F.col("value") - 27.0) / 8.0)).alias("a_strain"),
                    F.tanh((F.col("value") - 30.0) / 30.0).alias("a_water"), F.coalesce("value", F.lit(0.0)).alias("n_seis"))


@query("channel_health", f"""WITH {CH_SQL}, l AS (SELECT station, day, 'a_strain' AS channel, a_strain AS x, n_seis FROM ch UNION ALL SELECT station, day, 'a_water', a_water, n_seis FROM ch), z AS (SELECT station, avg((n_seis = 0)::INTEGER) AS zero_share FROM ch GROUP BY station),
 g AS (SELECT station, channel, count(*) AS n, avg((abs(x) > 0.95)::INTEGER) AS s FROM l WHERE x IS NOT NULL AND x <> 0 GROUP BY 1, 2) SELECT station, channel, n, {sql_round('s')} AS saturated, s > 0.05 AS flagged, {sql_round('zero_share')} AS zero_share FROM g JOIN z USING (station)""")
def _(spark, sf):
    return rounded(quality.channel_health(channels(spark, sf), ["station"], ["a_strain", "a_water"], "n_seis"))


@query("channel_range_audit", f"""WITH {CH_SQL}, l AS (SELECT 'a_strain' AS channel, a_strain AS x, 1e0 AS hi FROM ch UNION ALL SELECT 'a_water', a_water, 1e0 FROM ch UNION ALL SELECT 'n_seis', n_seis, 40e0 FROM ch)
 SELECT channel, {sql_round('min(x)')} AS min, {sql_round('max(x)')} AS max, {sql_round('avg(x)')} AS mean, {sql_round('avg((x IS NULL)::INTEGER)')} AS null_rate, CASE WHEN min(x) < -1 - 1e-4 OR max(x) > any_value(hi) + 1e-4 THEN 'FAIL' WHEN avg((x IS NULL)::INTEGER) > 0.05 THEN 'WARN' ELSE 'PASS' END AS status FROM l GROUP BY channel""")
def _(spark, sf):
    return rounded(quality.range_audit(channels(spark, sf), ["a_strain", "a_water", "n_seis"], {"n_seis": (-1.0, 40.0)}))


SHARES = [0, .05, .5, .95, 1]


@query("channel_distribution", f"""WITH {CH_SQL}, q AS (SELECT 'a_strain' AS channel, a_strain AS x FROM ch UNION ALL SELECT 'a_water', a_water FROM ch)
 SELECT channel, {', '.join(sql_round(f'quantile_cont(x, {s})') + f' AS q{int(s * 100)}' for s in SHARES)}, {sql_round('avg((abs(x) > 0.95)::INTEGER)')} AS saturated, {sql_round('avg((x = 0)::INTEGER)')} AS zero_share,
  {', '.join(sql_round(f'avg(({sql_membership("x", p)} > 0.5)::INTEGER)') + f' AS share_{t}' for t, p in ANOMALY_SETS.items())}, CASE WHEN quantile_cont(x, 0.95) - quantile_cont(x, 0.05) > 0.15 THEN 'PASS' WHEN quantile_cont(x, 0.95) - quantile_cont(x, 0.05) > 0.05 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM q GROUP BY channel""")
def _(spark, sf):
    return rounded(quality.distribution(channels(spark, sf), ["a_strain", "a_water"], ANOMALY_SETS))


@query("partition_coverage", f"""WITH {CH_SQL}, s AS (SELECT {' + '.join(sql_membership('a_water', p) for p in ANOMALY_SETS.values())} AS s FROM ch WHERE a_water IS NOT NULL)
 SELECT {sql_round('min(s)')} AS min_sum, {sql_round('max(s)')} AS max_sum, {sql_round('max(abs(s - 1))')} AS max_error, count(*) FILTER (WHERE s <= 1e-3) AS holes, count(*) FILTER (WHERE s < 1 - 1e-3) AS below, count(*) FILTER (WHERE s > 1 + 1e-3) AS above FROM s""")
def _(spark, sf):
    return rounded(quality.partition_coverage(channels(spark, sf), "a_water", ANOMALY_SETS))


@query("class_histogram", f"""WITH {CATALOG_SQL}, r AS (SELECT CAST(floor(latitude) AS INTEGER) AS la, CAST(floor(longitude) AS INTEGER) AS lo, count(*) / 66e0 AS rate FROM catalog GROUP BY 1, 2)
 SELECT CASE WHEN rate > 8 THEN 3 WHEN rate > 2 THEN 2 WHEN rate > 0.5 THEN 1 ELSE 0 END AS class, count(*) AS n FROM r GROUP BY 1""")
def _(spark, sf):
    r = catalog(spark, sf).groupBy(F.floor("latitude").alias("la"), F.floor("longitude").alias("lo")).agg((F.count(F.lit(1)) / 66.0).alias("rate"))
    return r.groupBy(value_bucket("rate", [0.5, 2, 8], [0, 1, 2, 3], strict=True).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("standardize_features", f"""WITH {SCORES_SQL}, m AS (SELECT avg(value) AS a, stddev_pop(value) AS b, avg(p) AS c, stddev_pop(p) AS d FROM scores) SELECT id, {sql_round('coalesce((value - a) / (b + 1e-9), 0e0)')} AS value, {sql_round('coalesce((p - c) / (d + 1e-9), 0e0)')} AS p FROM scores, m""")
def _(spark, sf):
    return rounded(standardize(score_rows(spark, sf).select("id", "value", "p"), ["value", "p"]))


@query("state_summary_stats", f"""WITH {SENSOR_SQL}, m AS (SELECT station, quantile_cont(value, 0.5) AS med, stddev_samp(value) AS sd, avg(value) AS mean, count(*) AS n, min_by(value, day) FILTER (WHERE value IS NOT NULL) AS f, max_by(value, day) FILTER (WHERE value IS NOT NULL) AS l FROM sensor GROUP BY station)
 SELECT station, {sql_round('any_value(mean)')} AS mean, {sql_round('any_value(sd)')} AS std, {sql_round('avg((value > med + 0.5e0 * sd)::INTEGER)')} AS frac_high, {sql_round('any_value((l - f) / greatest(n / 365.25e0 / 10, 0.1e0))')} AS trend_per_decade FROM sensor JOIN m USING (station) WHERE value IS NOT NULL GROUP BY station""")
def _(spark, sf):
    return rounded(summary_stats(sensor(spark, sf), ["station"], "day", "value"))
