"""Filters, buckets, ordering and set plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.fuzzy import value_bucket
from riskweave.operators import ranking
from riskweave.plans.spatial import CELLS_SQL, own_cells
from riskweave.plans.standins import AFTER_LAST_SQL, after_last, CATALOG_SQL, READINGS_SQL, SCORES_SQL, catalog, readings, rounded, score_rows, sql_round
from riskweave.registry import query
from riskweave.session import table


@query("quality_filter", f"WITH {READINGS_SQL} SELECT station, ts, {sql_round('value')} AS value FROM readings WHERE flag IN ('A', 'R') AND value IS NOT NULL")
def _(spark, sf):
    r = readings(spark, sf)
    return rounded(r.filter(F.col("flag").isin("A", "R") & F.col("value").isNotNull()).select("station", "ts", "value"))


@query("value_bucket", """SELECT event_id, CASE WHEN value > 80 THEN 3 WHEN value > 50 THEN 2 WHEN value > 20 THEN 1 ELSE 0 END AS activity,
  CASE WHEN value > 100 THEN 'very long term' WHEN value > 40 THEN 'decades' ELSE 'years' END AS wait_class,
  CASE WHEN value >= 90 THEN 'high' WHEN value >= 30 THEN 'mid' ELSE 'low' END AS band FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", value_bucket("value", [20, 50, 80], [0, 1, 2, 3], strict=True).alias("activity"),
        value_bucket("value", [40, 100], ["years", "decades", "very long term"], strict=True).alias("wait_class"),
        value_bucket("value", [30, 90], ["low", "mid", "high"]).alias("band"))


@query("topk_cells", f"WITH {CELLS_SQL} SELECT la, lo, {sql_round('mag_max')} AS p FROM cells ORDER BY mag_max DESC, la, lo LIMIT 5")
def _(spark, sf):
    c = own_cells(spark, sf)
    return rounded(c.orderBy(F.desc("mag_max"), "la", "lo").limit(5).select("la", "lo", F.col("mag_max").alias("p")))


KM = """(12742e0 * asin(sqrt(least(1e0, pow(sin(radians(CAST({b}.la - {a}.la AS DOUBLE)) / 2), 2) + cos(radians({a}.la + 0.5e0)) * cos(radians({b}.la + 0.5e0)) * pow(sin(radians(CAST((({b}.lo - {a}.lo) % 360 + 540) % 360 - 180 AS DOUBLE)) / 2), 2)))))"""


@query("diversified_topk", f"""WITH RECURSIVE {CELLS_SQL}, r AS (SELECT la, lo, mag_max AS p, row_number() OVER (ORDER BY mag_max DESC, la, lo) AS rn FROM cells),
 pick AS (SELECT rn, la, lo, p, 1 AS pick, [rn] AS taken FROM r WHERE rn = 1
  UNION ALL SELECT x.rn, x.la, x.lo, x.p, x.pick, list_append(x.taken0, x.rn) FROM (
    SELECT r.rn, r.la, r.lo, r.p, pick.pick + 1 AS pick, pick.taken AS taken0, row_number() OVER (ORDER BY r.rn) AS q FROM r, pick
    WHERE pick.pick < 8 AND NOT EXISTS (SELECT 1 FROM r AS c WHERE list_contains(pick.taken, c.rn) AND {KM.format(a='r', b='c')} < 300)) x WHERE x.q = 1)
 SELECT CAST(pick AS INTEGER) AS pick, la, lo, {sql_round('p')} AS p FROM pick""")
def _(spark, sf):
    cells = own_cells(spark, sf).select("la", "lo", F.col("mag_max").alias("p"))
    return rounded(ranking.diversified_topk(cells, "p", n=8, min_km=300.0))


@query("topk_rules_per_entity", f"""WITH {SCORES_SQL}, f AS (SELECT grp, CAST(episode AS VARCHAR) AS rule, avg(p) AS firing FROM scores GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY firing * (1 + CAST(rule AS INTEGER) % 4) DESC, rule) AS rank FROM f)
 SELECT grp, rule, {sql_round('firing')} AS firing, {sql_round('firing * (1 + CAST(rule AS INTEGER) % 4)')} AS weighted, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def _(spark, sf):
    f = score_rows(spark, sf).groupBy("grp", F.col("episode").cast("string").alias("rule")).agg(F.avg("p").alias("firing"))
    f = f.withColumn("weighted", F.col("firing") * (1 + F.col("rule").cast("int") % 4))
    return rounded(ranking.topk_per_key(f, ["grp"], [F.desc("weighted"), F.asc("rule")], 5))


@query("recent_events", f"""WITH {CATALOG_SQL} SELECT id, {sql_round('latitude', 2)} AS latitude, {sql_round('longitude', 2)} AS longitude, {sql_round('mag', 1)} AS mag, {sql_round(f"(epoch({AFTER_LAST_SQL}) - epoch(time)) / 3600e0", 5)} AS age_hours
 FROM catalog WHERE time >= {AFTER_LAST_SQL} - INTERVAL 7 DAY""")
def _(spark, sf):
    as_of = F.lit(after_last(spark, sf)).cast("timestamp_ntz")
    c = ranking.recent_events(catalog(spark, sf), as_of, days=7)
    return c.select("id", (F.round("latitude", 2) + 0.0).alias("latitude"), (F.round("longitude", 2) + 0.0).alias("longitude"), F.round("mag", 1).alias("mag"), F.round("age_hours", 5).alias("age_hours"))


@query("sort_by_time", f"WITH {CATALOG_SQL} SELECT id, time FROM catalog ORDER BY time, id")
def _(spark, sf):
    return catalog(spark, sf).select("id", "time").orderBy("time", "id")


@query("common_keys", f"""WITH {CATALOG_SQL}, a AS (SELECT DISTINCT floor(latitude) AS cell FROM catalog WHERE mag >= 5.6e0), b AS (SELECT DISTINCT floor(latitude) AS cell FROM catalog WHERE depth < 30 AND segment = 0)
 SELECT CAST(cell AS BIGINT) AS cell, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT CAST(cell AS BIGINT), 'left' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def _(spark, sf):
    c = catalog(spark, sf)
    a = c.filter("mag >= 5.6").select(F.floor("latitude").alias("cell"))
    b = c.filter("depth < 30 AND segment = 0").select(F.floor("latitude").alias("cell"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("left")))


@query("staleness_flag", """SELECT event_id, epoch((SELECT max(ts) FROM events) - ts) > 1200 AS stale FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    as_of = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    return e.select("event_id", ranking.stale("ts", as_of, minutes=20).alias("stale"))
