"""Catalog maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.parsing import stable_event_id
from riskweave.operators import catalogs as cat
from riskweave.plans.standins import CATALOG_SQL, catalog, rounded, sql_haversine, sql_round
from riskweave.registry import query

COLS = ["id", "time", "updated", "latitude", "longitude", "depth", "mag", "net"]

BASE_SQL = CATALOG_SQL + """,
base AS (SELECT CASE WHEN k % 10 = 0 THEN NULL ELSE id END AS id, time, CASE WHEN k % 11 = 0 THEN NULL ELSE time + to_hours(k % 7) END AS updated,
   latitude, longitude, depth, mag, 'us' AS net, k FROM catalog WHERE k % 3 <> 0),
inc AS (SELECT id, time, time + to_hours(k % 5) AS updated, latitude, longitude, depth, mag, 'us' AS net, k FROM catalog WHERE k % 3 = 0
  UNION ALL SELECT id, time, CASE WHEN k % 22 = 0 THEN NULL ELSE time + to_hours(k % 13) END, latitude, longitude, depth, mag + 0.1e0, 'ak', k FROM catalog WHERE k % 3 = 1 AND k % 5 <> 0
  UNION ALL SELECT 'r' || id, time + INTERVAL 2 SECOND, time + INTERVAL 1 HOUR, latitude + 0.01e0, longitude, depth, mag + 0.2e0, 'ci', k FROM catalog WHERE k % 3 <> 0 AND k % 20 = 0)"""


def hours(c, n):
    return F.timestamp_add("HOUR", n.cast("int"), c)


def base_rows(spark, sf):
    c = catalog(spark, sf).filter("k % 3 <> 0")
    k = F.col("k")
    return c.select(F.when(k % 10 != 0, F.col("id")).alias("id"), "time",
                    F.when(k % 11 != 0, hours(F.col("time"), k % 7)).alias("updated"),
                    "latitude", "longitude", "depth", "mag", F.lit("us").alias("net"), "k")


def incoming_rows(spark, sf):
    c, k = catalog(spark, sf), F.col("k")
    fresh = c.filter("k % 3 = 0").select("id", "time", hours(F.col("time"), k % 5).alias("updated"), "latitude", "longitude",
                                         "depth", "mag", F.lit("us").alias("net"), "k")
    revised = c.filter("k % 3 = 1 AND k % 5 <> 0").select(
        "id", "time", F.when(k % 22 != 0, hours(F.col("time"), k % 13)).alias("updated"), "latitude", "longitude", "depth",
        (F.col("mag") + 0.1).alias("mag"), F.lit("ak").alias("net"), "k")
    renamed = c.filter("k % 3 <> 0 AND k % 20 = 0").select(
        F.concat(F.lit("r"), F.col("id")).alias("id"), F.timestamp_add("SECOND", F.lit(2), F.col("time")).alias("time"),
        hours(F.col("time"), F.lit(1)).alias("updated"), (F.col("latitude") + 0.01).alias("latitude"), "longitude", "depth",
        (F.col("mag") + 0.2).alias("mag"), F.lit("ci").alias("net"), "k")
    return fresh.unionByName(revised).unionByName(renamed)


@query("normalize_schema", f"""WITH {CATALOG_SQL} SELECT id, TRY_CAST(CASE WHEN k % 9 = 0 THEN 'bad' ELSE CAST(time AS VARCHAR) END AS TIMESTAMP) AS time, CAST(NULL AS TIMESTAMP) AS updated,
  TRY_CAST(CASE WHEN k % 8 = 0 THEN 'x' ELSE CAST(k % 90 AS VARCHAR) END AS DOUBLE) AS latitude, CAST(NULL AS VARCHAR) AS net FROM catalog""")
def _(spark, sf):
    k = F.col("k")
    raw = catalog(spark, sf).select(
        "id", F.when(k % 9 == 0, "bad").otherwise(F.col("time").cast("string")).alias("time"),
        F.when(k % 8 == 0, "x").otherwise((k % 90).cast("string")).alias("latitude"))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("time", T.TimestampNTZType()),
                           T.StructField("updated", T.TimestampNTZType()), T.StructField("latitude", T.DoubleType()),
                           T.StructField("net", T.StringType())])
    return cat.normalize_schema(raw, schema)


@query("stable_event_id", f"""WITH {BASE_SQL} SELECT k, coalesce(nullif(id, ''), strftime(time, '%Y-%m-%d %H:%M:%S') || '|' || printf('%.4f', round(latitude, 4)) || '|' || printf('%.4f', round(longitude, 4))) AS event_id FROM base""")
def _(spark, sf):
    return base_rows(spark, sf).select("k", stable_event_id("id", "time", "latitude", "longitude").alias("event_id"))


@query("union_catalogs", f"""WITH {BASE_SQL} SELECT k, id, net, NULL::VARCHAR AS place FROM base UNION ALL SELECT k, id, NULL, 'place-' || CAST(k % 7 AS VARCHAR) FROM inc""")
def _(spark, sf):
    a = base_rows(spark, sf).select("k", "id", "net")
    b = incoming_rows(spark, sf).select("k", "id", F.concat(F.lit("place-"), (F.col("k") % 7).cast("string")).alias("place"))
    return a.unionByName(b, allowMissingColumns=True)


COPIES_SQL = BASE_SQL + """, rows AS (SELECT id, time, latitude, longitude, mag, coalesce(updated, time) AS updated, k FROM base UNION ALL SELECT id, time, latitude, longitude, mag + 0.05e0, coalesce(updated, time) + INTERVAL 1 MINUTE, k + 10000000 FROM base WHERE k % 4 = 1
   UNION ALL SELECT NULL, time, latitude, longitude, mag + 0.07e0, coalesce(updated, time), k + 20000000 FROM base WHERE k % 10 = 0)"""


def copies(spark, sf):
    b = base_rows(spark, sf).withColumn("updated", F.coalesce("updated", "time")).select("id", "time", "latitude", "longitude", "mag", "updated", "k")
    newer = b.filter("k % 4 = 1").withColumns({"mag": F.col("mag") + 0.05, "updated": F.timestamp_add("MINUTE", F.lit(1), F.col("updated")), "k": F.col("k") + 10000000})
    twin = b.filter("k % 10 = 0").withColumns({"id": F.lit(None).cast("string"), "mag": F.col("mag") + 0.07, "k": F.col("k") + 20000000})
    return b.unionByName(newer).unionByName(twin)


@query("dedupe_by_id_then_space", f"""WITH {COPIES_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated DESC, k DESC) AS r FROM rows WHERE id IS NOT NULL AND id <> ''),
 u AS (SELECT id, time, latitude, longitude, mag, updated, k FROM a WHERE r = 1 UNION ALL SELECT id, time, latitude, longitude, mag, updated, k FROM rows WHERE id IS NULL OR id = ''),
 s AS (SELECT *, row_number() OVER (PARTITION BY time, latitude, longitude ORDER BY (id IS NULL) DESC, updated DESC, k DESC) AS r FROM u)
 SELECT k, id, time, {sql_round('mag')} AS mag FROM s WHERE r = 1""")
def _(spark, sf):
    return rounded(cat.dedupe_by_id_then_space(copies(spark, sf), ["updated", "k"]).select("k", "id", "time", "mag"))


@query("incremental_merge", f"""WITH {BASE_SQL}, u AS (SELECT *, 0 AS src FROM base UNION ALL SELECT *, 1 AS src FROM inc),
 a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src DESC, k DESC) AS r FROM u WHERE id IS NOT NULL),
 v AS (SELECT * FROM a WHERE r = 1 UNION ALL SELECT *, 1 AS r FROM u WHERE id IS NULL),
 s AS (SELECT *, row_number() OVER (PARTITION BY time, latitude, longitude ORDER BY (id IS NULL) DESC, src DESC, k DESC) AS q FROM v)
 SELECT k, id, time, {sql_round('mag')} AS mag, net FROM s WHERE q = 1""")
def _(spark, sf):
    out = cat.incremental_merge(base_rows(spark, sf), incoming_rows(spark, sf), tie="k")
    return rounded(out.select("k", "id", "time", "mag", "net"))


MATCH_SQL = BASE_SQL + f""", known AS (SELECT DISTINCT id FROM base WHERE id IS NOT NULL), rest AS (SELECT * FROM inc WHERE id NOT IN (SELECT id FROM known)),
 mm AS (SELECT r.id AS rid, r.k AS rk, b.id AS bid, b.k AS bk, {sql_haversine('b.latitude', 'b.longitude', 'r.latitude', 'r.longitude')} AS d
   FROM rest r JOIN base b ON abs(epoch_us(r.time) - epoch_us(b.time)) <= 5000000 AND abs(r.mag - b.mag) <= 0.5e0),
 m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, bk) AS r FROM mm WHERE d <= 15) WHERE r = 1)"""


@query("fuzzy_revision_match", f"""WITH {MATCH_SQL} SELECT rest.k, rest.id, m.bk AS match, {sql_round('m.d', 5)} AS match_km FROM rest LEFT JOIN m ON m.rid = rest.id""")
def _(spark, sf):
    b = base_rows(spark, sf).withColumn("row", F.col("k"))
    known = b.filter(cat.has_id()).select("id").distinct()
    rest = incoming_rows(spark, sf).join(known, "id", "left_anti").withColumn("row", F.when(F.col("net") == "ci", F.col("k") + 10**9).otherwise(F.col("k")))
    out = cat.fuzzy_match(rest, b)
    return rounded(out.select("k", "id", "match", "match_km"), 5)


@query("catalog_upsert", f"""WITH {MATCH_SQL}, keyed AS (
  SELECT *, CASE WHEN id IS NOT NULL THEN 'id:' || id ELSE 'row:' || CAST(k AS VARCHAR) END AS key, 0 AS src, coalesce(updated, TIMESTAMP '0001-01-01') AS u FROM base
  UNION ALL SELECT inc.*, 'id:' || inc.id, 1, coalesce(updated, TIMESTAMP '9999-12-31') FROM inc WHERE id IN (SELECT id FROM known)
  UNION ALL SELECT rest.*, coalesce(CASE WHEN m.bk IS NOT NULL THEN CASE WHEN m.bid IS NOT NULL THEN 'id:' || m.bid ELSE 'row:' || CAST(m.bk AS VARCHAR) END END, 'id:' || rest.id),
    CASE WHEN m.bk IS NOT NULL THEN 2 ELSE 1 END, coalesce(updated, TIMESTAMP '9999-12-31') FROM rest LEFT JOIN m ON m.rid = rest.id),
 w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY (src = 2) DESC, u DESC, src DESC, time DESC) AS r FROM keyed) WHERE r = 1),
 z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(updated, TIMESTAMP '0001-01-01') DESC, src DESC) AS q FROM w WHERE id IS NOT NULL) WHERE q = 1
   UNION ALL SELECT *, 1 AS q FROM w WHERE id IS NULL)
 SELECT id, time, updated, {sql_round('latitude')} AS latitude, {sql_round('longitude')} AS longitude, depth, {sql_round('mag')} AS mag, net FROM z""")
def _(spark, sf):
    return rounded(cat.catalog_upsert(base_rows(spark, sf), incoming_rows(spark, sf), COLS), keep=("depth",))


@query("distinct_ids_added", f"WITH {BASE_SQL} SELECT DISTINCT id FROM inc WHERE id NOT IN (SELECT id FROM base WHERE id IS NOT NULL)")
def _(spark, sf):
    return cat.new_ids(incoming_rows(spark, sf), base_rows(spark, sf))


@query("input_cutoff", f"WITH {CATALOG_SQL} SELECT max(time) AS input_cutoff, count(*) AS n FROM catalog")
def _(spark, sf):
    return catalog(spark, sf).agg(F.max("time").alias("input_cutoff"), F.count(F.lit(1)).alias("n"))
