"""Corridors, halos, nearest entities and kernel sums."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.functions import geo
from riskweave.functions.parsing import parse_slip_rate
from riskweave.operators import spatial as sp
from riskweave.plans.standins import (
    AFTER_LAST_SQL, after_last,
    CATALOG_SQL, EDGES_SQL, FAULTS_SQL, SEGMENTS_SQL, VERTEX_COLS, VERTEX_ROWS, catalog, fault_vertices, literal_table, rounded,
    segments, sql_days, sql_haversine, sql_round, trace_vertices, values)
from riskweave.registry import query
from riskweave.session import table

VERT_SQL = f"""vert AS (SELECT * FROM (VALUES {values(VERTEX_ROWS)}) AS t({VERTEX_COLS})),
ref AS (SELECT segment, avg(lat) AS ref_lat, avg(lon) AS ref_lon, min(lat) AS south, max(lat) AS north FROM vert GROUP BY segment)"""
DX = "((({a} - ({b}) + 180e0) % 360e0 + 360e0) % 360e0 - 180e0) * 111.32e0 * cos(radians(ref_lat))"
DIST_SQL = f"""{CATALOG_SQL}, {SEGMENTS_SQL}, {EDGES_SQL}, {VERT_SQL},
proj AS (SELECT c.*, half_width_km, azimuth, {DX.format(a='longitude', b='ref_lon')} AS x, (latitude - ref_lat) * 110.57e0 AS y,
   {DX.format(a='lon1', b='ref_lon')} AS x1, (lat1 - ref_lat) * 110.57e0 AS y1, {DX.format(a='lon2', b='ref_lon')} AS x2, (lat2 - ref_lat) * 110.57e0 AS y2
 FROM catalog c JOIN segments USING (segment) JOIN ref USING (segment) JOIN edges USING (segment)),
dd AS (SELECT *, least(1e0, greatest(0e0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + 1e-9))) AS t FROM proj),
pd AS (SELECT id, segment, day, mag, half_width_km, min(sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2))) AS dist_km,
   CAST(any_value(sign(-cos(radians(azimuth)) * x + sin(radians(azimuth)) * y)) AS INTEGER) AS side
 FROM dd GROUP BY id, segment, day, mag, half_width_km)"""


@query("point_to_polyline_distance", f"WITH {DIST_SQL} SELECT id, segment, {sql_round('dist_km', 5)} AS dist_km, side FROM pd")
def _(spark, sf):
    ev = catalog(spark, sf).join(segments(spark).select("segment", "azimuth"), "segment")
    out = sp.polyline_distance(ev, sp.traces(trace_vertices(spark)), azimuth="azimuth")
    return rounded(out.select("id", "segment", "dist_km", "side"), 5)


@query("corridor_filter", f"WITH {DIST_SQL} SELECT id, segment, day, {sql_round('dist_km', 5)} AS dist_km FROM pd WHERE dist_km <= half_width_km")
def _(spark, sf):
    ev = catalog(spark, sf).join(segments(spark).select("segment", "half_width_km"), "segment")
    out = sp.polyline_distance(ev, sp.traces(trace_vertices(spark)), max_km=F.col("half_width_km"))
    return rounded(out.select("id", "segment", "day", "dist_km"), 5)


@query("bbox_filter", f"""WITH {CATALOG_SQL} SELECT id, {sql_round('latitude')} AS latitude, {sql_round('longitude')} AS longitude FROM catalog
 WHERE latitude BETWEEN -20.5e0 - 0.25e0 AND -15e0 + 0.25e0 AND longitude BETWEEN 173e0 - 0.25e0 AND 178.5e0 + 0.25e0""")
def _(spark, sf):
    return rounded(sp.bbox_filter(catalog(spark, sf), "latitude", "longitude", -20.5, -15.0, 173.0, 178.5, 0.25)
                   .select("id", "latitude", "longitude"))


@query("mag_time_filter", f"""WITH {CATALOG_SQL} SELECT id, time FROM catalog WHERE mag >= 5.4e0 AND time >= TIMESTAMP '1997-01-01'
 AND time < TIMESTAMP '2000-01-01' AND abs(latitude) <= 89""")
def _(spark, sf):
    start, stop = (F.lit(d).cast("timestamp_ntz") for d in ("1997-01-01", "2000-01-01"))
    c = catalog(spark, sf)
    return c.filter((F.col("mag") >= 5.4) & (F.col("time") >= start) & (F.col("time") < stop)
                    & (F.abs("latitude") <= 89)).select("id", "time")


@query("event_day", f"WITH {CATALOG_SQL} SELECT id, CAST(time AS DATE) AS day FROM catalog")
def _(spark, sf):
    return catalog(spark, sf).select("id", F.to_date("time").alias("day"))


@query("grid_cell", f"""WITH {CATALOG_SQL} SELECT id, CAST(floor(latitude) AS INTEGER) AS la, CAST(floor(longitude) AS INTEGER) AS lo,
 CAST(CAST(round_even(latitude * 4, 0) AS INTEGER) AS VARCHAR) || '|' || CAST(CAST(round_even(longitude * 4, 0) AS INTEGER) AS VARCHAR) AS cell FROM catalog""")
def _(spark, sf):
    la, lo = geo.grid_cell("latitude", "longitude")
    return catalog(spark, sf).select("id", la.alias("la"), lo.alias("lo"), geo.quarter_cell("latitude", "longitude").alias("cell"))


CELLS_SQL = CATALOG_SQL + """, cells AS (SELECT CAST(floor(latitude) AS INTEGER) AS la, CAST(floor(longitude) AS INTEGER) AS lo, count(*) AS n, max(mag) AS mag_max,
   sum(mag) AS mag_sum, count(*) FILTER (WHERE mag >= 5.6e0) AS n_big, sum(mag) FILTER (WHERE mag >= 5.6e0) AS big_sum, max(mag) FILTER (WHERE mag >= 5.6e0) AS big_max
   FROM catalog GROUP BY 1, 2),
 offs AS (SELECT a.v AS da, b.v AS do_ FROM (VALUES (-1), (0), (1)) a(v), (VALUES (-1), (0), (1)) b(v)),
 halo AS (SELECT CAST(la + da AS INTEGER) AS la, CAST(((lo + do_ + 180) % 360 + 360) % 360 - 180 AS INTEGER) AS lo, n, mag_max, mag_sum, n_big, big_sum, big_max FROM cells, offs)"""


def own_cells(spark, sf):
    la, lo = geo.grid_cell("latitude", "longitude")
    big = F.col("mag") >= 5.6
    return catalog(spark, sf).groupBy(la.alias("la"), lo.alias("lo")).agg(
        F.count(F.lit(1)).alias("n"), F.max("mag").alias("mag_max"), F.sum("mag").alias("mag_sum"),
        F.count(F.when(big, 1)).alias("n_big"), F.sum(F.when(big, F.col("mag"))).alias("big_sum"),
        F.max(F.when(big, F.col("mag"))).alias("big_max"))


@query("halo_join", f"WITH {CELLS_SQL} SELECT la, lo, CAST(sum(n) AS BIGINT) AS n_hist, {sql_round('max(mag_max)')} AS mag_max FROM halo GROUP BY la, lo")
def _(spark, sf):
    return rounded(sp.halo(own_cells(spark, sf)).groupBy("la", "lo").agg(F.sum("n").alias("n_hist"), F.max("mag_max").alias("mag_max")))


@query("halo_mag_stats", f"""WITH {CELLS_SQL} SELECT la, lo, {sql_round('sum(big_sum) / sum(n_big)')} AS mag_mean, {sql_round('max(big_max)')} AS mag_max
 FROM halo GROUP BY la, lo HAVING sum(n_big) > 0""")
def _(spark, sf):
    out = sp.halo(own_cells(spark, sf)).groupBy("la", "lo").agg(
        F.sum("big_sum").alias("s"), F.sum("n_big").alias("n"), F.max("big_max").alias("mag_max"))
    return rounded(out.filter("n > 0").select("la", "lo", (F.col("s") / F.col("n")).alias("mag_mean"), "mag_max"))


@query("own_cell_counts", f"WITH {CELLS_SQL} SELECT la, lo, n FROM cells WHERE n >= 3")
def _(spark, sf):
    return own_cells(spark, sf).filter("n >= 3").select("la", "lo", "n")


SLIP_SQL = r"TRY_CAST(nullif(regexp_extract(trim(slip_text), '^\(?\s*([0-9]*\.?[0-9]+)', 1), '') AS DOUBLE)"


def fault_cells(spark, sf):
    la, lo = geo.grid_cell("lat", "lon")
    v = fault_vertices(spark, sf).filter((F.col("pos") % 3 == 0) & (F.abs("lat") <= 89))
    slip = F.coalesce(parse_slip_rate("slip_text"), F.lit(0.0))
    return v.groupBy(la.alias("la"), lo.alias("lo")).agg(F.max(slip).alias("slip"))


@query("max_slip_per_cell", f"""WITH {FAULTS_SQL} SELECT CAST(floor(lat) AS INTEGER) AS la, CAST(floor(lon) AS INTEGER) AS lo, max(coalesce({SLIP_SQL}, 0e0)) AS slip
 FROM fault_vertices WHERE pos % 3 = 0 AND abs(lat) <= 89 GROUP BY 1, 2""")
def _(spark, sf):
    return fault_cells(spark, sf)


@query("outer_dimension_merge", f"""WITH {CELLS_SQL}, {FAULTS_SQL}, s AS (SELECT CAST(floor(lat) AS INTEGER) AS la, CAST(floor(lon) AS INTEGER) AS lo,
   max(coalesce({SLIP_SQL}, 0e0)) AS slip FROM fault_vertices WHERE pos % 3 = 0 GROUP BY 1, 2)
 SELECT la, lo, coalesce(c.n, 0) AS n_own, coalesce(s.slip, 0e0) AS slip FROM (SELECT * FROM cells WHERE n >= 3) c FULL JOIN s USING (la, lo)""")
def _(spark, sf):
    own = own_cells(spark, sf).filter("n >= 3").select("la", "lo", "n")
    return own.join(fault_cells(spark, sf), ["la", "lo"], "full").select(
        "la", "lo", F.coalesce("n", F.lit(0)).alias("n_own"), F.coalesce("slip", F.lit(0.0)).alias("slip"))


@query("nearest_k_entities", f"""WITH {FAULTS_SQL}, {EDGES_SQL}, {VERT_SQL},
 st AS (SELECT CAST(fault AS VARCHAR) || '-' || CAST(pos AS VARCHAR) AS sta, lat, lon FROM fault_vertices),
 pr AS (SELECT sta, segment, {DX.format(a='lon', b='ref_lon')} AS x, (lat - ref_lat) * 110.57e0 AS y, {DX.format(a='lon1', b='ref_lon')} AS x1, (lat1 - ref_lat) * 110.57e0 AS y1,
   {DX.format(a='lon2', b='ref_lon')} AS x2, (lat2 - ref_lat) * 110.57e0 AS y2 FROM st, ref JOIN edges USING (segment)),
 tt AS (SELECT *, least(1e0, greatest(0e0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + 1e-9))) AS t FROM pr),
 ds AS (SELECT segment, sta, min(sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2))) AS dist_km FROM tt GROUP BY 1, 2),
 rk AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY round(dist_km, 6), sta) AS rank FROM ds WHERE dist_km <= 60e0)
 SELECT segment, sta, {sql_round('dist_km', 5)} AS dist_km, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 20""")
def _(spark, sf):
    st = fault_vertices(spark, sf).select(
        F.concat_ws("-", F.col("fault").cast("string"), F.col("pos").cast("string")).alias("sta"),
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    out = sp.nearest_k(st, sp.traces(trace_vertices(spark)), 60.0, 20, "sta")
    return rounded(out.select("segment", "sta", "dist_km", "rank"), 5)


PLACES = [("Suva", "Viti Levu", "Fiji", -18.14, 178.44), ("Nuku'alofa", "Tongatapu", "Tonga", -21.14, -175.2),
          ("Port Vila", "Efate", "Vanuatu", -17.73, 168.32), ("Gisborne", "North Island", "New Zealand", -38.66, 178.02)]


@query("nearest_place", f"""WITH {CATALOG_SQL}, places AS (SELECT * FROM (VALUES {values([(i, *p) for i, p in enumerate(PLACES)])}) AS t(i, city, region, country, plat, plon)),
 d AS (SELECT id, latitude, longitude, city, region, country, {sql_haversine('latitude', 'longitude', 'plat', 'plon')} AS km, i FROM catalog, places),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, i) AS r FROM d)
 SELECT id, city, CASE WHEN km > 700 THEN CASE WHEN longitude > -80 AND longitude < 20 THEN 'Atlantic seismic grid' WHEN longitude >= 20 AND longitude < 120 THEN 'Indian Ocean seismic grid'
   ELSE 'Pacific seismic grid' END ELSE region END AS place_region, country, CAST(round(km, 0) AS INTEGER) AS place_km, km > 700 AS remote FROM r WHERE r = 1""")
def _(spark, sf):
    out = sp.nearest_place(catalog(spark, sf), PLACES, remote_km=700.0)
    return out.select("id", "city", "place_region", "country", "place_km", "remote")


@query("spatiotemporal_exclusion", f"""WITH {CATALOG_SQL} SELECT id FROM catalog e WHERE mag >= 5e0 AND NOT EXISTS (SELECT 1 FROM catalog g WHERE g.mag >= 5.65e0
   AND {sql_days('e.time', 'g.time')} > 0 AND {sql_days('e.time', 'g.time')} < 30
   AND sqrt(pow((e.latitude - g.latitude) * 110.6e0, 2) + pow((e.longitude - g.longitude) * 92.6e0, 2)) < 30)""")
def _(spark, sf):
    c = catalog(spark, sf)
    return sp.spatiotemporal_exclusion(c.filter("mag >= 5.0"), c.filter("mag >= 5.65")).select("id")


@query("kernel_range_join", f"""WITH {CATALOG_SQL}, e AS (SELECT segment, time, pow(10e0, 0.9e0 * (mag - 5e0)) AS w FROM catalog WHERE mag >= 5.3e0),
 d AS (SELECT CAST(unnest(generate_series((SELECT CAST(min(day) + 1 AS TIMESTAMP) FROM catalog), {AFTER_LAST_SQL}, INTERVAL 1 DAY)) AS DATE) AS day)
 SELECT segment, day, {sql_round(f"sum(w / pow({sql_days('day', 'time')} + 0.02e0, 1.1e0))", 5)} AS excitation FROM e JOIN d ON CAST(d.day AS TIMESTAMP) > e.time GROUP BY segment, day""")
def _(spark, sf):
    e = catalog(spark, sf).filter("mag >= 5.3").withColumn("w", F.pow(F.lit(10.0), 0.9 * (F.col("mag") - 5.0)))
    return rounded(sp.kernel_intensity(e, ["segment"], "time", "w", 0.02, 1.1, after_last(spark, sf)), 5)


ZONES = [("north", -16.0, -10.0, 172.0, 180.0), ("west", -25.0, -10.0, 172.0, 176.0), ("far east", -25.0, -10.0, -180.0, -172.0), ("south", -25.0, -21.0, 172.0, 180.0)]
ZONES_SQL = f"zones AS (SELECT * FROM (VALUES {values(ZONES)}) AS t(zone, la0, la1, lo0, lo1))"


def zoned_cells(spark, sf):
    zones = literal_table(spark, ZONES, "zone, la0, la1, lo0, lo1")
    inside = F.col("la").between(F.col("la0"), F.col("la1")) & F.col("lo").between(F.col("lo0"), F.col("lo1"))
    return own_cells(spark, sf).join(F.broadcast(zones), inside)


@query("zone_tagging", f"WITH {CELLS_SQL}, {ZONES_SQL} SELECT la, lo, zone FROM cells JOIN zones ON la BETWEEN la0 AND la1 AND lo BETWEEN lo0 AND lo1")
def _(spark, sf):
    return zoned_cells(spark, sf).select("la", "lo", "zone")


@query("zone_summary", f"""WITH {CELLS_SQL}, {ZONES_SQL} SELECT zone, CASE WHEN la >= -17 THEN 'N' ELSE 'S' END AS half, count(*) AS n_cells, {sql_round('avg(mag_max)')} AS mean_p, {sql_round('max(mag_max)')} AS max_p,
  CASE WHEN count(*) >= 40 THEN 'PASS' WHEN count(*) >= 10 THEN 'WARN' ELSE 'FAIL' END AS verdict
 FROM cells JOIN zones ON la BETWEEN la0 AND la1 AND lo BETWEEN lo0 AND lo1 GROUP BY GROUPING SETS ((zone), (zone, half), (half))""")
def _(spark, sf):
    z = zoned_cells(spark, sf).withColumn("half", F.when(F.col("la") >= -17, "N").otherwise("S"))
    g = z.groupingSets([["zone"], ["zone", "half"], ["half"]], "zone", "half").agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg("mag_max").alias("mean_p"), F.max("mag_max").alias("max_p"))
    return rounded(g.withColumn("verdict", F.when(F.col("n_cells") >= 40, "PASS").when(F.col("n_cells") >= 10, "WARN").otherwise("FAIL")))


STEP_KM = sql_haversine("lat", "lon", "lead(lat) OVER w", "lead(lon) OVER w")
BEARING = """((degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) % 360e0) + 360e0) % 360e0"""
METRICS_SQL = FAULTS_SQL + f""", st AS (SELECT *, {STEP_KM} AS km FROM fault_vertices WINDOW w AS (PARTITION BY fault ORDER BY pos)),
 m AS (SELECT fault, sum(km) AS length_km, min_by(lon, pos) AS lon1, min_by(lat, pos) AS lat1, max_by(lon, pos) AS lon2, max_by(lat, pos) AS lat2, any_value(slip_type) AS slip_type,
   any_value({SLIP_SQL}) AS slip, avg(lat) AS clat, avg(lon) AS clon FROM st GROUP BY fault),
 metrics AS (SELECT *, {BEARING} AS azimuth, coalesce(slip, 0.5e0) * length_km AS activity FROM m)"""


def fault_metrics(spark, sf):
    v = fault_vertices(spark, sf)
    w = Window.partitionBy("fault").orderBy("pos")
    v = v.withColumn("km", geo.haversine_km("lat", "lon", F.lead("lat").over(w), F.lead("lon").over(w)))
    m = v.groupBy("fault").agg(
        F.sum("km").alias("length_km"), F.min_by("lon", "pos").alias("lon1"), F.min_by("lat", "pos").alias("lat1"),
        F.max_by("lon", "pos").alias("lon2"), F.max_by("lat", "pos").alias("lat2"), F.first("slip_type").alias("slip_type"),
        F.first(parse_slip_rate("slip_text")).alias("slip"), F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
    return m.withColumns({"azimuth": geo.bearing_deg("lat1", "lon1", "lat2", "lon2"),
                          "activity": F.coalesce("slip", F.lit(0.5)) * F.col("length_km")})


@query("polyline_metrics", f"""WITH {METRICS_SQL}, b AS (SELECT *, CAST(floor(clat / 5) AS INTEGER) AS box FROM metrics),
 r AS (SELECT *, row_number() OVER (PARTITION BY box ORDER BY activity DESC, fault) AS r FROM b)
 SELECT fault, {sql_round('length_km')} AS length_km, {sql_round('azimuth')} AS azimuth, {sql_round('activity')} AS activity, box, r = 1 AS top FROM r""")
def _(spark, sf):
    m = fault_metrics(spark, sf).withColumn("box", F.floor(F.col("clat") / 5).cast("int"))
    top = m.groupBy("box").agg(F.max(F.struct("activity", -F.col("fault"))).alias("best"))
    m = m.join(top, "box").withColumn("top", (-F.col("best.col2")) == F.col("fault"))
    return rounded(m.select("fault", "length_km", "azimuth", "activity", "box", "top"))


REGIMES = {"Subduction_Thrust": "subduction", "Reverse": "subduction", "Dextral": "transform", "Sinistral": "transform", "Normal": "normal"}


@query("derived_fault_scaling", f"""WITH {METRICS_SQL}, s AS (SELECT fault, slip_type, 5.08e0 + 1.16e0 * log10(greatest(length_km, 1e0)) AS m, coalesce(CASE WHEN slip <> 0 THEN slip END, 2e0) AS slip FROM metrics)
 SELECT fault, CASE slip_type WHEN 'Subduction_Thrust' THEN 'subduction' WHEN 'Reverse' THEN 'subduction' WHEN 'Normal' THEN 'normal' ELSE 'transform' END AS regime,
  {sql_round('m')} AS m_char, round_even(least(greatest(m - 2e0, 4e0), 5.5e0) * 2e0, 0) / 2e0 AS target_mag,
  {sql_round('greatest(pow(10e0, -4.80e0 + 0.69e0 * m) * 1000e0 / slip, 50e0)', 4)} AS t_rec FROM s""")
def _(spark, sf):
    m = fault_metrics(spark, sf)
    regime = F.lit("transform")
    for slip_type, r in REGIMES.items():
        regime = F.when(F.col("slip_type") == slip_type, r).otherwise(regime)
    m_char = 5.08 + 1.16 * F.log10(F.greatest(F.col("length_km"), F.lit(1.0)))
    slip = F.coalesce(F.when(F.col("slip") != 0, F.col("slip")), F.lit(2.0))
    out = m.select("fault", regime.alias("regime"), m_char.alias("m_char"),
                   (F.bround(F.least(F.greatest(m_char - 2.0, F.lit(4.0)), F.lit(5.5)) * 2, 0) / 2).alias("target_mag"),
                   F.greatest(F.pow(F.lit(10.0), -4.80 + 0.69 * m_char) * 1000.0 / slip, F.lit(50.0)).alias("t_rec"))
    return rounded(out, 6, keep=("t_rec",)).withColumn("t_rec", F.round("t_rec", 4) + F.lit(0.0))


XY_SQL = FAULTS_SQL + """, r AS (SELECT fault, avg(lat) AS rla, avg(lon) AS rlo FROM fault_vertices GROUP BY fault),
 xy AS (SELECT fault, (lon - rlo) * 111.32e0 * cos(radians(rla)) AS x, (lat - rla) * 110.57e0 AS y FROM fault_vertices JOIN r USING (fault)),
 cv AS (SELECT fault, 0.5e0 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS t FROM xy GROUP BY fault)"""


@query("principal_strike", f"""WITH {XY_SQL} SELECT fault, {sql_round('((degrees(atan2(cos(t) * (CASE WHEN sin(t) < 0 THEN -1 ELSE 1 END), sin(t) * (CASE WHEN sin(t) < 0 THEN -1 ELSE 1 END))) % 360) + 360) % 360', 4)} AS strike FROM cv""")
def _(spark, sf):
    v = fault_vertices(spark, sf)
    ref = v.groupBy("fault").agg(F.avg("lat").alias("ref_lat"), F.avg("lon").alias("ref_lon"))
    x, y = geo.local_xy_km("lat", "lon", "ref_lat", "ref_lon")
    xy = v.join(ref, "fault").select("fault", x.alias("x"), y.alias("y"))
    cv = xy.groupBy("fault").agg(F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cxy"))
    return rounded(cv.select("fault", geo.principal_axis_deg("vx", "vy", "cxy").alias("strike")), 4)


@query("segment_centroid", f"""WITH {FAULTS_SQL}, n AS (SELECT fault, avg(lat) AS lat, avg(lon) AS lon, greatest(1, count(*) // 4) AS step FROM fault_vertices GROUP BY fault)
 SELECT fault, {sql_round('any_value(n.lat)', 4)} AS lat, {sql_round('any_value(n.lon)', 4)} AS lon, count(*) AS kept FROM n JOIN fault_vertices v USING (fault) WHERE v.pos % step = 0 GROUP BY fault""")
def _(spark, sf):
    v = fault_vertices(spark, sf)
    n = v.groupBy("fault").agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon"),
                               F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 4)).alias("step"))
    kept = v.join(n, "fault").filter(F.col("pos") % F.col("step") == 0)
    out = kept.groupBy("fault").agg(F.first("clat").alias("lat"), F.first("clon").alias("lon"), F.count(F.lit(1)).alias("kept"))
    return rounded(out, 4)
