"""Raster plans in long form."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.probability import phase_to_mm
from riskweave.operators import sensors
from riskweave.plans.standins import CATALOG_SQL, VERTEX_ROWS, catalog, literal_table, rounded, sql_round, values
from riskweave.registry import query
from riskweave.session import table

#: Configured points: the trace vertices and two beyond the rim of the grid.
POINTS = [(10 * s + i, lat, lon) for s, i, lon, lat in VERTEX_ROWS] + [(900, -28.0, 175.0), (901, -12.0, 190.0)]
GRID_SQL = CATALOG_SQL + f""", gr AS (SELECT CAST(date_trunc('year', day) AS DATE) AS day, CAST(k % 2 AS INTEGER) AS map, -25e0 + 5e0 * (k % 4) AS lat, 172e0 + 2e0 * (k // 4 % 5) AS lon, avg(mag) AS vtec FROM catalog GROUP BY 1, 2, 3, 4),
 pt AS (SELECT * FROM (VALUES {values(POINTS)}) AS t(point, latitude, longitude)), yx AS (SELECT point, greatest(0e0, least((latitude + 25) / 5, 3e0)) AS y, greatest(0e0, least((longitude - 172) / 2, 4e0)) AS x FROM pt),
 cn AS (SELECT point, least(floor(y), 2) AS i, least(floor(x), 3) AS j, y - least(floor(y), 2) AS ti, x - least(floor(x), 3) AS tj FROM yx),
 co AS (SELECT point, i + a AS gi, j + b AS gj, (CASE a WHEN 1 THEN ti ELSE 1 - ti END) * (CASE b WHEN 1 THEN tj ELSE 1 - tj END) AS w FROM cn, range(2) x(a), range(2) y(b)),
 pm AS (SELECT point, day, map, sum(w * vtec) / sum(w) AS v FROM co JOIN gr ON w > 0 AND gi = round((lat + 25) / 5) AND gj = round((lon - 172) / 2) GROUP BY 1, 2, 3)"""


@query("bilinear_interpolate", f"WITH {GRID_SQL} SELECT point, day, {sql_round('avg(v)')} AS vtec FROM pm GROUP BY point, day")
def _(spark, sf):
    c = catalog(spark, sf)
    k = F.col("k")
    g = c.groupBy(F.trunc("day", "YEAR").alias("day"), (k % 2).cast("int").alias("map"), (F.lit(-25.0) + 5.0 * (k % 4)).alias("lat"), (F.lit(172.0) + 2.0 * (F.floor(k / 4) % 5)).alias("lon")).agg(F.avg("mag").alias("vtec"))
    p = literal_table(spark, POINTS, "point, latitude, longitude")
    return rounded(sensors.bilinear(p, g, 5.0, 2.0, -25.0, 172.0, 4, 5))


PIX_SQL = """px AS (SELECT CAST(l_suppkey % 10 AS INTEGER) AS pair, CAST(l_partkey % 80 AS INTEGER) AS row, CAST(l_orderkey % 90 AS INTEGER) AS col, avg(CASE WHEN l_linenumber = 3 THEN 0e0 ELSE ln(l_extendedprice) + 0.01e0 * (l_partkey % 80) - 0.02e0 * (l_orderkey % 90) END) AS phase FROM lineitem GROUP BY 1, 2, 3),
 ok AS (SELECT * FROM px WHERE phase <> 0), s AS (SELECT pair, count(*) AS n, avg(row) AS mr, avg(col) AS mc, avg(phase) AS mv, var_pop(row) AS rr, var_pop(col) AS cc, covar_pop(row, col) AS rc, covar_pop(row, phase) AS rv, covar_pop(col, phase) AS cv FROM ok GROUP BY pair),
 pl AS (SELECT *, (rv * cc - cv * rc) / (rr * cc - rc * rc) AS b, (cv * rr - rv * rc) / (rr * cc - rc * rc) AS c FROM s WHERE n >= 1000),
 dt AS (SELECT pair, row, col, phase - (mv + b * (row - mr) + c * (col - mc)) AS phase FROM ok JOIN pl USING (pair))"""


def pixels(spark, sf):
    li = table(spark, sf, "lineitem")
    r, c = F.col("l_partkey") % 80, F.col("l_orderkey") % 90
    v = F.when(F.col("l_linenumber") == 3, 0.0).otherwise(F.log("l_extendedprice") + 0.01 * r - 0.02 * c)
    return li.groupBy((F.col("l_suppkey") % 10).cast("int").alias("pair"), r.cast("int").alias("row"), c.cast("int").alias("col")).agg(F.avg(v).alias("phase"))


@query("plane_detrend", f"WITH {PIX_SQL} SELECT pair, row, col, {sql_round('phase')} AS phase FROM dt")
def _(spark, sf):
    return rounded(sensors.plane_detrend(pixels(spark, sf), "pair").select("pair", "row", "col", "phase"))


CENTRES = [(1, 2, 5), (2, 40, 45), (3, 70, 80)]
AOI_SQL = PIX_SQL + f""", ct AS (SELECT * FROM (VALUES {', '.join(map(str, CENTRES))}) AS t(centre, cr, cc_)), nr AS (SELECT dt.pair, centre, greatest(abs(dt.row - cr), abs(dt.col - cc_)) AS d, phase FROM dt, ct WHERE phase <> 0),
 ag AS (SELECT pair, centre, count(*) FILTER (WHERE d <= 2) AS n2, quantile_cont(phase, 0.5) FILTER (WHERE d <= 2) AS m2, count(*) FILTER (WHERE d <= 5) AS n5, quantile_cont(phase, 0.5) FILTER (WHERE d <= 5) AS m5, count(*) FILTER (WHERE d <= 15) AS n15, quantile_cont(phase, 0.5) FILTER (WHERE d <= 15) AS m15 FROM nr GROUP BY 1, 2),
 med AS (SELECT pair, centre, CASE WHEN n2 >= 20 THEN 2 WHEN n5 >= 20 THEN 5 WHEN n15 >= 20 THEN 15 END AS half, CASE WHEN n2 >= 20 THEN m2 WHEN n5 >= 20 THEN m5 WHEN n15 >= 20 THEN m15 END AS phase, CASE WHEN n2 >= 20 THEN n2 WHEN n5 >= 20 THEN n5 ELSE n15 END AS n_px FROM ag WHERE n15 >= 20)"""


def medians(spark, sf):
    d = sensors.plane_detrend(pixels(spark, sf), "pair").select("pair", "row", "col", "phase")
    centres = spark.createDataFrame([(i, r, c) for i, r, c in CENTRES], "centre int, row int, col int")
    pairs = d.select("pair").distinct().crossJoin(F.broadcast(centres))
    return sensors.window_median(d, pairs, "pair", (2, 5, 15), 20)


@query("aoi_median_expand", f"WITH {AOI_SQL}, lk AS (SELECT centre FROM med ORDER BY pair, centre LIMIT 1) SELECT pair, med.centre, CAST(half AS INTEGER) AS half, {sql_round('phase')} AS phase, n_px FROM med JOIN lk USING (centre)")
def _(spark, sf):
    m = medians(spark, sf)
    lock = sensors.lock_centre(m, "pair", "pair")
    return rounded(m.join(F.broadcast(lock), "centre").select("pair", "centre", "half", "phase", "n_px"))


@query("interferogram_stack", f"""WITH p AS (SELECT CAST(o_orderdate AS DATE) AS d1, CAST(o_orderdate AS DATE) + CAST(6 + o_orderkey % 60 AS INTEGER) AS d2, (log10(o_totalprice) - 5e0) * 0.055465763e0 * 1000 / (4 * pi()) / (6 + o_orderkey % 60) AS rate FROM orders),
 k AS (SELECT (d1 - DATE '1996-01-01') // 30 AS bin, rate FROM p WHERE d1 >= DATE '1996-01-01' AND d2 <= DATE '2001-01-01' AND d2 - d1 <= 48) SELECT CAST(bin AS INTEGER) AS bin, {sql_round('quantile_cont(rate, 0.5)')} AS los_rate, count(*) AS n_pairs, CAST(DATE '1996-01-01' + CAST(bin * 30 + 15 AS INTEGER) AS DATE) AS day FROM k GROUP BY bin""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    gap = (6 + F.col("o_orderkey") % 60).cast("int")
    d1 = F.col("o_orderdate").cast("date")
    p = o.select(d1.alias("d1"), F.date_add(d1, gap).alias("d2"), (phase_to_mm(F.log10("o_totalprice") - 5.0) / gap).alias("rate"))
    return rounded(sensors.interferogram_stack(p, "rate", "d1", "d2", "1996-01-01", "2001-01-01").select("bin", "los_rate", "n_pairs", "day"))
