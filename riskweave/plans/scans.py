"""Scans and sinks (S1-S15): each plan lands rows derived from the driver tables and scans them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.plans.standins import CATALOG_SQL, FAULTS_SQL, READINGS_SQL, catalog, fault_vertices, readings, rounded, sql_round
from riskweave.registry import query
from riskweave.session import shared_dir, table
from riskweave.sources import files, schemas, sinks

TS = "yyyy-MM-dd HH:mm:ss"


@query("scan_catalog_csv", f"WITH {CATALOG_SQL} SELECT id, time, {sql_round('latitude')} AS latitude, {sql_round('mag')} AS mag FROM catalog")
def _(spark, sf):
    path = shared_dir(spark, "catalog-csv")
    c = catalog(spark, sf)
    c.select("id", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), F.date_format("time", TS).alias("updated"), "latitude",
             "longitude", "depth", "mag", F.lit("us").alias("net")).write.csv(path, header=True)
    return rounded(files.catalog_csv(spark, path, columns=["id", "time", "latitude", "mag"]))


@query("scan_geojson_events", f"""WITH {CATALOG_SQL} SELECT coalesce(CASE WHEN k % 7 <> 0 THEN id END, 'c' || id) AS id, time, CASE WHEN k % 5 <> 0 THEN time + INTERVAL 1 HOUR END AS updated,
  {sql_round('latitude')} AS latitude, {sql_round('longitude')} AS longitude, depth, {sql_round('mag')} AS mag, 'us' AS net FROM catalog WHERE k % 9 <> 0""")
def _(spark, sf):
    path = shared_dir(spark, "feed")
    c, k = catalog(spark, sf), F.col("k")
    def ms(x):
        return F.unix_millis(x.cast("timestamp"))
    props = F.struct(ms(F.col("time")).alias("time"), F.when(k % 5 != 0, ms(F.col("time")) + 3600000).alias("updated"),
                     F.when(k % 9 != 0, F.col("mag")).alias("mag"), F.lit("us").alias("net"), F.concat(F.lit("c"), "id").alias("code"))
    feature = F.struct(F.when(k % 7 != 0, F.col("id")).alias("id"), props.alias("properties"),
                       F.struct(F.array("longitude", "latitude", "depth").alias("coordinates")).alias("geometry"))
    docs = c.groupBy(F.floor(k / 500).alias("doc")).agg(F.collect_list(feature).alias("features"))
    docs.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.text(path)
    return rounded(files.geojson_events(spark, path))


SLIP_SQL = r"coalesce(TRY_CAST(nullif(regexp_extract(trim(slip_text), '^\(?\s*([0-9]*\.?[0-9]+)', 1), '') AS DOUBLE), 0e0)"


@query("scan_fault_geojson", f"""WITH {FAULTS_SQL} SELECT 'fault-' || CAST(fault AS VARCHAR) AS name, slip_type, {SLIP_SQL} AS slip, CAST(CASE WHEN fault % 4 = 0 AND pos >= 5 THEN 1 ELSE 0 END AS INTEGER) AS chain,
  CAST(CASE WHEN fault % 4 = 0 AND pos >= 5 THEN pos - 5 ELSE pos END AS INTEGER) AS pos, {sql_round('lon')} AS lon, {sql_round('lat')} AS lat FROM fault_vertices""")
def _(spark, sf):
    path = shared_dir(spark, "faults")
    v = fault_vertices(spark, sf)
    pts = v.groupBy("fault", "slip_type", "slip_text").agg(F.sort_array(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p"))
    line = F.transform("p", lambda x: F.array(x["lon"], x["lat"]))
    parts = F.array(F.slice(line, 1, 5), F.slice(line, 6, 5))
    multi = F.col("fault") % 4 == 0
    props = F.struct(F.concat(F.lit("fault-"), F.col("fault").cast("string")).alias("name"), "slip_type", F.col("slip_text").alias("net_slip_rate"))
    coords = F.when(multi, F.to_json(parts)).otherwise(F.to_json(line))
    head = F.to_json(F.struct(props.alias("properties")))
    feature = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(',"geometry":{"type":"'), F.when(multi, "MultiLineString").otherwise("LineString"),
                       F.lit('","coordinates":'), coords, F.lit("}}"))
    docs = pts.withColumn("h", head).select(F.floor(F.col("fault") / 50).alias("doc"), feature.alias("f")).groupBy("doc").agg(F.concat_ws(",", F.collect_list("f")).alias("fs"))
    docs.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "fs", F.lit("]}")).alias("value")).write.text(path)
    return rounded(files.fault_geojson(spark, path))


@query("scan_polyline_config", f"""WITH {FAULTS_SQL}, e AS (SELECT fault, pos, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM fault_vertices WINDOW w AS (PARTITION BY fault, pos // 5 ORDER BY pos)),
 p AS (SELECT fault, min_by(lon, pos) AS lon1, min_by(lat, pos) AS lat1, max_by(lon, pos) AS lon2, max_by(lat, pos) AS lat2 FROM fault_vertices GROUP BY fault)
 SELECT 'seg-' || CAST(fault AS VARCHAR) AS segment, CAST(pos // 5 AS INTEGER) AS chain, CAST(pos % 5 AS INTEGER) AS i, {sql_round('lon')} AS lon1, {sql_round('lat')} AS lat1, {sql_round('lon2')} AS lon2, {sql_round('lat2')} AS lat2
 FROM e WHERE lon2 IS NOT NULL AND fault % 3 <> 0 UNION ALL SELECT 'seg-' || CAST(fault AS VARCHAR), 0, 0, {sql_round('lon1')}, {sql_round('lat1')}, {sql_round('lon2')}, {sql_round('lat2')} FROM p WHERE fault % 3 = 0""")
def _(spark, sf):
    cfg, tr = shared_dir(spark, "config"), shared_dir(spark, "traces")
    v = fault_vertices(spark, sf)
    pts = v.groupBy("fault").agg(F.sort_array(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p"))
    name = F.concat(F.lit("trace-"), F.col("fault").cast("string"), F.lit(".json"))
    def end(x):
        return F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))
    trace = F.struct(name.alias("polyline_file"), end(F.element_at("p", 1)).alias("p1"), end(F.element_at("p", -1)).alias("p2"))
    pts.select(F.concat(F.lit("SEG_"), F.col("fault").cast("string")).alias("segment_id"), F.lit("transform").alias("regime"),
               F.lit(15.0).alias("corridor_half_width_km"), trace.alias("fault_trace")).write.json(cfg)
    line = F.transform("p", lambda x: F.array(x["lon"], x["lat"]))
    pts.filter("fault % 3 <> 0").select(name.alias("polyline_file"), F.array(F.slice(line, 1, 5), F.slice(line, 6, 5)).alias("polylines")).write.json(tr)
    return rounded(files.polyline_config(spark, cfg, tr).drop("regime", "corridor_half_width_km"))


@query("scan_fixed_width_gnss", f"""WITH {READINGS_SQL} SELECT 'ST' || CAST(station AS VARCHAR) AS station, day, {sql_round('(value / 1000e0 * sin(radians(30e0)) + volume / 1e6 * cos(radians(30e0))) * 1000e0', 4)} AS value FROM readings""")
def _(spark, sf):
    path = shared_dir(spark, "gnss")
    r = readings(spark, sf)
    mjd = F.datediff("day", F.lit("1858-11-17").cast("date"))
    line = F.concat_ws("  ", F.concat(F.lit("ST"), F.col("station").cast("string")), F.date_format("day", "yyMMdd"), F.lit("2000.1"), mjd.cast("string"),
                       F.lit("1"), F.lit("2"), F.lit("-120.5"), F.lit("0"), (F.col("value") / 1000).cast("string"), F.lit("0"), (F.col("volume") / 1e6).cast("string"),
                       F.lit("0"), F.lit("0.1"), F.lit("extra"))
    head = spark.range(1).select(F.lit("site YYMMMDD decyr MJD week d reflon e0 east n0 north u0 up").alias("value"))
    r.select(line.alias("value")).unionByName(head).write.text(path)
    return rounded(files.fixed_width_gnss(spark, path, 30.0), 4)


@query("scan_station_listing", f"""WITH {FAULTS_SQL} SELECT 'S' || CAST(fault AS VARCHAR) || '_' || CAST(pos AS VARCHAR) AS sta, {sql_round('lat')} AS lat, {sql_round('CASE WHEN lon + 5e0 > 180 THEN lon + 5e0 - 360 ELSE lon + 5e0 END')} AS lon,
  CAST(DATE '1995-01-01' + CAST(fault % 900 AS INTEGER) AS DATE) AS "begin", DATE '2001-06-30' AS "end" FROM fault_vertices WHERE fault % 5 <> 0""")
def _(spark, sf):
    path = shared_dir(spark, "stations")
    v = fault_vertices(spark, sf)
    begin = F.when(F.col("fault") % 5 == 0, "unknown").otherwise(F.date_add(F.lit("1995-01-01").cast("date"), (F.col("fault") % 900).cast("int")).cast("string"))
    line = F.concat_ws(" ", F.concat(F.lit("S"), F.col("fault").cast("string"), F.lit("_"), F.col("pos").cast("string")), F.col("lat").cast("string"), (F.col("lon") + 5.0).cast("string"),
                       F.lit("10.0 1 2 3"), begin, F.lit("2001-06-30 2001-07-01 100"))
    v.select(line.alias("value")).write.text(path)
    return rounded(files.station_listing(spark, path))


@query("scan_station_listing_piped", f"""WITH {FAULTS_SQL} SELECT 'P' || CAST(fault AS VARCHAR) || '_' || CAST(pos AS VARCHAR) AS sta, {sql_round('lat')} AS lat, {sql_round('lon')} AS lon,
  DATE '1996-02-01' AS "begin", DATE '2001-06-30' AS "end" FROM fault_vertices""")
def _(spark, sf):
    path = shared_dir(spark, "stations")
    sta = F.concat(F.lit("P"), F.col("fault").cast("string"), F.lit("_"), F.col("pos").cast("string"))
    fault_vertices(spark, sf).select(F.concat_ws("|", F.lit("PB"), sta, F.lit("--"), F.lit("BSM"), F.col("lat").cast("string"), F.col("lon").cast("string"),
                                                 F.lit("1996-02-01"), F.lit("2001-06-30")).alias("value")).write.text(path)
    return rounded(files.station_listing(spark, path, style="pipe"))


@query("scan_sensor_tsv", f"""WITH {READINGS_SQL} SELECT 'B' || CAST(station AS VARCHAR) AS station, ts, {sql_round('value')} AS value, CASE flag WHEN 'A' THEN 'g' ELSE 'i' END AS quality FROM readings WHERE flag <> 'N'""")
def _(spark, sf):
    path = shared_dir(spark, "strain")
    r = readings(spark, sf)
    flag = F.when(F.col("flag") == "A", " g ").when(F.col("flag") == "R", "i").otherwise("b")
    blank = [F.lit("0").alias(f"c{i}") for i in range(7)]
    r.select(F.concat(F.lit("B"), F.col("station").cast("string")).alias("strain"), F.date_format("ts", TS).alias("date"), F.lit("1").alias("doy"), F.lit("50000").alias("mjd"),
             F.col("value").cast("string").alias("areal"), F.lit("0").alias("off"), flag.alias("quality"), *blank).write.csv(path, sep="\t", header=True)
    return rounded(files.sensor_tsv(spark, path))


@query("scan_measurement_csv", f"""WITH {READINGS_SQL} SELECT 'T' || CAST(station AS VARCHAR) AS target, day, {sql_round('quantile_cont(value - 10, 0.5)')} AS sample_rms FROM readings WHERE value > 10 GROUP BY 1, 2""")
def _(spark, sf):
    path = shared_dir(spark, "metrics")
    q = F.lit('"')
    day = F.date_format("day", "yyyy/MM/dd")
    line = F.concat(q, (F.col("value") - 10).cast("string"), q, F.lit(',"'), F.concat(F.lit("T"), F.col("station").cast("string")), F.lit('","'), day, F.lit(' 00:00:00","'), day, F.lit(' 23:59:59","x"'))
    titles = spark.createDataFrame([("sample_rms Metric",), ('"value","target","start","end","lddate"',)], "value string")
    readings(spark, sf).select(line.alias("value")).unionByName(titles).write.text(path)
    return rounded(files.measurement_csv(spark, path))


@query("scan_observation_json", f"""WITH {READINGS_SQL} SELECT 'USGS-' || CAST(station AS VARCHAR) AS station, day, {sql_round("CASE WHEN flag <> 'N' THEN value END")} AS value FROM readings""")
def _(spark, sf):
    path = shared_dir(spark, "observations")
    p = F.struct(F.concat(F.lit("USGS-"), F.col("station").cast("string")).alias("monitoring_location_id"), F.col("day").cast("string").alias("time"),
                 F.when(F.col("flag") != "N", F.col("value").cast("string")).otherwise("Ice").alias("value"))
    readings(spark, sf).select(F.array(F.struct(p.alias("properties"))).alias("features")).write.json(path)
    return rounded(files.observation_json(spark, path))


WIDE_SQL = READINGS_SQL + """, wm AS (SELECT CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, 'W' || CAST(station AS VARCHAR) AS api, sum(CASE WHEN flag = 'A' THEN volume END) AS vol, max(CASE WHEN flag = 'R' THEN value END) AS psi FROM readings GROUP BY 1, 2, 3)"""


def well_months_wide(spark, sf):
    r = readings(spark, sf).withColumns({"year": F.year("day"), "month": F.month("day"), "api": F.concat(F.lit("W"), F.col("station").cast("string"))})
    g = r.groupBy("year", "api").pivot("month", list(range(1, 13))).agg(
        F.sum(F.when(F.col("flag") == "A", F.col("volume"))).alias("vol"), F.max(F.when(F.col("flag") == "R", F.col("value"))).alias("psi"))
    return g.select("year", "api", *[F.col(f"{i + 1}_{c}").alias(f"{m} {n}") for i, m in enumerate(schemas.MONTHS) for c, n in (("vol", "Vol"), ("psi", "PSI"))])


@query("scan_wide_months", f"WITH {WIDE_SQL} SELECT year, month, api, {sql_round('vol', 2)} AS vol_bbls, {sql_round('psi', 2)} AS psi FROM wm WHERE vol IS NOT NULL OR psi IS NOT NULL")
def _(spark, sf):
    return rounded(files.wide_months(well_months_wide(spark, sf), "year", "api"), 2)


@query("scan_gzip_csv", f"WITH {CATALOG_SQL} SELECT k, segment, {sql_round('mag')} AS mag FROM catalog")
def _(spark, sf):
    path = shared_dir(spark, "training")
    catalog(spark, sf).select("k", "segment", "mag").write.option("compression", "gzip").csv(path, header=True)
    return rounded(files.gzip_csv(spark, path, "k bigint, segment int, mag double", 8))


@query("sink_series", f"WITH {READINGS_SQL} SELECT segment, station, day, {sql_round('avg(value)')} AS value FROM readings GROUP BY 1, 2, 3")
def _(spark, sf):
    path = shared_dir(spark, "series")
    d = readings(spark, sf).groupBy("segment", "station", "day").agg(F.avg("value").alias("value"))
    sinks.write_series(d, path)
    return rounded(spark.read.schema("station int, day date, value double, segment int").parquet(path).select("segment", "station", "day", "value"))


@query("sink_table", f"WITH {CATALOG_SQL} SELECT CAST(year(day) AS INTEGER) AS year, k, {sql_round('mag')} AS mag FROM catalog WHERE year(day) >= 1998")
def _(spark, sf):
    path = shared_dir(spark, "table")
    c = catalog(spark, sf).select(F.year("day").alias("year"), "k", "mag")
    sinks.write_series(c, path, partition_by=["year"])
    # the year filter prunes folders
    return rounded(spark.read.schema("k bigint, mag double, year int").parquet(path).filter("year >= 1998").select("year", "k", "mag"))


@query("sink_json_document", f"""WITH {CATALOG_SQL} SELECT CAST(floor(latitude) AS DOUBLE) AS la, CAST(floor(longitude) AS DOUBLE) AS lo, {sql_round('max(mag)', 5)} AS p30, 'risk of large events' AS target FROM catalog GROUP BY 1, 2""")
def _(spark, sf):
    path = shared_dir(spark, "document")
    cells = catalog(spark, sf).groupBy(F.floor("latitude").alias("la"), F.floor("longitude").alias("lo")).agg(F.round(F.max("mag"), 5).alias("p30"))
    docs = sinks.json_documents(cells, "la", ["la", "lo", "p30"], {"target": F.lit("risk of large events")})
    docs.select("value").write.text(path)
    doc = spark.read.json(path, schema="target string, fields array<string>, n_cells int, cells array<array<double>>")
    return doc.select("target", F.explode("cells").alias("c")).select(
        F.col("c")[0].alias("la"), F.col("c")[1].alias("lo"), F.col("c")[2].alias("p30"), "target")


LEDGER_SQL = """issued AS (SELECT event_id, ts AS issued_at, value, date_trunc('hour', ts) + to_minutes(CAST(minute(ts) // 20 * 20 AS BIGINT)) AS slot, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS batch FROM events)"""


@query("ledger_append_once", f"""WITH {LEDGER_SQL} SELECT slot, event_id, {sql_round('value')} AS value, TRUE AS immutable FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY batch, issued_at, event_id) AS r FROM issued) WHERE r = 1""")
def _(spark, sf):
    path = shared_dir(spark, "ledger")
    e = table(spark, sf, "events").select("event_id", F.col("ts").alias("issued_at"), "value")
    for batch in (0, 1):
        sinks.ledger_append_once(e.filter(F.col("event_id") % 2 == batch), path, minutes=20)
    return rounded(spark.read.parquet(path).select("slot", "event_id", "value", "immutable"))


@query("table_fingerprint", """SELECT bit_xor(CAST('0x' || substr(sha256(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), l_returnflag, CAST(CAST(l_shipdate AS DATE) AS VARCHAR))), 1, 15) AS BIGINT)) AS fingerprint,
  count(*) AS n_rows FROM lineitem""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("ship", F.col("l_shipdate").cast("date"))
    return sinks.fingerprint(li, ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "ship"])
