"""File scans. Every scan has an explicit schema and yields rows in the library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.parsing import epoch_ms, fields, parse_slip_rate, parse_timestamp
from riskweave.functions.probability import mjd_to_date
from riskweave.sources import schemas


def catalog_csv(spark: SparkSession, path: str, columns=None, schema: str = schemas.CATALOG) -> DataFrame:
    """Catalog CSV with a header; only the wanted columns are parsed. Bad timestamps become null."""
    schema = T.StructType.fromDDL(schema)
    text = T.StructType([T.StructField(f.name, T.StringType() if f.dataType == T.TimestampNTZType() else f.dataType)
                         for f in schema.fields])
    df = spark.read.csv(path, schema=text, header=True, enforceSchema=False)
    out = [parse_timestamp(f.name).alias(f.name) if f.dataType == T.TimestampNTZType() else F.col(f.name)
           for f in schema.fields if columns is None or f.name in columns]
    return df.select(*out)


def geojson_events(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Event feed (FeatureCollection documents) to catalog rows; events without magnitude are dropped."""
    return feed_rows(spark.read.json(path, schema=schemas.FEED, multiLine=multi_line))


def feed_rows(docs: DataFrame) -> DataFrame:
    f = docs.select(F.explode("features").alias("f"))
    p, xyz = F.col("f.properties"), F.col("f.geometry.coordinates")
    return f.filter(F.col("f.properties.mag").isNotNull()).select(
        F.coalesce(F.nullif(F.col("f.id"), F.lit("")), p["code"]).alias("id"), epoch_ms(p["time"]).alias("time"),
        epoch_ms(p["updated"]).alias("updated"), F.get(xyz, F.lit(1)).alias("latitude"), F.get(xyz, F.lit(0)).alias("longitude"),
        F.get(xyz, F.lit(2)).alias("depth"), p["mag"].alias("mag"), p["net"].alias("net"))


def fault_geojson(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Fault traces (LineString or MultiLineString) to vertex rows with name, type and slip rate."""
    f = spark.read.json(path, schema=schemas.FAULTS, multiLine=multi_line).select(F.explode("features").alias("f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    line, multi = "array<array<double>>", "array<array<array<double>>>"
    lines = F.when(kind == "LineString", F.array(F.from_json(raw, line))).when(kind == "MultiLineString", F.from_json(raw, multi))
    props = F.col("f.properties")
    head = f.select(props["name"].alias("name"), props["slip_type"].alias("slip_type"),
                    F.coalesce(parse_slip_rate(props["net_slip_rate"]), F.lit(0.0)).alias("slip"), lines.alias("lines"))
    chains = head.select("name", "slip_type", "slip", F.posexplode("lines").alias("chain", "line"))
    return chains.select("name", "slip_type", "slip", "chain", F.posexplode("line").alias("pos", "pt")).select(
        "name", "slip_type", "slip", "chain", "pos", F.col("pt")[0].alias("lon"), F.col("pt")[1].alias("lat"))


def segment_slug(c):
    return F.replace(F.lower(c), F.lit("_"), F.lit("-"))


def polyline_config(spark: SparkSession, config_path: str, trace_path: str) -> DataFrame:
    """Segment configuration and trace documents to one row per trace edge.

    A segment without a trace document uses its two end points.
    """
    cfg = spark.read.json(config_path, schema=schemas.SEGMENT_CONFIG)
    tr = spark.read.json(trace_path, schema=schemas.TRACE)
    t = F.col("fault_trace")
    two_points = F.array(F.array(F.array(t["p1"]["lon"], t["p1"]["lat"]), F.array(t["p2"]["lon"], t["p2"]["lat"])))
    joined = cfg.withColumn("polyline_file", t["polyline_file"]).join(tr, "polyline_file", "left")
    chains = joined.select(segment_slug(F.col("segment_id")).alias("segment"), "regime", "corridor_half_width_km",
                           F.posexplode(F.coalesce("polylines", two_points)).alias("chain", "pts"))
    edges = F.arrays_zip(F.slice("pts", F.lit(1), F.size("pts") - 1).alias("a"), F.slice("pts", F.lit(2), F.size("pts") - 1).alias("b"))
    e = chains.select("segment", "regime", "corridor_half_width_km", "chain", F.posexplode(edges).alias("i", "e"))
    return e.select("segment", "regime", "corridor_half_width_km", "chain", "i",
                    F.col("e.a")[0].alias("lon1"), F.col("e.a")[1].alias("lat1"), F.col("e.b")[0].alias("lon2"), F.col("e.b")[1].alias("lat2"))


def fixed_width_gnss(spark: SparkSession, path: str, azimuth_deg: float) -> DataFrame:
    """Whitespace-delimited position series: station, day and fault-parallel motion in millimetres."""
    import math

    p = spark.read.text(path).select(fields("value").alias("p")).filter((F.size("p") >= 13) & (F.get("p", F.lit(0)) != "site"))
    def number(i):
        return F.get("p", F.lit(i)).try_cast("double")
    along = (number(8) * math.sin(math.radians(azimuth_deg)) + number(10) * math.cos(math.radians(azimuth_deg))) * 1000.0
    return p.select(F.get("p", F.lit(0)).alias("station"), mjd_to_date(number(3)).alias("day"), along.alias("value"))


def station_listing(spark: SparkSession, path: str, style: str = "space") -> DataFrame:
    """Station listing, space- or pipe-delimited: sta, lat, lon (-180..180), begin, end; bad rows dropped."""
    lines = spark.read.text(path)
    if style == "pipe":
        p = lines.select(F.split("value", r"\|").alias("p"))
        where, first, last = (1, 4, 5), 6, 7
    else:
        p = lines.select(fields("value").alias("p")).filter(F.size("p") >= 11)
        where, first, last = (0, 1, 2), 7, 8
    def at(i):
        return F.get("p", F.lit(i))
    lon = at(where[2]).try_cast("double")
    out = p.select(at(where[0]).alias("sta"), at(where[1]).try_cast("double").alias("lat"),
                   F.when(lon > 180, lon - 360).otherwise(lon).alias("lon"),
                   at(first).try_cast("date").alias("begin"), at(last).try_cast("date").alias("end"))
    return out.dropna(subset=["lat", "lon", "begin", "end"])


def sensor_tsv(spark: SparkSession, path: str, quality=("g", "i")) -> DataFrame:
    """Tab-separated strain readings (14 columns, own header row ignored), good quality only."""
    df = spark.read.csv(path, schema=schemas.STRAIN_TSV, sep="\t", header=True, enforceSchema=True)
    flag = F.trim("quality")
    return df.filter(flag.isin(*quality)).select(
        F.trim("strain").alias("station"), F.trim("date").try_cast("timestamp_ntz").alias("ts"),
        F.trim("areal_mstrain").try_cast("double").alias("value"), flag.alias("quality"))


def measurement_csv(spark: SparkSession, path: str) -> DataFrame:
    """Metric text with a title and a header line; positive values, median per target and day."""
    lines = spark.read.text(path)
    row = F.from_csv("value", "value double, target string, start string, end string, lddate string")
    parsed = lines.filter(F.col("value").rlike(r'^"?[0-9.eE+-]+"?,')).select(row.alias("r"))
    day = F.to_date(F.substring("r.start", 1, 10), "yyyy/MM/dd")
    from riskweave.operators.evaluation import grouped_quantile

    rows = parsed.select(F.col("r.target").alias("target"), day.alias("day"), F.col("r.value").alias("v")).filter("v > 0")
    return grouped_quantile(rows, ["target", "day"], "v", 0.5, "sample_rms")


def observation_json(spark: SparkSession, path: str) -> DataFrame:
    """Observation features to (station, day, value); non-numeric values become null."""
    f = spark.read.json(path, schema=schemas.OBSERVATIONS).select(F.explode("features.properties").alias("p"))
    return f.select(F.col("p.monitoring_location_id").alias("station"), F.col("p.time").try_cast("date").alias("day"),
                    F.col("p.value").try_cast("double").alias("value"))


def wide_months(df: DataFrame, year: str, well: str) -> DataFrame:
    """``Jan Vol, Jan PSI, ...`` columns to one row per month; rows without both values are skipped."""
    months = F.array(*[F.struct(F.lit(i + 1).alias("month"), F.col(f"{m} Vol").cast("string").try_cast("double").alias("vol_bbls"),
                                F.col(f"{m} PSI").cast("string").try_cast("double").alias("psi"),
                                (F.col(f"{m} Vol").isNull() & F.col(f"{m} PSI").isNull()).alias("empty"))
                       for i, m in enumerate(schemas.MONTHS)])
    long = df.select(F.col(year).alias("year"), F.col(well).alias("api"), F.explode(months).alias("m")).filter("not m.empty")
    return long.select("year", "m.month", "api", "m.vol_bbls", "m.psi")


def gzip_csv(spark: SparkSession, path: str, schema: str, partitions: int | None = None) -> DataFrame:
    """Gzip CSV table. A gzip file is one task, so rows are spread again when *partitions* is given;
    land such tables as Parquet before using them at scale."""
    df = spark.read.csv(path, schema=schema, header=True)
    return df.repartition(partitions) if partitions else df
