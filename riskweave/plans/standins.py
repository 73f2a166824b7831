"""Domain tables derived from the driver tables, in Spark and as SQL for the oracle.

The driver tables carry no catalog, sensors or faults, so both engines derive them by the same
formulas: orders are the event catalog, line items the sensor readings, customers the faults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.session import table

N_SEGMENTS = 8
SENSOR_UNIT = 1.0471975511965976
# (segment, regime, target magnitude, half width km, azimuth deg, reference rate, recurrence years)
SEGMENTS = [
    (0, "transform", 5.60, 150.0, 20.0, 20.0, 120.0),
    (1, "subduction", 5.55, 180.0, 25.0, 30.0, 200.0),
    (2, "induced", 5.60, 120.0, 35.0, 10.0, 80.0),
    (3, "transform", 5.50, 150.0, 40.0, 25.0, 150.0),
    (4, "subduction", 5.60, 200.0, 15.0, 40.0, 300.0),
    (5, "transform", 5.65, 150.0, 30.0, 22.0, 110.0),
    (6, "induced", 5.50, 100.0, 45.0, 12.0, 60.0),
    (7, "transform", 5.60, 160.0, 10.0, 28.0, 140.0),
]
# segment -> vertices (lon, lat) of its trace
TRACES = {
    s: [(172.5 + 0.7 * s, -24.0 + 1.2 * s), (173.5 + 0.7 * s, -22.8 + 1.2 * s),
        (174.0 + 0.7 * s, -21.5 + 1.2 * s)]
    for s in range(N_SEGMENTS)
}


def values(rows) -> str:
    """Rows of Python values as the body of a SQL VALUES list."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        if isinstance(v, int):
            return f"CAST({v} AS INTEGER)"
        return "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


def literal_table(spark: SparkSession, rows, columns: str) -> DataFrame:
    """A small constant table; its size is fixed by the code."""
    return spark.sql(f"SELECT * FROM VALUES {values(rows)} AS t({columns})")


SEGMENT_COLS = "segment, regime, target_mag, half_width_km, azimuth, v_ref, t_rec"
SEGMENTS_SQL = f"segments AS (SELECT * FROM (VALUES {values(SEGMENTS)}) AS t({SEGMENT_COLS}))"
EDGE_ROWS = [
    (s, i, v[i][0], v[i][1], v[i + 1][0], v[i + 1][1]) for s, v in TRACES.items() for i in range(len(v) - 1)
]
EDGE_COLS = "segment, i, lon1, lat1, lon2, lat2"
EDGES_SQL = f"edges AS (SELECT * FROM (VALUES {values(EDGE_ROWS)}) AS t({EDGE_COLS}))"
VERTEX_ROWS = [(s, i, p[0], p[1]) for s, v in TRACES.items() for i, p in enumerate(v)]
VERTEX_COLS = "segment, i, lon, lat"


def segments(spark) -> DataFrame:
    return literal_table(spark, SEGMENTS, SEGMENT_COLS)


def trace_vertices(spark) -> DataFrame:
    return literal_table(spark, VERTEX_ROWS, VERTEX_COLS)


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Event catalog: id, k, segment, time, day, latitude, longitude, depth, mag."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    lon = F.lit(172.0) + (k * 91 % 1493) / F.lit(100.0)
    return o.select(
        k.cast("string").alias("id"), k.alias("k"),
        (F.col("o_custkey") % N_SEGMENTS).cast("int").alias("segment"),
        F.timestamp_add("SECOND", (k * 7919 % 86400).cast("int"), F.col("o_orderdate")).alias("time"),
        F.col("o_orderdate").cast("date").alias("day"),
        ((k * 37 % 1499) / F.lit(100.0) - 25.0).alias("latitude"),
        F.when(lon >= 180, lon - 360).otherwise(lon).alias("longitude"),
        ((k % 600) / F.lit(10.0)).alias("depth"),
        F.log10("o_totalprice").alias("mag"))


CATALOG_SQL = """catalog AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS k, CAST(o_custkey % 8 AS INTEGER) AS segment,
         o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS time, CAST(o_orderdate AS DATE) AS day,
         CAST(o_orderkey * 37 % 1499 AS DOUBLE) / 100e0 - 25e0 AS latitude,
         CASE WHEN 172e0 + CAST(o_orderkey * 91 % 1493 AS DOUBLE) / 100e0 >= 180e0
              THEN 172e0 + CAST(o_orderkey * 91 % 1493 AS DOUBLE) / 100e0 - 360e0
              ELSE 172e0 + CAST(o_orderkey * 91 % 1493 AS DOUBLE) / 100e0 END AS longitude,
         CAST(o_orderkey % 600 AS DOUBLE) / 10e0 AS depth, log10(o_totalprice) AS mag
  FROM orders)"""


def after_last(spark: SparkSession, sf: str):
    """The day after the last event of the catalog: the instant of all live views."""
    return catalog(spark, sf).agg(F.date_add(F.max("day"), 1)).first()[0]


#: The same instant in SQL.
AFTER_LAST_SQL = "(SELECT CAST(max(day) + 1 AS TIMESTAMP) FROM catalog)"


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Sensor readings: station, segment, ts, day, value, volume, flag, side."""
    li = table(spark, sf, "lineitem")
    st = F.col("l_suppkey") % 12
    return li.select(
        st.cast("int").alias("station"), (st % 4).cast("int").alias("segment"),
        F.col("l_shipdate").alias("ts"), F.col("l_shipdate").cast("date").alias("day"),
        ((F.col("l_quantity") + F.col("l_discount") * 10) * SENSOR_UNIT).alias("value"),
        F.col("l_extendedprice").alias("volume"), F.col("l_returnflag").alias("flag"),
        F.when(st % 3 == 0, -1).when(st % 3 == 1, 1).otherwise(0).alias("side"))


READINGS_SQL = """readings AS (
  SELECT CAST(l_suppkey % 12 AS INTEGER) AS station, CAST(l_suppkey % 12 % 4 AS INTEGER) AS segment,
         l_shipdate AS ts, CAST(l_shipdate AS DATE) AS day, (l_quantity + l_discount * 10) * 1.0471975511965976e0 AS value,
         l_extendedprice AS volume, l_returnflag AS flag,
         CASE l_suppkey % 12 % 3 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS side
  FROM lineitem)"""


def fault_vertices(spark: SparkSession, sf: str) -> DataFrame:
    """Fault vertices: fault, pos, lon, lat, slip_type, slip_text (ten vertices per fault)."""
    c = table(spark, sf, "customer")
    f = F.floor(F.col("c_custkey") / 10)
    i = (F.col("c_custkey") % 10).cast("int")
    first = F.col("c_custkey") - F.col("c_custkey") % 10
    return c.select(
        f.cast("bigint").alias("fault"), i.alias("pos"),
        (F.lit(172.0) + (f * 91 % 700) / F.lit(100.0) + i * 0.04 + (f * i % 5) * 0.01).alias("lon"),
        ((f * 37 % 1499) / F.lit(100.0) - 25.0 + i * 0.05 + (f * i % 7) * 0.01).alias("lat"),
        F.element_at(F.array(*[F.lit(x) for x in FAULT_TYPES]), (f % 5 + 1).cast("int")).alias("slip_type"),
        F.when(f % 6 == 0, "").otherwise(
            F.concat(F.lit("("), (first % 97 / F.lit(10.0)).cast("string"), F.lit(",0.1,9.0)"))).alias("slip_text"))


FAULT_TYPES = ["Reverse", "Dextral", "Normal", "Sinistral", "Subduction_Thrust"]
FAULTS_SQL = """fault_vertices AS (
  SELECT c_custkey // 10 AS fault, CAST(c_custkey % 10 AS INTEGER) AS pos,
         172e0 + CAST((c_custkey // 10) * 91 % 700 AS DOUBLE) / 100e0 + (c_custkey % 10) * 0.04e0
           + ((c_custkey // 10) * (c_custkey % 10) % 5) * 0.01e0 AS lon,
         CAST((c_custkey // 10) * 37 % 1499 AS DOUBLE) / 100e0 - 25e0 + (c_custkey % 10) * 0.05e0
           + ((c_custkey // 10) * (c_custkey % 10) % 7) * 0.01e0 AS lat,
         list_extract(['Reverse', 'Dextral', 'Normal', 'Sinistral', 'Subduction_Thrust'],
                      (c_custkey // 10) % 5 + 1) AS slip_type,
         CASE WHEN (c_custkey // 10) % 6 = 0 THEN ''
              ELSE '(' || CAST(CAST((c_custkey - c_custkey % 10) % 97 AS DOUBLE) / 10e0 AS VARCHAR)
                   || ',0.1,9.0)' END AS slip_text
  FROM customer)"""


def score_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Scored labels: id, day, grp, y, p, w -- events with value >= 120 are the positives."""
    e = table(spark, sf, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("id"), F.col("ts"), F.col("ts").cast("date").alias("day"), F.col("event_type").alias("grp"),
        (F.col("user_id") % 20).cast("int").alias("episode"),
        (F.col("value") >= 120).cast("int").alias("y"),
        (F.lit(0.02) + (k * 7919 % 1000) / F.lit(1250.0) * F.when(F.col("value") >= 100, 1.0).otherwise(0.55))
        .alias("p"),
        (1 + k % 3).cast("double").alias("w"), F.col("value"))


SCORES_SQL = """scores AS (
  SELECT event_id AS id, ts, CAST(ts AS DATE) AS day, event_type AS grp, CAST(user_id % 20 AS INTEGER) AS episode,
         CAST(value >= 120 AS INTEGER) AS y,
         0.02e0 + CAST(event_id * 7919 % 1000 AS DOUBLE) / 1250e0 * (CASE WHEN value >= 100 THEN 1e0 ELSE 0.55e0 END)
           AS p,
         CAST(1 + event_id % 3 AS DOUBLE) AS w, value
  FROM events)"""


def sql_round(expr: str, digits: int = 6) -> str:
    """Rounded value without negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0e0)"


def sql_membership(x: str, p) -> str:
    """Membership degree in SQL; null input stays null."""
    sides = ["1e0"]
    if p[1] > p[0]:
        sides.append(f"(({x}) - ({float(p[0])!r}::DOUBLE)) / {float(p[1] - p[0] + 1e-12)!r}::DOUBLE")
    if p[-1] > p[-2]:
        sides.append(f"(({float(p[-1])!r}::DOUBLE) - ({x})) / {float(p[-1] - p[-2] + 1e-12)!r}::DOUBLE")
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest(least({', '.join(sides)}), 0e0) END)"


def sql_degree0(x: str, p) -> str:
    return f"coalesce({sql_membership(x, p)}, 0e0)"


def rounded(df: DataFrame, digits: int = 6, keep=()) -> DataFrame:
    """Round every double column for comparison."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() in ("double", "float") and f.name not in keep:
            c = (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name)
        out.append(c)
    return df.select(*out)


def sql_haversine(lat1, lon1, lat2, lon2) -> str:
    dl = f"(((({lon2}) - ({lon1}) + 180e0) % 360e0 + 360e0) % 360e0 - 180e0)"
    return (f"(2 * 6371e0 * asin(sqrt(least(1e0, greatest(0e0, pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * pow(sin(radians({dl}) / 2), 2))))))")


def sql_days(later, earlier) -> str:
    """Elapsed days with fraction between two timestamps."""
    return f"((epoch_us(CAST({later} AS TIMESTAMP)) - epoch_us(CAST({earlier} AS TIMESTAMP))) / 86400e6)"
