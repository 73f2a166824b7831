"""Streaming plans (R1-R7, R9, R10): run with availableNow and compared with their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import cells as ce
from riskweave.plans.aggregating import MONTH_SQL, monthly
from riskweave.plans.catalogs import BASE_SQL as UPSERT_BASE_SQL, COLS, base_rows, incoming_rows
from riskweave.plans.global_cells import FEATS, GRID_SQL, ORIGIN
from riskweave.plans.joining import BIG, INDEP_SQL
from riskweave.plans.spatial import fault_cells, own_cells
from riskweave.plans.standins import CATALOG_SQL, catalog, readings, rounded, sql_days, sql_haversine, sql_round
from riskweave.registry import query
from riskweave.session import cut_lineage, shared_dir
from riskweave.streaming import feeds, states
from riskweave.streaming.catalog_store import CatalogStore, upsert_stream
from riskweave.streaming.live_store import live_features

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark, sf):
    return feeds.table_stream(spark, sf, "events.parquet", EVENTS, "ts")


def paths(spark, label):
    return shared_dir(spark, f"{label}-out"), shared_dir(spark, f"{label}-cp")


PARTS = 4  # files of a slice; a trigger reads one slice


def span(df, time):
    """First and last second of *df*."""
    sec = F.unix_seconds(F.col(time).cast("timestamp"))
    return df.agg(F.min(sec), F.max(sec)).first()


def replay(spark, df, time, label, slices=3, late=None, columns=("*",)):
    """*columns* of *df* written as *slices* of its time span, one after the other, each by several tasks.

    *late* marks rows that come up to twenty days behind: one slice later if a cut lies within.
    """
    folder = shared_dir(spark, label)
    for i in range(slices):
        in_slice(df, time, slices, late).filter(F.col("slice") == i).drop("slice").select(*columns).repartition(PARTS).write.mode("append").parquet(folder)
    return folder


def in_slice(df, time, slices=3, late=None):
    lo, hi = span(df, time)
    sec = F.unix_seconds(F.col(time).cast("timestamp"))
    at = sec - lo if late is None else sec - lo + F.when(late, 20 * 86400).otherwise(0)
    return df.withColumn("slice", F.least(F.floor(at * slices / F.lit((hi or 0) - (lo or 0) + 1)), F.lit(slices - 1)).cast("int"))


def slice_sql(rows, time="time", late="FALSE", slices=3):
    """The slice of every row of *rows*, as :func:`in_slice`."""
    return (f"SELECT r.*, CAST(least(floor((CAST(epoch({time}) AS BIGINT) - lo + CASE WHEN {late} THEN 1728000 ELSE 0 END) * {slices} / CAST(hi - lo + 1 AS DOUBLE)), {slices - 1}) AS INTEGER) AS slice "
            f"FROM {rows} r, (SELECT CAST(min(epoch({time})) AS BIGINT) AS lo, CAST(max(epoch({time})) AS BIGINT) AS hi FROM {rows})")


#: Snapshots of the feed as shares of the span of its times, in percent; they overlap.
SNAPSHOTS = ((0, 36), (17, 70), (50, 101))


def write_feed(spark, sf):
    """Three overlapping snapshots of the event feed; later ones carry revised values."""
    folder = shared_dir(spark, "feed")
    e = spark.read.parquet(f"{sf}/events.parquet")
    lo, hi = span(e, "ts")
    second, ms = F.unix_seconds(F.col("ts").cast("timestamp")), F.unix_millis(F.col("ts").cast("timestamp"))
    for n, (a, b) in enumerate(SNAPSHOTS):
        part = e.filter((second >= lo + (hi - lo) * a // 100) & (second < lo + (hi - lo) * b // 100))
        mag = F.col("value") + n * (F.col("event_id") % 3)
        props = F.struct(ms.alias("time"), (ms + n * 3600000).alias("updated"), mag.alias("mag"), F.lit("us").alias("net"), F.lit(None).cast("string").alias("code"))
        feature = F.struct(F.col("event_id").cast("string").alias("id"), props.alias("properties"), F.struct(F.array(F.lit(178.0), F.lit(-18.0), F.lit(10.0)).alias("coordinates")).alias("geometry"))
        docs = part.groupBy(F.floor(F.col("event_id") / 500).alias("doc")).agg(F.collect_list(feature).alias("features"))
        docs.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).repartition(PARTS).write.mode("append").text(folder)
    return folder


FEED_SQL = f"""snap AS (SELECT n, lo + (hi - lo) * a // 100 AS f, lo + (hi - lo) * b // 100 AS t FROM (VALUES {", ".join(f"({n}, {a}, {b})" for n, (a, b) in enumerate(SNAPSHOTS))}) t(n, a, b),
  (SELECT CAST(floor(min(epoch(ts))) AS BIGINT) AS lo, CAST(floor(max(epoch(ts))) AS BIGINT) AS hi FROM events)),
 fd AS (SELECT CAST(event_id AS VARCHAR) AS id, value + n * (event_id % 3) AS mag, n, date_trunc('millisecond', ts) AS time FROM events, snap WHERE floor(epoch(ts)) >= f AND floor(epoch(ts)) < t)"""


@query("stream_feed_source", f"WITH {FEED_SQL} SELECT id, count(*) AS copies, {sql_round('max(mag)')} AS max_mag FROM fd GROUP BY id")
def _(spark, sf):
    out, cp = paths(spark, "source")
    feeds.drain(feeds.feed_stream(spark, write_feed(spark, sf), PARTS).select("id", "mag"), out, cp)
    return rounded(spark.read.schema("id string, mag double").parquet(out).groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.max("mag").alias("max_mag")))


@query("stream_dedupe_revisions", f"WITH {FEED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS r FROM fd) SELECT id, {sql_round('mag')} AS mag, CAST(n AS BIGINT) AS revision FROM r WHERE r = 1")
def _(spark, sf):
    out, cp = paths(spark, "revisions")
    feeds.drain(feeds.latest_revisions(feeds.feed_stream(spark, write_feed(spark, sf), PARTS), "30 days"), out, cp, mode="update")
    final = feeds.settle(spark.read.parquet(out), ["id"], "updated")
    hours = (F.unix_micros("updated") - F.unix_micros("time")) / F.lit(3600e6)
    return rounded(final.select("id", "mag", F.round(hours).cast("bigint").alias("revision")))


CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("stream_tumbling_counts", f"SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2 HAVING CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= {CLOSED}")
def _(spark, sf):
    out, cp = paths(spark, "tumbling")
    feeds.drain(feeds.tumbling_counts(event_stream(spark, sf), ["event_type"], "ts"), out, cp)
    return spark.read.schema("event_type string, start timestamp, n bigint").parquet(out).select("event_type", F.to_date("start").alias("day"), "n")


@query("stream_rolling_counts", f"""WITH w AS (SELECT event_type, CAST(ts AS DATE) - CAST(d AS INTEGER) AS start FROM events, range(7) t(d)) SELECT event_type, CAST(start AS DATE) AS start, count(*) AS n7 FROM w GROUP BY 1, 2 HAVING CAST(start AS TIMESTAMP) + INTERVAL 7 DAY <= {CLOSED}""")
def _(spark, sf):
    out, cp = paths(spark, "rolling")
    feeds.drain(feeds.rolling_counts(event_stream(spark, sf), ["event_type"], "ts", "7 days"), out, cp)
    r = spark.read.schema("event_type string, start timestamp, end timestamp, n bigint").parquet(out)
    return r.select("event_type", F.to_date("start").alias("start"), F.col("n").alias("n7"))


LATE = "k % 10 = 0"
LIVE_BATCHES_SQL = GRID_SQL + f""", sliced AS ({slice_sql('catalog', late=LATE)}),
 ats AS (SELECT b, date_trunc('hour', (SELECT max(time) FROM sliced WHERE slice <= b)) + INTERVAL 1 HOUR AS s FROM (SELECT CAST(unnest(range(3)) AS INTEGER) AS b)),
 hs AS (SELECT CAST(CAST(floor(latitude) AS INTEGER) + da AS INTEGER) AS la, CAST(((CAST(floor(longitude) AS INTEGER) + do_ + 180) % 360 + 360) % 360 - 180 AS INTEGER) AS lo, time, mag, slice FROM sliced, offs9),
 lf AS (SELECT b, la, lo, count(*) AS i, {FEATS} FROM hs JOIN ats ON slice <= b AND time < s GROUP BY b, la, lo),
 live AS (SELECT ats.b AS batch, s AS as_of, la, lo, coalesce(i, 0) / greatest({sql_days("s", f"TIMESTAMP '{ORIGIN}'")} / 365.25e0, 1e0) AS rate_bg, {', '.join(f'coalesce(n{w}, 0) AS n{w}' for w in ce.WINDOWS)},
   coalesce({sql_days("s", 't_max')}, 99999e0) AS t_last, coalesce(mag_max, 0e0) AS mag_max, coalesce(omori, 0e0) AS omori FROM grid CROSS JOIN ats LEFT JOIN lf USING (b, la, lo))"""


@query("stream_live_features", f"""WITH {LIVE_BATCHES_SQL} SELECT batch, as_of, la, lo, {sql_round('rate_bg')} AS rate_bg, n7, n30, n90, n365, {sql_round('t_last', 8)} AS t_last, {sql_round('mag_max')} AS mag_max, {sql_round('omori')} AS omori FROM live""")
def _(spark, sf):
    """Features of all cells at each of three batch times; a tenth of the events come late."""
    out, cp = paths(spark, "live")
    c = catalog(spark, sf).select("k", "id", "time", "latitude", "longitude", "mag")
    own = own_cells(spark, sf).filter("n >= 3").select("la", "lo", "n")
    grid = cut_lineage(own.join(fault_cells(spark, sf), ["la", "lo"], "full").select("la", "lo", F.coalesce("slip", F.lit(0.0)).alias("slip")))
    rows = feeds.table_stream(spark, replay(spark, c, "time", "live-src", late=F.expr(LATE)), "*.parquet",
                              "k bigint, id string, time timestamp_ntz, latitude double, longitude double, mag double", "time", PARTS)
    live_features(rows, shared_dir(spark, "live-store"), out, cp, grid, ORIGIN, compact_every=2)
    f = spark.read.parquet(out).select("batch", "as_of", "la", "lo", "rate_bg", "n7", "n30", "n90", "n365", "t_last", "mag_max", "omori")
    return rounded(f, keep=("t_last",)).withColumn("t_last", F.round("t_last", 8))


#: The last day whose end the watermark of thirty days has passed when the stream is drained.
LAST_CLOSED = "(SELECT CAST(max(time) - INTERVAL 30 DAY AS DATE) - 1 FROM catalog)"
STATE_SQL = CATALOG_SQL + f""", c AS (SELECT segment, day, count(*) / 3e0 AS x FROM catalog WHERE day <= {LAST_CLOSED} GROUP BY 1, 2),
 sp AS (SELECT segment, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST({LAST_CLOSED} AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT segment, min(day) AS lo FROM c GROUP BY 1)),
 b AS (SELECT segment, day, coalesce(x, 0e0) AS x, row_number() OVER (PARTITION BY segment ORDER BY day) AS rn FROM sp LEFT JOIN c USING (segment, day)),
 f AS (SELECT segment, day, rn, 0e0 AS s FROM b WHERE rn = 1 UNION ALL SELECT b.segment, b.day, b.rn, 0.95e0 * f.s + (1 - 0.95e0) * b.x FROM f JOIN b ON b.segment = f.segment AND b.rn = f.rn + 1)"""


def event_replay(spark, df, label):
    """A stream of catalog rows in three slices, a tenth of them late by up to twenty days."""
    cols = df.select("k", "segment", "time", "mag")
    return feeds.table_stream(spark, replay(spark, cols, "time", label, late=F.expr(LATE)), "*.parquet",
                              "k bigint, segment int, time timestamp_ntz, mag double", "time", PARTS)


@query("stream_decayed_state", f"WITH RECURSIVE {STATE_SQL} SELECT CAST(segment AS BIGINT) AS segment, day, {sql_round('s')} AS state FROM f")
def _(spark, sf):
    out, cp = paths(spark, "decay")
    rows = event_replay(spark, catalog(spark, sf), "decay-src")
    with states.state_store(spark):
        feeds.drain(states.decayed_state(rows, "segment", "time", F.lit(1 / 3)), out, cp)
    return rounded(spark.read.schema("segment bigint, day date, state double").parquet(out))


@query("stream_decluster", f"WITH RECURSIVE {INDEP_SQL} SELECT CAST(segment AS BIGINT) AS segment, day FROM indep WHERE day <= (SELECT CAST(max(time) - INTERVAL 30 DAY AS DATE) - 1 FROM catalog WHERE {BIG})")
def _(spark, sf):
    out, cp = paths(spark, "decluster")
    rows = event_replay(spark, catalog(spark, sf).filter(BIG), "decluster-src")
    with states.state_store(spark):
        feeds.drain(states.declustered_days(rows, "segment", "time"), out, cp)
    return spark.read.schema("segment bigint, day date").parquet(out)


def _upsert_sql(base, inc, n):
    """One upsert step of *inc* into *base* as table z{n}; see the batch form in :mod:`riskweave.plans.catalogs`."""
    return f"""known{n} AS (SELECT DISTINCT id FROM {base} WHERE id IS NOT NULL), rest{n} AS (SELECT * FROM {inc} WHERE id NOT IN (SELECT id FROM known{n})),
 mm{n} AS (SELECT r.id AS rid, b.id AS bid, b.k AS bk, {sql_haversine('b.latitude', 'b.longitude', 'r.latitude', 'r.longitude')} AS d
   FROM rest{n} r JOIN {base} b ON b.time BETWEEN r.time - INTERVAL 5 SECOND AND r.time + INTERVAL 5 SECOND AND abs(r.mag - b.mag) <= 0.5e0),
 m{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, bk) AS r FROM mm{n} WHERE d <= 15) WHERE r = 1),
 keyed{n} AS (SELECT *, CASE WHEN id IS NOT NULL THEN 'id:' || id ELSE 'row:' || CAST(k AS VARCHAR) END AS key, 0 AS src, coalesce(updated, TIMESTAMP '0001-01-01') AS u FROM {base}
  UNION ALL SELECT *, 'id:' || id, 1, coalesce(updated, TIMESTAMP '9999-12-31') FROM {inc} WHERE id IN (SELECT id FROM known{n})
  UNION ALL SELECT rest{n}.*, coalesce(CASE WHEN m{n}.bk IS NOT NULL THEN CASE WHEN m{n}.bid IS NOT NULL THEN 'id:' || m{n}.bid ELSE 'row:' || CAST(m{n}.bk AS VARCHAR) END END, 'id:' || rest{n}.id),
    CASE WHEN m{n}.bk IS NOT NULL THEN 2 ELSE 1 END, coalesce(updated, TIMESTAMP '9999-12-31') FROM rest{n} LEFT JOIN m{n} ON m{n}.rid = rest{n}.id),
 w{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY (src = 2) DESC, u DESC, src DESC, time DESC) AS r FROM keyed{n}) WHERE r = 1),
 z{n} AS (SELECT id, time, updated, latitude, longitude, depth, mag, net, k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(updated, TIMESTAMP '0001-01-01') DESC, src DESC) AS q FROM w{n} WHERE id IS NOT NULL) WHERE q = 1
   UNION ALL SELECT id, time, updated, latitude, longitude, depth, mag, net, k FROM w{n} WHERE id IS NULL)"""


UPSERT_LATE = "k % 7 = 0"
STREAM_UPSERT_SQL = UPSERT_BASE_SQL + f""", si AS ({slice_sql('inc', late=UPSERT_LATE, slices=2)}), i0 AS (SELECT * EXCLUDE (slice) FROM si WHERE slice = 0), i1 AS (SELECT * EXCLUDE (slice) FROM si WHERE slice = 1),
 {_upsert_sql('base', 'i0', 0)}, {_upsert_sql('z0', 'i1', 1)}"""


@query("stream_catalog_upsert", f"WITH {STREAM_UPSERT_SQL} SELECT id, time, updated, {sql_round('latitude')} AS latitude, {sql_round('longitude')} AS longitude, depth, {sql_round('mag')} AS mag, net FROM z1")
def _(spark, sf):
    """Two batches of revisions into a partitioned catalog; late revisions come with the second."""
    base = base_rows(spark, sf).select(*COLS)
    store = CatalogStore(spark, shared_dir(spark, "catalog"), base.schema, days=180)
    store.load(base)
    inc = incoming_rows(spark, sf)
    rows = feeds.table_stream(spark, replay(spark, inc, "time", "revisions-src", 2, F.expr(UPSERT_LATE), COLS), "*.parquet",
                              "id string, time timestamp_ntz, updated timestamp_ntz, latitude double, longitude double, depth double, mag double, net string", None, PARTS)
    upsert_stream(rows, store, shared_dir(spark, "catalog-cp"))
    return rounded(store.read(), keep=("depth",))


@query("stream_ledger", """SELECT date_trunc('hour', ts) AS slot, min(event_id) AS event_id FROM events GROUP BY 1""")
def _(spark, sf):
    out, cp = paths(spark, "ledger")
    records = event_stream(spark, sf).select("event_id", F.col("ts").cast("timestamp_ntz").alias("issued_at"))
    feeds.ledger_stream(records, out, cp)
    feeds.ledger_stream(records, out, shared_dir(spark, "ledger-replay"))  # a replay changes nothing
    return spark.read.parquet(out).select("slot", "event_id")


@query("late_available_join", f"""WITH {MONTH_SQL}, rl AS (SELECT available_at, max_by(total_vol, month) AS v FROM mo GROUP BY available_at), d AS (SELECT DISTINCT station, day FROM readings)
 SELECT station, day, available_at AS valid_from, {sql_round('v', 2)} AS total_vol FROM d ASOF LEFT JOIN rl ON d.day >= rl.available_at""")
def _(spark, sf):
    from riskweave.operators.sensors import latest_release

    out, cp = paths(spark, "late")
    static = feeds.available_intervals(latest_release(monthly(spark, sf), "available_at", "month", "total_vol"), "available_at", "total_vol")
    days = readings(spark, sf).select("station", "day").distinct()
    rows = feeds.table_stream(spark, replay(spark, days, "day", "days-src"), "*.parquet", "station int, day date", max_files=PARTS)
    feeds.drain(feeds.late_available_join(rows, static, "day"), out, cp)
    return rounded(spark.read.schema("station int, day date, valid_from date, total_vol double").parquet(out), 2)
