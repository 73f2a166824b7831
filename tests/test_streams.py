"""Streams against their batch forms: late and repeated rows, silent days, batches that touch few partitions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import cells as ce, episodes as ep, timeseries as ts
from riskweave.operators.catalogs import catalog_upsert, fuzzy_match
from riskweave.session import shared_dir
from riskweave.streaming import feeds, states
from riskweave.streaming.catalog_store import CatalogStore, upsert_stream
from riskweave.streaming.live_store import LiveCellStore, live_features, partial_states

T0 = dt.datetime(2021, 3, 1)
ROW = "id string, time timestamp_ntz, updated timestamp_ntz, latitude double, longitude double, mag double, net string"


def feed(spark, batches, schema):
    """Files in the order of *batches*, one file each."""
    folder = shared_dir(spark, "test-src")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.fixture(scope="module")
def drives():
    """Four batches; a fifth of the rows come a batch late, some rows come twice, entity 3 falls silent."""
    rng, batches = random.Random(11), [[] for _ in range(5)]
    for b in range(4):
        for _ in range(60):
            key = rng.choice([1, 1, 1, 2] + ([3] if b == 0 else []))
            row = (key, T0 + dt.timedelta(days=b * 40 + rng.random() * 40), rng.choice([1.0, 2.5, None]))
            batches[b].append(row)
            if rng.random() < 0.2 and row[1] > T0 + dt.timedelta(days=b * 40 + 25):
                batches[b + 1].append(batches[b].pop())
            elif rng.random() < 0.1:
                batches[b + 1 if row[1] > T0 + dt.timedelta(days=b * 40 + 25) else b].append(row)
    return batches


def drive_stream(spark, drives):
    folder = feed(spark, drives, "k int, time timestamp_ntz, x double")
    return feeds.table_stream(spark, folder, "*.parquet", "k int, time timestamp_ntz, x double", "time", 1)


def closed(drives):
    last = max(r[1] for b in drives for r in b) - dt.timedelta(days=30)
    return last.date() - dt.timedelta(days=1)


def test_decayed_state_equals_the_batch_fold(spark, drives):
    out, cp = shared_dir(spark, "out"), shared_dir(spark, "cp")
    with states.state_store(spark):
        feeds.drain(states.decayed_state(drive_stream(spark, drives), "k", "time", F.col("x"), 0.9), out, cp)
    got = {(r["k"], r["day"]): r["state"] for r in spark.read.parquet(out).collect()}
    rows = spark.createDataFrame([r for b in drives for r in b], "k int, time timestamp_ntz, x double").withColumn("day", F.to_date("time"))
    daily = rows.filter(F.col("day") <= F.lit(closed(drives))).groupBy("k", "day").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("x"))
    spine = ts.date_spine(daily, ["k"], values=["x"], end=str(closed(drives)))
    want = {(r["k"], r["day"]): r["s"] for r in ts.fold_states(spine, ["k"], "day", [ts.Ewma("s", "x", 0.9)]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert {k for k, _ in want} == {1, 2, 3} and max(d for k, d in want if k == 3) == closed(drives)


def test_declustered_days_equal_the_batch_walk(spark, drives):
    out, cp = shared_dir(spark, "out"), shared_dir(spark, "cp")
    with states.state_store(spark):
        feeds.drain(states.declustered_days(drive_stream(spark, drives), "k", "time", 12), out, cp)
    got = sorted((r["k"], r["day"]) for r in spark.read.parquet(out).collect())
    rows = spark.createDataFrame([r for b in drives for r in b], "k int, time timestamp_ntz, x double").withColumn("day", F.to_date("time"))
    want = ep.decluster_first(rows.filter(F.col("day") <= F.lit(closed(drives))), ["k"], "day", ["time"], 12)
    assert got == sorted((r["k"], r["day"]) for r in want.select("k", "day").collect()) and len(got) > 10


def test_no_state_uses_the_older_interface():
    import inspect

    import riskweave.streaming as package
    for module in (states, feeds):
        assert "applyInPandasWithState" not in inspect.getsource(module)
    assert package


def events(rng, n, first, last):
    return [(f"e{rng.randrange(10 ** 9)}", T0 + dt.timedelta(days=first + rng.random() * (last - first)), None, rng.uniform(-20, -16),
             rng.choice([rng.uniform(178, 180), rng.uniform(-180, -178)]), rng.uniform(3, 6.5), "us") for _ in range(n)]


@pytest.mark.parametrize("compact_every", [2, 96])
def test_live_features_equal_a_full_scan_at_every_batch(spark, compact_every):
    rng = random.Random(3)
    batches = [events(rng, 80, 0, 200), events(rng, 50, 190, 400), events(rng, 30, 300, 500), events(rng, 20, 5, 60) + events(rng, 5, 560, 565)]
    cells = spark.createDataFrame([(la, lo, 1.0) for la in range(-21, -15) for lo in (177, 178, 179, -180, -179, -178)], "la int, lo int, slip double")
    rows = feeds.table_stream(spark, feed(spark, batches, ROW), "*.parquet", ROW, "time", 1)
    out = shared_dir(spark, "out")
    live_features(rows, shared_dir(spark, "store"), out, shared_dir(spark, "cp"), cells, "2020-01-01", compact_every)
    got = spark.read.parquet(out).collect()
    assert {r["batch"] for r in got} == {0, 1, 2, 3}
    for b in range(4):
        seen = spark.createDataFrame([r for x in batches[:b + 1] for r in x], ROW)
        at = max(r[1] for x in batches[:b + 1] for r in x).replace(minute=0, second=0, microsecond=0) + dt.timedelta(hours=1)
        full = {(r["la"], r["lo"]): r for r in ce.cell_state(seen, cells, F.lit(at), "2020-01-01").collect()}
        mine = {(r["la"], r["lo"]): r for r in got if r["batch"] == b}
        assert mine.keys() == full.keys() and all(r["as_of"] == at for r in mine.values())
        for k, f in full.items():
            for c in ("n7", "n30", "n90", "n365", "rate_bg", "t_last", "mag_max"):
                assert mine[k][c] == f[c], (b, k, c)
            assert mine[k]["omori"] == pytest.approx(f["omori"], rel=1e-12)


def test_live_store_takes_rows_without_time_place_or_magnitude(spark):
    rows = [("a", None, None, -17.0, 178.5, 5.0, "us"), ("b", T0, None, None, 178.5, 5.0, "us"), ("c", T0, None, -17.5, 178.5, None, "us")]
    store = LiveCellStore(spark, shared_dir(spark, "store"))
    assert store.add(spark.createDataFrame([], ROW), 0) is None
    at = store.add(spark.createDataFrame(rows, ROW), 1)
    cells = spark.createDataFrame([(-18, 178, 0.0)], "la int, lo int, slip double")
    r = store.features(1, at, cells, "2020-01-01").collect()[0]
    assert (r["n7"], r["mag_max"], r["omori"]) == (1, 0.0, 0.0) and partial_states(spark.createDataFrame(rows, ROW)).count() == 1


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_upsert_stream_equals_upserts_in_turn(spark):
    rng = random.Random(7)
    base = events(rng, 200, 0, 120)
    def revise(rows, days):
        out = []
        for i, r in enumerate(rows):
            if i % 5 == 0:
                out.append((r[0], r[1] + dt.timedelta(days=days), T0 + dt.timedelta(days=500 + days), r[3] + 11.0, r[4], r[5] + 0.1, "id moved"))
            elif i % 5 == 1:
                out.append((f"n{r[0]}", r[1] + dt.timedelta(seconds=3), T0, r[3] + 0.02, r[4], r[5] + 0.2, "near"))
        return out
    batches = [revise(base[:40], 3) + events(rng, 5, 0, 120), revise(base[20:60], 9), [(None, T0, None, -18.0, 179.99, 4.0, "no id"), (None, None, None, None, None, None, "empty")]]
    schema = spark.createDataFrame([], ROW).schema
    store = CatalogStore(spark, shared_dir(spark, "cat"), schema, degrees=2.0, days=5)
    frame = spark.createDataFrame(base, ROW)
    store.load(frame)
    done = upsert_stream(feeds.table_stream(spark, feed(spark, batches, ROW), "*.parquet", ROW, None, 1), store, shared_dir(spark, "cp"))
    assert len(done) == 3
    want = frame
    for b in batches:
        want = spark.createDataFrame(catalog_upsert(want, spark.createDataFrame(b, ROW), schema.fieldNames()).collect(), schema)
    assert plain(store.read().collect()) == plain(want.collect())
    assert plain(store.read(before=1).collect()) == plain(frame.collect())  # earlier versions stay readable


def test_a_small_batch_touches_its_partitions_only(spark):
    rng = random.Random(8)
    base = events(rng, 300, 0, 300)
    store = CatalogStore(spark, shared_dir(spark, "cat"), spark.createDataFrame([], ROW).schema, degrees=5.0, days=10)
    store.load(spark.createDataFrame(base, ROW))
    total = store.entries().count()
    one = base[17]
    used = store.merge(spark.createDataFrame([(one[0], one[1], T0, one[3], one[4], one[5] + 0.3, "ak")], ROW), 1)
    assert total > 50 and used["read"] <= 2 and used["written"] == 1
    again = store.merge(spark.createDataFrame([(one[0], one[1], T0, one[3], one[4], one[5] + 0.3, "ak")], ROW), 1)
    assert again == used and store.read().count() == 300  # a replay finds the same base and overwrites itself
    spark.createDataFrame([(dt.date(2021, 3, 1), 1, 0, 2)], "day date, zone int, n long, parts long").write.parquet(f"{store.path}/manifest/version=2")
    assert store.read().filter("net = 'ak'").count() == 1  # half a manifest publishes nothing


def test_fuzzy_match_near_poles_and_across_the_date_line(spark):
    places = [(89.99, 10.0), (89.99, -170.0), (-89.95, 0.0), (-89.95, 120.0), (60.0, 179.99), (60.0, -179.99), (0.05, 0.001), (0.0, -0.05), (75.0, 30.0), (75.0, 30.4)]
    rows = [(i, T0, a, o, 5.0) for i, (a, o) in enumerate(places)]
    base = spark.createDataFrame([(f"b{i}", *r) for i, *r in rows], "row string, time timestamp_ntz, latitude double, longitude double, mag double")
    inc = spark.createDataFrame([(f"i{i}", t + dt.timedelta(seconds=4), a, o + 0.01, m) for i, t, a, o, m in rows], base.schema)
    from riskweave.functions.geo import haversine_km
    pairs = inc.alias("i").crossJoin(base.alias("b")).withColumn("d", haversine_km("b.latitude", "b.longitude", "i.latitude", "i.longitude")).filter("d <= 15")
    want = {r[0]: r[1] for r in pairs.groupBy("i.row").agg(F.min_by("b.row", F.struct("d", "b.row"))).collect()}
    got = {r["row"]: r["match"] for r in fuzzy_match(inc, base).collect()}
    assert got == want and len(want) == len(places)


def test_a_batch_indexes_the_ids_it_put(spark):
    rng = random.Random(9)
    base = events(rng, 300, 0, 30)
    store = CatalogStore(spark, shared_dir(spark, "cat"), spark.createDataFrame([], ROW).schema, degrees=90.0, days=400)
    store.load(spark.createDataFrame(base, ROW))
    one, near = base[17], base[40]
    batch = [(one[0], one[1], T0 + dt.timedelta(days=900), one[3], one[4], one[5] + 0.3, "ak"), ("other", near[1], T0, near[3] + 0.01, near[4], near[5], "ak")]
    store.merge(spark.createDataFrame(batch, ROW), 1)
    put = spark.read.parquet(f"{store.path}/ids/version=1").collect()
    assert sorted((r["id"], r["alive"]) for r in put) == sorted([(one[0], True), ("other", True), (near[0], False)])
    store.merge(spark.createDataFrame([("other", near[1], T0 + dt.timedelta(days=901), near[3], near[4], 3.0, "us")], ROW), 2)
    assert store.read().filter("id = 'other'").collect()[0]["net"] == "us" and store.read().count() == 300
