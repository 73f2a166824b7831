"""Revisions, duplicates, the ledger, as-of joins with hot keys, and rule strictness."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import asof, catalogs as cat, cells as ce, mining, scoring as sc, spatial as sp
from riskweave.operators.ranking import diversified_topk
from riskweave.operators.scoring import Rule
from riskweave.session import shared_dir
from riskweave.sources import sinks

COLS = ["id", "time", "updated", "latitude", "longitude", "depth", "mag", "net"]
DDL = "id string, time timestamp_ntz, updated timestamp_ntz, latitude double, longitude double, depth double, mag double, net string"
T0 = dt.datetime(2026, 1, 1)


def row(event_id, seconds, updated_hours, mag, lat=10.0, lon=20.0):
    updated = None if updated_hours is None else T0 + dt.timedelta(hours=updated_hours)
    return (event_id, T0 + dt.timedelta(seconds=seconds), updated, lat, lon, 12.0, mag, "us")


def table(spark, *rows):
    return spark.createDataFrame(list(rows), DDL)


def test_revision_replaces_a_row_without_id(spark):
    out = cat.catalog_upsert(table(spark, row(None, 0, None, 4.9)), table(spark, row("us123", 2, 1, 5.1)), COLS).collect()
    assert len(out) == 1 and out[0]["id"] == "us123" and out[0]["mag"] == 5.1


@pytest.mark.parametrize("updated, expected", [(0, 4.9), (2, 5.5), (None, 5.5)])
def test_older_revision_is_ignored(spark, updated, expected):
    out = cat.catalog_upsert(table(spark, row("a", 0, 1, 4.9)), table(spark, row("a", 1, updated, 5.5)), COLS).collect()
    assert [r["mag"] for r in out] == [expected]


def test_far_event_is_inserted(spark):
    out = cat.catalog_upsert(table(spark, row("a", 0, 1, 4.9)), table(spark, row("b", 2, 1, 5.0, lat=10.5)), COLS)
    assert out.count() == 2


def test_two_revisions_of_one_row_settle_on_the_latest(spark):
    out = cat.catalog_upsert(table(spark, row(None, 0, None, 4.9)), table(spark, row("x", 1, 1, 5.0), row("y", 2, 3, 5.2)), COLS).collect()
    assert [r["id"] for r in out] == ["y"]


def test_incremental_merge_keeps_the_new_row(spark):
    old = table(spark, row("x", 0, None, 4.0))
    out = cat.incremental_merge(old, table(spark, row("x", 1, None, 4.2))).collect()
    assert len(out) == 1 and out[0]["mag"] == 4.2


def test_ledger_slot_is_written_once(spark):
    path = shared_dir(spark, "ledger-test")
    issued = dt.datetime(2026, 7, 11, 12, 7)
    def record(cell):
        return spark.createDataFrame([(issued, cell)], "issued_at timestamp_ntz, cell int")
    sinks.ledger_append_once(record(1), path)
    sinks.ledger_append_once(record(2), path)
    rows = spark.read.parquet(path).collect()
    assert [(r["cell"], r["immutable"], r["slot"]) for r in rows] == [(1, True, dt.datetime(2026, 7, 11, 12))]


def test_nearest_prefers_the_later_of_equals(spark):
    left = spark.createDataFrame([("k", dt.date(2020, 1, 3))], "k string, d date")
    right = spark.createDataFrame([("k", dt.date(2020, 1, 1), 1), ("k", dt.date(2020, 1, 5), 2)], "k string, t date, v int")
    assert asof.nearest(left, right, ["k"], "d", "t", ["v"]).first()["match"]["v"] == 2


@pytest.mark.parametrize("equal", ["prev", "next"])
def test_neighbours_against_brute_force(spark, equal):
    rng = np.random.default_rng(8)
    base = dt.datetime(2020, 1, 1)
    def rows(n):
        return [("hot" if rng.random() < 0.6 else f"k{rng.integers(3)}", base + dt.timedelta(hours=int(rng.integers(0, 4000))), i) for i in range(n)]
    lrows, rrows = rows(200), rows(150)
    left = spark.createDataFrame(lrows, "k string, lt timestamp_ntz, i int")
    right = spark.createDataFrame(rrows, "k string, rt timestamp_ntz, v int")
    out = asof.neighbours(left, right, ["k"], "lt", "rt", ["v"], tiebreak=["v"], equal=equal).collect()
    assert len(out) == 200
    for r in out:
        before = [(t, v) for k, t, v in rrows if k == r["k"] and (t < r["lt"] or (t == r["lt"] and equal == "prev"))]
        after = [(t, v) for k, t, v in rrows if k == r["k"] and (t > r["lt"] or (t == r["lt"] and equal == "next"))]
        assert (r["prev"]["v"] if r["prev"] else None) == (max(before)[1] if before else None)
        assert (r["next"]["v"] if r["next"] else None) == (min(after)[1] if after else None)


def test_exclusion_against_brute_force(spark):
    rng = np.random.default_rng(6)
    def rows(n):
        return [(i, T0 + dt.timedelta(days=float(rng.uniform(0, 120))), float(rng.uniform(-20, -18)), float(rng.uniform(170, 172))) for i in range(n)]
    ev, trig = rows(300), rows(60)
    ddl = "id int, time timestamp_ntz, latitude double, longitude double"
    kept = {r["id"] for r in sp.spatiotemporal_exclusion(spark.createDataFrame(ev, ddl), spark.createDataFrame(trig, ddl)).collect()}
    def near(e, g):
        days = (e[1] - g[1]).total_seconds() / 86400
        return 0 < days < 30 and np.hypot((e[2] - g[2]) * 110.6, (e[3] - g[3]) * 92.6) < 30
    assert kept == {e[0] for e in ev if not any(near(e, g) for g in trig)}


def test_cell_months_against_brute_force(spark):
    rng = np.random.default_rng(12)
    rows = [(dt.datetime(2000, 1, 1) + dt.timedelta(days=float(rng.uniform(0, 900))), float(rng.uniform(-12, -9)), float(rng.uniform(178, 180)), float(rng.uniform(4.5, 6.0))) for _ in range(250)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, latitude double, longitude double, mag double")
    out = ce.cell_months(df, "2000-06-01", "2002-03-01", "2000-01-01", 5.5).collect()
    wrap = lambda lo: (lo + 180) % 360 - 180
    for r in out[::7]:
        at = dt.datetime.combine(r["date"], dt.time())
        mine = sorted((t, m) for t, la, lo, m in rows if abs(np.floor(la) - r["la"]) <= 1 and int(np.floor(lo)) in {wrap(r["lo"] + d) for d in (-1, 0, 1)})
        past = [(t, m) for t, m in mine if t < at]
        lag = lambda t: (at - t).total_seconds() / 86400
        assert r["n30"] == sum(lag(t) <= 30 for t, _ in past) and r["n365"] == sum(lag(t) <= 365 for t, _ in past)
        assert r["mag_max"] == max(m for _, m in past) and r["t_last"] == pytest.approx(lag(past[-1][0]), abs=1e-6)
        assert r["omori"] == pytest.approx(sum(10 ** (0.5 * (m - 4.5)) / (lag(t) + 5) ** 1.1 for t, m in past if lag(t) <= 365))
        assert r["y"] == int(any(m >= 5.5 and 0 <= -lag(t) < 30 for t, m in mine))
        nxt = [(t, m) for t, m in mine if m >= 5.5 and 0 < -lag(t) <= 365]
        assert r["mag_next"] == (nxt[0][1] if nxt else None)


def test_incomplete_antecedent_does_not_fire(spark):
    df = spark.createDataFrame([(0.35, None)], "a double, b double")
    rule = Rule((("a", "high"), ("b", "high")), out_term="t1")
    s = sc.term_strengths([rule])
    r = df.select(s["t1"].alias("s"), sc.centroid_defuzz(s, {"t1": 0.5}).alias("v")).first()
    assert r["s"] == 0 and r["v"] is None


def test_pair_statistics_against_brute_force(spark):
    rng = np.random.default_rng(13)
    x = rng.uniform(-1, 1, (200, 2))
    y = rng.integers(0, 2, 200)
    df = spark.createDataFrame([("fit", float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "e string, a_x double, a_y double, y int")
    got = {(r["term_a"], r["term_b"]): (r["support"], r["rate"]) for r in mining.support_lift(df, ["a_x", "a_y"], "y", "e", pairs=True).collect()}
    from riskweave.functions.fuzzy import ANOMALY_SETS
    def mu(v, p):
        left = (v - p[0]) / (p[1] - p[0]) if p[1] > p[0] else 1.0
        right = (p[-1] - v) / (p[-1] - p[-2]) if p[-1] > p[-2] else 1.0
        return max(0.0, min(left, 1.0, right))
    for (ta, tb), (support, rate) in got.items():
        m = np.array([min(mu(a, ANOMALY_SETS[ta]), mu(b, ANOMALY_SETS[tb])) for a, b in x])
        assert support == pytest.approx(m.sum(), rel=1e-9) and rate == pytest.approx((m * y).sum() / m.sum(), rel=1e-9)


def test_diversified_picks_keep_their_distance(spark):
    cells = spark.createDataFrame([(0, i, float(100 - i)) for i in range(30)], "la int, lo int, p double")
    picks = diversified_topk(cells, "p", n=4, min_km=300.0).orderBy("pick").collect()
    assert [r["lo"] for r in picks] == [0, 3, 6, 9]


def test_corridor_prefilter_changes_nothing(spark):
    rng = np.random.default_rng(14)
    pts = spark.createDataFrame([(i, 0, float(rng.uniform(-25, -15)), float(rng.uniform(170, 176))) for i in range(300)], "id int, segment int, latitude double, longitude double")
    tr = sp.traces(spark.createDataFrame([(0, 0, 172.0, -22.0), (0, 1, 173.0, -20.0)], "segment int, i int, lon double, lat double"))
    near = {r["id"] for r in sp.polyline_distance(pts, tr, max_km=100.0).collect()}
    assert near == {r["id"] for r in sp.polyline_distance(pts, tr).filter(F.col("dist_km") <= 100.0).collect()}


def test_batch_rows_stand_in_few_cells(spark):
    """A row of the batch is sent to the cells that its limits reach, not to all 27 around its own; no partner is lost."""
    rng = random.Random(11)
    spots = [(i, dt.datetime(2020, 1, 1) + dt.timedelta(seconds=rng.uniform(0, 1e6)), rng.uniform(-80, 80), rng.uniform(-180, 180), 5.0) for i in range(300)]
    near = [(i, t + dt.timedelta(seconds=rng.uniform(-4.9, 4.9)), lat + rng.uniform(-0.09, 0.09), lon, m) for i, t, lat, lon, m in spots]
    schema = "row long, time timestamp_ntz, latitude double, longitude double, mag double"
    base, inc = spark.createDataFrame(spots, schema), spark.createDataFrame(near, schema)
    sent, _ = cat.meeting_sides(inc, base, 5.0, 15.0, "row")
    assert sent.count() < 7 * 300
    assert all(r["match"] == r["row"] for r in cat.fuzzy_match(inc, base).collect())


def upserted(base, batch):
    """The rules of catalog_upsert, row by row; a row is (id, time, updated, latitude, longitude, depth, mag, net)."""
    far, old = dt.datetime(9999, 12, 31), dt.datetime(1, 1, 1)
    km = lambda a, b: 12742 * math.asin(math.sqrt(math.sin(math.radians(a[3] - b[3]) / 2) ** 2 + math.cos(math.radians(a[3])) * math.cos(
        math.radians(b[3])) * math.sin(math.radians(a[4] - b[4]) / 2) ** 2))
    name = lambda r: r[0] or ("row", *r)
    known, held, taken = {r[0] for r in base if r[0]}, {}, {}
    for r in base:
        held.setdefault(name(r), []).append((False, r[2] or old, 0, r[1], r))
    for r in batch:
        if r[0] in known:
            held[r[0]].append((False, r[2] or far, 1, r[1], r))
            continue
        near = [(km(r, b), name(b)) for b in base if abs((r[1] - b[1]).total_seconds()) <= 5 and abs(r[6] - b[6]) <= 0.5 and km(r, b) <= 15]
        key, src = (min(near)[1], 2) if near else (("new", name(r)), 1)
        held.setdefault(key, []).append((src == 2, r[2] or far, src, r[1], r))
    for rows in held.values():
        best = max(rows, key=lambda x: x[:4])
        taken.setdefault(name(best[4]), []).append((best[4][2] or old, best[2], best[3], best[4]))
    return sorted((max(rows, key=lambda x: x[:3])[3] for rows in taken.values()), key=repr)


def test_upsert_against_the_rules_row_by_row(spark):
    rng = random.Random(5)
    second = iter(rng.sample(range(10 ** 6), 1000))
    start = dt.datetime(2020, 1, 1)
    def one(i, at):
        return (i, at, rng.choice([None, start + dt.timedelta(days=400, seconds=next(second))]), rng.uniform(-80, 80), rng.uniform(-179, 179), 1.0, 5.0, "x")
    base = [one(None if i % 6 == 0 else f"b{i}", start + dt.timedelta(seconds=1000 * i)) for i in range(90)]
    batch = [one(rng.choice([None, "n1", "n2", f"b{i}"]), start + dt.timedelta(seconds=777 * i)) for i in range(60)]
    for i, b in enumerate(base):  # near ones, several of a target, names shared with others
        for _ in range(rng.randrange(3)):
            near = one(rng.choice([None, f"n{rng.randrange(30)}", f"b{rng.randrange(90)}"]), b[1] + dt.timedelta(seconds=rng.uniform(-4, 4)))
            batch.append((*near[:3], b[3] + rng.uniform(-0.05, 0.05), b[4], *near[5:]))
    frames = [spark.createDataFrame(rows, DDL) for rows in (base, batch)]
    got = cat.catalog_upsert(*frames, frames[0].columns).collect()
    assert sorted((tuple(r) for r in got), key=repr) == upserted(base, batch)


def test_few_copies_of_a_batch_meet_the_base(spark):
    """Cells are so wide that a row of the batch stands in little more than two of them, time and both axes together."""
    rng = random.Random(12)
    spots = [(i, dt.datetime(2020, 1, 1) + dt.timedelta(seconds=rng.uniform(0, 1e6)), rng.uniform(-80, 80), rng.uniform(-180, 180), 5.0) for i in range(300)]
    frame = spark.createDataFrame(spots, "row long, time timestamp_ntz, latitude double, longitude double, mag double")
    assert cat.meeting_sides(frame, frame, 5.0, 15.0, "row")[0].count() < 3 * 300
