"""Past-only operators: exact values, two implementations, and indifference to the future."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.operators import critical as cr, episodes as ep, timeseries as ts
from riskweave.operators.timeseries import Ewma, Recurrent, Robust, Roll

DAY0 = dt.date(2020, 1, 1)


def frame(spark, values, name="x"):
    rows = [(1, DAY0 + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"seg int, day date, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("day").collect()]


def test_causal_fill_never_looks_ahead(spark):
    src = spark.createDataFrame([(1, DAY0, 1.0), (1, DAY0 + dt.timedelta(days=3), 9.0)], "seg int, day date, v double")
    spine = frame(spark, [0, 0, 0, 0]).select("seg", "day")
    assert column(ts.causal_ffill(src, spine, ["seg"], "day", "v"), "v") == [1, 1, 1, 9]
    assert column(ts.causal_ffill(src, spine, ["seg"], "day", "v", limit=1), "v") == [1, 1, None, 9]


def test_date_spine_fills_gaps_and_tail(spark):
    src = spark.createDataFrame([(1, DAY0, 2), (1, DAY0 + dt.timedelta(days=2), 5)], "seg int, day date, n int")
    assert column(ts.date_spine(src, ["seg"], end=DAY0 + dt.timedelta(days=4)), "n") == [2, 0, 5, 0, 0]


def test_rolling_matches_pandas(spark):
    rng = np.random.default_rng(3)
    x = [None if rng.random() < 0.2 else float(v) for v in rng.normal(size=60)]
    out = ts.rolling(frame(spark, x), ["seg"], "day", [Roll("a", "x", 7, "mean", 4, 1), Roll("b", "x", 10, "sum", 1, 0), Roll("c", "x", 5, "count", 1, 1)])
    s = pd.Series(x, dtype=float)
    for name, want in (("a", s.rolling(7, min_periods=4).mean().shift(1)), ("b", s.rolling(10, min_periods=1).sum()), ("c", s.rolling(5).count().shift(1))):
        got = pd.Series(column(out, name), dtype=float)
        ok = want.notna() & (want != 0) if name == "c" else want.notna()
        np.testing.assert_allclose(got[ok], want[ok], atol=1e-9)


def test_robust_anomaly_two_ways(spark):
    rng = np.random.default_rng(5)
    x = [None if rng.random() < 0.1 else float(v) for v in rng.normal(size=120)]
    spec = Robust("z", "x", 20, None, 6)
    a = column(ts.robust_anomaly(frame(spark, x), ["seg"], "day", [spec]), "z")
    b = column(ts.robust_anomaly_window(frame(spark, x), ["seg"], "day", spec), "z")
    assert [v is None for v in a] == [v is None for v in b]
    np.testing.assert_allclose([v for v in a if v is not None], [v for v in b if v is not None], rtol=1e-9)


def test_trailing_slope_of_a_line(spark):
    out = ts.trailing_slope(frame(spark, [2.0 * i for i in range(120)]), ["seg"], "day", "x", "s", 90, scale=1.0)
    got = column(out, "s")
    assert got[89] is None and got[90] == pytest.approx(2.0) and got[119] == pytest.approx(2.0)


def test_recurrent_memory_decays(spark):
    x = [0.0] * 10 + [1.0] + [0.0] * 30
    s = column(ts.fold_states(frame(spark, x), ["seg"], "day", [Recurrent("s", "x")]), "s")
    assert s[10] > 0.5 and s[11] > 0 and s[40] < s[11]


def test_ewma_ignores_first_drive(spark):
    s = column(ts.fold_states(frame(spark, [1.0, 0.0, 1.0]), ["seg"], "day", [Ewma("s", "x", 0.9)]), "s")
    assert s == pytest.approx([0.0, 0.0, 0.1])


CHANNELS = ["a_seis", "a_swarm", "a_foreshock", "a_noise", "a_gnss", "a_sse", "a_strain", "a_insar", "C_state", "a_fluid", "F_state", "a_water", "a_ocean", "a_tec"]
SENSORS = ["gnss", "strain", "insar", "fluid", "water", "ocean", "tec", "noise"]


def channel_frame(spark, n, change):
    pdf = pd.DataFrame({c: np.zeros(n) for c in CHANNELS} | {f"has_{s}_data": np.ones(n) for s in SENSORS})
    change(pdf)
    pdf.insert(0, "day", [DAY0 + dt.timedelta(days=i) for i in range(n)])
    pdf.insert(0, "seg", 1)
    return spark.createDataFrame(pdf, "seg int, day date, " + ", ".join(f"{c} double" for c in pdf.columns[2:]))


def firings(df):
    return cr.rule_firings(cr.cluster_evidence(df, ["seg"], "day"))


def last(df):
    return df.orderBy(F.desc("day")).first().asDict()


def test_two_clusters_beat_one(spark):
    def one(p):
        p.loc[p.index[-30]:, ["a_seis", "a_swarm"]] = 0.9
    def both(p):
        p.loc[p.index[-30]:, ["a_seis", "a_swarm", "a_gnss", "a_strain"]] = 0.9
    assert last(firings(channel_frame(spark, 100, one)))["r_seismic_deformation"] == 0
    assert last(firings(channel_frame(spark, 100, both)))["r_seismic_deformation"] > 0.5


def test_missing_sensor_cannot_vote(spark):
    def silent(p):
        p[["has_gnss_data", "has_strain_data", "has_insar_data"]] = 0
        p[["a_gnss", "a_sse", "a_strain", "a_insar"]] = 1.0
    r = last(cr.cluster_evidence(channel_frame(spark, 100, silent), ["seg"], "day"))
    assert r["deformation_level"] == 0 and r["deformation_coverage"] == 0


def test_future_rows_do_not_change_the_past(spark):
    def late(p):
        p.loc[100:, "a_seis"] = 1.0
    weights = {n: 1.0 for n in cr.EVIDENCE_RULES}
    before = cr.critical_state(firings(channel_frame(spark, 100, lambda p: None)), ["seg"], "day", weights)
    after = cr.critical_state(firings(channel_frame(spark, 120, late)), ["seg"], "day", weights)
    np.testing.assert_allclose(column(before, "critical_state"), column(after, "critical_state")[:100])


@pytest.mark.parametrize("build", [
    lambda f: ts.poisson_anomaly(f, ["seg"], "day", "x", "o", 30, 2.0),
    lambda f: ts.robust_anomaly(f, ["seg"], "day", [Robust("o", "x", 20, 2.0)]),
    lambda f: ts.trailing_slope(f, ["seg"], "day", "x", "o", 20),
    lambda f: ts.rate_ratios(f, ["seg"], "day", "x").withColumnRenamed("swarm_ratio", "o"),
    lambda f: ts.detrend_residual(f, ["seg"], "day", "x", "o", 30, 10),
    lambda f: ts.fold_states(f, ["seg"], "day", [Ewma("o", "x", 0.9)]),
    lambda f: f.withColumn("o", ts.fast_slow_trend("x", ["seg"], "day")),
], ids=["poisson", "robust", "slope", "ratio", "detrend", "ewma", "trend"])
def test_appending_the_future_changes_nothing(spark, build):
    rng = np.random.default_rng(11)
    x = rng.poisson(1.0, 220).astype(float)
    y = np.concatenate([x, rng.poisson(40.0, 30)])
    a, b = column(build(frame(spark, x)), "o"), column(build(frame(spark, y)), "o")[:220]
    assert [v is None for v in a] == [v is None for v in b]
    np.testing.assert_allclose([v for v in a if v is not None], [v for v in b if v is not None], atol=1e-12)


def test_declustering_is_anchored_at_the_kept_event(spark):
    days = [0, 30, 50, 90, 96, 200]
    ev = spark.createDataFrame([(1, DAY0 + dt.timedelta(days=d), i, float(i)) for i, d in enumerate(days)], "seg int, day date, id int, mag double")
    kept = [r["id"] for r in ep.decluster_first(ev, ["seg"], "day", ["id"], 45).orderBy("day").collect()]
    assert kept == [0, 2, 4, 5]
    big = ev.withColumn("t", F.col("day").cast("timestamp_ntz"))
    largest = [r["id"] for r in ep.decluster_largest(big, ["seg"], "t", "mag", ["id"], 30).orderBy("t").collect()]
    assert largest == [1, 2, 4, 5]


def test_control_days_of_spans_equal_those_of_the_laid_out_days(spark):
    """The stretches between events give the control days without a row for each day of each entity."""
    import random

    from riskweave.operators import timeseries as ts

    rng = random.Random(5)
    rows = sorted({(s, DAY0 + dt.timedelta(days=rng.randrange(2400))) for s in range(12) for _ in range(rng.choice([1, 2, 5]))})
    ev = spark.createDataFrame([(s, d, f"{i:03d}") for i, (s, d) in enumerate(rows)], "seg int, day date, id string")
    quiet = spark.createDataFrame([(s, DAY0 + dt.timedelta(days=s * 11)) for s in range(14)], "seg int, day date")
    end = DAY0 + dt.timedelta(days=2600)
    spans = quiet.select("seg", F.col("day").alias("first"), F.lit(end).alias("last"))
    days = ts.date_spine(quiet.withColumn("n", F.lit(1)), ["seg"], end=end).select("seg", "day")
    shuffle = F.unix_date("day").cast("bigint") * 7919 % 10007
    cols = ["seg", "day", "event_day", "id", "rank"]
    want = sorted(map(tuple, ep.control_days(days, ev, ["seg"], "day", "id", shuffle).select(*cols).collect()))
    got = ep.control_days_of_spans(spans, ev, ["seg"], "day", "id", shuffle).select(*cols)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_next_event_of_a_cell_month_is_settled_where_times_are_equal(spark, tmp_path):
    """Events of one time and place: query and SQL both take the least magnitude, whatever the order of the rows."""
    from riskweave.registry import load_all
    from tests.oracle import compare, connect

    apart = 86400 * 1499 * 1493  # keys this far apart have the same second, latitude and longitude
    day = dt.datetime(1998, 3, 9)
    rows = [(k + i * apart, 1, 430000.0 + 1000.0 * ((4 + i) * 7 % 5), day) for i in range(5) for k in range(1, 400)]
    for name in ("region nation customer supplier part lineitem events documents embeddings pages benchmark labels conversations").split():
        spark.range(1).coalesce(1).write.parquet(f"{tmp_path}/src/{name}")
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz")
    orders.coalesce(1).write.parquet(f"{tmp_path}/src/orders")
    for folder in (tmp_path / "src").iterdir():
        next(folder.glob("*.parquet")).rename(tmp_path / f"{folder.name}.parquet")
    q = load_all()["point_in_time_features"]
    assert "min_by(mag, time)" not in q.sql  # leaves the tie to the order in which DuckDB meets the rows
    status, n, _, _, detail = compare(spark, connect(str(tmp_path)), q, str(tmp_path))
    assert status == "OK" and n > 100, detail
