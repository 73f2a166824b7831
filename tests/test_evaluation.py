"""Forecast comparison, rank statistics, quantiles and fits against direct computations."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import evaluation as ev, isotonic, learning as ln
from riskweave.operators.quantiles import ordered_totals, quantiles

DAY0 = dt.date(2020, 1, 1)


def test_paired_test_corrects_for_expected_counts(spark):
    ratios = spark.createDataFrame([("s", math.log(2.0)), ("s", math.log(3.0))], "seg string, d double")
    expected = spark.createDataFrame([("s", 7.0, 3.0)], "seg string, exp_a double, exp_b double")
    r = ev.paired_event_test(ratios, expected, ["seg"]).first()
    assert r["n_events"] == 2 and r["low_power"] is True
    assert r["info_gain"] == pytest.approx((math.log(2) + math.log(3)) / 2 - (7 - 3) / 2)


def test_absolute_rate_failure_is_visible(spark):
    ratios = spark.createDataFrame([("s", math.log(100.0)), ("s", math.log(200.0)), ("s", math.log(300.0))], "seg string, d double")
    expected = spark.createDataFrame([("s", 200.0, 1.0)], "seg string, exp_a double, exp_b double")
    r = ev.paired_event_test(ratios, expected, ["seg"]).first()
    assert r["n_p_a"] < 0.05 < r["n_p_b"]


def test_p_values_against_known_numbers():
    assert ev.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert ev.t_two_sided(-12.7062, 1) == pytest.approx(0.05, abs=1e-5)
    assert ev.signed_rank_p(0, 5, 0.0, False) == pytest.approx(2 / 32)
    assert ev.signed_rank_p(8, 10, 0.0, False) == pytest.approx(0.048828125)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    shares = [0.0, 0.1, 0.5, 0.77, 0.95, 1.0]
    np.testing.assert_allclose(quantiles(df, "v", shares), np.quantile(x, shares), rtol=1e-12)


def test_ordered_totals_with_a_hot_group(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 else f"g{i % 7}", float(rng.integers(0, 40)), 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    got = {(r["g"], r["v"]): r["n_below"] for r in ordered_totals(df, ["g"], "v", ["n"], buckets=16).collect()}
    for (g, v), below in got.items():
        assert below == sum(1 for a, b, _ in rows if a == g and b < v)


def test_bucket_lookup_counts_the_points(spark):
    from riskweave.operators.quantiles import bucket_of

    points = [float(p) for p in range(0, 300, 3)]
    rows = spark.range(-5, 310).select((F.col("id") * 1.0).alias("x")).select("x", bucket_of("x", points).alias("b")).collect()
    assert all(r["b"] == sum(p <= r["x"] for p in points) for r in rows)


def test_grouped_quantile_and_auc(spark):
    rng = np.random.default_rng(4)
    p, y, w = rng.random(400).round(2), rng.integers(0, 2, 400), rng.integers(1, 4, 400)
    df = spark.createDataFrame([("a", float(a), int(b), float(c)) for a, b, c in zip(p, y, w)], "g string, p double, y int, w double")
    assert ev.grouped_quantile(df, ["g"], "p", 0.9).first()["q"] == pytest.approx(np.quantile(p, 0.9))
    pos, neg = [(a, c) for a, b, c in zip(p, y, w) if b], [(a, c) for a, b, c in zip(p, y, w) if not b]
    want = sum(c1 * c0 * (1.0 if a1 > a0 else 0.5 if a1 == a0 else 0.0) for a1, c1 in pos for a0, c0 in neg) / (sum(c for _, c in pos) * sum(c for _, c in neg))
    assert ev.rank_scores(df, ["g"], "p", "y", "w").first()["auc"] == pytest.approx(want)


def test_term_fit_equals_iterating_over_rows(spark):
    rng = np.random.default_rng(7)
    s = rng.random((300, 3)) * (rng.random((300, 3)) > 0.4)
    y = rng.normal(5, 1, 300)
    y[::17] = np.nan
    rows = [(*map(float, a), None if np.isnan(b) else float(b)) for a, b in zip(s, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    sets = {"a": [3.0, 4.0, 5.0], "b": [4.0, 5.0, 6.0], "c": [5.0, 6.0, 7.0]}
    got = ln.fit_output_terms(df, {k: k for k in "abc"}, "y", sets, lr=0.3, iterations=6)
    centre = np.array([4.0, 5.0, 6.0])
    ok = ~np.isnan(y) & (s.sum(1) > 0)
    for _ in range(6):
        err = y[ok] - (s[ok] @ centre) / s[ok].sum(1)
        centre = centre + 0.3 * (err[:, None] * s[ok]).sum(0) / s[ok].sum(0)
    np.testing.assert_allclose([got[k][1] for k in "abc"], centre, rtol=1e-9)


def pooled(points):
    """Blocks (lo, hi, sum, n) of sorted (x, sum, n) by pooling neighbours until the rates rise."""
    out = []
    for x, s, n in points:
        out.append([x, x, s, n])
        while len(out) > 1 and out[-2][2] / out[-2][3] >= out[-1][2] / out[-1][3]:
            b = out.pop()
            out[-1] = [out[-1][0], b[1], out[-1][2] + b[2], out[-1][3] + b[3]]
    return out


@pytest.mark.parametrize("rows,parts", [(1, 4), (300, 1), (3000, 40)])
def test_isotonic_blocks_equal_pooling_in_turn(spark, rows, parts):
    rng = np.random.default_rng(rows)
    data = [(round(float(p), 4), int(rng.random() < p ** 2), float(rng.integers(1, 4))) for p in rng.random(rows)] + [(None, 1, 1.0), (0.5, None, 1.0)]
    df = spark.createDataFrame(data, "p double, y int, w double").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        blocks = isotonic.fit_blocks(df, "p", "y", "w")
        got = sorted(tuple(r) for r in blocks.collect())
        ask = [-1.0, 0.0, 0.1234, 0.5, 0.77, 0.99999, 2.0, None] + [d[0] for d in data[:40]]
        out = {r["i"]: r["p_cal"] for r in isotonic.apply_blocks(spark.createDataFrame(list(enumerate(ask)), "i int, p double"), blocks, "p").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    totals = {}
    for p, y, w in data:
        if p is not None and y is not None:
            s, n = totals.get(p, (0.0, 0.0))
            totals[p] = (s + y * w, n + w)
    want = pooled([(x, *totals[x]) for x in sorted(totals)])
    assert [(a, b) for a, b, _, _ in got] == [(a, b) for a, b, _, _ in want]
    np.testing.assert_allclose([r for _, _, _, r in got], [s / n for _, _, s, n in want], rtol=1e-12)
    ends = [v for a, b, s, n in want for v in ((a, s / n), (b, s / n))]
    for i, x in enumerate(ask):
        assert out[i] is None if x is None else out[i] == pytest.approx(np.interp(x, [e[0] for e in ends], [e[1] for e in ends]))


def test_isotonic_without_labels(spark):
    blocks = isotonic.fit_blocks(spark.createDataFrame([], "p double, y int"), "p", "y")
    out = isotonic.apply_blocks(spark.createDataFrame([(0.3, 1)], "p double, k int"), blocks, "p").collect()
    assert blocks.count() == 0 and out[0]["p_cal"] is None


def test_bounded_logistic_respects_limits(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    intercept, coef = ln.fit_bounded_logistic(df, ["a", "b"], "y")
    assert coef[0] > 0.2 and coef[1] == pytest.approx(0.0, abs=1e-6) and -8 <= intercept <= 2


def test_quantiles_of_a_column_without_values(spark):
    assert all(math.isnan(v) for v in quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.1, 0.5]))


def test_bilinear_clips_to_the_rim_and_skips_missing_corners(spark):
    from riskweave.operators.sensors import bilinear

    grid = spark.createDataFrame([(DAY0, 0, 0.0, 0.0, 1.0), (DAY0, 0, 0.0, 2.0, 3.0), (DAY0, 0, 1.0, 0.0, 5.0), (DAY0, 0, 1.0, 2.0, None)],
                                 "day date, map int, lat double, lon double, vtec double")
    points = spark.createDataFrame([(0, 0.0, 1.0), (1, -9.0, 9.0), (2, 0.5, 0.0), (3, 0.5, 1.0)], "point int, latitude double, longitude double")
    got = {r["point"]: r["vtec"] for r in bilinear(points, grid, 1.0, 2.0, 0.0, 0.0, 2, 2).collect()}
    assert got == pytest.approx({0: 2.0, 1: 3.0, 2: 3.0, 3: 3.0})


def test_information_gain_over_a_sure_reference_does_not_fail(spark):
    """A reference rate of 1 (or 0) divides by zero; the mean gain is then not a number, as in DuckDB."""
    df = spark.createDataFrame([("m", 0.9, 1.0), ("m", 0.9, 0.0), ("m", 0.8, 1.0)], "model string, p double, y double")
    for sure in (1.0, 0.0):
        r = ev.forecast_metrics(df, ["model"], "p", "y", sure).first()
        assert r["n"] == 3 and math.isnan(r["info_gain"]) and r["brier"] == pytest.approx(0.86 / 3)
    r = ev.forecast_metrics(df, ["model"], "p", "y", 0.5).first()
    assert r["info_gain"] == pytest.approx((math.log(1.8) + math.log(0.2) + math.log(1.6)) / 3)


def test_leave_group_out_reads_the_events_without_a_join(spark, monkeypatch):
    """The groups come with the features from one scan: a join would be made again for every pass of every fit."""
    from riskweave.plans import learning as plans
    from riskweave.registry import load_all

    seen = []
    monkeypatch.setattr(plans.ln, "leave_group_out", lambda d, *_: seen.append(d) or d)
    load_all()["leave_group_out"].run(spark, "/root/testdata/sf0.001")
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "region" in seen[0].columns


def test_forest_sees_cells_of_rows_and_draws_their_rows(spark):
    """Repeated rows add no cells, a cell is drawn once for each of its rows, and the importances are those of Spark's forest on rows."""
    from pyspark.ml.classification import RandomForestClassifier

    k = F.col("id")
    rows = spark.range(4000).select((k % 37).cast("double").alias("a"), (k % 23).cast("double").alias("b"), (k % 5).cast("double").alias("c"),
                                    ((k % 37 > 20) & (k % 23 > 8) | (k % 11 == 0)).cast("int").alias("y"))
    cells, more = (ln.bin_cells(d, ["a", "b", "c"], "y", None) for d in (rows, rows.unionByName(rows).unionByName(rows)))
    assert cells.count() == more.count() < 3800 and cells.agg(F.sum("__n")).first()[0] == 4000
    many = cells.withColumn("__n", F.lit(50)).limit(2000)
    drawn = ln.bootstrap(many, 3).agg(F.count(F.lit(1)).alias("n"), F.avg("__w").alias("m"), F.variance("__w").alias("v")).first()
    assert drawn["n"] == 2000 and drawn["m"] == pytest.approx(50, abs=1) and drawn["v"] == pytest.approx(50, rel=0.2)
    data, _ = ln.assemble(rows.withColumn("__y", F.col("y").cast("double")), ["a", "b", "c"])
    want = RandomForestClassifier(featuresCol="features", labelCol="__y", numTrees=80, maxDepth=4, seed=1).fit(data).featureImportances.toArray()
    got = ln.forest_importance(rows, ["a", "b", "c"], "y", trees=80, depth=4)
    assert sum(v for _, v in got) == pytest.approx(1) and [v for _, v in got] == pytest.approx(list(want), abs=0.1)
