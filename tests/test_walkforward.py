"""Walk-forward folds: sums of periods equal mining each fold on its own rows; later rows change nothing."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskweave.functions.fuzzy import ANOMALY_SETS
from riskweave.operators import mining, walkforward as wf

CH = ["a", "b"]
SETS = {c: ANOMALY_SETS for c in CH}
DAY0 = dt.date(2015, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    out = []
    for i in range(3000):
        a, b = rng.uniform(-1, 1), rng.choice([None, rng.uniform(-1, 1)])
        out.append((DAY0 + dt.timedelta(days=rng.randrange(1500)), a, b, int(rng.random() < (0.5 if a > 0.5 else 0.1)), rng.random() * 9, rng.random() * 4))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "date date, a double, b double, y int, rate double, activity double")


def test_folds_equal_mining_their_own_rows(spark, rows):
    df = frame(spark, rows)
    origins = ["2017-01-01", "2018-01-01"]
    folds = wf.folds_of(df, "date", origins, 1.0)
    assert [f.origin for f in folds] == origins
    found, _ = wf.fold_rules(wf.PeriodCube(df, "date", CH, "y", folds, SETS), 20, 20)
    got = sorted((r["fold"], r["arity"], r["channel_a"], r["term_a"], r["channel_b"] or "", r["term_b"] or "", round(r["support"], 6), round(r["lift_fit"], 9), round(r["lift_val"], 9)) for r in found.collect())
    want = []
    for f in folds:
        own = df.filter(F.unix_date("date") < f.start).withColumn("e", F.when(F.unix_date("date") < f.mid, "fit").otherwise("val"))
        want += [(f.origin, r["arity"], r["channel_a"], r["term_a"], r["channel_b"] or "", r["term_b"] or "", round(r["support"], 6), round(r["lift_fit"], 9), round(r["lift_val"], 9))
                 for r in mining.mine_rules(own, CH, "y", "e", 20, 20, sets=SETS)[0].collect()]
    assert got == sorted(want) and len(got) > 3


def test_run_scores_only_the_years_behind_the_origin(spark, rows):
    df = frame(spark, rows)
    args = ("date", "y", "rate", "activity", CH, ["2017-06-01"], 1.0, 20, 20, 1, SETS)
    rules, metrics = wf.run(df, *args)
    later = frame(spark, [(dt.date(2030, 1, 1), 0.9, 0.9, 1, 1.0, 1.0)] * 50)
    again = wf.run(df.unionByName(later), *args)[1]
    def plain(m):
        return sorted((r["model"], r["n"], round(r["brier"], 12)) for r in m.collect())
    n = sum(dt.date(2017, 6, 1) <= r[0] and (r[0] - dt.date(2017, 6, 1)).days < 365.25 for r in rows)
    assert plain(metrics) == plain(again) and {x[1] for x in plain(metrics)} == {n} and rules.count() > 0
    m = wf.fold_materiality(metrics).collect()[0]
    assert m["mean_delta"] == pytest.approx(m["last_delta"])
    with pytest.raises(ValueError):
        wf.run(df, "date", "y", "rate", "activity", CH, ["2017-06-01"], 1.0, min_test=10 ** 6, sets=SETS)
