"""Scalar functions and set geometry."""

import math

import pytest
from pyspark.sql import functions as F

from riskweave.functions import fuzzy, geo
from riskweave.functions import probability as pr


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


@pytest.mark.parametrize("knots, expected", [([0, 3, 6], 3), ([0, 0, 1, 2], 7 / 9), ([0, 1, 2, 2], 11 / 9)])
def test_area_centroid(spark, knots, expected):
    assert fuzzy.centroid(knots) == pytest.approx(expected)
    col = F.array(*[F.lit(float(k)) for k in knots])
    assert one(spark, c=fuzzy.centroid_column(col))["c"] == pytest.approx(expected)


@pytest.mark.parametrize("sets, domain", [(fuzzy.ANOMALY_SETS, (-1, 1)), (fuzzy.UNIT_SETS, (0, 1)), (fuzzy.LOAD_SETS, (0, 3))])
def test_partitions_add_up_to_one(spark, sets, domain):
    grid = spark.range(0, 5001).select((domain[0] + F.col("id") / 5000.0 * (domain[1] - domain[0])).alias("x"))
    total = sum((fuzzy.membership("x", p) for p in sets.values()), F.lit(0.0))
    r = grid.select(total.alias("s")).agg(F.min("s").alias("lo"), F.max("s").alias("hi")).first()
    assert r["lo"] == pytest.approx(1, abs=1e-9) and r["hi"] == pytest.approx(1, abs=1e-9)


def test_missing_input_has_no_degree(spark):
    r = one(spark, m=fuzzy.membership(F.lit(None).cast("double"), [0, 1, 2]), z=fuzzy.degree0(F.lit(None).cast("double"), [0, 1, 2]))
    assert r["m"] is None and r["z"] == 0


def test_ruspini_chain_matches_column_form(spark):
    knots = [0.0, 0.5, 0.7, 2.0]
    terms = fuzzy.ruspini_chain(knots)
    rows = spark.range(1).select(F.explode(fuzzy.ruspini_terms(F.array(*[F.lit(k) for k in knots]))).alias("t")).select("t.*").collect()
    for r in rows:
        assert list(r["knots"]) == pytest.approx(terms[f"t{r['term']}"])


def stress(spark, mag, lat, lon, strike=0.0, regime="transform"):
    d = pr.delta_stress(F.lit(mag), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit("transform"), F.lit(lat), F.lit(lon), F.lit(strike), F.lit(regime))
    return one(spark, d=d)["d"]


def test_stress_decay_lobes_and_far_field(spark):
    near, along, across = stress(spark, 7.0, 0.1, 0.0), stress(spark, 7.0, 1.0, 0.0), stress(spark, 7.0, 0.0, 1.0)
    assert 500 < near / along < 2000
    assert along > 0 > across
    assert abs(stress(spark, 7.5, 13.5, 0.0)) < 0.01
    assert stress(spark, 7.0, 1.0, 0.0, regime="subduction") == pytest.approx(along / 4)


def test_poisson_tails_and_chi_square(spark):
    r = one(spark, a=pr.poisson_lower_tail(F.lit(3), F.lit(2.0)), b=pr.poisson_two_sided(F.lit(3), F.lit(200.0)),
            c=pr.chi2_upper_even(F.lit(4.0), F.lit(1)), d=pr.chi2_upper_even(F.lit(9.4877), F.lit(2)))
    assert r["a"] == pytest.approx(math.exp(-2) * (1 + 2 + 2 + 8 / 6))
    assert r["b"] < 1e-6
    assert r["c"] == pytest.approx(math.exp(-2.0))
    assert r["d"] == pytest.approx(0.05, abs=1e-4)


def test_longitude_wraps(spark):
    r = one(spark, a=geo.wrap_longitude(F.lit(180)), b=geo.wrap_longitude(F.lit(-181)), d=geo.haversine_km(F.lit(0.0), F.lit(179.5), F.lit(0.0), F.lit(-179.5)))
    assert (r["a"], r["b"]) == (-180, 179)
    assert r["d"] == pytest.approx(111.19, abs=0.1)


def test_principal_axis(spark):
    rows = [(float(i), 2.0 * i) for i in range(10)]
    df = spark.createDataFrame(rows, "x double, y double")
    c = df.agg(F.var_pop("x").alias("a"), F.var_pop("y").alias("b"), F.covar_pop("x", "y").alias("c"))
    assert c.select(geo.principal_axis_deg("a", "b", "c").alias("s")).first()["s"] == pytest.approx(math.degrees(math.atan2(1, 2)))
