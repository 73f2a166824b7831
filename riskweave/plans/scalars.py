"""Scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import fuzzy, geo
from riskweave.functions import probability as pr
from riskweave.functions.parsing import parse_slip_rate
from riskweave.operators.scoring import lift_to_term
from riskweave.plans.standins import CATALOG_SQL, FAULTS_SQL, catalog, fault_vertices, rounded, sql_haversine, sql_membership, sql_round
from riskweave.registry import query
from riskweave.session import table

X = "(value / 120e0 - 1e0)"
WRAP = "((({d} + 180e0) % 360e0 + 360e0) % 360e0 - 180e0)"


def ev(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "value", (F.col("value") / 120.0 - 1.0).alias("x"))


@query("local_xy_km", f"""WITH {CATALOG_SQL} SELECT id, {sql_round(WRAP.format(d='longitude - 176e0') + ' * 111.32e0 * cos(radians(-18e0))')} AS x_km, {sql_round('(latitude + 18e0) * 110.57e0')} AS y_km FROM catalog""")
def _(spark, sf):
    x, y = geo.local_xy_km("latitude", "longitude", -18.0, 176.0)
    return rounded(catalog(spark, sf).select("id", x.alias("x_km"), y.alias("y_km")))


@query("haversine_km", f"WITH {CATALOG_SQL} SELECT id, {sql_round(sql_haversine('latitude', 'longitude', '-18e0', '179.5e0'))} AS km FROM catalog")
def _(spark, sf):
    return rounded(catalog(spark, sf).select("id", geo.haversine_km("latitude", "longitude", F.lit(-18.0), F.lit(179.5)).alias("km")))


AZ = "((degrees(atan2(sin(radians(176e0 - longitude)) * cos(radians(-18e0)), cos(radians(latitude)) * sin(radians(-18e0)) - sin(radians(latitude)) * cos(radians(-18e0)) * cos(radians(176e0 - longitude)))) % 360e0) + 360e0) % 360e0"


@query("bearing_deg", f"WITH {CATALOG_SQL} SELECT id, {sql_round(AZ)} AS azimuth FROM catalog")
def _(spark, sf):
    return rounded(catalog(spark, sf).select("id", geo.bearing_deg("latitude", "longitude", F.lit(-18.0), F.lit(176.0)).alias("azimuth")))


LOBE = "cos(2 * radians(({az}) - depth * 3e0)) * (0.5e0 + 0.5e0 * greatest(cos(radians(2 * (40e0 - depth * 3e0))), 0e0))"


@query("lobe_pattern", f"WITH {CATALOG_SQL} SELECT id, {sql_round(LOBE.format(az=AZ))} AS lobe FROM catalog")
def _(spark, sf):
    az = geo.bearing_deg("latitude", "longitude", F.lit(-18.0), F.lit(176.0))
    return rounded(catalog(spark, sf).select("id", pr.lobe_pattern(F.col("depth") * 3.0, az, F.lit(40.0)).alias("lobe")))


@query("delta_stress", f"""WITH {CATALOG_SQL} SELECT id, {sql_round("2.0095e-07 * pow(10e0, 1.5e0 * mag + 9.1e0) / pow(greatest(" + sql_haversine('latitude', 'longitude', '-18e0', '176e0') + ", 5e0) * 1000e0, 3) * " + LOBE.format(az=AZ) + " * (CASE WHEN segment % 2 = 0 THEN 1e0 ELSE 0.25e0 END)")} AS delta_cfs_bar FROM catalog""")
def _(spark, sf):
    style = F.when(F.col("segment") % 2 == 0, "transform").otherwise("subduction")
    d = pr.delta_stress("mag", "latitude", "longitude", F.col("depth") * 3.0, style, F.lit(-18.0), F.lit(176.0), F.lit(40.0), F.lit("transform"))
    return rounded(catalog(spark, sf).select("id", d.alias("delta_cfs_bar")))


@query("axial_angle_diff", f"""WITH {CATALOG_SQL}, d AS (SELECT id, abs(depth * 6e0 - 73.3e0) % 180e0 AS d FROM catalog) SELECT id, {sql_round('least(d, 180e0 - d)')} AS diff, {sql_round('abs(least(d, 180e0 - d) - 30e0)')} AS from_optimal FROM d""")
def _(spark, sf):
    d = geo.axial_difference(F.col("depth") * 6.0, F.lit(73.3))
    return rounded(catalog(spark, sf).select("id", d.alias("diff"), F.abs(d - 30.0).alias("from_optimal")))


SETS = fuzzy.ANOMALY_SETS


@query("membership", f"SELECT event_id, {sql_round(sql_membership(X, SETS['high']))} AS high, {sql_round(sql_membership(X, SETS['very_low']))} AS very_low, {sql_round(sql_membership('CASE WHEN event_id % 3 > 0 THEN ' + X + ' END', SETS['normal']))} AS normal FROM events")
def _(spark, sf):
    e = ev(spark, sf)
    return rounded(e.select("event_id", fuzzy.membership("x", SETS["high"]).alias("high"), fuzzy.membership("x", SETS["very_low"]).alias("very_low"),
                            fuzzy.membership(F.when(F.col("event_id") % 3 > 0, F.col("x")), SETS["normal"]).alias("normal")))


@query("membership_centroid", f"""WITH k AS (SELECT event_id, [value, value + event_id % 3, value + event_id % 3 + event_id % 5, value + event_id % 3 + event_id % 5 + event_id % 7] AS p FROM events),
 q AS (SELECT event_id, p[1] AS a, p[2] AS b, p[3] AS c, p[4] AS d FROM k),
 r AS (SELECT *, (b - a) / 2 AS a1, (a + 2 * b) / 3 AS c1, c - b AS a2, (b + c) / 2 AS c2, (d - c) / 2 AS a3, (2 * c + d) / 3 AS c3 FROM q)
 SELECT event_id, {sql_round('CASE WHEN a1 + a2 + a3 > 0 THEN (a1 * c1 + a2 * c2 + a3 * c3) / (a1 + a2 + a3) ELSE (a + d) / 2 END', 5)} AS centroid FROM r""")
def _(spark, sf):
    e, k = ev(spark, sf), F.col("event_id")
    v = F.col("value")
    knots = F.array(v, v + k % 3, v + k % 3 + k % 5, v + k % 3 + k % 5 + k % 7)
    # the moment form divides by small areas, so centre the knots first
    shifted = F.transform(knots, lambda t: t - v)
    return rounded(e.select("event_id", (fuzzy.centroid_column(shifted) + v).alias("centroid")), 5)


@query("ruspini_chain", f"""WITH k AS (SELECT user_id, [min(value), min(value) + 0.25e0 * (max(value) - min(value)), min(value) + 0.6e0 * (max(value) - min(value)), max(value)] AS q FROM events GROUP BY user_id),
 t AS (SELECT user_id, 0 AS term, q[1] - 1e-6 AS a, q[1] - 1e-6 AS b, q[1] AS c, q[2] AS d FROM k UNION ALL SELECT user_id, 1, q[1], q[2], NULL, q[3] FROM k UNION ALL SELECT user_id, 2, q[2], q[3], NULL, q[4] FROM k
   UNION ALL SELECT user_id, 3, q[3], q[4], q[4] + 1e-6, q[4] + 1e-6 FROM k)
 SELECT user_id, CAST(term AS INTEGER) AS term, {sql_round('a')} AS foot_l, {sql_round('b')} AS top_l, {sql_round('d')} AS foot_r FROM t""")
def _(spark, sf):
    g = ev_users(spark, sf)
    span = F.col("hi") - F.col("lo")
    knots = F.array(F.col("lo"), F.col("lo") + 0.25 * span, F.col("lo") + 0.6 * span, F.col("hi"))
    t = g.select("user_id", F.explode(fuzzy.ruspini_terms(knots)).alias("t"))
    kn = F.col("t.knots")
    return rounded(t.select("user_id", "t.term", kn[0].alias("foot_l"), kn[1].alias("top_l"), F.element_at(kn, -1).alias("foot_r")))


def ev_users(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


BEST = "greatest(" + ", ".join(sql_membership(X, p) for p in SETS.values()) + ")"


@query("dominant_term", f"SELECT event_id, CASE " + " ".join(f"WHEN {sql_membership(X, p)} = {BEST} THEN '{t}'" for t, p in SETS.items()) + " END AS term FROM events")
def _(spark, sf):
    return ev(spark, sf).select("event_id", fuzzy.dominant_term("x", SETS).alias("term"))


@query("fuzzify", f"SELECT event_id, " + ", ".join(f"{sql_round('coalesce(' + sql_membership('CASE WHEN event_id % 4 > 0 THEN ' + X + ' END', p) + ', 0e0)')} AS mu__x__{t}" for t, p in SETS.items()) + " FROM events")
def _(spark, sf):
    e = ev(spark, sf).withColumn("x", F.when(F.col("event_id") % 4 > 0, F.col("x")))
    return rounded(fuzzy.fuzzify(e, ["x"]).drop("x", "ts", "value"))


@query("tanh_normalize", f"""SELECT event_id, {sql_round('tanh((value - 50) / 40e0)')} AS t, {sql_round('greatest(-1e0, least(1e0, 2 * (value - 4.5e0) / 150e0 - 1))')} AS c, {sql_round('greatest(-1e0, least(1e0, 2 * ln(1 + value) / ln(51e0) - 1))')} AS l FROM events""")
def _(spark, sf):
    return rounded(ev(spark, sf).select("event_id", fuzzy.tanh_normalize(F.col("value") - 50, F.lit(40.0)).alias("t"),
                                        fuzzy.clip_scale("value", 4.5, 154.5).alias("c"), fuzzy.log_scale("value", 50.0).alias("l")))


@query("clip_scale", f"""SELECT event_id, {sql_round('greatest(-1e0, least(1e0, 2 * (value - 10e0) / 90e0 - 1))')} AS x, {sql_round('greatest(0e0, least(1e0, value / 80e0))')} AS u FROM events""")
def _(spark, sf):
    return rounded(ev(spark, sf).select("event_id", fuzzy.clip_scale("value", 10.0, 100.0).alias("x"), fuzzy.clip(F.col("value") / 80.0, 0.0, 1.0).alias("u")))


@query("poisson_probability", f"""SELECT event_id, {sql_round('1 - exp(-value / 2000e0 * 30)')} AS p30, {sql_round('-ln(greatest(1 - (1 - exp(-value / 2000e0 * 30)), 1e-9)) / 30e0')} AS rate, {sql_round('CASE WHEN value > 0 THEN 30e0 / -ln(greatest(1 - (1 - exp(-value / 2000e0 * 30)), 1e-9)) END', 4)} AS wait_days FROM events""")
def _(spark, sf):
    p = pr.poisson_probability(F.col("value") / 2000.0, 30)
    e = ev(spark, sf).select("event_id", p.alias("p30"))
    return rounded(e.select("event_id", "p30", pr.rate_from_probability("p30").alias("rate"), (F.round(pr.mean_wait_days("p30"), 4)).alias("wait_days")), keep=("wait_days",))


@query("logistic_score", f"SELECT event_id, {sql_round('1 / (1 + exp(-greatest(-30e0, least(30e0, -4.728e0 + 1.4486e0 * ln(1 + value) + 0.7058e0 * (value > 60)::INTEGER))))')} AS p FROM events")
def _(spark, sf):
    p = pr.logistic_score([F.log1p("value"), (F.col("value") > 60).cast("double")], [1.4486, 0.7058], -4.728, limit=30.0)
    return rounded(ev(spark, sf).select("event_id", p.alias("p")))


@query("softplus", f"SELECT event_id, {sql_round('ln(1 + exp(-abs(value - 60))) + greatest(value - 60, 0)')} AS s FROM events")
def _(spark, sf):
    return rounded(ev(spark, sf).select("event_id", pr.softplus(F.col("value") - 60).alias("s")))


@query("seismic_unit_conversions", f"""SELECT event_id, {sql_round('value / 100 * 0.055465763e0 * 1000 / (4 * pi())')} AS los_mm, {sql_round('log10(greatest(value, 1e-3))')} AS log_rms, CAST(DATE '1858-11-17' + CAST(floor(50000 + value) AS INTEGER) AS DATE) AS day FROM events""")
def _(spark, sf):
    return rounded(ev(spark, sf).select("event_id", pr.phase_to_mm(F.col("value") / 100).alias("los_mm"),
                                        F.log10(F.greatest("value", F.lit(1e-3))).alias("log_rms"), pr.mjd_to_date(50000 + F.col("value")).alias("day")))


@query("parse_slip_rate", f"""WITH {FAULTS_SQL} SELECT fault, pos, TRY_CAST(nullif(regexp_extract(trim(slip_text), '^\\(?\\s*([0-9]*\\.?[0-9]+)', 1), '') AS DOUBLE) AS slip FROM fault_vertices""")
def _(spark, sf):
    return fault_vertices(spark, sf).select("fault", "pos", parse_slip_rate("slip_text").alias("slip"))


@query("round_fields", """SELECT event_id, round_even(value, 1) + 0e0 AS v1, round_even(value / 3e0, 3) + 0e0 AS v3, CAST(round_even(value, 0) AS INTEGER) AS v0 FROM events""")
def _(spark, sf):
    return ev(spark, sf).select("event_id", F.bround("value", 1).alias("v1"), F.bround(F.col("value") / 3.0, 3).alias("v3"), F.bround("value", 0).cast("int").alias("v0"))


@query("lift_to_output_term", """WITH b AS (SELECT event_id, least(greatest(value / 40e0 * 0.06e0, 0e0), 1e0) AS implied FROM events) SELECT event_id, CAST(least(6, greatest(0, round_even((ln(implied + 1e-9) - ln(0.06e0 / 5 + 1e-9)) / (ln(0.06e0 * 8 + 1e-9) - ln(0.06e0 / 5 + 1e-9) + 1e-12) * 6, 0))) AS INTEGER) AS term FROM b""")
def _(spark, sf):
    return ev(spark, sf).select("event_id", lift_to_term(F.col("value") / 40.0, F.lit(0.06)).alias("term"))
