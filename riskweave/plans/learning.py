"""Model fits and profile plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.fuzzy import ANOMALY_SETS, degree0
from riskweave.operators import isotonic, learning as ln
from riskweave.operators.profiles import pairwise_distance, summary_stats
from riskweave.plans.rules import CASE_SQL, CH, cases
from riskweave.plans.series import SENSOR_SQL, sensor
from riskweave.plans.standins import SCORES_SQL, rounded, score_rows, sql_degree0, sql_round
from riskweave.registry import query
from riskweave.session import table

OUT = {"t1": [0.0, 20.0, 40.0], "t2": [30.0, 50.0, 70.0], "t3": [60.0, 90.0, 120.0], "t4": [100.0, 150.0, 200.0]}
SRC = {"t1": ("a_seis", "low"), "t2": ("a_seis", "normal"), "t3": ("a_seis", "high"), "t4": ("a_swarm", "very_high")}
S_SQL = CASE_SQL + ", st AS (SELECT value, y, " + ", ".join(f"{sql_degree0(c, ANOMALY_SETS[t])} AS {k}" for k, (c, t) in SRC.items()) + " FROM cs), tot AS (SELECT *, t1 + t2 + t3 + t4 AS s FROM st WHERE t1 + t2 + t3 + t4 > {floor})"


def stats_sql(target, floor):
    t = list(SRC)
    return S_SQL.replace("{floor}", floor) + ", su AS (SELECT " + ", ".join([f"sum({a}) AS s_{a}" for a in t] + [f"sum({target} * {a}) AS y_{a}" for a in t] + [f"sum({a} * {b} / s) AS m_{a}_{b}" for a in t for b in t]) + " FROM tot)"


def move(a, lr):
    return f"({lr} * (y_{a} - ({' + '.join(f'c_{b} * m_{a}_{b}' for b in SRC)})) / s_{a})"


def strengths(spark, sf):
    return cases(spark, sf).withColumns({k: degree0(c, ANOMALY_SETS[t]) for k, (c, t) in SRC.items()})


@query("ia3_batch_fit", f"""WITH RECURSIVE {stats_sql('value', '0')}, it AS (SELECT 0 AS i, {', '.join(f'CAST({sum(OUT[a]) / 3} AS DOUBLE) AS c_{a}' for a in SRC)} UNION ALL SELECT i + 1, {', '.join(f'c_{a} + ' + move(a, '0.3e0') for a in SRC)} FROM it, su WHERE i < 12)
 SELECT term, {sql_round('c', 5)} AS centre FROM (SELECT {', '.join(f'c_{a} AS {a}' for a in SRC)} FROM it WHERE i = 12) UNPIVOT (c FOR term IN ({', '.join(SRC)}))""")
def _(spark, sf):
    sets = ln.fit_output_terms(strengths(spark, sf), {k: k for k in SRC}, "value", OUT)
    return rounded(spark.createDataFrame([(t, sum(k) / 3) for t, k in sets.items()], "term string, centre double"), 5)


def ordered_sql():
    cl = {a: f"least(0.97e0, greatest(1e-4, c_{a} + {move(a, '0.25e0')}))" for a in SRC}
    names, cols = list(SRC), []
    for i, a in enumerate(names):
        cols.append((f"greatest({', '.join(cl[b] for b in names[:i + 1])})" if i else cl[a]))
    import math
    base = "(SELECT avg(y) FROM cs)"
    init = [f"least(0.95e0, greatest(1e-4, exp(ln({base} / 5 + 1e-9) + (ln(least({base} * 8, 0.9e0)) - ln({base} / 5 + 1e-9)) * {i} / 3)))" for i in range(4)]
    return init, cols


INIT, NEXT = ordered_sql()


@query("ia3_ordered_centroids_fit", f"""WITH RECURSIVE {stats_sql('y', '1e-6')}, it AS (SELECT 0 AS i, {', '.join(f'{e} AS c_{a}' for e, a in zip(INIT, SRC))} UNION ALL SELECT i + 1, {', '.join(NEXT)} FROM it, su WHERE i < 25)
 SELECT term, {sql_round('c', 5)} AS centre FROM (SELECT {', '.join(f'c_{a} AS {a}' for a in SRC)} FROM it WHERE i = 25) UNPIVOT (c FOR term IN ({', '.join(SRC)}))""")
def _(spark, sf):
    s = strengths(spark, sf)
    base = s.agg(F.avg("y")).first()[0]
    c = ln.fit_ordered_centres(s, list(SRC), "y", base)
    return rounded(spark.createDataFrame(list(zip(SRC, c)), "term string, centre double"), 5)


def model_table(spark, features, fitted):
    rows = [("intercept", float(fitted[0])), *zip(features, map(float, fitted[1]))]
    return rounded(spark.createDataFrame(rows, "feature string, coefficient double"), 4)


@query("logistic_fit")
def _(spark, sf):
    return model_table(spark, CH, ln.fit_logistic(cases(spark, sf), CH, "y"))


@query("logistic_fit_l1_balanced")
def _(spark, sf):
    d = ln.class_balance(cases(spark, sf), "y")
    return model_table(spark, CH, ln.fit_logistic(d, CH, "y", "__w", reg=0.02, l1=1.0))


@query("bounded_logistic_fit")
def _(spark, sf):
    d = cases(spark, sf).withColumn("w", 1.0 / (1 + F.col("event_id") % 3))
    return model_table(spark, CH, ln.fit_bounded_logistic(d, CH, "y", "w"))


ISO_SQL = SCORES_SQL + """, m AS (SELECT p, sum(y) AS s, count(*) AS n, row_number() OVER (ORDER BY p) AS i FROM scores WHERE day < DATE '2024-01-20' GROUP BY p), cs AS (SELECT *, sum(s) OVER (ORDER BY i) AS cs, sum(n) OVER (ORDER BY i) AS cn FROM m),
 pairs AS (SELECT a.i AS j, b.i AS i, (b.cs - a.cs + a.s) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS r FROM cs a JOIN cs b ON b.i >= a.i), low AS (SELECT j, i, min(r) OVER (PARTITION BY j ORDER BY i DESC) AS r FROM pairs), iso AS (SELECT p AS x, max(r) AS v FROM low JOIN m USING (i) GROUP BY p),
 h AS (SELECT id, y, p FROM scores WHERE day >= DATE '2024-01-20'), lo AS (SELECT h.*, iso.x AS x0, iso.v AS v0 FROM h ASOF LEFT JOIN iso ON h.p >= iso.x), hi AS (SELECT lo.*, iso.x AS x1, iso.v AS v1 FROM lo ASOF LEFT JOIN iso ON lo.p <= iso.x)"""


@query("isotonic_calibration", f"WITH {ISO_SQL} SELECT id, y, {sql_round('CASE WHEN x0 IS NULL THEN v1 WHEN x1 IS NULL THEN v0 WHEN x1 > x0 THEN v0 + (p - x0) * (v1 - v0) / (x1 - x0) ELSE v0 END')} AS p_cal FROM hi")
def _(spark, sf):
    s = score_rows(spark, sf)
    cut = F.lit("2024-01-20").cast("date")
    blocks = isotonic.fit_blocks(s.filter(F.col("day") < cut), "p", "y")
    return rounded(isotonic.apply_blocks(s.filter(F.col("day") >= cut).select("id", "y", "p"), blocks, "p").select("id", "y", "p_cal"))


@query("forest_importance")
def _(spark, sf):
    imp = ln.forest_importance(ln.class_balance(cases(spark, sf), "y"), CH, "y", trees=300, weight="__w")
    return rounded(spark.createDataFrame(imp, "feature string, importance double"))


@query("rank_sum_features", """WITH f AS (SELECT event_type AS feature, sum(value) AS a, count(*) AS b, max(value) AS c FROM events GROUP BY 1), r AS (SELECT feature, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2e0 + rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2e0 + rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2e0 AS rank_score FROM f)
 SELECT feature, rank_score FROM r""")
def _(spark, sf):
    f = table(spark, sf, "events").groupBy(F.col("event_type").alias("feature")).agg(F.sum("value").alias("a"), F.count(F.lit(1)).alias("b"), F.max("value").alias("c"))
    return ln.rank_sum(f, ["a", "b", "c"]).select("feature", "rank_score")


@query("forward_subset_curve")
def _(spark, sf):
    c = cases(spark, sf)
    curve = ln.forward_subset(c.filter("epoch = 'fit'"), c.filter("epoch = 'val'"), CH[1:], CH[:1], "y")
    return rounded(spark.createDataFrame(curve, "k int, auc double"))


@query("leave_group_out")
def _(spark, sf):
    d = cases(spark, sf, F.col("event_type").alias("region"))
    return rounded(ln.leave_group_out(d, "region", CH, "y"))


@query("time_shift_falsification")
def _(spark, sf):
    from riskweave.operators import asof

    d = cases(spark, sf, F.col("event_type").alias("segment"), F.col("ts"))
    fitted = ln.fit_bounded_logistic(d.filter("epoch = 'fit'"), CH, "y")
    d = ln.predict(d, CH, fitted)
    pos = d.filter("epoch = 'val' AND y = 1").select("event_id", "segment", "p", F.timestamp_add("DAY", F.lit(-7), F.col("ts")).alias("target"))
    m = asof.nearest(pos, d.select("segment", "ts", F.col("p").alias("q")), ["segment"], "target", "ts", ["q"], bucket="DAY")
    m = m.filter(F.abs(asof.days_between("target", "match.t")) <= 1.0)
    both = m.select(F.explode(F.array(F.struct(F.col("p").alias("p"), F.lit(1).alias("y")), F.struct(F.col("match.q").alias("p"), F.lit(0).alias("y")))).alias("s")).select("s.p", "s.y")
    n = m.agg(F.count(F.lit(1)).alias("pairs"))
    from riskweave.operators.evaluation import rank_scores
    return rounded(rank_scores(both, [], "p", "y").select(F.col("auc").alias("auc_actual_vs_shifted")).crossJoin(n))


@query("pairwise_profile_distance", f"""WITH {SENSOR_SQL}, m AS (SELECT station, quantile_cont(value, 0.5) AS med, stddev_samp(value) AS sd, avg(value) AS mean FROM sensor GROUP BY station), f AS (SELECT station, any_value(mean) AS mean, any_value(sd) AS std, avg((value > med + 0.5e0 * sd)::INTEGER) AS frac_high FROM sensor JOIN m USING (station) WHERE value IS NOT NULL GROUP BY station),
 g AS (SELECT avg(mean) AS a, stddev_pop(mean) AS b, avg(std) AS c, stddev_pop(std) AS d, avg(frac_high) AS e, stddev_pop(frac_high) AS h FROM f), z AS (SELECT station, (mean - a) / (b + 1e-9) AS x, (std - c) / (d + 1e-9) AS y, (frac_high - e) / (h + 1e-9) AS w FROM f, g)
 SELECT p.station AS a, q.station AS b, {sql_round('sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.w - q.w, 2))', 5)} AS distance FROM z p JOIN z q ON p.station < q.station""")
def _(spark, sf):
    prof = summary_stats(sensor(spark, sf), ["station"], "day", "value")
    return rounded(pairwise_distance(prof, "station", ["mean", "std", "frac_high"]), 5)


@query("profile_clusters")
def _(spark, sf):
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return ln.profile_clusters(e, "v", 5).select("vec_id", "cluster")
