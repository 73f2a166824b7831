"""Rule mining plans."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from riskweave.functions.fuzzy import ANOMALY_SETS, centroid
from riskweave.operators import mining
from riskweave.plans.standins import rounded, sql_degree0, sql_round
from riskweave.registry import query
from riskweave.session import table

CH = ["a_seis", "a_swarm", "a_fore", "A_state"]
CASE_SQL = """cs AS (SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-17' THEN 'fit' ELSE 'val' END AS epoch, (value >= 60)::INTEGER AS y, value,
  tanh((event_id * 37 % 101 - 50) / 40e0 + (value - 50) / 80e0) AS a_seis, tanh((event_id * 53 % 97 - 48) / 45e0 + (value - 50) / 160e0) AS a_swarm, tanh((event_id * 71 % 89 - 44) / 40e0) AS a_fore,
  tanh((event_id * 11 % 83 - 41) / 40e0 - (value - 50) / 120e0) AS A_state FROM events)"""


def cases(spark, sf, *columns):
    """The cases; *columns* are further ones of the events, taken along in the same scan."""
    e = table(spark, sf, "events")
    k, v = F.col("event_id"), F.col("value")
    def wave(mult, mod, mid, scale):
        return (k * mult % mod - mid) / F.lit(scale)
    return e.select("event_id", F.when(F.col("ts") < F.lit("2024-01-17").cast("timestamp_ntz"), "fit").otherwise("val").alias("epoch"), (v >= 60).cast("int").alias("y"), "value",
                    F.tanh(wave(37, 101, 50, 40.0) + (v - 50) / 80.0).alias("a_seis"), F.tanh(wave(53, 97, 48, 45.0) + (v - 50) / 160.0).alias("a_swarm"),
                    F.tanh(wave(71, 89, 44, 40.0)).alias("a_fore"), F.tanh(wave(11, 83, 41, 40.0) - (v - 50) / 120.0).alias("A_state"), *columns)


SETS = {c: ANOMALY_SETS for c in CH}
MU_SQL = CASE_SQL + ", mu AS (SELECT event_id, epoch, y, value, " + ", ".join(f"{sql_degree0(c, p)} AS {c}__{t}" for c in CH for t, p in ANOMALY_SETS.items()) + " FROM cs), base AS (SELECT epoch, avg(y) AS base FROM cs GROUP BY epoch)"
TERMS = [(c, t) for c in CH for t in ANOMALY_SETS]
SINGLE_SQL = MU_SQL + ", sg AS (" + " UNION ALL ".join(f"SELECT epoch, '{c}' AS channel, '{t}' AS term, sum({c}__{t}) AS support, sum({c}__{t} * y) AS hits FROM mu GROUP BY epoch" for c, t in TERMS) + "), sl AS (SELECT epoch, channel, term, support, hits / support AS rate, hits / support / (base + 1e-12) AS lift FROM sg JOIN base USING (epoch))"
PAIRS = [(a, b) for a, b in combinations(TERMS, 2) if a[0] != b[0]]
PAIR_SQL = SINGLE_SQL + ", pg AS (" + " UNION ALL ".join(
    f"SELECT epoch, '{a}' AS channel_a, '{s}' AS term_a, '{b}' AS channel_b, '{t}' AS term_b, sum(least({a}__{s}, {b}__{t})) AS support, sum(least({a}__{s}, {b}__{t}) * y) AS hits FROM mu GROUP BY epoch" for (a, s), (b, t) in PAIRS) + \
    "), pl AS (SELECT epoch, channel_a, term_a, channel_b, term_b, support, hits / support AS rate, hits / support / (base + 1e-12) AS lift FROM pg JOIN base USING (epoch) WHERE support > 0)"


@query("membership_support_lift", f"WITH {SINGLE_SQL} SELECT epoch, channel, term, {sql_round('support', 5)} AS support, {sql_round('rate', 5)} AS rate, {sql_round('lift', 5)} AS lift FROM sl")
def _(spark, sf):
    return rounded(mining.support_lift(cases(spark, sf), CH, "y", "epoch", SETS), 5)


@query("pair_support_lift", f"WITH {PAIR_SQL} SELECT epoch, channel_a, term_a, channel_b, term_b, {sql_round('support', 5)} AS support, {sql_round('rate', 5)} AS rate, {sql_round('lift', 5)} AS lift FROM pl")
def _(spark, sf):
    return rounded(mining.support_lift(cases(spark, sf), CH, "y", "epoch", SETS, pairs=True), 5)


def two_sql(src, names, prefix):
    cols = ", ".join(names)
    return f"""{prefix}w AS (SELECT {cols}, max(support) FILTER (WHERE epoch = 'fit') AS sf, max(lift) FILTER (WHERE epoch = 'fit') AS lf, max(support) FILTER (WHERE epoch = 'val') AS sv, max(lift) FILTER (WHERE epoch = 'val') AS lv FROM {src} GROUP BY {cols}),
 {prefix}2 AS (SELECT *, CASE WHEN abs(lf - 1) > 1e-6 THEN (lv - 1) / (lf - 1) ELSE 0 END AS ret FROM {prefix}w WHERE sf >= 100 AND sv >= 80), {prefix} AS (SELECT *, (lf - 1) * (lv - 1) > 0 AND ret >= 0.5 AS ok FROM {prefix}2)"""


@query("channel_retention", f"WITH {SINGLE_SQL}, {two_sql('sl', ['channel', 'term'], 's')}, c AS (SELECT unnest(['a_seis', 'a_swarm', 'a_fore', 'A_state', 'a_tect']) AS channel) SELECT channel, {sql_round('least(1e0, greatest(0.2e0, coalesce(avg(CASE WHEN ret IS NOT NULL THEN least(1e0, greatest(0e0, ret)) END), 0.3e0)))', 5)} AS influence FROM c LEFT JOIN s USING (channel) GROUP BY channel")
def _(spark, sf):
    s = mining.two_epochs(mining.support_lift(cases(spark, sf), CH, "y", "epoch", SETS), ["channel", "term"], "epoch", 100, 80)
    return rounded(mining.channel_influence(s, [*CH, "a_tect"]), 5)


@query("mine_rules", f"""WITH {PAIR_SQL}, {two_sql('sl', ['channel', 'term'], 's')}, {two_sql('pl', ['channel_a', 'term_a', 'channel_b', 'term_b'], 'p')},
 g AS (SELECT p.*, p.lf / (CASE WHEN p.lf > 1 THEN greatest(coalesce(a.lf, 1), coalesce(b.lf, 1)) ELSE least(coalesce(a.lf, 1), coalesce(b.lf, 1)) END + 1e-12) AS gain FROM p LEFT JOIN s a ON a.channel = p.channel_a AND a.term = p.term_a LEFT JOIN s b ON b.channel = p.channel_b AND b.term = p.term_b)
 SELECT CAST(1 AS INTEGER) AS arity, channel AS channel_a, term AS term_a, NULL::VARCHAR AS channel_b, NULL::VARCHAR AS term_b, {sql_round('sf', 4)} AS support, {sql_round('lf', 5)} AS lift_fit, {sql_round('lv', 5)} AS lift_val, {sql_round('ret', 4)} AS retention, NULL::DOUBLE AS gain FROM s WHERE ok
 UNION ALL SELECT 2, channel_a, term_a, channel_b, term_b, {sql_round('sf', 4)}, {sql_round('lf', 5)}, {sql_round('lv', 5)}, {sql_round('ret', 4)}, {sql_round('gain', 5)} FROM g WHERE ok AND CASE WHEN lf > 1 THEN gain >= 1.15 ELSE gain <= 1 / 1.15 END""")
def _(spark, sf):
    rules, _ = mining.mine_rules(cases(spark, sf), CH, "y", "epoch", 100, 80, sets=SETS)
    return rules.select("arity", "channel_a", "term_a", "channel_b", "term_b", *[F.round(c, d).alias(c) for c, d in (("support", 4), ("lift_fit", 5), ("lift_val", 5), ("retention", 4), ("gain", 5))])


ONE_SQL = PAIR_SQL.replace("CASE WHEN ts < TIMESTAMP '2024-01-17' THEN 'fit' ELSE 'val' END AS epoch", "'fit' AS epoch")
W = "least(1e0, greatest(0e0, CASE WHEN rate > base THEN (rate - base) / (1 - base) ELSE (base - rate) / (base + 1e-9) END))"


@query("mine_single_epoch_rules", f"""WITH {ONE_SQL}, s AS (SELECT * FROM sl WHERE support >= 40), g AS (SELECT p.*, p.lift / (CASE WHEN p.lift > 1 THEN greatest(coalesce(a.lift, 1), coalesce(b.lift, 1)) ELSE least(coalesce(a.lift, 1), coalesce(b.lift, 1)) END + 1e-12) AS gain
   FROM pl p LEFT JOIN s a ON a.channel = p.channel_a AND a.term = p.term_a LEFT JOIN s b ON b.channel = p.channel_b AND b.term = p.term_b WHERE p.support >= 40 AND p.term_a <> 'normal' AND p.term_b <> 'normal' AND abs(p.lift - 1) >= 0.15e0 - 1e-16),
 r AS (SELECT channel AS channel_a, term AS term_a, NULL::VARCHAR AS channel_b, NULL::VARCHAR AS term_b, support, rate, lift, NULL::DOUBLE AS gain FROM s WHERE abs(lift - 1) >= 0.15e0 - 1e-16 UNION ALL SELECT channel_a, term_a, channel_b, term_b, support, rate, lift, gain FROM g WHERE CASE WHEN lift > 1 THEN gain >= 1.12 ELSE gain <= 1 / 1.12 END)
 SELECT channel_a, term_a, channel_b, term_b, {sql_round('support', 4)} AS support, {sql_round('rate', 5)} AS rate, {sql_round('lift', 5)} AS lift, {sql_round('gain', 5)} AS gain, CASE WHEN rate > base THEN 'yes' ELSE 'no' END AS direction, {sql_round(W, 5)} AS weight FROM r, (SELECT base FROM base) WHERE {W} > 0.05""")
def _(spark, sf):
    r = mining.mine_single_epoch(cases(spark, sf), CH, "y", sets=SETS)
    return rounded(r.withColumn("support", F.round("support", 4)), 5, keep=("support",))


OUT_SETS = {f"t{i + 1}": [200.0 * i / 5, 200.0 * (i + 0.5) / 5, 200.0 * (i + 1) / 5] for i in range(5)}
TT_SQL = MU_SQL + ", tt AS (" + " UNION ALL ".join(f"SELECT '{c}' AS channel, '{t}' AS term, sum({c}__{t}) AS support, sum({c}__{t} * value) / sum({c}__{t}) AS m FROM mu WHERE y = 1" for c, t in TERMS) + ")"
NEAR = "CASE " + " ".join(f"WHEN abs(m - {centroid(p)!r}::DOUBLE) = least({', '.join(f'abs(m - {centroid(q)!r}::DOUBLE)' for q in OUT_SETS.values())}) THEN '{t}'" for t, p in OUT_SETS.items()) + " END"


@query("term_target_mean", f"WITH {TT_SQL} SELECT channel, term, {sql_round('support', 5)} AS support, {sql_round('m', 5)} AS mean_target, {NEAR} AS out_term FROM tt WHERE support >= 40")
def _(spark, sf):
    t = mining.term_targets(cases(spark, sf).filter("y = 1"), CH, "value", 40.0, SETS)
    return rounded(mining.nearest_output_term(t, OUT_SETS), 5)


@query("mine_output_rules", f"""WITH {TT_SQL}, b AS (SELECT avg(value) AS b FROM cs WHERE y = 1), l AS (SELECT channel, term, support, m, b, CASE WHEN m < b THEN 'centre' ELSE 'edge' END AS out_term, CASE WHEN m < b THEN b / (m + 1e-9) ELSE m / (b + 1e-9) END AS lift FROM tt, b WHERE support >= 30 AND term <> 'normal')
 SELECT channel, term, {sql_round('m', 5)} AS mean_target, out_term, {sql_round('lift', 5)} AS lift, {sql_round('least(1e0, abs(m - b) / (b + 1e-9))', 5)} AS weight FROM l WHERE lift >= 1.03""")
def _(spark, sf):
    from riskweave.operators.mining_outputs import directional_rules

    r = directional_rules(cases(spark, sf).filter("y = 1"), CH, "value", "centre", "edge", 30.0, 1.03, SETS)
    return rounded(r.select("channel", "term", "mean_target", "out_term", "lift", "weight"), 5)


@query("magnitude_rules", f"WITH {TT_SQL} SELECT channel, term, {sql_round('support', 5)} AS support, {sql_round('m', 5)} AS mean_target, {NEAR} AS out_term FROM tt WHERE channel = 'A_state' AND support >= 20")
def _(spark, sf):
    from riskweave.operators.mining_outputs import magnitude_rules

    return rounded(magnitude_rules(cases(spark, sf).filter("y = 1"), "A_state", "value", OUT_SETS, 20.0, SETS), 5)


SOON_SQL = MU_SQL + ", sn AS (SELECT *, (value - 60) / 3e0 <= 10 AS soon FROM mu WHERE y = 1), sb AS (SELECT avg(soon::INTEGER) AS base FROM sn), st AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS channel, '{t}' AS term, sum({c}__{t}) AS support, sum({c}__{t} * soon::INTEGER) / sum({c}__{t}) AS rate FROM sn" for c, t in TERMS if t in ("high", "very_high")) + "), so AS (SELECT *, rate / (base + 1e-12) AS lift FROM st, sb WHERE support >= 20)"


@query("timing_rules", f"WITH {SOON_SQL} SELECT channel, term, {sql_round('support', 5)} AS support, {sql_round('rate', 5)} AS rate, {sql_round('lift', 5)} AS lift, 'imminent' AS out_term, {sql_round('least(1e0, greatest(0e0, (rate - base) / (1 - base)))', 5)} AS weight FROM so WHERE lift >= 1.01")
def _(spark, sf):
    from riskweave.operators.mining_outputs import timing_rules

    d = cases(spark, sf).filter("y = 1").withColumn("delta_days", (F.col("value") - 60) / 3.0)
    return rounded(timing_rules(d, CH, "delta_days", 10.0, 20.0, 1.01, SETS), 5)
