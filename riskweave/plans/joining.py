"""As-of, label, matching and declustering plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.functions.geo import month_distance
from riskweave.operators import asof, episodes as ep, graph, timeseries as ts
from riskweave.plans.series import DAILY_SQL, SENSOR_SQL, daily, sensor
from riskweave.plans.standins import (
    CATALOG_SQL, READINGS_SQL, catalog, literal_table, readings, rounded, sql_days, sql_round, values)
from riskweave.registry import query
from riskweave.session import cut_lineage, table

FEAT_SQL = READINGS_SQL + ", feat AS (SELECT segment, day, avg(value) AS value FROM readings GROUP BY 1, 2)"


def features(spark, sf):
    return readings(spark, sf).groupBy("segment", "day").agg(F.avg("value").alias("value"))


@query("asof_backward_row", f"""WITH {CATALOG_SQL}, {FEAT_SQL}, a AS (SELECT id, segment, day - 7 AS anchor FROM catalog WHERE mag >= 5.6e0)
 SELECT a.id, a.segment, CAST(a.anchor AS DATE) AS anchor, f.day AS feature_day, {sql_round('f.value')} AS value FROM a ASOF LEFT JOIN feat f ON a.segment = f.segment AND a.anchor >= f.day""")
def _(spark, sf):
    a = catalog(spark, sf).filter("mag >= 5.6").select("id", "segment", F.date_sub("day", 7).alias("anchor"))
    out = asof.neighbours(a, features(spark, sf), ["segment"], "anchor", "day", ["value"], next=False)
    return rounded(out.select("id", "segment", "anchor", F.col("prev.t").alias("feature_day"), F.col("prev.value").alias("value")))


@query("asof_forward_next_event", f"""WITH e AS (SELECT event_id, event_type, ts, value FROM events), t AS (SELECT * FROM e WHERE value >= 140)
 SELECT e.event_id, CASE WHEN {sql_days('t.ts', 'e.ts')} <= 0.25e0 THEN t.event_id END AS next_id, {sql_round(f"CASE WHEN {sql_days('t.ts', 'e.ts')} <= 0.25e0 THEN t.value END")} AS next_mag,
  {sql_round(f"CASE WHEN {sql_days('t.ts', 'e.ts')} <= 0.25e0 THEN {sql_days('t.ts', 'e.ts')} END")} AS delta_days
 FROM e ASOF LEFT JOIN t ON e.event_type = t.event_type AND e.ts < t.ts""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    t = e.filter("value >= 140")
    out = asof.neighbours(e, t, ["event_type"], "ts", "ts", ["event_id", "value"], bucket=None, prev=False)
    d = asof.days_between("next.t", "ts")
    return rounded(out.select("event_id", F.when(d <= 0.25, F.col("next.event_id")).alias("next_id"),
                              F.when(d <= 0.25, F.col("next.value")).alias("next_mag"), F.when(d <= 0.25, d).alias("delta_days")))


NEAREST_SQL = f"""b AS (SELECT a.id, a.segment, a.time, f.day AS d, f.value AS v FROM a ASOF LEFT JOIN feat f ON a.segment = f.segment AND a.time >= f.day),
 n AS (SELECT a.id, f.day AS d, f.value AS v FROM a ASOF LEFT JOIN feat f ON a.segment = f.segment AND a.time < f.day),
 near AS (SELECT b.id, b.segment, b.time, CASE WHEN b.d IS NULL OR (n.d IS NOT NULL AND {sql_days('n.d', 'b.time')} <= {sql_days('b.time', 'b.d')}) THEN n.d ELSE b.d END AS d,
   CASE WHEN b.d IS NULL OR (n.d IS NOT NULL AND {sql_days('n.d', 'b.time')} <= {sql_days('b.time', 'b.d')}) THEN n.v ELSE b.v END AS v FROM b JOIN n USING (id))"""


@query("asof_nearest", f"""WITH {CATALOG_SQL}, {FEAT_SQL}, a AS (SELECT id, segment, time FROM catalog), {NEAREST_SQL}
 SELECT id, d AS match_day, {sql_round('v')} AS value FROM near""")
def _(spark, sf):
    a = catalog(spark, sf).select("id", "segment", "time")
    f = features(spark, sf).withColumn("fday", F.col("day").cast("timestamp_ntz"))
    out = asof.nearest(a, f, ["segment"], "time", "fday", ["value"])
    return rounded(out.select("id", F.to_date("match.t").alias("match_day"), F.col("match.value").alias("value")))


BIG = "mag >= 5.69e0"


@query("range_join_forward_label", f"""WITH {DAILY_SQL}, big AS (SELECT DISTINCT segment, day FROM catalog WHERE {BIG})
 SELECT d.segment, d.day, CAST(coalesce(b.day - d.day <= 30, FALSE) AS INTEGER) AS f_30d, CAST(coalesce(b.day - d.day <= 90, FALSE) AS INTEGER) AS f_90d
 FROM daily d ASOF LEFT JOIN big b ON d.segment = b.segment AND d.day < b.day""")
def _(spark, sf):
    ev = catalog(spark, sf).filter(BIG)
    out = asof.forward_labels(daily(spark, sf), ev, ["segment"], "day", "time", ["mag"], ["k"])
    gap = F.datediff(F.col("next.day"), F.col("day"))
    return out.select("segment", "day", *[F.coalesce(gap <= h, F.lit(False)).cast("int").alias(f"f_{h}d") for h in (30, 90)])


@query("next_event_link", f"""WITH {DAILY_SQL}, big AS (SELECT *, row_number() OVER (PARTITION BY segment, day ORDER BY time, k) AS r FROM catalog WHERE {BIG}), f AS (SELECT * FROM big WHERE r = 1)
 SELECT d.segment, d.day, CASE WHEN f.day - d.day <= 30 THEN f.id END AS event_id, {sql_round('CASE WHEN f.day - d.day <= 30 THEN f.mag END')} AS event_mag,
   CASE WHEN f.day - d.day <= 30 THEN CAST(f.day - d.day AS INTEGER) END AS event_delta_days FROM daily d ASOF LEFT JOIN f ON d.segment = f.segment AND d.day < f.day""")
def _(spark, sf):
    ev = catalog(spark, sf).filter(BIG)
    out = asof.forward_labels(daily(spark, sf), ev, ["segment"], "day", "time", ["id", "mag"], ["k"])
    gap = F.datediff(F.col("next.day"), F.col("day"))
    return rounded(out.select("segment", "day", F.when(gap <= 30, F.col("next.id")).alias("event_id"),
                              F.when(gap <= 30, F.col("next.mag")).alias("event_mag"), F.when(gap <= 30, gap).alias("event_delta_days")))


@query("first_last_event_gap", f"""WITH {DAILY_SQL}, m AS (SELECT segment, day, max(time) AS t, max(mag) AS mg FROM catalog GROUP BY 1, 2)
 SELECT segment, day, {sql_round(f"coalesce({sql_days('day', 'max(t) OVER w')}, 99999e0)", 8)} AS t_last, {sql_round('coalesce(max(mg) OVER w, 0e0)')} AS mag_max
 FROM spine LEFT JOIN m USING (segment, day) WINDOW w AS (PARTITION BY segment ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    m = catalog(spark, sf).groupBy("segment", "day").agg(F.max("time").alias("t"), F.max("mag").alias("mg"))
    d = ts.date_spine(m, ["segment"], values=["t", "mg"], fill=None)
    past = Window.partitionBy("segment").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"lt": F.max("t").over(past), "lm": F.max("mg").over(past)})
    return d.select("segment", "day", F.round(F.coalesce(asof.days_between("day", "lt"), F.lit(99999.0)), 8).alias("t_last"),
                    F.round(F.coalesce("lm", F.lit(0.0)), 6).alias("mag_max"))


FIRST_SQL = f"""dd AS (SELECT segment, day, row_number() OVER (PARTITION BY segment ORDER BY day) AS rn FROM (SELECT DISTINCT segment, day FROM catalog WHERE {BIG})),
 fold AS (SELECT segment, day, rn, day AS kept FROM dd WHERE rn = 1 UNION ALL SELECT dd.segment, dd.day, dd.rn, CASE WHEN dd.day - fold.kept > {{gap}} THEN dd.day ELSE fold.kept END
   FROM fold JOIN dd ON dd.segment = fold.segment AND dd.rn = fold.rn + 1)"""
INDEP_SQL = CATALOG_SQL + ", " + FIRST_SQL.format(gap=45) + f""", indep AS (SELECT c.segment, c.day, c.id, c.k, c.mag, c.time FROM (SELECT *, row_number() OVER (PARTITION BY segment, day ORDER BY time, k) AS r FROM catalog WHERE {BIG}) c
   JOIN fold ON fold.segment = c.segment AND fold.day = c.day AND fold.kept = fold.day WHERE c.r = 1)"""


def independent(spark, sf):
    ev = catalog(spark, sf).filter(BIG).select("segment", "day", "id", "k", "mag", "time")
    return ep.decluster_first(ev, ["segment"], "day", ["time", "k"], 45)


@query("greedy_decluster_first", f"WITH RECURSIVE {INDEP_SQL} SELECT segment, day, id, {sql_round('mag')} AS mag FROM indep")
def _(spark, sf):
    return rounded(independent(spark, sf).select("segment", "day", "id", "mag"))


@query("greedy_decluster_largest", f"""WITH RECURSIVE {CATALOG_SQL}, bt AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY time, k) AS rn FROM catalog WHERE {BIG}),
 wf AS (SELECT segment, rn, time AS opened FROM bt WHERE rn = 1 UNION ALL SELECT bt.segment, bt.rn, CASE WHEN bt.time >= wf.opened + INTERVAL 31 DAY THEN bt.time ELSE wf.opened END FROM wf JOIN bt ON bt.segment = wf.segment AND bt.rn = wf.rn + 1),
 r AS (SELECT bt.*, row_number() OVER (PARTITION BY segment, opened ORDER BY mag DESC, time, k) AS r FROM bt JOIN wf USING (segment, rn))
 SELECT segment, time, id, {sql_round('mag')} AS mag FROM r WHERE r = 1""")
def _(spark, sf):
    ev = catalog(spark, sf).filter(BIG).select("segment", "time", "id", "k", "mag")
    return rounded(ep.decluster_largest(ev, ["segment"], "time", "mag", ["k"], 30).select("segment", "time", "id", "mag"))


@query("order_fraction_split", f"""WITH RECURSIVE {INDEP_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY day) / CAST(count(*) OVER (PARTITION BY segment) AS DOUBLE) AS f FROM indep)
 SELECT segment, id, CASE WHEN f <= 0.6e0 THEN 'fit' WHEN f <= 0.8e0 THEN 'cal' ELSE 'test' END AS block FROM s""")
def _(spark, sf):
    return ep.order_fraction_split(independent(spark, sf), ["segment"], ["day"]).select("segment", "id", "block")


@query("event_count_epochs", f"""WITH {CATALOG_SQL}, r AS (SELECT segment, day, (row_number() OVER (PARTITION BY segment ORDER BY day, k) - 1) // 5 AS epoch FROM catalog WHERE {BIG} AND day >= DATE '1996-01-01'),
 e AS (SELECT segment, epoch, CAST(max(day) + 1 AS DATE) AS "end" FROM r GROUP BY 1, 2)
 SELECT segment, epoch, "end", coalesce(lag("end") OVER (PARTITION BY segment ORDER BY epoch), DATE '1996-01-01') AS start FROM e""")
def _(spark, sf):
    c = ts.daily_counts(catalog(spark, sf).filter(BIG), ["segment"])
    return ep.event_count_epochs(c, ["segment"], "day", "n", 5, "1996-01-01").select("segment", "epoch", "start", "end")


@query("lead_time_expand", f"""WITH RECURSIVE {INDEP_SQL}, {FEAT_SQL}, a AS (SELECT i.segment, i.id, l.v AS lead_days, i.day - l.v AS anchor FROM indep i, (VALUES (7), (14), (30)) l(v))
 SELECT a.segment, a.id, a.lead_days, CAST(a.anchor AS DATE) AS anchor, f.day AS feature_day, {sql_round('f.value')} AS value FROM a ASOF JOIN feat f ON a.segment = f.segment AND a.anchor >= f.day""")
def _(spark, sf):
    ind = independent(spark, sf).select("segment", "day", "id")
    out = ep.lead_time_rows(ind, features(spark, sf), ["segment"], "day", [7, 14, 30], ["value"])
    return rounded(out.select("segment", "id", "lead_days", "anchor", "feature_day", "value"))


#: Sites are the customers of the events: so many that days far from every event of a site are left at any scale.
SITE_SQL = f"""sites AS (SELECT o_custkey AS site, CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS time, log10(o_totalprice) AS mag FROM orders),
 sb AS (SELECT site, day, row_number() OVER (PARTITION BY site ORDER BY day) AS rn FROM (SELECT DISTINCT site, day FROM sites WHERE {BIG})),
 sfold AS (SELECT site, day, rn, day AS kept FROM sb WHERE rn = 1 UNION ALL SELECT sb.site, sb.day, sb.rn, CASE WHEN sb.day - sfold.kept > 45 THEN sb.day ELSE sfold.kept END FROM sfold JOIN sb ON sb.site = sfold.site AND sb.rn = sfold.rn + 1),
 sind AS (SELECT c.site, c.day, c.id FROM (SELECT *, row_number() OVER (PARTITION BY site, day ORDER BY time, k) AS r FROM sites WHERE {BIG}) c JOIN sfold f ON f.site = c.site AND f.day = c.day AND f.kept = f.day WHERE c.r = 1),
 sdays AS (SELECT site, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST((SELECT max(day) FROM sites) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT site, min(day) AS lo FROM sites GROUP BY 1))"""
CONTROL_SQL = SITE_SQL + """, ix AS (SELECT site, day, row_number() OVER (PARTITION BY site ORDER BY day) AS i, count(*) OVER (PARTITION BY site) AS n FROM sdays),
 cd AS (SELECT site, day FROM ix x WHERE i > 180 AND i <= n - 1 AND NOT EXISTS (SELECT 1 FROM sind WHERE sind.site = x.site AND abs(x.day - sind.day) <= 180)),
 cl AS (SELECT cd.site, cd.day, r.day AS event_day, r.id, row_number() OVER (PARTITION BY cd.site, cd.day ORDER BY r.day, r.id) AS q FROM cd JOIN sind r ON r.site = cd.site AND abs(cd.day - r.day) <= 1095
   AND least(abs(month(cd.day) - month(r.day)), 12 - abs(month(cd.day) - month(r.day))) <= 1),
 pk AS (SELECT *, row_number() OVER (PARTITION BY site, id ORDER BY CAST(day - DATE '1970-01-01' AS BIGINT) * 7919 % 10007, day) AS rank FROM cl WHERE q = 1)"""


def site_events(spark, sf):
    """The catalog by site: the events of each customer."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("site"))
    return catalog(spark, sf).select("k", "id", "day", "time", "mag").join(o, "k")


def controls(spark, sf):
    """Control days of every independent event of a site, kept away from all independent events of the site."""
    events = site_events(spark, sf)
    big = ep.decluster_first(events.filter(BIG).select("site", "day", "id", "k", "time"), ["site"], "day", ["time", "k"], 45).select("site", "day", "id")
    as_of = catalog(spark, sf).agg(F.max("day")).first()[0]
    spans = events.groupBy("site").agg(F.min("day").alias("first"), F.lit(as_of).cast("date").alias("last"))
    shuffle = F.unix_date("day").cast("bigint") * 7919 % 10007
    return ep.control_days_of_spans(spans, cut_lineage(big), ["site"], "day", "id", shuffle)


@query("case_control_match", f"WITH RECURSIVE {CONTROL_SQL} SELECT site, day, event_day, id, CAST(rank AS INTEGER) AS rank FROM pk WHERE rank <= 3")
def _(spark, sf):
    return controls(spark, sf).select("site", "day", "event_day", "id", "rank")


@query("episode_weights", f"""WITH RECURSIVE {INDEP_SQL}, {FEAT_SQL}, l AS (SELECT i.segment, i.id, l.v AS lead_days, i.day - l.v AS anchor FROM indep i, (VALUES (7), (14), (30)) l(v)),
 a AS (SELECT 'event:' || l.id AS episode_id, lead_days FROM l ASOF JOIN feat f ON l.segment = f.segment AND l.anchor >= f.day)
 SELECT episode_id, lead_days, {sql_round('1e0 / count(*) OVER (PARTITION BY episode_id)')} AS sample_weight FROM a""")
def _(spark, sf):
    ind = independent(spark, sf).select("segment", "day", "id")
    a = ep.lead_time_rows(ind, features(spark, sf), ["segment"], "day", [7, 14, 30], ["value"]).select(F.concat(F.lit("event:"), F.col("id")).alias("episode_id"), "lead_days")
    return rounded(a.withColumn("sample_weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("episode_id"))))


@query("nearest_row_shift_match", f"""WITH RECURSIVE {INDEP_SQL}, p AS (SELECT a.segment, a.id, CAST(a.day + 365 AS DATE) AS target, b.id AS match_id, abs(b.day - (a.day + 365)) AS gap,
   row_number() OVER (PARTITION BY a.segment, a.id ORDER BY abs(b.day - (a.day + 365)), b.day DESC) AS r FROM indep a JOIN indep b ON a.segment = b.segment)
 SELECT segment, id, target, match_id, CAST(gap AS INTEGER) AS gap_days FROM p WHERE r = 1 AND gap <= 20""")
def _(spark, sf):
    ind = independent(spark, sf).select("segment", "id", "day")
    left = ind.select("segment", "id", F.date_add("day", 365).alias("target"))
    right = ind.withColumnRenamed("id", "match_id")
    out = asof.nearest(left, right, ["segment"], "target", "day", ["match_id"], bucket="YEAR")
    gap = F.abs(F.datediff(F.col("match.t"), F.col("target")))
    return out.filter(gap <= 20).select("segment", "id", "target", F.col("match.match_id").alias("match_id"), gap.alias("gap_days"))


@query("station_code_match", f"""WITH {READINGS_SQL}, st AS (SELECT DISTINCT station, segment FROM readings), files AS (SELECT s_suppkey % 17 AS code, 'series-' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS file FROM supplier),
 f AS (SELECT code, min(file) AS file FROM files GROUP BY code) SELECT segment, station, file FROM st JOIN f ON f.code = st.station""")
def _(spark, sf):
    st = readings(spark, sf).select("station", "segment").distinct()
    files = table(spark, sf, "supplier").select((F.col("s_suppkey") % 17).alias("station"),
                                                F.concat(F.lit("series-"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("file"))
    first = files.groupBy("station").agg(F.min("file").alias("file"))
    return st.join(first, "station").select("segment", "station", "file")


@query("group_prior_lookup", f"""WITH {CATALOG_SQL}, tr AS (SELECT segment, mag FROM catalog WHERE day < DATE '1999-01-01' AND segment <> 5), md AS (SELECT segment, quantile_cont(mag, 0.5) AS m FROM tr GROUP BY segment),
 g AS (SELECT quantile_cont(mag, 0.5) AS m FROM tr) SELECT c.id, {sql_round('coalesce(md.m, g.m)')} AS prior FROM catalog c LEFT JOIN md USING (segment), g WHERE c.day >= DATE '1999-01-01'""")
def _(spark, sf):
    from riskweave.operators.evaluation import grouped_quantile
    from riskweave.operators.quantiles import quantiles

    c = catalog(spark, sf)
    train = c.filter((F.col("day") < F.lit("1999-01-01").cast("date")) & (F.col("segment") != 5)).select("segment", "mag")
    medians = grouped_quantile(train, ["segment"], "mag", 0.5, "m")
    overall = quantiles(train, "mag", [0.5])[0]
    test = c.filter(F.col("day") >= F.lit("1999-01-01").cast("date"))
    return rounded(test.join(medians, "segment", "left").select("id", F.coalesce("m", F.lit(overall)).alias("prior")))


NODES = [(s, -24.0 + 1.5 * s, 173.0 + 0.5 * s, 10.0 * s + 5.0, r) for s, r in enumerate(
    ["transform", "subduction", "induced", "transform", "subduction", "transform", "induced", "transform"])]
NODES_SQL = f"nodes AS (SELECT * FROM (VALUES {values(NODES)}) AS t(segment, lat, lon, strike, regime))"
from riskweave.plans.standins import sql_haversine  # noqa: E402

AZ = """degrees(atan2(sin(radians(d.lon - e.longitude)) * cos(radians(d.lat)), cos(radians(e.latitude)) * sin(radians(d.lat)) - sin(radians(e.latitude)) * cos(radians(d.lat)) * cos(radians(d.lon - e.longitude))))"""
EDGE_SQL = CATALOG_SQL + f""", {NODES_SQL}, edg AS (SELECT e.id, e.day, e.segment, d.segment AS receiver, 2.0095e-07 * pow(10e0, 1.5e0 * e.mag + 9.1e0) / pow(greatest({sql_haversine('e.latitude', 'e.longitude', 'd.lat', 'd.lon')}, 5e0) * 1000e0, 3)
   * cos(2 * radians({AZ} - s.strike)) * (0.5e0 + 0.5e0 * greatest(cos(radians(2 * (d.strike - s.strike))), 0e0)) * (CASE WHEN s.regime = d.regime THEN 1e0 ELSE 0.25e0 END) AS v
  FROM catalog e JOIN nodes s ON s.segment = e.segment JOIN nodes d ON d.segment <> e.segment WHERE e.mag >= 5.6e0)"""


def edges(spark, sf):
    nodes = literal_table(spark, NODES, "segment, lat, lon, strike, regime")
    return graph.stress_edges(catalog(spark, sf).filter("mag >= 5.6"), nodes)


@query("edge_expand", f"WITH {EDGE_SQL} SELECT id, segment, receiver, {sql_round('v', 5)} AS delta_cfs_bar FROM edg")
def _(spark, sf):
    return rounded(edges(spark, sf).select("id", "segment", "receiver", "delta_cfs_bar"), 5)


@query("daily_step_series", f"WITH {EDGE_SQL} SELECT receiver, day, {sql_round('sum(v)', 5)} AS delta_cfs_bar FROM edg GROUP BY receiver, day")
def _(spark, sf):
    return rounded(graph.step_series(edges(spark, sf)), 5)


@query("moment_graph_rollup", f"""WITH {EDGE_SQL}, r AS (SELECT receiver, segment, sum(v) AS net, count(*) AS n FROM edg GROUP BY ROLLUP (receiver, segment) HAVING receiver IS NOT NULL),
 q AS (SELECT *, CASE WHEN segment IS NOT NULL THEN row_number() OVER (PARTITION BY receiver, segment IS NULL ORDER BY abs(net) DESC, segment) END AS source_rank FROM r)
 SELECT receiver, segment, {sql_round('net', 5)} AS net_cfs_bar, n AS n_events, CAST(source_rank AS INTEGER) AS source_rank FROM q WHERE source_rank IS NULL OR source_rank <= 3""")
def _(spark, sf):
    return rounded(graph.transfer_rollup(edges(spark, sf)), 5)


RULE_REFS = [(1, "a_seis", "high", "occurrence", "yes"), (1, "a_swarm", "high", "occurrence", "yes"), (2, "a_gone", "high", "occurrence", "yes"),
             (3, "a_seis", "huge", "occurrence", "no"), (4, "a_swarm", "low", "place", "edge")]


@query("antecedent_reference_check", f"""WITH refs AS (SELECT * FROM (VALUES {values(RULE_REFS)}) AS t(rule_id, var, term, output, out_term) UNION ALL SELECT CAST(100 + event_id AS INTEGER), 'a_' || event_type, CASE WHEN event_id % 4 = 0 THEN 'odd' ELSE 'high' END, 'occurrence', 'yes' FROM events),
 vars AS (SELECT * FROM (VALUES ('a_seis'), ('a_swarm'), ('a_view'), ('a_click'), ('a_error')) t(var)), terms AS (SELECT * FROM (VALUES ('very_low'), ('low'), ('normal'), ('high'), ('very_high')) t(term))
 SELECT rule_id, var, term, CASE WHEN var NOT IN (SELECT var FROM vars) THEN 'unknown variable' WHEN term NOT IN (SELECT term FROM terms) THEN 'unknown term' ELSE 'unknown output' END AS problem
 FROM refs WHERE var NOT IN (SELECT var FROM vars) OR term NOT IN (SELECT term FROM terms) OR output <> 'occurrence'""")
def _(spark, sf):
    from riskweave.operators.quality import reference_check

    lit = literal_table(spark, RULE_REFS, "rule_id, var, term, output, out_term")
    ev = table(spark, sf, "events").select(
        (F.col("event_id") + 100).cast("int").alias("rule_id"), F.concat(F.lit("a_"), F.col("event_type")).alias("var"),
        F.when(F.col("event_id") % 4 == 0, "odd").otherwise("high").alias("term"), F.lit("occurrence").alias("output"), F.lit("yes").alias("out_term"))
    return reference_check(lit.unionByName(ev), {v: ("very_low", "low", "normal", "high", "very_high") for v in
                                                 ("a_seis", "a_swarm", "a_view", "a_click", "a_error")}, ["occurrence"])


@query("one_case_per_event", f"""WITH {DAILY_SQL}, big AS (SELECT *, row_number() OVER (PARTITION BY segment, day ORDER BY time, k) AS r FROM catalog WHERE {BIG}), f AS (SELECT * FROM big WHERE r = 1),
 l AS (SELECT d.segment, d.day, f.id FROM daily d ASOF JOIN f ON d.segment = f.segment AND d.day < f.day WHERE f.day - d.day <= 30)
 SELECT segment, min(day) AS day, id AS event_id FROM l GROUP BY segment, id""")
def _(spark, sf):
    ev = catalog(spark, sf).filter(BIG)
    out = asof.forward_labels(daily(spark, sf), ev, ["segment"], "day", "time", ["id"], ["k"])
    hit = out.filter(F.datediff(F.col("next.day"), F.col("day")) <= 30).select("segment", "day", F.col("next.id").alias("event_id"))
    return hit.groupBy("segment", "event_id").agg(F.min("day").alias("day"))


@query("temporal_split", f"""WITH {DAILY_SQL} SELECT segment, day, CASE WHEN day < DATE '1999-01-01' - 30 THEN 'train' WHEN day < DATE '1999-01-01' THEN 'purged' ELSE 'holdout' END AS block FROM daily""")
def _(spark, sf):
    return daily(spark, sf).select("segment", "day", ep.temporal_split("day", "1999-01-01", 30).alias("block"))


@query("block_id", f"""WITH {DAILY_SQL} SELECT segment, day, CAST(segment AS VARCHAR) || '_' || CAST((day - min(day) OVER (PARTITION BY segment)) // 90 AS VARCHAR) AS block FROM daily""")
def _(spark, sf):
    return ep.block_id(daily(spark, sf), ["segment"], "day").select("segment", "day", "block")


@query("month_circular_distance", """SELECT o_orderkey AS k, CAST(least(abs(month(o_orderdate) - 2), 12 - abs(month(o_orderdate) - 2)) AS INTEGER) AS months FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), month_distance("o_orderdate", F.lit("1990-02-15").cast("date")).alias("months"))


TRAJ_SQL = SENSOR_SQL + f""", ev AS (SELECT DISTINCT station, day FROM readings WHERE value > 52.2e0), ix AS (SELECT station, day, value, row_number() OVER (PARTITION BY station ORDER BY day) AS i FROM sensor),
 w AS (SELECT ev.station, ev.day AS event_day, h.i - greatest(1, c.i - 90) AS x, h.value AS v FROM ev JOIN ix c ON c.station = ev.station AND c.day = ev.day JOIN ix h ON h.station = ev.station AND h.i BETWEEN c.i - 90 AND c.i WHERE h.value IS NOT NULL),
 g AS (SELECT station, event_day, x, v, row_number() OVER (PARTITION BY station, event_day ORDER BY x) - 1 AS j, count(*) OVER (PARTITION BY station, event_day) AS n FROM w)"""


@query("trajectory_shape", f"""WITH {TRAJ_SQL} SELECT station, event_day, {sql_round('max_by(v, j)')} AS level, {sql_round('regr_slope(v, j)')} AS slope,
  {sql_round('arg_min(j, struct_pack(a := -v, b := j)) / CAST(greatest(max(n) - 1, 1) AS DOUBLE)')} AS peak_frac, max(n) AS rows_used FROM g GROUP BY station, event_day HAVING max(n) >= 45""")
def _(spark, sf):
    s = sensor(spark, sf)
    w = Window.partitionBy("station").orderBy("day")
    ix = s.withColumn("i", F.row_number().over(w))
    ev = readings(spark, sf).filter("value > 52.2").select("station", "day").distinct()
    at = ev.join(ix.select("station", "day", "i"), ["station", "day"]).withColumnRenamed("day", "event_day")
    at = at.withColumn("i", F.explode(F.sequence(F.greatest(F.lit(1), F.col("i") - 90), F.col("i"))))
    win = at.join(ix.select("station", "i", "value"), ["station", "i"]).filter("value is not null")
    o = Window.partitionBy("station", "event_day")
    win = win.withColumns({"j": F.row_number().over(o.orderBy("i")) - 1, "n": F.count(F.lit(1)).over(o)})
    out = win.groupBy("station", "event_day").agg(
        F.max_by("value", "j").alias("level"), F.regr_slope("value", "j").alias("slope"),
        (F.min_by("j", F.struct(-F.col("value"), F.col("j"))) / F.greatest(F.max("n") - 1, F.lit(1))).alias("peak_frac"),
        F.max("n").alias("rows_used"))
    return rounded(out.filter("rows_used >= 45"))
