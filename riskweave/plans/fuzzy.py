"""Fuzzy scoring plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.fuzzy import ANOMALY_SETS, LOAD_SETS, UNIT_SETS, centroid
from riskweave.operators import critical as cr, gain as gn, rulebase, scoring as sc
from riskweave.operators.scoring import Output, Rule
from riskweave.plans.series import SENSOR_SQL, sensor
from riskweave.plans.standins import rounded, sql_degree0, sql_membership, sql_round
from riskweave.registry import query

# channel -> formula of the daily sensor value v (null on silent days)
CHANNELS = {
    "a_seis": "tanh((v - 27e0) / 12e0)", "a_swarm": "tanh((v - 20e0) / 20e0)", "a_foreshock": "tanh((35e0 - v) / 15e0)", "a_gnss": "tanh((v - 33e0) / 9e0)",
    "a_strain": "tanh((30e0 - v) / 10e0)", "a_water": "tanh((v - 40e0) / 20e0)", "a_fluid": "tanh((v - 25e0) / 25e0)", "a_ocean": "tanh((v - 30e0) / 40e0)",
    "C_state": "v / 30e0", "A_state": "coalesce(v, 10e0) / 60e0", "K_state": "coalesce(v, 5e0) / 80e0", "F_state": "coalesce(v, 8e0) / 70e0", "E_state": "coalesce(v, 2e0) / 90e0",
}
FLAGS = {"has_gnss_data": "CASE WHEN station % 4 = 1 THEN 0 ELSE 1 END", "has_strain_data": "CASE WHEN v IS NULL THEN 0 ELSE 1 END",
         "has_water_data": "1", "has_fluid_data": "CASE WHEN station % 5 = 2 THEN 0 ELSE 1 END", "has_ocean_data": "1"}
FRAME_SQL = SENSOR_SQL + ", fr AS (SELECT station, day, " + ", ".join(f"{f} AS {c}" for c, f in (CHANNELS | FLAGS).items()) + " FROM (SELECT station, day, value AS v FROM sensor))"


def frame(spark, sf):
    s = sensor(spark, sf).select("station", "day", F.col("value").alias("v"))
    return s.selectExpr("station", "day", *[f"{f.replace('e0', 'D')} AS {c}" for c, f in (CHANNELS | FLAGS).items()])


def hi(c, sets=ANOMALY_SETS):
    return f"greatest({sql_degree0(c, sets['high'])}, {sql_degree0(c, sets['very_high'])})"


def lo(c, sets=ANOMALY_SETS):
    return f"greatest({sql_degree0(c, sets['low'])}, {sql_degree0(c, sets['very_low'])})"


CHI = "(CASE WHEN C_state IS NULL THEN NULL ELSE least(1e0, greatest(0e0, (C_state - 0.6e0) / 0.3e0)) END)"
W_SQL = {"anchor": "0.5e0", **{f"seis_{t}": sql_degree0("a_seis", ANOMALY_SETS[t]) for t in ANOMALY_SETS}, "seis_and_gnss": f"least({hi('a_seis')}, {hi('a_gnss')})",
         "seis_and_load": f"least({hi('a_seis')}, {CHI})", "agitation_and_load": f"least(A_state, {CHI})", "sse_alone": "K_state", "sse_and_seis": f"least(K_state, {hi('a_seis')})",
         "fluid_low": sql_degree0("a_fluid", ANOMALY_SETS["low"]), "fluid_very_low": sql_degree0("a_fluid", ANOMALY_SETS["very_low"]), "fluid_alone": "F_state", "fluid_and_seis": f"least(F_state, {hi('a_seis')})",
         "swarm_low": lo("a_swarm"), "swarm_high": "E_state", "foreshock_low": lo("a_foreshock"), "foreshock_high": hi("a_foreshock"), "seis_and_strain": f"least({hi('a_seis')}, {hi('a_strain')})",
         "seis_and_ocean": f"least({hi('a_seis')}, {hi('a_ocean')})", "water_low": lo("a_water"), "water_high": hi("a_water"), "strain_low": lo("a_strain"), "strain_high": hi("a_strain"),
         "ocean_low": lo("a_ocean"), "ocean_high": hi("a_ocean"), **{f"{c}_{s}": "0e0" for c in ("insar", "tec", "noise") for s in ("low", "high")}}
WS_SQL = FRAME_SQL + ", ws AS (SELECT station, day, " + ", ".join(f"{e} AS w_{k}" for k, e in W_SQL.items()) + " FROM fr)"


@query("rule_weights", f"WITH {WS_SQL} SELECT station, day, " + ", ".join(f"{sql_round('w_' + k)} AS w_{k}" for k in W_SQL) + " FROM ws")
def _(spark, sf):
    w = gn.with_strengths(frame(spark, sf))
    return rounded(w.select("station", "day", *[f"w_{k}" for k in gn.CONSEQUENTS]))


GAIN_SQL = "pow(10e0, least(1.7e0, greatest(-1e0, (" + " + ".join(f"w_{k} * ({v}::DOUBLE)" for k, v in gn.CONSEQUENTS.items()) + ") / (" + " + ".join(f"w_{k}" for k in gn.CONSEQUENTS) + " + 1e-9))))"


@query("weighted_gain", f"WITH {WS_SQL} SELECT station, day, {sql_round(GAIN_SQL)} AS G FROM ws")
def _(spark, sf):
    w = gn.with_strengths(frame(spark, sf))
    return rounded(w.select("station", "day", gn.gain(w).alias("G")))


# Influence of each channel and the expert rules.
INFLUENCE = {"a_seis": 0.50, "a_swarm": 0.55, "a_foreshock": 0.40, "a_gnss": 0.85, "a_sse": 0.60, "a_fluid": 0.90, "a_water": 0.35, "a_strain": 0.675, "a_ocean": 0.35,
             "a_insar": 0.15, "a_tec": 0.25, "a_noise": 0.35, "A_state": 0.50, "C_state": 0.50, "K_state": 0.60, "E_state": 0.55, "F_state": 0.90}
OCCURRENCE = [
    Rule((("a_seis", "very_high"),), weight=0.9), Rule((("a_seis", "high"), ("a_foreshock", "high")), weight=0.8),
    Rule((("a_swarm", "high"), ("a_seis", "high")), weight=0.7), Rule((("C_state", "very_high"), ("a_seis", "high")), weight=0.75),
    Rule((("a_seis", "normal"), ("a_swarm", "normal"), ("a_foreshock", "normal")), out_term="no", weight=0.6), Rule((("a_seis", "low"),), out_term="no", weight=0.5)]
MAGNITUDE = [Rule((("a_seis", "very_high"),), "magnitude", "strong", 0.6), Rule((("a_seis", "very_high"), ("C_state", "very_high")), "magnitude", "very_strong", 0.7),
             Rule((("a_seis", "high"),), "magnitude", "moderate", 0.6)]
# Output universes.
MAG_OUTPUT = Output(3.0, 8.5, 221, {"moderate": [3.0, 3.0, 4.0, 5.5], "strong": [4.0, 5.5, 7.0], "very_strong": [5.5, 7.0, 8.5, 8.5]})
WHEN_OUTPUT = Output(0.0, 30.0, 301, {"imminent": [0.0, 0.0, 15.0], "near": [0.0, 15.0, 30.0], "far": [15.0, 30.0, 30.0]})
WHERE_OUTPUT = Output(0.0, 1.0, 201, {"centre": [0.0, 0.0, 0.5], "middle": [0.0, 0.5, 1.0], "edge": [0.5, 1.0, 1.0]})
WHERE = [Rule((("C_state", "high"),), "where", "centre", 0.8), Rule((("F_state", "low"),), "where", "edge", 0.5)]
SETS = {"C_state": LOAD_SETS, "A_state": UNIT_SETS, "K_state": UNIT_SETS, "E_state": UNIT_SETS, "F_state": UNIT_SETS}


def sql_antecedent(rule):
    parts = [sql_degree0(v, SETS.get(v, ANOMALY_SETS)[t]) for v, t in rule.antecedent]
    return f"least({', '.join(parts)})" if len(parts) > 1 else parts[0]


def sql_power(rule):
    return f"{sql_antecedent(rule)} * ({rule.weight * min(INFLUENCE[v] for v in rule.variables)!r}::DOUBLE)"


@query("mamdani_bipolar", f"""WITH {FRAME_SQL}, s AS (SELECT station, day, greatest({', '.join(sql_power(r) for r in OCCURRENCE if r.out_term == 'yes')}) AS ws, greatest({', '.join(sql_power(r) for r in OCCURRENCE if r.out_term == 'no')}) AS wn FROM fr)
 SELECT station, day, {sql_round('CASE WHEN abs(ws - wn) <= 1e-8 + 1e-5 * abs(wn) THEN 0e0 WHEN ws > wn THEN ws ELSE -wn END')} AS mom, {sql_round('ws - wn')} AS score FROM s""")
def _(spark, sf):
    out = sc.bipolar(OCCURRENCE, INFLUENCE)
    return rounded(frame(spark, sf).select("station", "day", out["mom"].alias("mom"), out["score"].alias("score")))


def sql_mamdani(name, rules, o):
    by = {}
    for r in rules:
        by.setdefault(r.out_term, []).append(sql_power(r))
    strength = {t: (f"greatest({', '.join(c)})" if len(c) > 1 else c[0]) for t, c in by.items()}
    heights = [f"least(s_{t}, {sql_membership('x', o.sets[t])})" for t in by]
    step = (o.high - o.low) / (o.points - 1)
    return f"""{name}s AS (SELECT station, day, {', '.join(f'{e} AS s_{t}' for t, e in strength.items())}, {' + '.join(c for cs in by.values() for c in cs)} AS act FROM fr),
 {name}g AS (SELECT station, day, act, x, greatest({', '.join(heights)}, 0e0) AS h FROM {name}s, (SELECT {o.low!r}::DOUBLE + range * {step!r}::DOUBLE AS x FROM range({o.points}))),
 {name} AS (SELECT station, day, CASE WHEN sum(h) > 1e-9 THEN sum(h * x) / sum(h) END AS value, CASE WHEN sum(h) > 1e-9 THEN max(h) ELSE 0 END AS confidence, any_value(act) AS activation FROM {name}g GROUP BY 1, 2)"""


@query("mamdani_centroid", f"""WITH {FRAME_SQL}, {sql_mamdani('m', MAGNITUDE, MAG_OUTPUT)}, {sql_mamdani('w', WHERE, WHERE_OUTPUT)}
 SELECT station, day, {', '.join(sql_round(f'{a}.{c}') + f' AS {n}_{c}' for a, n in (('m', 'magnitude'), ('w', 'where')) for c in ('value', 'confidence', 'activation'))} FROM m JOIN w USING (station, day)""")
def _(spark, sf):
    out = sc.mamdani(frame(spark, sf), "magnitude", MAGNITUDE, MAG_OUTPUT, INFLUENCE)
    out = sc.mamdani(out, "where", WHERE, WHERE_OUTPUT, INFLUENCE)
    return rounded(out.select("station", "day", *[f"{n}_{c}" for n in ("magnitude", "where") for c in ("value", "confidence", "activation")]))


WHEN = [Rule((("a_foreshock", "very_high"),), "when", "imminent", 0.7), Rule((("a_foreshock", "high"), ("a_seis", "high")), "when", "imminent", 0.6), Rule((("a_seis", "high"),), "when", "near", 0.5),
        Rule((("a_seis", "normal"),), "when", "far", 0.4), Rule((("a_seis", "low"),), "when", "far", 0.6)]


@query("mamdani_timing", f"""WITH {FRAME_SQL}, {sql_mamdani('t', WHEN, WHEN_OUTPUT)} SELECT station, day, {', '.join(sql_round(f't.{c}') + f' AS when_{c}' for c in ('value', 'confidence', 'activation'))} FROM t""")
def _(spark, sf):
    out = sc.mamdani(frame(spark, sf), "when", WHEN, WHEN_OUTPUT, INFLUENCE)
    return rounded(out.select("station", "day", *[f"when_{c}" for c in ("value", "confidence", "activation")]))


TERM_RULES = [Rule((("a_seis", "low"),), out_term="t1"), Rule((("a_seis", "normal"),), out_term="t2"), Rule((("a_seis", "high"), ("a_gnss", "high")), out_term="t4"),
              Rule((("a_gnss", "very_high"),), out_term="t5"), Rule((("a_water", "high"),), out_term="t4"), Rule((("C_state", "very_high"),), out_term="t5")]
TERM_SETS = {"t1": [0.0, 0.1, 0.2], "t2": [0.2, 0.3, 0.4], "t4": [0.6, 0.7, 0.8], "t5": [0.8, 0.9, 1.0, 1.0]}


def sql_terms(rules=TERM_RULES):
    by = {}
    for r in rules:
        by.setdefault(r.out_term, []).append(sql_antecedent(r))
    return {t: f"greatest({', '.join(c)}, 0e0)" for t, c in by.items()}


TS_SQL = FRAME_SQL + ", tsx AS (SELECT station, day, " + ", ".join(f"{e} AS {t}" for t, e in sql_terms().items()) + " FROM fr)"


@query("term_strengths", f"WITH {TS_SQL} SELECT station, day, {', '.join(sql_round(t) + f' AS {t}' for t in TERM_SETS)} FROM tsx")
def _(spark, sf):
    s = sc.term_strengths(TERM_RULES)
    return rounded(frame(spark, sf).select("station", "day", *[s[t].alias(t) for t in TERM_SETS]))


NUM = " + ".join(f"{t} * ({centroid(p)!r}::DOUBLE)" for t, p in TERM_SETS.items())


@query("centroid_defuzz", f"""WITH {TS_SQL} SELECT station, day, {sql_round(f"CASE WHEN t1 + t2 + t4 + t5 > 0 THEN ({NUM}) / (t1 + t2 + t4 + t5) END")} AS value, CASE WHEN greatest(t1, t2, t4, t5) <= 0 THEN NULL WHEN t1 = greatest(t1, t2, t4, t5) THEN 't1' WHEN t2 = greatest(t1, t2, t4, t5) THEN 't2'
 WHEN t4 = greatest(t1, t2, t4, t5) THEN 't4' ELSE 't5' END AS label FROM tsx""")
def _(spark, sf):
    f = frame(spark, sf).withColumns(sc.term_strengths(TERM_RULES))
    s = {t: F.col(t) for t in TERM_SETS}
    return rounded(f.select("station", "day", sc.centroid_defuzz(s, sc.centers_of(TERM_SETS)).alias("value"), sc.dominant_output(s).alias("label")))


LIFTS = {("a_seis", "very_high"): 3.2, ("a_seis", "low"): 0.6, ("a_gnss", "high"): 1.4, ("a_water", "very_low"): 0.8}


@query("additive_lift_score", f"WITH {FRAME_SQL} SELECT station, day, {sql_round(' + '.join(f'{sql_degree0(v, ANOMALY_SETS[t])} * ({x - 1.0!r}::DOUBLE)' for (v, t), x in LIFTS.items()))} AS score FROM fr")
def _(spark, sf):
    return rounded(frame(spark, sf).select("station", "day", sc.additive_lift(LIFTS).alias("score")))


# ---------------------------------------------------------------- cluster evidence

def evidence_sql() -> str:
    present = {k: [c for c in cs if c in CHANNELS] for k, cs in cr.CLUSTERS.items()}
    chans = sorted({c for cs in present.values() for c in cs})
    sets = {c: SETS.get(c, ANOMALY_SETS) for c in chans}
    flag = {c: (f"{cr.AVAILABILITY[c]} > 0.5" if cr.AVAILABILITY.get(c) in FLAGS else f"{c} IS NOT NULL") for c in chans}
    win = "WINDOW w7 AS (PARTITION BY station ORDER BY day ROWS 6 PRECEDING), w60 AS (PARTITION BY station ORDER BY day ROWS 59 PRECEDING)"
    tr = {c: f"greatest(-1e0, least(1e0, coalesce((CASE WHEN count({c}) OVER w7 >= 3 THEN avg({c}) OVER w7 END) - (CASE WHEN count({c}) OVER w60 >= 20 THEN avg({c}) OVER w60 END), 0e0) / 0.35e0))" for c in chans}
    e1 = "e1 AS (SELECT *, " + ", ".join(f"{tr[c]} AS tr_{c}" for c in chans) + f" FROM fr {win})"
    e2 = "e2 AS (SELECT station, day, " + ", ".join(
        f"{hi(f'coalesce({c}, 0e0)', sets[c])} AS lev_{c}, {lo(f'coalesce({c}, 0e0)', sets[c])} AS qui_{c}, {hi('tr_' + c)} AS tre_{c}, ({flag[c]}) AS av_{c}" for c in chans) + " FROM e1)"
    cols = []
    for k, cs in present.items():
        if not cs:
            continue
        n = "(" + " + ".join(f"av_{c}::INTEGER" for c in cs) + ")"
        for s, p in (("level", "lev"), ("quiet", "qui"), ("trend", "tre")):
            cols.append("1 - " + " * ".join(f"(CASE WHEN av_{c} THEN 1 - {p}_{c} ELSE 1e0 END)" for c in cs) + f" AS {k}_{s}")
        cols.append(f"CASE WHEN {n} > 0 THEN (" + " + ".join(f"(CASE WHEN av_{c} THEN lev_{c} ELSE 0e0 END)" for c in cs) + f") / {n} ELSE 0e0 END AS d_{k}")
        cols.append(f"CASE WHEN {n} > 0 THEN (" + " + ".join(f"(av_{c} AND lev_{c} >= 0.5)::INTEGER" for c in cs) + f") / {n}::DOUBLE ELSE 0e0 END AS {k}_coherence")
        cols.append(f"{n} / {len(cs)}e0 AS {k}_coverage")
    e3 = "e3 AS (SELECT station, day, " + ", ".join(cols) + " FROM e2)"
    live = [k for k, cs in present.items() if cs]
    zero = ", ".join(f"0e0 AS {k}_{s}" for k, cs in present.items() if not cs for s in cr.SUFFIXES)
    e4 = "evid AS (SELECT *, " + ", ".join(f"coalesce(CASE WHEN count(d_{k}) OVER w >= 10 THEN avg(d_{k}) OVER w END, 0e0) AS {k}_persistence" for k in live) + (", " + zero if zero else "") + " FROM e3 WINDOW w AS (PARTITION BY station ORDER BY day ROWS 29 PRECEDING))"
    return ", ".join([FRAME_SQL, e1, e2, e3, e4])


EVID_SQL = evidence_sql()
EVID_COLS = [f"{k}_{s}" for k in cr.CLUSTERS for s in cr.SUFFIXES]


def evidence(spark, sf):
    return cr.cluster_evidence(frame(spark, sf), ["station"], "day")


@query("cluster_evidence", f"WITH {EVID_SQL} SELECT station, day, {', '.join(sql_round(c, 5) + f' AS {c}' for c in EVID_COLS)} FROM evid")
def _(spark, sf):
    return rounded(evidence(spark, sf), 5)


def sql_firing(name):
    parts = cr.EVIDENCE_RULES[name]
    cover = [f"{c}_coverage" for c in dict.fromkeys(p.rsplit("_", 1)[0] for p in parts)]
    return f"least({', '.join(parts)}) * " + (f"least({', '.join(cover)})" if len(cover) > 1 else cover[0])


FIRE_SQL = EVID_SQL + ", fire AS (SELECT *, " + ", ".join(f"{sql_firing(n)} AS r_{n}" for n in cr.EVIDENCE_RULES) + " FROM evid)"


@query("evidence_rule_firings", f"WITH {FIRE_SQL} SELECT station, day, {', '.join(sql_round('r_' + n, 5) + f' AS r_{n}' for n in cr.EVIDENCE_RULES)} FROM fire")
def _(spark, sf):
    f = cr.rule_firings(evidence(spark, sf))
    return rounded(f.select("station", "day", *[f"r_{n}" for n in cr.EVIDENCE_RULES]), 5)


WEIGHTS = {n: 1.0 + 0.25 * (i % 4) for i, n in enumerate(cr.EVIDENCE_RULES)}
STATE_SQL = FIRE_SQL + f""", dr AS (SELECT *, 1 / (1 + exp(-({' + '.join(f'r_{n} * ({w!r}::DOUBLE)' for n, w in WEIGHTS.items())} - 2e0))) AS raw, row_number() OVER (PARTITION BY station ORDER BY day) AS rn FROM fire),
 fold AS (SELECT station, day, rn, 0e0 AS s FROM dr WHERE rn = 1 UNION ALL SELECT dr.station, dr.day, dr.rn, fold.s + (dr.raw - fold.s) * CASE WHEN dr.raw > fold.s THEN 0.65e0 ELSE 0.06e0 END FROM fold JOIN (SELECT station, day, rn, raw FROM dr) dr ON dr.station = fold.station AND dr.rn = fold.rn + 1)"""


def states(spark, sf):
    return cr.critical_state(cr.rule_firings(evidence(spark, sf)), ["station"], "day", WEIGHTS)


@query("critical_state_series", f"WITH RECURSIVE {STATE_SQL} SELECT station, day, {sql_round('s', 5)} AS critical_state FROM fold")
def _(spark, sf):
    return rounded(states(spark, sf).select("station", "day", "critical_state"), 5)


@query("critical_shadow_table", f"""WITH RECURSIVE {STATE_SQL}, l AS (SELECT fold.station, fold.day, fold.s, dr.* EXCLUDE (station, day, rn) FROM fold JOIN dr USING (station, day) WHERE fold.day = (SELECT max(day) FROM fold f2 WHERE f2.station = fold.station)),
 u AS (SELECT station, i, rule, firing, w FROM (SELECT station, {', '.join(f"r_{n}" for n in cr.EVIDENCE_RULES)} FROM l) UNPIVOT (firing FOR rule IN ({', '.join(f'r_{n}' for n in cr.EVIDENCE_RULES)})) JOIN (VALUES {', '.join(f"({i}, 'r_{n}', {w!r}::DOUBLE)" for i, (n, w) in enumerate(WEIGHTS.items()))}) AS t(i, rule, w) USING (rule)),
 k AS (SELECT station, rule, firing, firing * w AS weighted, row_number() OVER (PARTITION BY station ORDER BY round_even(firing * w, 4) DESC, i) AS rank FROM u)
 SELECT l.station, l.day AS state_as_of, {sql_round('l.s', 4)} AS critical_state, l.s >= 0.2e0 AS above_threshold, {sql_round('l.seismic_level', 4)} AS seismic_level, substr(k.rule, 3) AS rule, {sql_round('k.weighted', 4)} AS weighted, CAST(k.rank AS INTEGER) AS rank FROM l JOIN k USING (station) WHERE k.rank <= 5""")
def _(spark, sf):
    t = cr.shadow_table(states(spark, sf), ["station"], "day", WEIGHTS, 0.2)
    t = t.select("station", "state_as_of", F.round("critical_state", 4).alias("critical_state"), "above_threshold", F.col("clusters.seismic.level").alias("seismic_level"), F.posexplode("top_rules").alias("rank", "r"))
    return rounded(t.select("station", "state_as_of", "critical_state", "above_threshold", "seismic_level", "r.rule", "r.weighted", (F.col("rank") + 1).alias("rank")), 4)


@query("suppress_unskilled", f"""WITH {TS_SQL} SELECT station, day, CASE WHEN station % 2 = 0 THEN round_even(t1, 3) + 0e0 END AS prob, NULL::DOUBLE AS place, round_even(t5, 2) + 0e0 AS magnitude FROM tsx""")
def _(spark, sf):
    f = frame(spark, sf).withColumns(sc.term_strengths(TERM_RULES)).select("station", "day", F.col("t1").alias("prob"), F.col("t4").alias("place"), F.col("t5").alias("magnitude"))
    return sc.suppress_unskilled(f, {"prob": F.col("station") % 2 == 0, "place": False, "magnitude": True}, {"prob": 3, "magnitude": 2})


STEPS = [(0.1, 0.01), (0.3, 0.04), (0.6, 0.1), (0.8, 0.25)]


@query("step_calibration_apply", f"WITH {TS_SQL} SELECT station, day, CASE " + " ".join(f"WHEN t5 <= {t} THEN {r}::DOUBLE" for t, r in STEPS) + " ELSE 0.25e0 END AS rate FROM tsx")
def _(spark, sf):
    f = frame(spark, sf).withColumns(sc.term_strengths(TERM_RULES))
    return f.select("station", "day", sc.step_calibration("t5", *map(list, zip(*STEPS))).alias("rate"))


FIRING = {i: sql_antecedent(r) for i, r in enumerate(OCCURRENCE + MAGNITUDE + WHERE)}
ALL_RULES = OCCURRENCE + MAGNITUDE + WHERE
REF_SQL = ", ".join(f"({i}, '{v}', '{r.output}', {len(r.antecedent)})" for i, r in enumerate(ALL_RULES) for v, _ in r.antecedent)


@query("rule_coverage", f"""WITH {FRAME_SQL}, mx AS (SELECT {', '.join(f'max({e}) AS f{i}' for i, e in FIRING.items())} FROM fr), m AS (SELECT CAST(substr(rule, 2) AS INTEGER) AS i, firing FROM mx UNPIVOT (firing FOR rule IN ({', '.join(f'f{i}' for i in FIRING)}))),
 ref AS (SELECT * FROM (VALUES {REF_SQL}) AS t(i, variable, output, arity)), vars AS (SELECT unnest([{', '.join(f"'{c}'" for c in CHANNELS)}]) AS variable)
 SELECT vars.variable, ref.output, count(ref.i) AS n_rules, {sql_round('coalesce(max(m.firing), 0e0)')} AS max_firing, count(ref.i) = 0 AS unused FROM vars LEFT JOIN ref USING (variable) LEFT JOIN m USING (i) GROUP BY GROUPING SETS ((vars.variable, ref.output), (vars.variable)) HAVING NOT (GROUPING(ref.output) = 0 AND ref.output IS NULL)""")
def _(spark, sf):
    return rounded(rulebase.coverage(frame(spark, sf), ALL_RULES, list(CHANNELS)))


PROBES = [-1.0, -0.35, 0.0, 0.35, 1.0]


def sql_sens():
    parts = []
    for v in ("a_seis", "a_gnss", "a_ocean"):
        for i, p in enumerate(PROBES):
            sub = {t: e for t, e in sql_terms([Rule(r.antecedent, r.output, r.out_term) for r in TERM_RULES]).items()}
            def rep(e, v=v, p=p):
                import re
                return re.sub(rf"\b{v}\b", f"({p}::DOUBLE)", e)
            s = {t: rep(e) for t, e in sub.items()}
            den = " + ".join(s.values())
            num = " + ".join(f"{e} * ({centroid(TERM_SETS[t])!r}::DOUBLE)" for t, e in s.items())
            parts.append(f"SELECT '{v}' AS variable, {i} AS probe, avg(CASE WHEN {den} > 0 THEN ({num}) / ({den}) END) AS m FROM fr")
    return " UNION ALL ".join(parts)


@query("variable_sensitivity", f"WITH {FRAME_SQL}, s AS ({sql_sens()}) SELECT variable, {sql_round('max(m) - min(m)')} AS sensitivity, max(m) - min(m) <= 1e-9 AS dead FROM s GROUP BY variable")
def _(spark, sf):
    return rounded(rulebase.sensitivity(frame(spark, sf), TERM_RULES, sc.centers_of(TERM_SETS), {v: PROBES for v in ("a_seis", "a_gnss", "a_ocean")}))
