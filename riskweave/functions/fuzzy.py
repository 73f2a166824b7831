"""Fuzzy sets as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions.geo import col

TERMS = ("very_low", "low", "normal", "high", "very_high")

# The knots of the shared partitions. Three knots are a triangle, four a trapezoid.
ANOMALY_SETS = {
    "very_low": [-1.0, -1.0, -0.70, -0.35],
    "low": [-0.70, -0.35, 0.0],
    "normal": [-0.35, 0.0, 0.35],
    "high": [0.0, 0.35, 0.70],
    "very_high": [0.35, 0.70, 1.0, 1.0],
}
UNIT_SETS = {
    "very_low": [0.0, 0.0, 0.175, 0.35],
    "low": [0.175, 0.35, 0.50],
    "normal": [0.35, 0.50, 0.65],
    "high": [0.50, 0.65, 0.825],
    "very_high": [0.65, 0.825, 1.0, 1.0],
}
LOAD_SETS = {
    "very_low": [0.0, 0.0, 0.20, 0.45],
    "low": [0.20, 0.45, 0.60],
    "normal": [0.45, 0.60, 0.90],
    "high": [0.60, 0.90, 1.20],
    "very_high": [0.90, 1.20, 3.0, 3.0],
}
VARIABLE_SETS = {"A_state": UNIT_SETS, "K_state": UNIT_SETS, "E_state": UNIT_SETS,
                 "F_state": UNIT_SETS, "C_state": LOAD_SETS}
VARIABLE_DOMAINS = {"A_state": (0.0, 1.0), "K_state": (0.0, 1.0), "E_state": (0.0, 1.0),
                    "F_state": (0.0, 1.0), "C_state": (0.0, 3.0)}
EPS = 1e-12


def sets_for(variable: str) -> Mapping[str, Sequence[float]]:
    """Partition of a variable; anomaly channels share one."""
    return VARIABLE_SETS.get(variable, ANOMALY_SETS)


def domain_for(variable: str) -> tuple[float, float]:
    return VARIABLE_DOMAINS.get(variable, (-1.0, 1.0))


def clip(c, low, high) -> Column:
    """``c`` limited to [low, high]; null stays null (least/greatest would skip it)."""
    x = col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def membership_sql(name: str, params: Sequence[float]) -> str:
    """SQL text of the degree of column *name*; null stays null.

    A text is one call to the JVM where the Column form takes a dozen, which matters for frames with
    hundreds of degrees.
    """
    if len(params) not in (3, 4):
        raise ValueError("a membership function has 3 or 4 knots")
    v = f"`{name}`"
    foot_l, top_l, top_r, foot_r = (float(params[i]) for i in (0, 1, -2, -1))
    sides = ["1D"]
    if top_l > foot_l:
        sides.append(f"({v} - ({foot_l!r}D)) / {top_l - foot_l + EPS!r}D")
    if foot_r > top_r:
        sides.append(f"(({foot_r!r}D) - {v}) / {foot_r - top_r + EPS!r}D")
    degree = f"least({', '.join(sides)})" if len(sides) > 1 else sides[0]
    return f"CASE WHEN {v} IS NOT NULL THEN greatest({degree}, 0D) END"


def membership(x, params: Sequence[float]) -> Column:
    """Degree of *x* in a triangle (3 knots) or trapezoid (4 knots); null stays null.

    A side of zero width counts as 1, so that it is a shoulder.
    """
    if isinstance(x, str) and "." not in x:
        return F.expr(membership_sql(x, params))
    if len(params) not in (3, 4):
        raise ValueError("a membership function has 3 or 4 knots")
    v = col(x)
    foot_l, top_l, top_r, foot_r = params[0], params[1], params[-2], params[-1]
    sides = [F.lit(1.0)]
    if top_l > foot_l:
        sides.append((v - F.lit(foot_l)) / F.lit(top_l - foot_l + EPS))
    if foot_r > top_r:
        sides.append((F.lit(foot_r) - v) / F.lit(foot_r - top_r + EPS))
    degree = F.least(*sides) if len(sides) > 1 else sides[0]
    return F.when(v.isNotNull(), F.greatest(degree, F.lit(0.0)))


def degree0(x, params) -> Column:
    """Membership with missing input counted as 0."""
    if isinstance(x, str) and "." not in x:
        return F.expr(f"coalesce({membership_sql(x, params)}, 0D)")
    return F.coalesce(membership(x, params), F.lit(0.0))


def _either(x, first, second) -> Column:
    if isinstance(x, str) and "." not in x:
        return F.expr(f"greatest(coalesce({membership_sql(x, first)}, 0D), coalesce({membership_sql(x, second)}, 0D))")
    return F.greatest(degree0(x, first), degree0(x, second))


def elevated(x, variable: str = "anomaly") -> Column:
    """Degree of being high or very high; missing counts as 0."""
    return _either(x, sets_for(variable)["high"], sets_for(variable)["very_high"])


def depressed(x, variable: str = "anomaly") -> Column:
    """Degree of being low or very low; missing counts as 0."""
    return _either(x, sets_for(variable)["low"], sets_for(variable)["very_low"])


def centroid(params: Sequence[float]) -> float:
    """Area centroid of a triangle or trapezoid."""
    p = [float(v) for v in params]
    if len(p) == 3:
        return sum(p) / 3.0
    if len(p) != 4 or sorted(p) != p:
        raise ValueError(f"not a trapezoid: {params}")
    a, b, c, d = p
    area = (d - a + c - b) / 2.0
    if area <= 0:
        return (a + d) / 2.0
    # first moment of the area below the trapezoid, divided by the area
    moment = ((c * c + c * d + d * d) - (a * a + a * b + b * b)) / 6.0
    return moment / area


def centroid_column(knots) -> Column:
    """Area centroid with the knots in an array column of length 3 or 4."""
    k = col(knots)
    n = F.size(k)
    a, b = F.element_at(k, 1), F.element_at(k, 2)
    c, d = F.element_at(k, n - 1), F.element_at(k, n)
    area = (d - a + c - b) / 2.0
    moment = ((c * c + c * d + d * d) - (a * a + a * b + b * b)) / 6.0
    return F.when(area > 0, moment / area).otherwise((a + d) / 2.0)


def ruspini_chain(knots: Sequence[float], names: Sequence[str] | None = None) -> dict[str, list[float]]:
    """n increasing knots -> n overlapping terms whose degrees add up to 1."""
    n = len(knots)
    names = list(names or [f"t{i}" for i in range(n)])
    tiny = 1e-6
    first, last = knots[0], knots[-1]
    sets = {names[0]: [first - tiny, first - tiny, first, knots[1]]}
    for i in range(1, n - 1):
        sets[names[i]] = list(knots[i - 1:i + 2])
    sets[names[-1]] = [knots[-2], last, last + tiny, last + tiny]
    return sets


def ruspini_terms(knots) -> Column:
    """The same chain for an array column of knots: array<struct<term int, knots array<double>>>."""
    k = col(knots)
    n, tiny = F.size(k), F.lit(1e-6)

    def term(v, i):
        prev, nxt = F.get(k, i - 1), F.get(k, i + 1)
        shape = (F.when(i == 0, F.array(v - tiny, v - tiny, v, nxt))
                 .when(i == n - 1, F.array(prev, v, v + tiny, v + tiny))
                 .otherwise(F.array(prev, v, nxt)))
        return F.struct(i.cast("int").alias("term"), shape.alias("knots"))

    return F.transform(k, term)


def strictly_increasing(knots, step: float = 1e-4) -> Column:
    """Push up every knot that is not above its predecessor by *step*."""
    return F.aggregate(
        col(knots), F.expr("CAST(array() AS array<double>)"),
        lambda acc, v: F.concat(acc, F.array(
            F.when((F.size(acc) > 0) & (v <= F.element_at(acc, -1)), F.element_at(acc, -1) + F.lit(step))
            .otherwise(v))))


def dominant_term(x, sets: Mapping[str, Sequence[float]], default: str = "normal") -> Column:
    """Name of the term with the largest degree; the first of equals wins."""
    best = F.greatest(*[membership(x, p) for p in sets.values()])
    label = F.lit(default)
    for name in reversed(list(sets)):
        label = F.when(membership(x, sets[name]) == best, F.lit(name)).otherwise(label)
    return label


def fuzzify(df, channels: Sequence[str], fill_zero: bool = True, sets=None):
    """Add one ``mu__<channel>__<term>`` column per channel and term."""
    out = {}
    for c in channels:
        for term, params in (sets or sets_for(c)).items():
            mu = membership(c, params)
            out[f"mu__{c}__{term}"] = F.coalesce(mu, F.lit(0.0)) if fill_zero else mu
    return df.withColumns(out)


def tanh_normalize(z, tau) -> Column:
    return F.tanh(col(z) / col(tau))


def clip_scale(x, low: float, high: float) -> Column:
    """Linear map of [low, high] to [-1, 1], clipped."""
    return clip(2 * (col(x) - low) / (high - low) - 1, -1.0, 1.0)


def log_scale(x, top: float) -> Column:
    """log1p map of [0, top] to [-1, 1], clipped."""
    import math

    return clip(2 * F.log1p(col(x)) / math.log1p(top) - 1, -1.0, 1.0)


def value_bucket(x, thresholds: Sequence[float], labels: Sequence, strict: bool = False) -> Column:
    """Label of the band of *x*: the number of thresholds passed picks the label.

    ``strict`` compares with ``>``, otherwise ``>=``. Null stays null.
    """
    v = col(x)
    out = F.lit(labels[0])
    for limit, label in zip(thresholds, labels[1:]):
        out = F.when((v > limit) if strict else (v >= limit), F.lit(label)).otherwise(out)
    return F.when(v.isNotNull(), out)
