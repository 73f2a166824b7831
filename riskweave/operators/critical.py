"""Cluster evidence and the recurrent critical state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.fuzzy import clip, depressed, elevated
from riskweave.functions.probability import sigmoid
from riskweave.operators.timeseries import Recurrent, Roll, fold_states, latest_row, rolling

# Channels per cluster, availability flags, evidence rules.
CLUSTERS = {
    "regional": ["a_regional_rate", "a_regional_spread", "a_bvalue_drop", "a_fault_concentration", "a_mag_accel"],
    "seismic": ["a_seis", "a_swarm", "a_foreshock", "a_noise"],
    "deformation": ["a_gnss", "a_sse", "a_strain", "a_insar"],
    "mechanical": ["C_state", "a_fluid", "F_state"],
    "hydro": ["a_water", "a_fluid"],
    "remote": ["a_ocean", "a_tec"],
}
AVAILABILITY = {c: "has_regional_catalog_data" for c in CLUSTERS["regional"]} | {
    "a_gnss": "has_gnss_data", "a_sse": "has_gnss_data", "a_fluid": "has_fluid_data", "a_water": "has_water_data",
    "a_strain": "has_strain_data", "a_ocean": "has_ocean_data", "a_insar": "has_insar_data", "a_tec": "has_tec_data",
    "a_noise": "has_noise_data"}
EVIDENCE_RULES = {
    "regional_expansion": ("regional_level", "regional_persistence"),
    "regional_local_confirmation": ("regional_level", "seismic_level"),
    "regional_deformation": ("regional_trend", "deformation_level"),
    "regional_loading": ("regional_level", "mechanical_level"),
    "regional_quiescence_loading": ("regional_quiet", "mechanical_level"),
    "seismic_deformation": ("seismic_level", "deformation_level"),
    "deformation_loading": ("deformation_trend", "mechanical_level"),
    "seismic_loading": ("seismic_trend", "mechanical_level"),
    "local_quiescence_deformation": ("seismic_quiet", "deformation_level"),
    "persistent_multiphysics": ("seismic_persistence", "deformation_persistence"),
    "triple_cluster": ("seismic_level", "deformation_level", "mechanical_level"),
    "hydro_mechanical": ("hydro_trend", "mechanical_level"),
    "remote_confirmation": ("remote_level", "deformation_level"),
    "coherent_acceleration": ("seismic_coherence", "deformation_coherence"),
}
SUFFIXES = ("level", "quiet", "trend", "persistence", "coherence", "coverage")


def _available(df: DataFrame, channel: str) -> Column:
    flag = AVAILABILITY.get(channel)
    if flag in df.columns:
        return F.coalesce(F.col(flag).cast("double"), F.lit(0.0)) > 0.5
    return F.col(channel).isNotNull()


def _noisy_or(degrees: Sequence[tuple[Column, Column]]) -> Column:
    """1 - product of (1 - degree) over the available channels."""
    return 1 - reduce(lambda a, b: a * b, [F.when(ok, 1 - d).otherwise(1.0) for d, ok in degrees])


def cluster_evidence(frame: DataFrame, keys: Sequence[str], day: str, clusters: Mapping[str, Sequence[str]] = CLUSTERS) -> DataFrame:
    """Evidence in [0, 1] per cluster; an unavailable channel neither votes nor counts as neutral.

    Channels the frame does not have are left out of the coverage; a cluster without channels is 0.
    """
    present = {k: [c for c in cs if c in frame.columns] for k, cs in clusters.items()}
    channels = sorted({c for cs in present.values() for c in cs})
    out = rolling(frame, keys, day, [Roll(f"__f_{c}", c, 7, "mean", 3, 0) for c in channels]
                  + [Roll(f"__s_{c}", c, 60, "mean", 20, 0) for c in channels])
    # degrees are columns of their own, so that the cluster formulas below reuse them
    inputs, per_channel = {}, {}
    for c in channels:
        inputs[f"__x_{c}"] = F.expr(f"coalesce(CAST(`{c}` AS double), 0D)")
        gap = F.coalesce(F.col(f"__f_{c}") - F.col(f"__s_{c}"), F.lit(0.0)) / 0.35
        inputs[f"__g_{c}"] = F.least(F.greatest(gap, F.lit(-1.0)), F.lit(1.0))
        per_channel |= {f"__lev_{c}": elevated(f"__x_{c}", c), f"__qui_{c}": depressed(f"__x_{c}", c),
                        f"__tre_{c}": elevated(f"__g_{c}"), f"__av_{c}": _available(frame, c)}
    out = out.withColumns(inputs)
    out = out.withColumns(per_channel)
    cols, daily = {}, {}
    for k, cs in present.items():
        if not cs:
            cols |= {f"{k}_{s}": F.lit(0.0) for s in SUFFIXES}
            continue
        av = [F.col(f"__av_{c}") for c in cs]
        lev = [F.col(f"__lev_{c}") for c in cs]
        n = sum((a.cast("int") for a in av), F.lit(0))
        for s, p in (("level", "lev"), ("quiet", "qui"), ("trend", "tre")):
            cols[f"{k}_{s}"] = _noisy_or([(F.col(f"__{p}_{c}"), a) for c, a in zip(cs, av)])
        high = sum((F.when(a, v).otherwise(0.0) for v, a in zip(lev, av)), F.lit(0.0))
        daily[f"__d_{k}"] = F.when(n > 0, high / n).otherwise(0.0)
        agree = sum(((a & (v >= 0.5)).cast("int") for v, a in zip(lev, av)), F.lit(0))
        cols[f"{k}_coherence"] = F.when(n > 0, agree / n).otherwise(0.0)
        cols[f"{k}_coverage"] = n / len(cs)
    out = rolling(out.withColumns(daily | cols), keys, day, [Roll(f"__p_{k[4:]}", k, 30, "mean", 10, 0) for k in daily])
    out = out.withColumns({f"{k[4:]}_persistence": F.coalesce(F.col(f"__p_{k[4:]}"), F.lit(0.0)) for k in daily})
    names = [f"{k}_{s}" for k in present for s in SUFFIXES]
    return out.select(*keys, day, *[clip(c, 0.0, 1.0).alias(c) for c in names])


def rule_firings(evidence: DataFrame, rules: Mapping[str, Sequence[str]] = EVIDENCE_RULES, prefix: str = "r_") -> DataFrame:
    """Smallest antecedent times the smallest coverage of the clusters involved."""
    out = {}
    for name, parts in rules.items():
        covers = [F.col(f"{c}_coverage") for c in dict.fromkeys(p.rsplit("_", 1)[0] for p in parts)]
        cover = F.least(*covers) if len(covers) > 1 else covers[0]
        out[prefix + name] = F.least(*[F.col(p) for p in parts]) * cover
    return evidence.withColumns(out)


def critical_state(firings: DataFrame, keys, day: str, weights: Mapping[str, float] | None = None, intercept: float = -2.0, prefix: str = "r_") -> DataFrame:
    """Logistic score of the firings followed by the asymmetric memory."""
    names = list(EVIDENCE_RULES)
    weights = weights or {n: 1.0 / len(names) for n in names}
    z = sum((F.col(prefix + n) * float(weights[n]) for n in names), F.lit(float(intercept)))
    return fold_states(firings.withColumn("raw_score", sigmoid(z, 30.0)), keys, day, [Recurrent("critical_state", "raw_score")])


def shadow_table(states: DataFrame, keys, day: str, weights: Mapping[str, float], threshold: float, top: int = 5, prefix: str = "r_") -> DataFrame:
    """Latest state per entity: evidence struct per cluster, strongest rules, threshold flag."""
    last = latest_row(states, keys, day)
    contributions = F.array(*[F.struct((-F.bround(F.col(prefix + n) * float(weights[n]), 4)).alias("neg"), F.lit(i).alias("i"), F.lit(n).alias("rule"),
                                       F.bround(prefix + n, 4).alias("firing")) for i, n in enumerate(EVIDENCE_RULES)])
    ordered = F.slice(F.array_sort(contributions), 1, top)
    clusters = F.struct(*[F.struct(*[F.bround(f"{k}_{s}", 4).alias(s) for s in SUFFIXES]).alias(k) for k in CLUSTERS])
    return last.select(*keys, F.col(day).alias("state_as_of"), F.bround("critical_state", 5).alias("critical_state"),
                       (F.col("critical_state") >= threshold).alias("above_threshold"), clusters.alias("clusters"),
                       F.transform(ordered, lambda r: F.struct(r["rule"].alias("rule"), r["firing"].alias("firing"), (-r["neg"]).alias("weighted"))).alias("top_rules"))
