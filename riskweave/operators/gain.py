"""Named rule strengths of the daily state and the gain they imply."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.fuzzy import clip, degree0, depressed, elevated, sets_for
from riskweave.operators.scoring import weighted_gain

# Consequents in log10 units.
CONSEQUENTS = {
    "seis_low": -0.30, "seis_very_low": -0.60, "seis_high": 0.30, "seis_very_high": 0.60,
    "seis_and_gnss": 1.00, "seis_and_load": 0.80, "agitation_and_load": 0.50,
    "sse_alone": 0.40, "sse_and_seis": 0.85,
    "fluid_low": -0.35, "fluid_very_low": -0.70, "fluid_alone": 0.60, "fluid_and_seis": 1.10,
    "swarm_high": 0.45, "swarm_low": -0.20, "foreshock_high": 0.55, "foreshock_low": -0.25,
    "water_low": -0.15, "water_high": 0.15, "strain_low": -0.35, "strain_high": 0.35, "seis_and_strain": 0.90,
    "ocean_low": -0.15, "ocean_high": 0.15, "seis_and_ocean": 0.70,
    "insar_low": -0.08, "insar_high": 0.08, "tec_low": -0.15, "tec_high": 0.15, "noise_low": -0.15, "noise_high": 0.15,
    "anchor": 0.0, "seis_normal": 0.0,
}
# Sign constraints of a fit (low rules never raise the gain; stronger terms never weaken it).
NEGATIVE_CHAINS = [("seis_low", "seis_very_low"), ("fluid_low", "fluid_very_low")]
NEGATIVE_SINGLES = ["swarm_low", "foreshock_low", "water_low", "strain_low", "ocean_low", "insar_low", "tec_low", "noise_low"]
POSITIVE_CHAINS = [("seis_high", "seis_very_high")]
PAIRED_CHANNELS = ("water", "strain", "ocean", "insar", "tec", "noise")


def rule_strengths(df: DataFrame) -> dict[str, Column]:
    """Strength of the 33 rules; channels the frame does not have stay silent."""
    have = set(df.columns)
    def up(c):
        return elevated(c) if c in have else F.lit(0.0)
    def down(c):
        return depressed(c) if c in have else F.lit(0.0)
    def one(c, term):
        return degree0(c, sets_for(c)[term]) if c in have else F.lit(0.0)
    def state(c):
        return F.col(c) if c in have else F.lit(0.0)
    seis = up("a_seis")
    load = clip((F.col("C_state") - 0.6) / 0.3, 0.0, 1.0) if "C_state" in have else F.lit(0.0)
    s = {"anchor": F.lit(0.5)}
    s |= {f"seis_{t}": one("a_seis", t) for t in ("normal", "low", "very_low", "high", "very_high")}
    s |= {
        "seis_and_gnss": F.least(seis, up("a_gnss")), "seis_and_load": F.least(seis, load),
        "agitation_and_load": F.least(state("A_state"), load), "sse_alone": state("K_state"),
        "sse_and_seis": F.least(state("K_state"), seis), "fluid_low": one("a_fluid", "low"),
        "fluid_very_low": one("a_fluid", "very_low"), "fluid_alone": state("F_state"), "fluid_and_seis": F.least(state("F_state"), seis),
        "swarm_low": down("a_swarm"), "swarm_high": state("E_state"), "foreshock_low": down("a_foreshock"), "foreshock_high": up("a_foreshock"),
        "seis_and_strain": F.least(seis, up("a_strain")), "seis_and_ocean": F.least(seis, up("a_ocean")),
    }
    for c in PAIRED_CHANNELS:
        s |= {f"{c}_low": down(f"a_{c}"), f"{c}_high": up(f"a_{c}")}
    return s


def with_strengths(df: DataFrame, prefix: str = "w_") -> DataFrame:
    return df.withColumns({prefix + k: v for k, v in rule_strengths(df).items()})


def gain(df: DataFrame, consequents: Mapping[str, float] | None = None, low: float = -1.0, high: float = 1.7, prefix: str = "w_") -> Column:
    """Gain of a frame with strength columns; consequents that are not given keep their default."""
    full = {**CONSEQUENTS, **(consequents or {})}
    return weighted_gain({k: F.col(prefix + k) for k in CONSEQUENTS}, full, low, high)
