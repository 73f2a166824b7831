"""Probability, stress and unit formulas as Column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions.fuzzy import clip
from riskweave.functions.geo import bearing_deg, col, haversine_km

# Fixed values of the stress-transfer approximation.
STRESS_CALIBRATION = 2.0095e-07
MIN_STRESS_RADIUS_KM = 5.0
CROSS_STYLE_COUPLING = 0.25
# Fixed value: radar wavelength in metres (C band).
RADAR_WAVELENGTH_M = 0.055465763


def poisson_probability(rate_per_day, days) -> Column:
    """P(at least one event in *days*)."""
    return 1 - F.exp(-col(rate_per_day) * col(days))


def rate_from_probability(p, days: float = 30.0) -> Column:
    """Daily Poisson rate with probability *p* over *days*."""
    return -F.log(F.greatest(1 - col(p), F.lit(1e-9))) / days


def mean_wait_days(p, days: float = 30.0) -> Column:
    rate = rate_from_probability(p, days)
    return F.when(rate > 0, 1 / rate)


def sigmoid(z, limit: float | None = None) -> Column:
    z = col(z)
    if limit is not None:
        z = clip(z, -limit, limit)
    return 1 / (1 + F.exp(-z))


def logistic_score(features, coef, intercept: float, limit: float | None = None) -> Column:
    z = F.lit(float(intercept))
    for feature, weight in zip(features, coef):
        z = z + col(feature) * float(weight)
    return sigmoid(z, limit)


def softplus(x) -> Column:
    """log(1 + e^x) without overflow."""
    x = col(x)
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def seismic_moment(mag) -> Column:
    return F.pow(F.lit(10.0), 1.5 * col(mag) + 9.1)


def lobe_pattern(source_strike, azimuth, receiver_strike) -> Column:
    """Four-lobe sign pattern of stress transfer, weakened when the strikes differ."""
    quadrupole = F.cos(2 * F.radians(col(azimuth) - col(source_strike)))
    alignment = F.cos(F.radians(2 * (col(receiver_strike) - col(source_strike))))
    return quadrupole * (0.5 + 0.5 * F.greatest(alignment, F.lit(0.0)))


def delta_stress(mag, ev_lat, ev_lon, src_strike, src_regime, rcv_lat, rcv_lon, rcv_strike,
                 rcv_regime) -> Column:
    """Stress step (bar) at a receiver after an event: moment / distance^3, lobes, style match."""
    r_m = F.greatest(haversine_km(ev_lat, ev_lon, rcv_lat, rcv_lon),
                     F.lit(MIN_STRESS_RADIUS_KM)) * 1000.0
    lobe = lobe_pattern(src_strike, bearing_deg(ev_lat, ev_lon, rcv_lat, rcv_lon), rcv_strike)
    style = F.when(col(src_regime) == col(rcv_regime), 1.0).otherwise(CROSS_STYLE_COUPLING)
    return STRESS_CALIBRATION * seismic_moment(mag) / F.pow(r_m, 3) * lobe * style


def phase_to_mm(phase) -> Column:
    """Interferometric phase to line-of-sight millimetres."""
    return col(phase) * (RADAR_WAVELENGTH_M * 1000.0 / (4 * math.pi))


def mjd_to_date(mjd) -> Column:
    return F.date_add(F.lit("1858-11-17").cast("date"), F.floor(col(mjd)).cast("int"))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x); the work grows with the root of its arguments."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while term > total * 1e-17:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h, i = d, 0
    while True:
        i += 1
        an, b = -i * (i - a), b + 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15 or i > 10_000_000:
            return min(1.0, scale * h)


def _upper_gamma_column(a: Column, x: Column) -> Column:
    @F.pandas_udf("double")
    def q(a: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([upper_gamma(u, v) if u > 0 and v == v else None for u, v in zip(a, x)], dtype="float64")

    return q(a.cast("double"), x.cast("double"))


def poisson_lower_tail(k, mean) -> Column:
    """P(X <= k) of a Poisson variable; counts and means may be of any size."""
    k, mean = col(k), col(mean)
    return F.when(k < 0, 0.0).otherwise(_upper_gamma_column(F.greatest(k, F.lit(0)) + 1, mean))


def poisson_two_sided(k, mean) -> Column:
    """Two-sided p-value with inclusive tails."""
    lower = poisson_lower_tail(k, mean)
    upper = 1 - poisson_lower_tail(col(k) - 1, mean)
    return F.least(F.lit(1.0), 2 * F.least(lower, upper))


def chi2_upper_even(chi2, half_df) -> Column:
    """P(X > chi2) for 2*half_df degrees of freedom."""
    return _upper_gamma_column(col(half_df), col(chi2) / 2)
