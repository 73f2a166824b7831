"""Geometry as Column expressions: projections, distances, bearings, cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kilometres per degree of the local projection, mean Earth radius, flat factors
# of the aftershock exclusion zone.
KM_PER_DEG_LON_EQUATOR = 111.32
KM_PER_DEG_LAT = 110.57
EARTH_RADIUS_KM = 6371.0
EXCLUSION_KM_PER_DEG_LAT = 110.6
EXCLUSION_KM_PER_DEG_LON = 92.6


def col(c: str | Column | float) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(c)


def wrap_longitude(lon) -> Column:
    """Longitude in [-180, 180); the modulus is the floor modulus."""
    return F.pmod(col(lon) + 180, F.lit(360)) - 180


def wrapped_delta(lon_a, lon_b) -> Column:
    return F.pmod(col(lon_b) - col(lon_a) + 180.0, F.lit(360.0)) - 180.0


def local_xy_km(lat, lon, ref_lat, ref_lon) -> tuple[Column, Column]:
    """Equirectangular kilometres east and north of a reference point."""
    scale = F.cos(F.radians(col(ref_lat))) * KM_PER_DEG_LON_EQUATOR
    return wrapped_delta(ref_lon, lon) * scale, (col(lat) - col(ref_lat)) * KM_PER_DEG_LAT


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dl = F.radians(wrapped_delta(lon1, lon2))
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h)))) * (2 * EARTH_RADIUS_KM)


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Azimuth from point 1 to point 2 in [0, 360)."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dl = F.radians(col(lon2) - col(lon1))
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def segment_distance_km(x, y, x1, y1, x2, y2, eps: float = 1e-9) -> Column:
    """Distance from (x, y) to the edge (x1, y1)-(x2, y2), all in projected kilometres."""
    dx, dy = x2 - x1, y2 - y1
    along = ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy + eps)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), along))
    return F.hypot(x - (x1 + t * dx), y - (y1 + t * dy))


def strike_side(x, y, azimuth_deg) -> Column:
    """Sign of the cross product of the strike direction and the projected point."""
    az = F.radians(col(azimuth_deg))
    return F.signum(-F.cos(az) * x + F.sin(az) * y)


def grid_cell(lat, lon) -> tuple[Column, Column]:
    return F.floor(col(lat)).cast("int"), F.floor(col(lon)).cast("int")


def quarter_cell(lat, lon) -> Column:
    """Quarter-degree cell label; rounding is half-even."""
    def part(c):
        return F.bround(col(c) * 4, 0).cast("int").cast("string")

    return F.concat_ws("|", part(lat), part(lon))


def axial_difference(a, b) -> Column:
    """Smallest angle between two axes (period 180)."""
    d = F.pmod(F.abs(col(a) - col(b)), F.lit(180.0))
    return F.least(d, F.lit(180.0) - d)


def month_distance(a, b) -> Column:
    """Months apart on the yearly circle."""
    d = F.abs(F.month(col(a)) - F.month(col(b)))
    return F.least(d, F.lit(12) - d)


def principal_axis_deg(var_x, var_y, cov_xy) -> Column:
    """Azimuth of the main axis of a point cloud from its covariances, in [0, 360).

    The direction is taken with a non-negative northing.
    """
    theta = 0.5 * F.atan2(2 * col(cov_xy), col(var_x) - col(var_y))
    dx, dy = F.cos(theta), F.sin(theta)
    flip = F.when(dy < 0, -1.0).otherwise(1.0)
    return F.pmod(F.degrees(F.atan2(dx * flip, dy * flip)), F.lit(360.0))
