"""Sensor-network aggregation and raster operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.evaluation import grouped_quantile


def station_robust_z(df: DataFrame, station: str, value: str, out: str = "z") -> DataFrame:
    """(x - median) / (1.4826 MAD + 1e-6) over the whole series of a station.

    Both medians come from totals over distinct values, so a station may hold any share of the rows.
    """
    med = grouped_quantile(df, [station], value, 0.5, "__m")
    centred = df.join(med, station).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    mad = grouped_quantile(centred, [station], "__d", 0.5, "__s")
    return centred.join(mad, station).withColumn(out, (F.col(value) - F.col("__m")) / (1.4826 * F.col("__s") + 1e-6)).drop("__m", "__d", "__s")


def network_daily_mean(df: DataFrame, day: str, station: str, z: str = "z") -> DataFrame:
    return df.groupBy(day).agg(F.avg(z).alias("mean_z"), F.countDistinct(station).alias("n_stations"))


def available_at(month) -> Column:
    """Annual reports are published on 15 February of the next year."""
    return F.make_date(F.year(month) + 1, F.lit(2), F.lit(15))


def volume_weighted_month(df: DataFrame, month: str, well: str, volume: str, pressure: str) -> DataFrame:
    """Monthly volume, volume-weighted pressure over rows with both, wells, and date of publication."""
    both = F.col(pressure).isNotNull() & (F.coalesce(F.col(volume), F.lit(0.0)) > 0)
    g = df.groupBy(month).agg(
        F.sum(F.coalesce(F.col(volume), F.lit(0.0))).alias("total_vol"),
        (F.sum(F.when(both, F.col(pressure) * F.col(volume))) / F.sum(F.when(both, F.col(volume)))).alias("vol_weighted_psi"),
        F.countDistinct(well).alias("n_wells"))
    return g.withColumn("available_at", available_at(month))


def latest_release(df: DataFrame, released: str, month: str, value: str) -> DataFrame:
    """Value of the latest month among those released on one date."""
    return df.groupBy(released).agg(F.max_by(value, month).alias(value))


def axial_mean(df: DataFrame, keys: Sequence[str], azimuth: str) -> DataFrame:
    """Mean direction in [0, 180) of axes and their concentration R."""
    t = F.radians(F.col(azimuth) * 2)
    g = df.groupBy(*keys).agg(F.avg(F.cos(t)).alias("__c"), F.avg(F.sin(t)).alias("__s"), F.count(azimuth).alias("n"))
    return g.select(*keys, F.pmod(F.degrees(F.atan2("__s", "__c")) / 2, F.lit(180.0)).alias("mean_azimuth"), F.hypot("__c", "__s").alias("concentration"), "n")


def dominant_category(df: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """Most frequent category (the alphabetically first of equals), its count and the number of categories."""
    c = df.filter(F.col(category).isNotNull()).groupBy(*keys, category).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("neg"), F.col(category).alias("name")))
    return c.groupBy(*keys).agg(best.alias("__b"), F.sum("__n").alias("n"), F.count(F.lit(1)).alias("n_categories")).select(
        *keys, F.col("__b.name").alias("dominant"), (-F.col("__b.neg")).alias("n_dominant"), "n", "n_categories")


# ---------------------------------------------------------------- rasters in long form

def bilinear(points: DataFrame, grid: DataFrame, step_lat: float, step_lon: float, lat0: float, lon0: float, n_lat: int, n_lon: int,
             value: str = "vtec") -> DataFrame:
    """Bilinear value at each point, averaged over the maps of a day.

    *grid* has day, map, lat, lon (regular, n_lat by n_lon from lat0/lon0) and a value. A point expands to
    its four weighted corners and meets the grid in one equi join; the weighted mean is a partial
    aggregation. Points outside take the value at the edge; a corner that a map lacks has no weight.
    """
    y = F.greatest(F.lit(0.0), F.least((F.col("latitude") - lat0) / step_lat, F.lit(n_lat - 1.0)))
    x = F.greatest(F.lit(0.0), F.least((F.col("longitude") - lon0) / step_lon, F.lit(n_lon - 1.0)))
    i, j = F.least(F.floor(y), F.lit(n_lat - 2)), F.least(F.floor(x), F.lit(n_lon - 2))
    ti, tj = y - i, x - j
    corner = F.array(*[F.struct((i + a).cast("int").alias("gi"), (j + b).cast("int").alias("gj"),
                                ((ti if a else 1 - ti) * (tj if b else 1 - tj)).alias("w")) for a in (0, 1) for b in (0, 1)])
    c = points.select("point", F.explode(corner).alias("c")).select("point", "c.gi", "c.gj", "c.w").filter("w > 0")
    g = grid.select("day", "map", F.round((F.col("lat") - lat0) / step_lat).cast("int").alias("gi"),
                    F.round((F.col("lon") - lon0) / step_lon).cast("int").alias("gj"), F.col(value).alias("v"))
    per_map = c.join(g.filter("v IS NOT NULL"), ["gi", "gj"]).groupBy("point", "day", "map").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
    return per_map.groupBy("point", "day").agg(F.avg("v").alias(value))


def valid_pixel(c) -> Column:
    """Pixels equal to 0, null or NaN carry no data."""
    v = F.col(c) if isinstance(c, str) else c
    return v.isNotNull() & ~F.isnan(v) & (v != 0)


def plane_detrend(pixels: DataFrame, key: str, row: str = "row", column: str = "col", value: str = "phase", min_pixels: int = 1000) -> DataFrame:
    """Subtract the least-squares plane of every image from its valid pixels; small images are dropped.

    The plane solves the 3x3 normal equations of the sums of an image, taken around its mean position,
    so all pixels are used and no image is collected.
    """
    ok = pixels.filter(valid_pixel(value))
    r, c, v = (F.col(x).cast("double") for x in (row, column, value))
    s = ok.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("mr"), F.avg(c).alias("mc"), F.avg(v).alias("mv"), F.var_pop(r).alias("rr"),
        F.var_pop(c).alias("cc"), F.covar_pop(r, c).alias("rc"), F.covar_pop(r, v).alias("rv"), F.covar_pop(c, v).alias("cv"))
    det = F.col("rr") * F.col("cc") - F.col("rc") * F.col("rc")
    s = s.filter((F.col("n") >= min_pixels) & (det > 0)).withColumns({
        "__b": (F.col("rv") * F.col("cc") - F.col("cv") * F.col("rc")) / det,
        "__c": (F.col("cv") * F.col("rr") - F.col("rv") * F.col("rc")) / det})
    ramp = F.col("mv") + F.col("__b") * (r - F.col("mr")) + F.col("__c") * (c - F.col("mc"))
    return ok.join(s.select(key, "mr", "mc", "mv", "__b", "__c"), key).withColumn(value, v - ramp).drop("mr", "mc", "mv", "__b", "__c")


def window_median(pixels: DataFrame, centres: DataFrame, key: str, halves: Sequence[int] = (5, 15, 30, 60), min_pixels: int = 5,
                  value: str = "phase") -> DataFrame:
    """Median of the valid pixels in the smallest window around each centre that has *min_pixels*.

    *centres* has the key, ``centre``, ``row`` and ``col``. Only the ring index of a pixel is needed: the
    counts per ring choose the window before any median is taken, and a window is at most
    (2 * max(halves) + 1)^2 pixels.
    """
    big = max(halves)
    p = pixels.filter(valid_pixel(value)).select(key, F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value).alias("__v"))
    near = centres.join(p, key)
    near = near.withColumn("__d", F.greatest(F.abs(F.col("__r") - F.col("row")), F.abs(F.col("__c") - F.col("col")))).filter(F.col("__d") <= big)
    agg = [F.count(F.when(F.col("__d") <= h, 1)).alias(f"n{h}") for h in halves] + [F.percentile(F.when(F.col("__d") <= h, F.col("__v")), 0.5).alias(f"m{h}") for h in halves]
    g = near.groupBy(key, "centre").agg(*agg)
    pick = F.coalesce(*[F.when(F.col(f"n{h}") >= min_pixels, F.struct(F.lit(h).alias("half"), F.col(f"m{h}").alias("v"), F.col(f"n{h}").alias("n"))) for h in halves])
    return g.withColumn("__p", pick).filter("__p is not null").select(key, "centre", F.col("__p.half").alias("half"), F.col("__p.v").alias(value), F.col("__p.n").alias("n_px"))


def lock_centre(medians: DataFrame, key: str, order: str) -> DataFrame:
    """First candidate centre (by number) with coverage in the earliest image; one centre for the whole series."""
    return medians.groupBy().agg(F.min(F.struct(F.col(order), F.col("centre"))).alias("__f")).select(F.col("__f.centre").alias("centre"))


def interferogram_stack(pairs: DataFrame, rate: str, start: str, end: str, first_day, last_day, max_gap: int = 48, bin_days: int = 30) -> DataFrame:
    """Median rate of the short-baseline pairs per bin of start dates; bins are dated at their middle."""
    gap = F.datediff(F.col(end), F.col(start))
    origin = F.lit(first_day).cast("date")
    b = F.floor(F.datediff(F.col(start), origin) / bin_days)
    keep = pairs.filter((F.col(start) >= origin) & (F.col(end) <= F.lit(last_day).cast("date")) & (gap <= max_gap) & (gap > 0))
    keep = keep.withColumn("bin", b.cast("int"))
    g = grouped_quantile(keep, ["bin"], rate, 0.5, "los_rate").join(keep.groupBy("bin").agg(F.count(F.lit(1)).alias("n_pairs")), "bin")
    return g.withColumn("day", F.date_add(origin, F.col("bin") * bin_days + bin_days // 2))
