"""Spatial operators: corridors, halos, nearest entities, space-time exclusion, kernel sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import geo
from riskweave.functions.geo import col
from riskweave.session import cut_lineage


def bbox_filter(df: DataFrame, lat: str, lon: str, south: float, north: float, west: float, east: float,
                pad: float = 0.0) -> DataFrame:
    """Rows in a padded box; plain ranges, so they reach the Parquet scan."""
    return df.filter(F.col(lat).between(south - pad, north + pad) & F.col(lon).between(west - pad, east + pad))


def traces(vertices: DataFrame, segment: str = "segment", chain: str | None = None, order: str = "i") -> DataFrame:
    """One row per segment: reference point and edge array in projected kilometres.

    Vertices are configuration (a few thousand per segment at most), so the array is small and the
    distance of a point needs no join blow-up and no second aggregation.
    """
    part = [segment] + ([chain] if chain else [])
    w = Window.partitionBy(*part).orderBy(order)
    ref = vertices.groupBy(segment).agg(F.avg("lat").alias("ref_lat"), F.avg("lon").alias("ref_lon"),
                                        F.min("lat").alias("south"), F.max("lat").alias("north"))
    v = vertices.join(ref, segment)
    x, y = geo.local_xy_km("lat", "lon", "ref_lat", "ref_lon")
    v = v.withColumns({"x": x, "y": y})
    v = v.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)}).filter("x2 is not null")
    edge = F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    return v.groupBy(segment, "ref_lat", "ref_lon", "south", "north").agg(F.collect_list(edge).alias("edges"))


def polyline_distance(points: DataFrame, trace: DataFrame, segment: str = "segment", azimuth: str | None = None,
                      max_km: float | Column | None = None, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Add ``dist_km`` (and ``side`` when an azimuth column is given) to every point of a segment.

    With *max_km* points far outside the latitude band are dropped before the exact distance.
    """
    p = points.join(trace, segment)
    if max_km is not None:
        pad = col(max_km) / geo.KM_PER_DEG_LAT + 0.01
        p = p.filter(F.col(lat).between(F.col("south") - pad, F.col("north") + pad))
    x, y = geo.local_xy_km(lat, lon, "ref_lat", "ref_lon")
    p = p.withColumns({"__x": x, "__y": y})
    distances = F.transform("edges", lambda e: geo.segment_distance_km(
        F.col("__x"), F.col("__y"), e["x1"], e["y1"], e["x2"], e["y2"]))
    out = {"dist_km": F.array_min(distances)}
    if azimuth is not None:
        out["side"] = geo.strike_side(F.col("__x"), F.col("__y"), azimuth).cast("int")
    p = p.withColumns(out)
    if max_km is not None:
        p = p.filter(F.col("dist_km") <= col(max_km))
    return p.select(*points.columns, *out)


def halo(df: DataFrame, la: str = "la", lo: str = "lo", radius: int = 1) -> DataFrame:
    """Replicate rows to the neighbouring cells; longitude wraps, latitude does not.

    Aggregate per own cell first: sums, counts and extrema of a halo are those of its cells.
    """
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    return (df.withColumn("__da", F.explode(steps)).withColumn("__do", F.explode(steps))
            .withColumns({la: (F.col(la) + F.col("__da")).cast("int"),
                          lo: geo.wrap_longitude(F.col(lo) + F.col("__do")).cast("int")})
            .drop("__da", "__do"))


def _cells_of(edges: DataFrame, km: float) -> DataFrame:
    """Distinct (segment, __ca, __co): cells of about *km* that hold every point within *km* of an edge.

    Cells are squares of *km* in the projection at the poleward side of the trace, so no distance spans more of them
    than at the trace itself; longitude cells are counted around the globe.
    """
    high = km / geo.KM_PER_DEG_LAT
    wide = F.lit(km) / (geo.KM_PER_DEG_LON_EQUATOR * F.greatest(F.cos(F.radians("ref_lat")), F.lit(1e-6))) * 1.001
    lat = (F.least("lat1", "lat2"), F.greatest("lat1", "lat2"))
    west, east = F.least("lon1", "lon2"), F.greatest("lon1", "lon2")
    n = F.lit(max(1, int(360 / high)))
    rows = F.sequence(F.floor((lat[0] - high * 1.001) / high), F.floor((lat[1] + high * 1.001) / high))
    first, last = F.floor((west - wide + 180) / 360 * n), F.floor((east + wide + 180) / 360 * n)
    columns = F.sequence(first, F.least(last, first + n - 1))
    out = edges.select("segment", F.explode(rows).alias("__ca"), columns.alias("c")).select("segment", "__ca", F.explode("c").alias("c"))
    return out.select("segment", "__ca", F.pmod("c", n).alias("__co")).distinct()


def nearest_k(entities: DataFrame, trace: DataFrame, max_km: float, k: int, order_tie: str, rings: Sequence[float] = (0.1, 0.35, 1.0),
              lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """The *k* entities nearest to every trace within *max_km*.

    Traces are searched in rings: cells within a share of *max_km* first, and a trace that has found *k*
    entities within that distance is done, as nothing farther can come before them. Entities and traces meet on cells;
    ``row_number() <= k`` lets Spark keep k rows per task before the exchange.
    """
    lon1 = (F.col("e.x1") / (F.cos(F.radians("ref_lat")) * geo.KM_PER_DEG_LON_EQUATOR)) + F.col("ref_lon")
    lon2 = (F.col("e.x2") / (F.cos(F.radians("ref_lat")) * geo.KM_PER_DEG_LON_EQUATOR)) + F.col("ref_lon")
    edges = trace.select("segment", "ref_lat", "ref_lon", F.explode("edges").alias("e")).select(
        "segment", "ref_lat", (F.col("e.y1") / geo.KM_PER_DEG_LAT + F.col("ref_lat")).alias("lat1"), (F.col("e.y2") / geo.KM_PER_DEG_LAT + F.col("ref_lat")).alias("lat2"),
        lon1.alias("lon1"), lon2.alias("lon2"))
    order = Window.partitionBy("segment").orderBy(F.round("dist_km", 6), order_tie)
    done = None
    for share in rings:
        km = max_km * share
        high = km / geo.KM_PER_DEG_LAT
        n = max(1, int(360 / high))
        here = entities.withColumns({"__ca": F.floor(F.col(lat) / high), "__co": F.pmod(F.floor((F.col(lon) + 180) / 360 * n), F.lit(n))})
        open_ = edges if done is None else edges.join(done.select("segment").distinct(), "segment", "left_anti")
        near = here.join(_cells_of(open_, km), ["__ca", "__co"]).drop("__ca", "__co")
        found = polyline_distance(near, trace, max_km=km, lat=lat, lon=lon).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        if share < rings[-1]:
            full = found.groupBy("segment").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= k).select("segment")
            found = cut_lineage(found.join(full, "segment", "left_semi"))
        done = found if done is None else done.unionByName(found)
    return done


def nearest_place(points: DataFrame, places: Sequence[tuple], lat: str = "latitude", lon: str = "longitude",
                  remote_km: float = 900.0) -> DataFrame:
    """Closest of a fixed list of (city, region, country, lat, lon); far points get an ocean basin."""
    options = F.array(*[F.struct(geo.haversine_km(F.col(lat), F.col(lon), F.lit(p[3]), F.lit(p[4])).alias("d"),
                                 F.lit(i).alias("i"), F.lit(p[0]).alias("city"), F.lit(p[1]).alias("region"),
                                 F.lit(p[2]).alias("country")) for i, p in enumerate(places)])
    out = points.withColumn("__best", F.array_min(options))
    remote = F.col("__best.d") > remote_km
    return out.withColumns({
        "city": F.col("__best.city"),
        "place_region": F.when(remote, ocean_basin(F.col(lat), F.col(lon))).otherwise(F.col("__best.region")),
        "country": F.col("__best.country"),
        "place_km": F.round(F.col("__best.d"), 0).cast("int"),
        "remote": remote}).drop("__best")


def ocean_basin(lat: Column, lon: Column) -> Column:
    return (F.when(F.abs(lat) > 60, F.when(lat > 0, "Arctic seismic grid").otherwise("Southern Ocean seismic grid"))
            .when((lon > -80) & (lon < 20), "Atlantic seismic grid")
            .when((lon >= 20) & (lon < 120), "Indian Ocean seismic grid")
            .otherwise("Pacific seismic grid"))


def spatiotemporal_exclusion(events: DataFrame, triggers: DataFrame, days: float = 30.0, km: float = 30.0,
                             time: str = "time", lat: str = "latitude", lon: str = "longitude", keys: Sequence[str] = ()) -> DataFrame:
    """Drop events strictly within *days* after and *km* of a trigger (of the same *keys*).

    Triggers are reduced to distinct (time, place) and replicated to the space-time cells they can
    reach, so the anti join is an equi join on small cells.
    """
    dlat, dlon = km / geo.EXCLUSION_KM_PER_DEG_LAT, km / geo.EXCLUSION_KM_PER_DEG_LON
    def cells(t, a, o):
        return (F.floor(F.unix_micros(t.cast("timestamp")) / F.lit(days * 86400e6)).alias("__ct"),
                F.floor(a / F.lit(dlat)).alias("__ca"), F.floor(o / F.lit(dlon)).alias("__co"))
    ev = events.select("*", *cells(F.col(time), F.col(lat), F.col(lon)))
    trig = triggers.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(time).alias("__t"), F.col(lat).alias("__la"), F.col(lon).alias("__lo")).distinct()
    trig = trig.select("*", *cells(F.col("__t"), F.col("__la"), F.col("__lo")))
    around = F.sequence(F.lit(-1), F.lit(1))
    for c, steps in (("__ct", F.array(F.lit(0), F.lit(1))), ("__ca", around), ("__co", around)):
        trig = trig.withColumn("__s", F.explode(steps)).withColumn(c, F.col(c) + F.col("__s"))
    dt = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("__t").cast("timestamp"))) / F.lit(86400e6)
    near = F.hypot((F.col(lat) - F.col("__la")) * geo.EXCLUSION_KM_PER_DEG_LAT,
                   (F.col(lon) - F.col("__lo")) * geo.EXCLUSION_KM_PER_DEG_LON) < km
    e, g = ev.alias("e"), trig.alias("g")
    same = (F.col("e.__ct") == F.col("g.__ct")) & (F.col("e.__ca") == F.col("g.__ca")) & (F.col("e.__co") == F.col("g.__co"))
    for k in keys:
        same = same & (F.col(f"e.{k}") == F.col(f"g.__k_{k}"))
    return e.join(g, same & (dt > 0) & (dt < days) & near, "left_anti").select(*events.columns)


NEAR_DAYS, MOMENTS = 8, 14


def kernel_intensity(events: DataFrame, keys: Sequence[str], time: str, weight: str, c: float, p: float,
                     last_day, lookback: int | None = None, out: str = "excitation") -> DataFrame:
    """Sum over past events of weight / (lag + c)^p at the start of every later day.

    The first days after an event are summed event by event. Beyond them the kernel is a power series in
    the time of day s (|s| <= 0.5 of a lag of at least 8.5 days, so 14 terms reach double precision):
    events are reduced to 14 moments per (entity, day) before the exchange, and a convolution over the
    calendar of one entity finishes the sum. The work per event is 8 rows, not one per later day, and no
    pair of events and days is ever joined. *lookback* limits the lag in days.
    """
    stop = F.lit(last_day).cast("date")
    near_last = NEAR_DAYS if lookback is None else min(NEAR_DAYS, lookback)
    day = F.to_date(F.col(time))
    e = events.select(*keys, day.alias("__d"), F.col(weight).cast("double").alias("__w"),
                      ((F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(day.cast("timestamp"))) / F.lit(86400e6)).alias("__u"))
    near = e.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(near_last)))).withColumn("day", F.date_add("__d", F.col("__k")))
    near = near.filter(F.col("day") <= stop)
    near = near.select(*keys, "day", (F.col("__w") / F.pow(F.col("__k") - F.col("__u") + c, F.lit(p))).alias(out))
    if lookback is not None and lookback <= NEAR_DAYS:
        return near.groupBy(*keys, "day").agg(F.sum(out).alias(out))
    s = F.col("__u") - 0.5
    moments = e.groupBy(*keys, "__d").agg(*[F.sum(F.col("__w") * (F.pow(s, F.lit(float(k))) if k else F.lit(1.0))).alias(f"m{k}") for k in range(MOMENTS)])
    key_fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moments.schema.fields if f.name in keys)
    end_day = np.datetime64(str(last_day)[:10], "D").astype(int)

    def far(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pd.to_datetime(pdf["__d"]).to_numpy().astype("datetime64[D]").astype(int)
        first = d.min()
        span = int(end_day - first) + 1
        keep = d <= end_day
        lag = np.arange(1, span + 1, dtype=float)
        reach = (lag > NEAR_DAYS) & ((lag <= lookback) if lookback is not None else True)
        centre = lag - 0.5 + c
        total, coef = np.zeros(span), 1.0
        for k in range(MOMENTS):
            if k:
                coef *= (p + k - 1) / k
            daily = np.zeros(span)
            daily[d[keep] - first] = pdf[f"m{k}"].to_numpy()[keep]
            kernel = np.concatenate([[0.0], np.where(reach, coef * centre ** (-p - k), 0.0)[: span - 1]])
            total += np.convolve(daily, kernel)[:span]
        days = (np.arange(span) + first).astype("datetime64[D]")
        res = pd.DataFrame({"day": pd.Series(days).dt.date, out: total})
        for key in keys:
            res[key] = pdf[key].iloc[0]
        return res[total > 0][[*keys, "day", out]]

    rest = moments.groupBy(*keys).applyInPandas(far, f"{key_fields}, day date, {out} double")
    return near.unionByName(rest).groupBy(*keys, "day").agg(F.sum(out).alias(out))
