"""As-of neighbours without one sort per entity.

The timeline of an entity is cut into calendar buckets. Inside a bucket a window finds the neighbour;
the last (first) right row of every bucket is carried over the bucket axis and joined back. One busy
entity is spread over its buckets, and only one small row per bucket is ever ordered as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.quantiles import bucket_of, bucket_points


def neighbours(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
               values: Sequence[str], tiebreak: Sequence[str] = (), bucket: str | None = "MONTH",
               prev: bool = True, next: bool = True, equal: str = "prev") -> DataFrame:
    """Add structs ``prev`` and/or ``next`` (fields ``t`` and *values*) to every left row.

    *equal* says which neighbour a right row at the same time is. Among right rows of one time the
    last by *tiebreak* is the previous one, the first by *tiebreak* the next one. *bucket* is a calendar
    unit; None cuts the times at equal-count split points instead, for sources that are busy in bursts.
    """
    keys = list(keys)
    fields = F.struct(F.col(right_time).alias("t"), *[F.col(c).alias(c) for c in dict.fromkeys([*values, *tiebreak])])
    rank = F.struct(*[F.col(c) for c in (tiebreak or [right_time])])
    # one row per (key, time) on either side: repeated times merge before the exchange
    r = right.groupBy(*keys, F.col(right_time).alias("__t")).agg(F.max_by(fields, rank).alias("__vp"), F.min_by(fields, rank).alias("__vn"))
    empty = F.lit(None).cast(r.schema["__vp"].dataType)
    asked = left.select(*keys, F.col(left_time).alias("__t")).distinct()
    u = asked.select(*keys, "__t", empty.alias("__vp"), empty.alias("__vn"), F.lit(1).alias("__ask")).unionByName(r.withColumn("__ask", F.lit(0)))
    if bucket is None:
        at = F.unix_micros(F.col("__t").cast("timestamp")).cast("double")
        points = bucket_points(left.select(F.unix_micros(F.col(left_time).cast("timestamp")).cast("double").alias("x")), "x")
        u = u.withColumn("__at", at).withColumn("__b", bucket_of("__at", points)).drop("__at")
    else:
        u = u.withColumn("__b", F.date_trunc(bucket, F.col("__t").cast("timestamp")))
    part = [*keys, "__b"]
    first_at_tie = F.col("__ask") if equal == "prev" else -F.col("__ask")
    over_buckets, inside = Window.partitionBy(*keys), Window.partitionBy(*part)
    before = (Window.unboundedPreceding, -1)
    aggs, carry, found, out = [], {}, {}, []
    if prev:
        aggs.append(F.max_by("__vp", F.when(F.col("__vp").isNotNull(), F.col("__t"))).alias("__bp"))
        carry["__cp"] = F.last("__bp", True).over(over_buckets.orderBy("__b").rowsBetween(*before))
        found["__ip"] = F.last("__vp", True).over(inside.orderBy("__t", first_at_tie.asc()).rowsBetween(Window.unboundedPreceding, 0))
        out.append(F.coalesce("__ip", "__cp").alias("prev"))
    if next:
        aggs.append(F.min_by("__vn", F.when(F.col("__vn").isNotNull(), F.col("__t"))).alias("__bn"))
        carry["__cn"] = F.last("__bn", True).over(over_buckets.orderBy(F.col("__b").desc()).rowsBetween(*before))
        found["__in"] = F.last("__vn", True).over(inside.orderBy(F.col("__t").desc(), first_at_tie.desc()).rowsBetween(Window.unboundedPreceding, 0))
        out.append(F.coalesce("__in", "__cn").alias("next"))
    carried = u.groupBy(*part).agg(*aggs).withColumns(carry).select(*part, *carry)
    solved = u.withColumns(found).filter("__ask = 1").join(carried, part).select(*keys, F.col("__t").alias(left_time), *out)
    return left.join(solved, [*keys, left_time], "left").select(*left.columns, *(["prev"] if prev else []), *(["next"] if next else []))


def days_between(later, earlier):
    """Elapsed days with fraction."""
    return (F.unix_micros(F.col(later).cast("timestamp")) - F.unix_micros(F.col(earlier).cast("timestamp"))) / F.lit(86400e6)


def nearest(left: DataFrame, right: DataFrame, keys, left_time, right_time, values, tiebreak=(), bucket: str | None = "MONTH",
            out: str = "match") -> DataFrame:
    """Right row nearest in time; the later one of two equally near."""
    both = neighbours(left, right, keys, left_time, right_time, values, tiebreak, bucket)
    back = days_between(left_time, "prev.t")
    ahead = days_between("next.t", left_time)
    pick_next = F.col("prev").isNull() | (F.col("next").isNotNull() & (ahead <= back))
    return both.withColumn(out, F.when(pick_next, F.col("next")).otherwise(F.col("prev"))).drop("prev", "next")


def forward_labels(spine: DataFrame, events: DataFrame, keys, day: str, event_time: str, attrs: Sequence[str],
                   tiebreak: Sequence[str] = ()) -> DataFrame:
    """First event strictly after each day of a daily frame: adds struct ``next`` (day, attrs).

    Events are first reduced to the earliest of each (entity, day), so both sides are calendar-bounded.
    """
    struct = F.struct(F.col(day), *[F.col(a) for a in attrs])
    order = F.struct(F.col(event_time), *[F.col(c) for c in tiebreak])
    firsts = events.groupBy(*keys, day).agg(F.min_by(struct, order).alias("__ev"))
    rest = [c for c in spine.columns if c not in (*keys, day)]
    u = (spine.select(*keys, day, F.struct(F.lit(1).alias("__one"), *rest).alias("__row"),
                      F.lit(None).cast(firsts.schema["__ev"].dataType).alias("__ev"))
         .unionByName(firsts.withColumn("__row", F.lit(None)), allowMissingColumns=True)
         .groupBy(*keys, day).agg(F.first("__row", True).alias("__row"), F.first("__ev", True).alias("__ev")))
    later = Window.partitionBy(*keys).orderBy(F.col(day).desc()).rowsBetween(Window.unboundedPreceding, -1)
    u = u.withColumn("next", F.last("__ev", True).over(later)).filter(F.col("__row").isNotNull())
    return u.select(*keys, day, *[F.col(f"__row.{c}").alias(c) for c in rest], "next")
