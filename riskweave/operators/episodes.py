"""Declustering, case/control episodes and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.asof import neighbours
from riskweave.session import cut_lineage

#: Events that share a task where their wanted days are laid out.
EVENTS_PER_TASK = 2000


def decluster_first(events: DataFrame, keys: Sequence[str], day: str, order: Sequence[str], gap_days: int = 45) -> DataFrame:
    """Keep an event when it is more than *gap_days* after the last kept one.

    Only the first event of an (entity, day) can be kept, so the ordered fold sees at most one row
    per calendar day of an entity.
    """
    rest = [c for c in events.columns if c not in (*keys, day)]
    firsts = events.filter(F.col(day).isNotNull()).groupBy(*keys, day).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    def step(kept, e):
        return F.when(F.datediff(e["day"], F.element_at(kept, -1)["day"]) > gap_days, F.concat(kept, F.array(e))).otherwise(kept)
    entity = firsts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(day).alias("day"), "__first")), lambda x, y: F.datediff(x["day"], y["day"])).alias("__all"))
    kept = entity.select(*keys, F.explode(F.aggregate(F.slice("__all", 2, F.size("__all")), F.slice("__all", 1, 1), step)).alias("__e"))
    return kept.select(*keys, F.col("__e.day").alias(day), *[F.col(f"__e.__first.{c}").alias(c) for c in rest])


def window_openings(times: DataFrame, keys: Sequence[str], time: str, gap_days: int) -> DataFrame:
    """(keys, time) of the events that open a window: the first one, then each first event whose elapsed time since
    the last opening has more than *gap_days* whole days.

    Every time points to the one that would open the next window. The chain from the first time is
    followed by doubling: in each round all openings known so far jump at once, and pointers are composed with
    themselves. A chain of n windows takes log2(n) joins, and no entity is ever walked in one task.
    """
    k = list(keys)
    distinct = cut_lineage(times.select(*k, time).distinct())
    due = distinct.withColumn("__due", F.timestamp_add("DAY", F.lit(gap_days + 1), F.col(time)))
    ahead = neighbours(due, distinct, k, "__due", time, [], prev=False, equal="next")
    hops = cut_lineage(ahead.filter(F.col("next").isNotNull()).select(*k, time, F.col("next.t").alias("__to")))
    found = cut_lineage(distinct.groupBy(*k).agg(F.min(time).alias(time)))
    count = found.count()
    while True:
        more = found.join(hops, [*k, time]).select(*k, F.col("__to").alias(time))
        found = cut_lineage(found.unionByName(more).distinct())
        fresh = found.count()
        if fresh == count:
            return found
        count = fresh
        onward = hops.select(*k, F.col(time).alias("__to"), F.col("__to").alias("__next"))
        hops = cut_lineage(hops.join(onward, [*k, "__to"]).select(*k, time, F.col("__next").alias("__to")))


def decluster_largest(events: DataFrame, keys: Sequence[str], time: str, mag: str, order: Sequence[str],
                      gap_days: int = 30) -> DataFrame:
    """Largest event of every window; a window opens at its first event and lasts *gap_days* whole days of elapsed time.

    Of equal magnitudes the earliest wins, then the first by *order*. Each event finds the last opening
    up to it, and the largest is a partial aggregation.
    """
    k = list(keys)
    openings = window_openings(events, k, time, gap_days)
    placed = neighbours(events, openings, k, time, time, [], next=False)
    rest = [c for c in events.columns if c not in k]
    first = F.struct(-F.col(mag), F.col(time), *[F.col(o) for o in order])
    best = placed.groupBy(*k, F.col("prev.t").alias("__open")).agg(F.min_by(F.struct(*rest), first).alias("__best"))
    return best.select(*k, *[F.col(f"__best.{c}").alias(c) for c in rest]).select(*events.columns)


def order_fraction_split(events: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "block") -> DataFrame:
    """fit / cal / test by rank share 0.6 / 0.8 of the (declustered) events of an entity."""
    w = Window.partitionBy(*keys)
    share = F.row_number().over(w.orderBy(*order)) / F.count(F.lit(1)).over(w)
    return events.withColumn(out, F.when(share <= 0.60, "fit").when(share <= 0.80, "cal").otherwise("test"))


def event_count_epochs(daily_counts: DataFrame, keys: Sequence[str], day: str, n: str, size: int, origin) -> DataFrame:
    """Epochs of *size* consecutive events from daily counts: epoch, start (inclusive), end (exclusive).

    *origin* is a date or a column of *daily_counts* with the date of each entity.
    """
    origin = origin if isinstance(origin, Column) else F.lit(origin).cast("date")
    w = Window.partitionBy(*keys).orderBy(day)
    before = F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = daily_counts.withColumn("__o", origin).filter(F.col(day) >= F.col("__o")).withColumn("__c", before)
    epochs = ranked.withColumn("epoch", F.explode(F.sequence(
        F.floor(F.col("__c") / size), F.floor((F.col("__c") + F.col(n) - 1) / size))))
    ends = epochs.groupBy(*keys, "epoch").agg(F.date_add(F.max(day), 1).alias("end"), F.first("__o").alias("__o"))
    start = F.coalesce(F.lag("end").over(Window.partitionBy(*keys).orderBy("epoch")), F.col("__o"))
    return ends.withColumn("start", start).drop("__o")


def lead_time_rows(events: DataFrame, features: DataFrame, keys: Sequence[str], day: str, leads: Sequence[int],
                   values: Sequence[str]) -> DataFrame:
    """One row per event and lead with the last feature row at or before event day - lead."""
    anchors = (events.withColumn("lead_days", F.explode(F.array(*[F.lit(x) for x in leads])))
               .withColumn("anchor", F.date_sub(F.col(day), F.col("lead_days"))))
    hit = neighbours(anchors, features, keys, "anchor", day, values, next=False)
    return hit.filter(F.col("prev").isNotNull()).select(
        *anchors.columns, F.col("prev.t").alias("feature_day"), *[F.col(f"prev.{v}").alias(v) for v in values])


def control_days(features: DataFrame, events: DataFrame, keys: Sequence[str], day: str, event_id: str,
                 shuffle: Column, per_event: int = 3, years: int = 3, exclusion_days: int = 180, edge_rows: int = 180) -> DataFrame:
    """Matched control days: same entity, within *years*, at most one month of the year apart, more than
    *exclusion_days* from every event and away from the ends of the series.

    A day can serve one event only: it goes to the earliest event it matches, then every event takes its
    first *per_event* days in *shuffle* order (a deterministic hash of the row).
    """
    w = Window.partitionBy(*keys).orderBy(day)
    whole = Window.partitionBy(*keys)
    days = features.select(*keys, day).withColumns({
        "__i": F.row_number().over(w), "__n": F.count(F.lit(1)).over(whole)})
    days = days.filter((F.col("__i") > edge_rows) & (F.col("__i") <= F.col("__n") - 1)).select(*keys, day)
    near = neighbours(days, events, keys, day, day, [event_id], tiebreak=[event_id], bucket="YEAR")
    free = near.filter(
        (F.col("prev").isNull() | (F.datediff(F.col(day), F.col("prev.t")) > exclusion_days))
        & (F.col("next").isNull() | (F.datediff(F.col("next.t"), F.col(day)) > exclusion_days))).select(*keys, day)
    span = 365 * years
    wanted = (events.select(*keys, event_id, F.col(day).alias("event_day"))
              .withColumn(day, F.explode(F.sequence(F.date_sub("event_day", span), F.date_add("event_day", span)))))
    wanted = wanted.filter(_same_season(day)).join(free, [*keys, day])
    return _claimed(wanted, keys, day, event_id, shuffle, per_event)


def _same_season(day: str) -> Column:
    gap = F.abs(F.month(day) - F.month("event_day"))
    return F.least(gap, 12 - gap) <= 1


def _claimed(wanted: DataFrame, keys: Sequence[str], day: str, event_id: str, shuffle: Column, per_event: int) -> DataFrame:
    """Every day goes to the earliest event that wants it; events take their first days in *shuffle* order."""
    claimed = (wanted.groupBy(*keys, day)
               .agg(F.min(F.struct("event_day", event_id)).alias("__e"))
               .select(*keys, day, "__e.event_day", f"__e.{event_id}"))
    pick = Window.partitionBy(*keys, event_id).orderBy(shuffle, day)
    return claimed.withColumn("rank", F.row_number().over(pick)).filter(F.col("rank") <= per_event)


def control_days_of_spans(spans: DataFrame, events: DataFrame, keys: Sequence[str], day: str, event_id: str,
                          shuffle: Column, per_event: int = 3, years: int = 3, exclusion_days: int = 180, edge_rows: int = 180) -> DataFrame:
    """:func:`control_days` of dense daily series, given by their ends: *spans* has keys, first and last.

    No day of a series is laid out. What the events leave free are the stretches between them; an event meets those of its
    entity within *years*, and only days in both become rows. Stretches are longer than the exclusion, so they are few.
    An event wants some hundred days, so a task gets EVENTS_PER_TASK events, however small their rows are.
    """
    order = Window.partitionBy(*keys).orderBy(day)
    dates = events.filter(F.col(day).isNotNull()).select(*keys, day).distinct()
    after = F.struct(F.date_add(day, exclusion_days + 1).alias("lo"), F.date_sub(F.lead(day).over(order), exclusion_days + 1).alias("hi"))
    before = F.when(F.lag(day).over(order).isNull(), F.struct(F.lit(None).cast("date").alias("lo"), F.date_sub(day, exclusion_days + 1).alias("hi")))
    gaps = dates.withColumn("__gaps", F.array(after, before)).select(*keys, F.explode("__gaps").alias("g")).filter("g IS NOT NULL")
    free = gaps.join(spans, list(keys)).select(
        *keys, F.greatest("g.lo", F.date_add("first", edge_rows)).alias("__lo"), F.least("g.hi", F.date_sub("last", 1)).alias("__hi")).filter("__lo <= __hi")
    span = 365 * years
    wanted = events.select(*keys, event_id, F.col(day).alias("event_day")).join(free, list(keys)).withColumns({
        "__lo": F.greatest("__lo", F.date_sub("event_day", span)), "__hi": F.least("__hi", F.date_add("event_day", span))}).filter("__lo <= __hi")
    wanted = wanted.repartition(1 + events.count() // EVENTS_PER_TASK, *keys)
    wanted = wanted.withColumn(day, F.explode(F.sequence("__lo", "__hi"))).filter(_same_season(day))
    return _claimed(wanted, keys, day, event_id, shuffle, per_event)


def block_id(frame: DataFrame, keys: Sequence[str], day: str, days: int = 90, out: str = "block") -> DataFrame:
    """Entity plus the number of the *days*-long block since its first day."""
    first = F.min(day).over(Window.partitionBy(*keys))
    return frame.withColumn(out, F.concat_ws("_", *[F.col(k).cast("string") for k in keys],
                                             F.floor(F.datediff(F.col(day), first) / days).cast("string")))


def temporal_split(day: str, cutoff: str, horizon: int) -> Column:
    """train / purged / holdout; the purge keeps labels of the training rows before the cutoff."""
    cut = F.lit(cutoff).cast("date")
    return (F.when(F.col(day) < F.date_sub(cut, horizon), "train").when(F.col(day) < cut, "purged").otherwise("holdout"))
