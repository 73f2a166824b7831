"""Live cell features from a store of mergeable partial states: no trigger reads an event twice.

Events become partial states of (cell, slot of one hour): count, largest magnitude, last time and moments of
the activity kernel. A trigger adds the states of its own events, and its features are sums over the slots of
the last year and over the all-time totals of a cell. Both are written below the number of the batch, so a replay
overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import cells as ce
from riskweave.streaming.feeds import drain

SLOT = 3600  # seconds
PER_DAY = 86_400 // SLOT
#: Terms of the kernel's series about the middle of a slot. The lag plus 5 days is at least 240 times the
#: distance from the middle, so the first term left out is below 1e-14 of the sum.
MOMENTS = 6
YEAR_SLOTS = 366 * PER_DAY
SLOT_FIELDS = "la int, lo int, slot long, n long, mag_max double, t_max timestamp_ntz, " + ", ".join(f"m{k} double" for k in range(MOMENTS))
TOTAL_FIELDS = "la int, lo int, n long, mag_max double, t_max timestamp_ntz"


def _month(slot: Column) -> Column:
    day = F.date_from_unix_date(F.floor(slot / PER_DAY).cast("int"))
    return (F.year(day) * 12 + F.month(day) - 1).cast("int")


def partial_states(events: DataFrame, time: str = "time") -> DataFrame:
    """(la, lo, slot, n, mag_max, t_max, m0...) of *events*; rows without time or place have no cell.

    A partial aggregation: a cell with very many events sends one row per slot and task.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    e = ce.own_cells(events.filter(F.col(time).isNotNull())).filter("la IS NOT NULL AND lo IS NOT NULL")
    e = e.withColumn("slot", F.floor(micros / F.lit(SLOT * 1_000_000)))
    off = (micros - F.col("slot") * (SLOT * 1_000_000) - SLOT * 500_000) / F.lit(86_400e6)
    weight = F.pow(F.lit(10.0), 0.5 * (F.col("mag") - ce.KERNEL_MAG))
    return e.groupBy("la", "lo", "slot").agg(
        F.count(F.lit(1)).alias("n"), F.max("mag").alias("mag_max"), F.max(F.col(time).cast("timestamp_ntz")).alias("t_max"),
        *[F.sum(weight * F.pow(off, F.lit(float(k)))).alias(f"m{k}") for k in range(MOMENTS)])


def merged(states: DataFrame, *keys: str) -> DataFrame:
    """Partial states of equal keys as one."""
    sums = [c for c in states.columns if c == "n" or c.startswith("m") and c[1:].isdigit()]
    return states.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], F.max("mag_max").alias("mag_max"), F.max("t_max").alias("t_max"))


def kernel_sum(lag: Column) -> Column:
    """Activity of a slot whose middle lies *lag* days back, from its moments."""
    base, total, factor = lag + ce.KERNEL_C, F.lit(0.0), 1.0
    for k in range(MOMENTS):
        total = total + F.col(f"m{k}") * factor * F.pow(base, F.lit(-ce.KERNEL_P - k))
        factor *= (ce.KERNEL_P + k) / (k + 1)
    return total


class LiveCellStore:
    """Partial states below *path*, by batch; every *compact_every* batches those of the last year are merged."""

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 96):
        self.spark, self.path, self.every = spark, path, compact_every

    def _read(self, kind: str, fields: str, *batches: int) -> DataFrame:
        return self.spark.read.schema(fields).option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/batch={b}" for b in batches])

    def slots(self, batch: int, first_slot: int) -> DataFrame:
        """Slots from *first_slot* on that the store holds after *batch*: the last merged batch and those behind it."""
        known = self._read("slots", SLOT_FIELDS + ", month int", *range(batch - batch % self.every, batch + 1))
        first_month = self.spark.range(1).select(_month(F.lit(first_slot))).first()[0]
        return known.filter((F.col("month") >= first_month) & (F.col("slot") >= first_slot))

    def totals(self, batch: int) -> DataFrame:
        return self._read("totals", TOTAL_FIELDS, batch)

    def _last_slot(self, batch: int) -> int | None:
        return self.totals(batch).agg(F.floor(F.unix_seconds(F.max("t_max").cast("timestamp")) / SLOT)).first()[0]

    def add(self, events: DataFrame, batch: int) -> int | None:
        """Store the states of a batch; the first slot after the last event seen so far (none yet: None)."""
        states = partial_states(events)
        target = f"{self.path}/slots/batch={batch}"
        if batch and batch % self.every == 0:
            last = self._last_slot(batch - 1)
            old = self._read("slots", SLOT_FIELDS, *range(batch - self.every, batch)).filter(F.col("slot") >= (last or 0) - YEAR_SLOTS)
            fresh = self.spark.createDataFrame([], SLOT_FIELDS).unionByName(states)
            fresh.write.mode("overwrite").parquet(f"{self.path}/fresh/batch={batch}")
            fresh = self._read("fresh", SLOT_FIELDS, batch)
            states = merged(old.select(*fresh.columns).unionByName(fresh), "la", "lo", "slot")
        else:
            fresh = None
        states.withColumn("month", _month(F.col("slot"))).write.mode("overwrite").partitionBy("month").parquet(target)
        delta = self._read("slots", SLOT_FIELDS, batch) if fresh is None else fresh
        total = delta.select("la", "lo", "n", "mag_max", "t_max")
        if batch:
            total = total.unionByName(self.totals(batch - 1).select(*total.columns))
        merged(total, "la", "lo").write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")
        last = self._last_slot(batch)
        return None if last is None else last + 1

    def features(self, batch: int, at_slot: int, cells: DataFrame, origin: str) -> DataFrame:
        """Features of every cell of (la, lo, slip) at the start of *at_slot*: sums over slots, joined with the totals."""
        back = lambda w: F.col("slot") >= at_slot - int(w) * PER_DAY
        lag = (F.lit(at_slot) - F.col("slot") - 0.5) / PER_DAY
        recent = self.slots(batch, at_slot - int(ce.LOOKBACK) * PER_DAY).filter(F.col("slot") < at_slot)
        sums = recent.groupBy("la", "lo").agg(
            *[F.coalesce(F.sum(F.when(back(w), F.col("n"))), F.lit(0)).alias(f"n{w}") for w in ce.WINDOWS], F.sum(kernel_sum(lag)).alias("omori"))
        own = self.totals(batch).join(sums, ["la", "lo"], "left")
        own = own.withColumns({c: F.coalesce(c, F.lit(0)) for c in (f"n{w}" for w in ce.WINDOWS)} | {"omori": F.coalesce("omori", F.lit(0.0))})
        return ce.features_of_own(own, cells, F.timestamp_seconds(F.lit(at_slot * SLOT)).cast("timestamp_ntz"), origin)


def live_features(rows: DataFrame, store: str, out: str, checkpoint: str, cells: DataFrame, origin: str, compact_every: int = 96) -> None:
    """On every trigger: add the batch to the store and write the features of all cells at the batch time.

    The batch time is the end of the hour of the latest event seen, so late events change the features of the
    batch that brings them and of later ones. Nothing is written before the first event.
    """
    def each(df: DataFrame, batch: int) -> None:
        live = LiveCellStore(df.sparkSession, store, compact_every)
        at = live.add(df, batch)
        if at is not None:
            live.features(batch, at, cells, origin).withColumn("as_of", F.timestamp_seconds(F.lit(at * SLOT)).cast("timestamp_ntz")).write.mode(
                "overwrite").parquet(f"{out}/batch={batch}")

    drain(rows, out, checkpoint, each=each)
