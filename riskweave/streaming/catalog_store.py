"""A catalog kept in (day, zone) partitions that a stream of revisions upserts batch by batch.

Layout below one folder, everything by version (the number of the batch):

- ``data/version=V/day=D/zone=Z``: rows of the partitions that version V rewrote, and which of them it put there;
- ``ids/version=V/bucket=B``: where the ids are that version V put somewhere, or that they are gone;
- ``manifest/version=V``: one row for each rewritten partition, with the number of such rows.

A version counts only when its manifest is complete, which is written last; so readers see a batch whole or
not at all, and a replayed batch overwrites its own folders. A batch reads the partitions its rows can match,
writes them, and takes away those that came out the same, whatever the size of the catalog.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators.catalogs import MATCH_KM, MATCH_SECONDS, has_id, upsert_known, with_known
from riskweave.session import cut_lineage
from riskweave.streaming.feeds import drain

BUCKETS = 256
PART = ["day", "zone"]
MANIFEST = "day date, zone int, n long, parts long"
IDS = "id string, day date, zone int, alive boolean"


class CatalogStore:
    """*schema*: fields of a row, with id, time (timestamp_ntz), updated, latitude, longitude and mag.

    A partition covers *days* days, named by the first, and a square of *degrees*; choose them so that a
    partition holds some megabytes.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, degrees: float = 10.0, days: int = 1):
        self.spark, self.path, self.schema, self.degrees, self.days = spark, path, schema, degrees, days
        self.columns = [f.name for f in schema.fields]
        self.across = int(360 / degrees)

    def _band(self, lat: Column) -> Column:
        return F.floor((lat + 90) / self.degrees).cast("int")

    def _slice(self, lon: Column) -> Column:
        return F.floor((lon + 180) / self.degrees).cast("int")

    def _zone(self, band: Column, slice_: Column) -> Column:
        return band * self.across + F.pmod(slice_, F.lit(self.across))

    def _day(self, time: Column) -> Column:
        return F.date_from_unix_date((F.floor(F.unix_date(F.to_date(time)) / self.days) * self.days).cast("int"))

    def placed(self, rows: DataFrame) -> DataFrame:
        """*rows* with day and zone; rows without time or place share a partition of their own."""
        return rows.withColumns({
            "day": F.coalesce(self._day(F.col("time")), F.lit("0001-01-01").cast("date")),
            "zone": F.coalesce(self._zone(self._band(F.col("latitude")), self._slice(F.col("longitude"))), F.lit(-1))})

    def reach(self, rows: DataFrame) -> DataFrame:
        """Distinct (day, zone) in which a row of *rows* can find a match, its own among them."""
        lat, lon = F.col("latitude"), F.col("longitude")
        pad = F.lit(MATCH_KM / 111.0 * 1.02)
        wide = F.least(pad / F.greatest(F.cos(F.radians(F.least(F.abs(lat) + pad, F.lit(90.0)))), F.lit(1e-3)), F.lit(180.0))
        near = rows.select(
            F.explode(F.array_distinct(F.array(*[self._day(F.timestamp_add("SECOND", F.lit(s), F.col("time"))) for s in (-int(MATCH_SECONDS), 0, int(MATCH_SECONDS))]))).alias("day"),
            F.sequence(self._band(lat - pad), self._band(lat + pad)).alias("bands"), F.sequence(self._slice(lon - wide), self._slice(lon + wide)).alias("slices"))
        near = near.select("day", F.explode("bands").alias("band"), "slices").select("day", "band", F.explode("slices").alias("slice"))
        return near.select("day", self._zone(F.col("band"), F.col("slice")).alias("zone")).unionByName(self.placed(rows).select(*PART)).filter(
            "day IS NOT NULL AND zone IS NOT NULL").distinct()

    def entries(self, before: int | None = None) -> DataFrame:
        """(day, zone, version, n) of every partition as of the last complete version (below *before*)."""
        rows = self.spark.read.schema(MANIFEST + ", version int").parquet(f"{self.path}/manifest")
        if before is not None:
            rows = rows.filter(F.col("version") < before)
        whole = rows.groupBy("version").agg(F.count(F.lit(1)).alias("c"), F.max("parts").alias("p")).filter("c = p").select("version")
        return rows.join(whole, "version", "left_semi").groupBy(*PART).agg(
            F.max_by(F.struct("version", "n"), "version").alias("m")).select(*PART, "m.version", "m.n")

    def _rows(self, paths: Sequence[str] = ()) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField("__moved", T.BooleanType()), T.StructField("version", T.IntegerType()), T.StructField("day", T.DateType()), T.StructField("zone", T.IntegerType())])
        root = f"{self.path}/data"
        return self.spark.read.schema(full).option("basePath", root).parquet(*(paths or [root]))

    def read(self, before: int | None = None) -> DataFrame:
        """The catalog as of the last complete version."""
        live = self.entries(before).filter("n > 0").select(*PART, "version")
        return self._rows().join(live, [*PART, "version"], "left_semi").select(*self.columns)

    def _known_ids(self, rows: DataFrame, version: int) -> DataFrame:
        """(id, day, zone) of the ids of *rows* that the catalog has; only their buckets are read."""
        bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")
        wanted = rows.filter(has_id()).select("id").distinct()
        buckets = [r[0] for r in wanted.select(bucket.alias("b")).distinct().collect()]  # at most BUCKETS
        known = self.spark.read.schema(IDS + ", version int, bucket int").parquet(f"{self.path}/ids").filter(
            F.col("bucket").isin(buckets) & (F.col("version") < version))
        last = known.join(wanted, "id", "left_semi").groupBy("id").agg(F.max_by(F.struct(*PART, "alive"), "version").alias("l"))
        return last.filter("l.alive").select("id", "l.day", "l.zone")

    def _write_rows(self, rows: DataFrame, version: int) -> DataFrame:
        """The partitions of *rows* as data of *version*, read back from there."""
        self.placed(rows).hint("rebalance", *PART).write.mode("overwrite").partitionBy(*PART).parquet(f"{self.path}/data/version={version}")
        return self._written(version)

    def _written(self, version: int) -> DataFrame:
        return self._rows([f"{self.path}/data/version={version}"])

    def _publish(self, ids: DataFrame, parts: DataFrame, version: int) -> None:
        ids.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")).hint("rebalance", "bucket").write.mode("overwrite").partitionBy(
            "bucket").parquet(f"{self.path}/ids/version={version}")
        parts.write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def _remove(self, version: int, parts: Sequence) -> None:
        """Take away partitions that *version* wrote but does not publish."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for r in parts:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/version={version}/day={r['day']}/zone={r['zone']}")
            path.getFileSystem(conf).delete(path, True)

    def load(self, rows: DataFrame) -> None:
        """Version 0: a whole catalog."""
        held = self._write_rows(rows.select(*self.columns, F.lit(True).alias("__moved")), 0)
        parts = held.groupBy(*PART).agg(F.count(F.lit(1)).alias("n"))
        total = parts.agg(F.count(F.lit(1)).alias("parts"))
        self._publish(self._moved(held), parts.crossJoin(F.broadcast(total)), 0)

    @staticmethod
    def _moved(rows: DataFrame) -> DataFrame:
        return rows.filter(has_id() & F.col("__moved")).select("id", *PART, F.lit(True).alias("alive"))

    @staticmethod
    def _marks(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Order-free fingerprint of each partition."""
        h = F.xxhash64(*columns)
        return rows.groupBy(*PART).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s"))

    def merge(self, incoming: DataFrame, version: int) -> dict[str, int]:
        """Upsert a batch as *version*: every earlier version is its base. Returns how many partitions were read and written.

        Matches as :func:`catalog_upsert`: by id wherever the row is, then by nearness. Lists on the driver hold
        partitions that the batch touches, never rows.
        """
        inc = cut_lineage(incoming.select(*self.columns))
        inc = with_known(inc, self._known_ids(inc, version))
        wanted = self.reach(inc).unionByName(inc.filter("__known IS NOT NULL").select("__known.day", "__known.zone")).distinct()
        found = self.entries(version).filter("n > 0").join(wanted, PART, "left_semi").collect()
        paths = [f"{self.path}/data/version={r['version']}/day={r['day']}/zone={r['zone']}" for r in found]
        base = self._rows(paths).select(*self.columns, *PART) if paths else self.placed(self.spark.createDataFrame([], self.schema))
        result, taken = upsert_known(base.select(*self.columns), inc, self.columns)
        after = self._write_rows(result, version)
        old, new = self._marks(base, self.columns), self._marks(after, self.columns)
        both = old.select(*PART, F.struct("n", "x", "s").alias("old")).join(new.select(*PART, "n", F.struct("n", "x", "s").alias("new")), PART, "full")
        both = cut_lineage(both.select(*PART, F.coalesce("n", F.lit(0)).alias("n"), F.col("old").eqNullSafe(F.col("new")).alias("same")))
        changed = both.filter("NOT same").select(*PART, "n")
        count = changed.count()
        self._remove(version, both.filter("same").collect())
        ids = self._moved(self._written(version))  # what is left are the partitions that changed
        gone = taken.select("id", F.lit(None).cast("date").alias("day"), F.lit(None).cast("int").alias("zone"), F.lit(False).alias("alive"))
        self._publish(ids.unionByName(gone), changed.withColumn("parts", F.lit(count).cast("long")), version)
        return {"read": len(paths), "written": count}


def upsert_stream(rows: DataFrame, store: CatalogStore, checkpoint: str) -> list[dict[str, int]]:
    """Run a stream of revisions into *store*; batch b becomes version b + 1. Returns the partitions of each batch."""
    done = []

    def each(df: DataFrame, batch: int) -> None:
        fit = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in store.schema.fields])
        done.append(store.merge(fit, batch + 1))

    drain(rows, "", checkpoint, each=each)
    return done
