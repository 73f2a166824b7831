"""Catalog maintenance: schemas, revisions, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.geo import haversine_km
from riskweave.session import cut_lineage

#: Limits within which two rows are one event.
MATCH_SECONDS, MATCH_KM = 5.0, 15.0
#: Width of the slots and cells in which rows meet, in these limits: a row reaches 1 + 2 / width of them on each axis.
SLOT_LIMITS, CELL_LIMITS = 12, 6
MEET = ["__slot", "__band", "__cell"]
#: What a row is to its identity in an upsert, in the order in which one wins: held so far, taken away by a match, named so from now on.
HELD, GONE, TAKEN = 0, 1, 2


def normalize_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of *schema* in order; missing ones are null, unparsable values become null."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name).try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields])


def latest_per_key(df: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """Row with the greatest *order* per key, as a partial aggregation.

    Copies of one key are merged inside every task before the exchange, so a key that holds a large
    part of the rows does not end up in one window partition.
    """
    rest = [c for c in df.columns if c not in keys]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
            .select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns]))


def has_id(c: str = "id"):
    return F.col(c).isNotNull() & (F.col(c) != "")


def row_identity(columns: Sequence[str]):
    """Name of a row from its content: two independent 64-bit hashes, the same on every recomputation."""
    return F.concat(F.lit("row:"), F.hex(F.xxhash64(*columns)), F.hex(F.xxhash64(F.lit(7), *reversed(list(columns)))))


def identity_key(columns: Sequence[str], id_col: str = "id"):
    """The id, or the content of a row that has none (equal copies share it)."""
    return F.when(has_id(id_col), F.concat(F.lit("id:"), F.col(id_col))).otherwise(row_identity(columns))


def dedupe_by_id_then_space(df: DataFrame, order: Sequence[str], id_col: str = "id",
                            space=("time", "latitude", "longitude")) -> DataFrame:
    """Latest row per id (different rows without id are exempt), then the last per (time, lat, lon)."""
    keyed = df.withColumn("__key", identity_key(df.columns, id_col))
    named = latest_per_key(keyed, ["__key"], *order).drop("__key")
    return latest_per_key(named, list(space), F.col(id_col).isNull().cast("int"), *order)


def incremental_merge(old: DataFrame, new: DataFrame, id_col: str = "id",
                      space=("time", "latitude", "longitude"), tie: str | None = None) -> DataFrame:
    """Old and new rows, keeping the new one per id and then per (time, lat, lon)."""
    both = old.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)))
    order = ["__src"] + ([tie] if tie else [])
    return dedupe_by_id_then_space(both, order, id_col, space).drop("__src")


def meeting_sides(incoming: DataFrame, base: DataFrame, seconds: float, km: float, row: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of :func:`fuzzy_match` with __slot, __band and __cell; the batch stands in each that its limits reach."""
    height = km / 111.0 * 1.02  # degrees of latitude within the limit
    slot_width, band_width = SLOT_LIMITS * seconds * 1e6, CELL_LIMITS * height

    def micros(c):
        return F.unix_micros(F.col(c).cast("timestamp"))

    def slot(at):
        return F.floor(at / F.lit(slot_width))

    def band(lat):
        return F.floor(lat / F.lit(band_width))

    def reach(b):
        """Degrees of longitude that a distance within *km* can span between this band and what is as near to it."""
        edge = F.least(F.greatest(F.abs(b * band_width - height), F.abs((b + 1) * band_width + height)), F.lit(90.0))
        half = F.sin(F.lit(km / 6371.0 / 2)) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-9))
        return F.degrees(F.asin(F.least(half, F.lit(1.0)))) * 2 * 1.02

    def around(b):
        """Cells around the globe in this band, each CELL_LIMITS times the reach at least."""
        return F.greatest(F.floor(F.lit(360.0) / (reach(b) * CELL_LIMITS)), F.lit(1)).cast("long")

    def cell(lon, n):
        return F.floor((lon + 180.0) / 360.0 * n)

    place = ["time", "latitude", "longitude", "mag"]
    b = base.select(*[F.col(c).alias(f"__b_{c}") for c in place], F.col(row).alias("__brow")).filter(" AND ".join(f"__b_{c} IS NOT NULL" for c in place))
    b = b.withColumns({"__slot": slot(micros("__b_time")), "__band": band(F.col("__b_latitude"))})
    b = b.withColumn("__n", around(F.col("__band"))).withColumn("__cell", F.pmod(cell(F.col("__b_longitude"), F.col("__n")), F.col("__n"))).drop("__n")
    # one exchange serves the merge of copies and the join
    b = b.repartition(*MEET).groupBy(*MEET, *[f"__b_{c}" for c in place]).agg(F.min("__brow").alias("__brow"))
    inc = incoming.select(row, *place).filter(" AND ".join(f"{c} IS NOT NULL" for c in place))
    inc = inc.withColumn("__slot", F.explode(F.sequence(slot(micros("time") - F.lit(seconds * 1e6)), slot(micros("time") + F.lit(seconds * 1e6)))))
    inc = inc.withColumn("__band", F.explode(F.sequence(band(F.col("latitude") - height), band(F.col("latitude") + height))))
    inc = inc.withColumns({"__n": around(F.col("__band")), "__reach": F.least(reach(F.col("__band")), F.lit(180.0))})
    cells = F.sequence(cell(F.col("longitude") - F.col("__reach"), F.col("__n")), cell(F.col("longitude") + F.col("__reach"), F.col("__n")))
    inc = inc.withColumn("__cell", F.explode(F.array_distinct(F.transform(cells, lambda c: F.pmod(c, F.col("__n")))))).drop("__n", "__reach")
    return inc, b


def nearest_rows(incoming: DataFrame, base: DataFrame, seconds: float = MATCH_SECONDS, km: float = MATCH_KM, dmag: float = 0.5,
                 row: str = "row") -> DataFrame:
    """(*row*, match, match_km): nearest base row of each incoming row that has one within the time, distance and magnitude limits.

    Both sides meet on (time slot, latitude band, longitude cell), which are a few limits wide; exact copies in the base
    are merged where they meet. Of the batch only name, time, place and magnitude are sent to the one or two cells of each axis
    that the limits reach, and the base stays as it is; the best match is a ``min_by`` aggregation, so no list of
    candidates is ever built.
    """
    inc, b = meeting_sides(incoming, base, seconds, km, row)
    d = haversine_km("__b_latitude", "__b_longitude", "latitude", "longitude")
    dt = F.abs(F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(F.col("__b_time").cast("timestamp"))) / F.lit(1e6)
    hit = inc.join(b, MEET).withColumn("__d", d)
    hit = hit.filter((dt <= seconds) & (F.col("__d") <= km) & (F.abs(F.col("mag") - F.col("__b_mag")) <= dmag))
    best = hit.groupBy(row).agg(F.min_by(F.struct(F.col("__brow").alias("m"), F.col("__d").alias("d")),
                                         F.struct("__d", "__brow")).alias("__m"))
    return best.select(row, F.col("__m.m").alias("match"), F.col("__m.d").alias("match_km"))


def fuzzy_match(incoming: DataFrame, base: DataFrame, seconds: float = MATCH_SECONDS, km: float = MATCH_KM, dmag: float = 0.5,
                row: str = "row") -> DataFrame:
    """*incoming* with ``match`` (the base *row*) and ``match_km`` of :func:`nearest_rows`."""
    best = nearest_rows(incoming, base, seconds, km, dmag, row)
    return incoming.join(best, row, "left").select(*incoming.columns, "match", "match_km")


def catalog_upsert(base: DataFrame, incoming: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Merge revisions into a catalog.

    An incoming row replaces the base row of its id unless it is older (missing dates and ties favour
    the incoming row). Without that id in the base it replaces the nearest row of ``fuzzy_match``;
    otherwise it is inserted. Ids are unique in the result. Incoming rows that share a target are
    settled by the latest ``updated``.
    """
    cols = list(columns)
    # only ids that the batch asks for leave the base
    asked = incoming.filter(has_id()).select("id").distinct()
    known = base.select("id").join(asked, "id", "left_semi").distinct()
    return upsert_known(base, with_known(incoming.select(*cols), known.withColumn("held", F.lit(True))), cols)[0].select(*cols)


def with_known(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """*incoming*, written once, with the number of each row and what *known* has beside its id as __known."""
    named = known.select(F.col("id").alias("__id"), F.struct(*[c for c in known.columns if c != "id"]).alias("__known"))
    return cut_lineage(incoming.withColumn("row", F.monotonically_increasing_id()).join(named, F.col("id") == F.col("__id"), "left").drop("__id"))


def upsert_known(base: DataFrame, incoming: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """:func:`catalog_upsert` of rows of :func:`with_known`, and the ids that matches took away.

    ``__moved`` is false on rows that stay as the one row of the base with their identity.
    Whole rows of both sides move once, to the identity they have in the result: there the base row, the revision of its
    id, the mark that a match took it and the rows that bear this identity from now on are told apart by one aggregation.
    """
    cols = list(columns)
    far, old_time = (F.lit(t).cast("timestamp_ntz") for t in ("9999-12-31", "0001-01-01"))
    rest = [c for c in cols if c not in ("time", "updated")]

    def ranked(kind, src, missing):
        """Row of *kind* in the order in which one wins: kind, date (*missing* for none), source, time."""
        return F.struct(F.lit(kind).alias("__kind"), F.coalesce("updated", missing).alias("__u"), F.lit(src).alias("__src"), F.col("time"),
                        F.col("updated").isNull().alias("__undated"), *rest)

    b = base.select(*cols).withColumn("row", identity_key(cols))
    exact = incoming.filter(F.col("__known").isNotNull())
    fresh = incoming.filter(F.col("__known").isNull()).select(*cols, "row")
    best = cut_lineage(nearest_rows(fresh, b).select("row", "match"))
    gone = best.select("match").distinct()
    # a match always wins over its target, the latest of several
    taken = fresh.join(best, "row").groupBy("match").agg(F.max(ranked(TAKEN, 2, far)).alias("r")).select("r.*")
    taken = taken.withColumn("updated", F.when(~F.col("__undated"), F.col("__u")))
    none = F.lit(None)
    shape = b.select(F.col("row").alias("__key"), ranked(HELD, 0, old_time).alias("r"), none.alias("n"))
    kind = shape.schema["r"].dataType
    named = identity_key(cols).alias("__key")
    merged = (
        shape
        .unionByName(exact.select(named, ranked(HELD, 1, far).alias("r"), none.alias("n")))
        .unionByName(gone.select(
            F.col("match").alias("__key"), F.struct(F.lit(GONE).alias("__kind"), *[none.cast(f.dataType).alias(f.name) for f in kind.fields[1:]]).alias("r"), none.alias("n")))
        .unionByName(taken.select(named, ranked(TAKEN, 2, old_time).alias("r"), none.alias("n")))
        .unionByName(fresh.join(best, "row", "left_anti").select(named, none.cast(kind).alias("r"), ranked(TAKEN, 1, far).alias("n"))))
    both = merged.groupBy("__key").agg(F.max("r").alias("r"), F.max("n").alias("n"), F.count(F.when(F.col("r.__src") == 0, 1)).alias("held"))
    # ids are unique in the result: a match may bear the id of a row that is new
    new = F.col("r").isNull() | (F.col("r.__kind") < TAKEN) | (F.col("r.__u") < F.when(F.col("n.__undated"), old_time).otherwise(F.col("n.__u")))
    final = both.select(F.when(F.col("n").isNotNull() & new, F.col("n")).otherwise(F.col("r")).alias("r"), "held").select("r.*", "held").filter(F.col("__kind") != GONE)
    final = final.withColumns({"updated": F.when(~F.col("__undated"), F.col("__u")), "__moved": (F.col("__src") > 0) | (F.col("held") > 1)})
    return final.select(*cols, "__moved"), gone.filter(F.col("match").startswith("id:")).select(F.substr("match", F.lit(4)).alias("id"))


def new_ids(merged: DataFrame, before: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids present after a merge and absent before it."""
    named = merged.filter(has_id(id_col)).select(id_col).distinct()
    return named.join(before.filter(has_id(id_col)).select(id_col).distinct(), id_col, "left_anti")
