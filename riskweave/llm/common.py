"""Helpers shared by the operators: word patterns, row numbers, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import cut_lineage

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
LOCAL_BITS = 33  # of monotonically_increasing_id: row within its partition


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words of the whole text; none for a missing one."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text modulo *parts*; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def row_numbers(df: DataFrame, order: list[str], name: str = "row") -> tuple[DataFrame, int]:
    """*df* with dense numbers from 0 in the order of *order* (nulls first), and the number of rows.

    Rows are dealt out by ranges of the order and sorted within them. The result is written with the
    row's place in its range, so that ranges, totals and rows come from one run; only the totals of
    the ranges, a row for each partition, are added up in one place. Rows that are equal in *order*
    are interchangeable; a salt spreads them over several ranges.
    """
    salted = df.withColumn("_salt", F.monotonically_increasing_id() % 1024)
    keys = [*order, "_salt"]
    placed = cut_lineage(salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
                         .withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_at", LOCAL_BITS))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.col("_at").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    numbered = placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + local)
    return numbered.drop("_range", "_at", "_start"), total


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of *edges* (a, b): root is the smallest node that can be reached.

    Large-star and small-star rounds: each node hangs its neighbours on the smallest one it knows,
    until every edge leads to a root. All steps are aggregations and joins; a node with very many
    edges is aggregated in part before it moves, and no list of neighbours is ever built. Each round
    is written to the shared folder.
    """
    def both(e):
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def state(e):
        e = cut_lineage(e.filter("a <> b").distinct())
        return e, e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()

    current, mark = state(edges)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        # large star: larger neighbours of a go to the least of a and its neighbours
        links = both(current)
        least = links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = links.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        # small star: a and its smaller neighbours go to the least neighbour; edges run from small to large
        up = large.filter("a <> b").distinct()
        low = up.groupBy("b").agg(F.min("a").alias("m"))
        small = up.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("c"), "b")
        small = small.select("a", F.explode(F.array("b", "c")).alias("b"))
        current, fresh = state(small)
        if fresh == mark:
            break
        mark = fresh
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    pairs = current.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return pairs.union(current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
