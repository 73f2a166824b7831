"""Mixing sources to target weights by hash-random order and exact budgets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import row_numbers, word_count
from riskweave.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
ROWS_PER_BUCKET = 65_536


def source_key(source: str = "source"):
    """A key that is never null, in place of the source."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def mixing_key():
    """Hash-random order of the documents: the md5 of the id, a string of 32 hex digits."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(gkey, source_size, target) from (gkey, source, source_size).

    Sources in code-point order, null last, weigh *weights* in turn and share *share* times all sizes
    by weight. A source stops at *most* times its size; what is over is shared again by weight until
    none is above. Each round is one aggregation of the sources; only the level moves to the driver.
    """
    ranked, _ = row_numbers(sources.withColumn("_null", F.col("source").isNull().cast("int")), ["_null", "source"], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight.cast("long"))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, seen = None, -1
    while True:
        stopped = F.lit(False) if level is None else F.lit(level) * F.col("w") > most * F.col("source_size")
        held, free, n = ranked.agg(F.coalesce(F.sum(F.when(stopped, most * F.col("source_size"))), F.lit(0)),
                                   F.coalesce(F.sum(F.when(~stopped, F.col("w"))), F.lit(0)), F.count(F.when(stopped, 1))).first()
        if n == seen or free == 0:
            break
        level, seen = (total - held) / free, n
    share_of = F.lit(float(level or 0.0)) * F.col("w")
    return ranked.select("gkey", "source_size", F.least(share_of, (most * F.col("source_size")).cast("double")).alias("target"))


def mix(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """*docs* with size, source_size, target and taken, the words that the mix takes of the document.

    size: words of the whole text (null: 0). Within a source the documents stand in the order of a
    hash of their id. The source's budget, its target rounded to whole words, is met exactly: whole
    epochs first, then documents in that order until the budget is reached, the last one in part.
    Hash order is uniform, so equal ranges of the hash (buckets) cut a hot source into pieces of a
    known size; prefix sums run within a bucket, and bucket totals carry them across. No order over
    a whole source is ever formed. Rows of equal id, size and checksum are interchangeable. Without
    *carry* only ids, sources and sizes move; a null id sorts as the empty text. An empty table stays
    empty, and sources without a word take nothing.
    """
    keep = [c for c in (carry or ["doc_id", "source"]) if c not in ("size", "gkey", "mkey")]
    rows = docs.select(*keep, word_count(F.col("text")).alias("size"), source_key().alias("gkey"), mixing_key().alias("mkey"),
                       F.coalesce(F.crc32("text"), F.lit(-1)).alias("_crc"))
    rows = cut_lineage(rows)
    n = rows.count()
    digits = max(1, math.ceil(math.log(max(n / ROWS_PER_BUCKET, 1), 16)))
    rows = rows.withColumn("_bucket", F.substring("mkey", 1, digits))
    parts = cut_lineage(rows.groupBy("gkey", "_bucket").agg(F.sum("size").alias("_sum"), F.first("source").alias("source")))
    sources = parts.groupBy("gkey").agg(F.first("source").alias("source"), F.sum("_sum").alias("source_size"))
    aims = targets(cut_lineage(sources))
    before = Window.partitionBy("gkey").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("gkey", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")).join(aims, "gkey")
    inside = Window.partitionBy("gkey", "_bucket").orderBy("mkey", "size", "_crc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_running", F.sum("size").over(inside) - F.col("size")).join(offsets, ["gkey", "_bucket"])
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0)
    rest = budget - whole * F.col("source_size") - F.col("_offset") - F.col("_running")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return placed.withColumn("taken", taken.cast("long")).drop("gkey", "mkey", "_crc", "_bucket", "_offset", "_running")


def mix_documents(docs: DataFrame) -> DataFrame:
    """One digest row for each document of :func:`mix`."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of *docs*: a row for each time a document is taken.

    A document that the budget cuts keeps its first words, joined by single spaces, in its last row.
    Documents of which nothing is taken are left out; texts without a word have nothing to take.
    """
    columns = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c_{c}") for c in columns], "doc_id", "source", "text")
    rows = mix(plain, carry=[*plain.columns])
    epochs = F.explode(F.sequence(F.lit(0), F.expr("cast((taken - 1) div size as int)")))
    left = F.col("taken") - F.col("_epoch") * F.col("size")
    rows = rows.filter("taken > 0").withColumn("_epoch", epochs).withColumn("_left", left)
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]++)"))
    cut = F.when(F.col("_left") >= F.col("size"), F.col("text")).otherwise(
        F.array_join(F.slice(words, F.lit(1), F.col("_left").cast("int")), " "))
    return rows.select(*[(cut if c == "text" else F.col(f"`c_{c}`")).alias(c) for c in columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 1.5 * sum(source_size) OVER () AS t, 2.0 * source_size / w AS ratio FROM s),
p AS (
  SELECT *, (t - coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE) / sum(w) OVER after AS level,
         row_number() OVER (ORDER BY ratio, source NULLS LAST) AS pos FROM r
  WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lev AS (SELECT arg_min(level, pos) FILTER (WHERE level <= ratio) AS level FROM p),
g AS (
  SELECT source, source_size, least(coalesce(level, 0) * w, 2.0 * source_size)::DOUBLE AS target FROM s, lev),
x AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, round(g.target)::BIGINT AS budget,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS run
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(budget - (budget // source_size) * source_size - run, size)) END::BIGINT AS taken
FROM x"""
