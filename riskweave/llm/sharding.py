"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import row_numbers

PRIME = 2_147_483_647
ROUNDS = 8


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Three constants below the prime for each round."""
    draw = random.Random(seed)
    return [tuple(draw.randrange(1, PRIME) for _ in range(3)) for _ in range(ROUNDS)]


def sides(rows: int) -> tuple[int, int]:
    """The least near-square grid a x b that holds *rows* numbers."""
    a = max(1, math.isqrt(max(rows, 1) - 1) + 1)
    return a, max(1, -(-rows // a))


def _mix(v: Column, key: Column) -> Column:
    """A number below the prime; no product leaves 63 bits."""
    y = (v % PRIME * key["p"] + key["q"]) % PRIME
    return (y * y + key["s"]) % PRIME


def feistel(x: Column, rows: int, seed: int) -> Column:
    """The image of *x* (0 to a * b - 1) under a permutation of that grid.

    The halves are the column and row of the grid; each round adds a mix of one to the other modulo
    its side, which can be undone, so that the whole is a permutation.
    """
    a, b = sides(rows)
    keys = F.array(*[F.struct(F.lit(p).cast("long").alias("p"), F.lit(q).cast("long").alias("q"), F.lit(s).cast("long").alias("s"),
                              F.lit(i % 2 == 1).alias("odd")) for i, (p, q, s) in enumerate(round_keys(seed))])
    start = F.struct((x % a).alias("l"), ((x - x % a) / a).cast("long").alias("r"))

    def one_round(h, key):
        return F.struct(F.when(key["odd"], h["l"]).otherwise((h["l"] + _mix(h["r"], key)) % a).alias("l"),
                        F.when(key["odd"], (h["r"] + _mix(h["l"], key)) % b).otherwise(h["r"]).alias("r"))

    return F.aggregate(keys, start, one_round, lambda h: h["l"] + h["r"] * a)


def walk_steps(spark, rows: int, seed: int) -> int:
    """Steps until every number below *rows* is below *rows* again.

    A walk leaves the range only through the a * b - rows numbers beyond it, fewer than the square
    root of *rows*; how long those stay outside bounds every walk.
    """
    a, b = sides(rows)
    outside, steps = spark.range(rows, a * b).toDF("x"), 1
    while not outside.isEmpty():
        outside = outside.select(feistel(F.col("x"), rows, seed).alias("x")).filter(F.col("x") >= rows)
        steps += 1
    return steps


def permute(x: Column, rows: int, steps: int, seed: int) -> Column:
    """Row number 0 to *rows* - 1 permuted among themselves by cycle walking."""
    walk = F.sequence(F.lit(1), F.lit(max(steps, 1)))
    return F.aggregate(walk, x, lambda at, i: F.when((i > 1) & (at < rows), at).otherwise(feistel(at, rows, seed)))


def assign_shards(df: DataFrame, order: list[str], shards: int, seed: int = 42) -> DataFrame:
    """*df* with shard (0 to *shards* - 1) and slot (gapless from 0 within the shard).

    The rows are numbered in the order of *order*, the numbers permuted, and number p goes to shard
    p mod shards, slot p div shards: shard counts are at most one apart, and anyone who knows the
    number of rows and the seed can compute a row's place, or the row of a place, without the table.
    The same rows give the same places whatever their files and partitions. Rows that are equal in
    *order* (nulls are equal and come first) are interchangeable. An empty table stays empty.
    """
    numbered, rows = row_numbers(df, order, "_p")
    steps = walk_steps(df.sparkSession, rows, seed) if rows else 1
    placed = numbered.withColumn("_p", permute(F.col("_p"), rows, steps, seed))
    return placed.withColumns({"shard": (F.col("_p") % shards).cast("int"), "slot": F.expr(f"_p div {shards}")}).drop("_p")


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 42) -> DataFrame:
    """One row for each document, see :func:`assign_shards`; law ``rows``, so grown_shard is null.

    size is the UTF-8 length of the whole text (null: 0) plus 16, text_crc32 its checksum (null: null).
    Only ids, sizes and checksums move; other columns of *docs* are left behind.
    """
    narrow = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
                         F.crc32("text").alias("text_crc32"))
    placed = assign_shards(narrow, ["doc_id", "text_crc32", "size"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


CRC_TABLE_SQL = """
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))"""


def oracle(shards: int = 40, seed: int = 42) -> str:
    """The same placement in DuckDB: crc32 byte by byte, walks as a recursive query."""
    step = "SELECT row, step, x % a AS l, x // a AS r, a, b, n FROM walk WHERE step = 0 OR x >= n"
    for i, (p, q, s) in enumerate(round_keys(seed)):
        target, source, side = ("r", "l", "b") if i % 2 else ("l", "r", "a")
        y = f"(({source} % {PRIME}) * {p} + {q}) % {PRIME}"
        step = f"SELECT * REPLACE (({target} + ((({y}) * ({y}) + {s}) % {PRIME})) % {side} AS {target}) FROM ({step})"
    return f"""
WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE_SQL}),
d AS MATERIALIZED (
  SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE strlen(text) END + 16 AS size,
         CASE WHEN text IS NOT NULL THEN xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(range(strlen(text)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
           lambda c, k: xor(c // 256, t[xor(c % 256, k) + 1]))) END AS text_crc32
  FROM (SELECT doc_id, text, hex(encode(text)) AS h FROM documents), crc),
numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) - 1 AS row, count(*) OVER () AS n FROM d),
grid AS (SELECT *, greatest(1, (n + a - 1) // a) AS b FROM (SELECT *, ceil(sqrt(n))::BIGINT AS a FROM numbered)),
walk AS (
  SELECT row, 0 AS step, row AS x, a, b, n FROM grid
  UNION ALL
  SELECT row, step + 1, l + r * a, a, b, n FROM ({step})),
done AS (SELECT row, x FROM walk WHERE step > 0 AND x < n)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law,
       (x % {shards})::INT AS shard, (x // {shards})::BIGINT AS slot, NULL::INT AS grown_shard
FROM numbered JOIN done USING (row)"""
