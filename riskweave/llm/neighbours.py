"""Nearest neighbours by collision counting over single-projection sorted arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import cut_lineage

BLOCK = 16_384  # vectors that are indexed together
QUERY_BLOCK = 4_096
LEAST_PROJECTIONS = 64
COLLISIONS = 0.75  # share of the projections in whose window a vector must lie
START, LEADERS = 0.3, 32  # half width of the first windows in units of the mean spread; so many times k that collide most in them are verified
#: Windows stop when their half width is so many spreads of a vector as far as the k-th best found. A projection of
#: such a vector then lies in its window with probability 0.79, above the share of COLLISIONS, and one that is nearer more often.
SURE = 1.25


class CollisionIndex:
    """Sorted arrays of the projections of one block of vectors."""

    def __init__(self, vectors: np.ndarray, longest: float, seed: int = 42):
        self.vectors = vectors
        n, d = vectors.shape
        # a last coordinate lifts all vectors to the longest norm: nearest is then largest inner product
        lift = np.sqrt(np.maximum(longest ** 2 - (vectors ** 2).sum(axis=1), 0.0))
        rng = np.random.default_rng(seed)
        turns = -(-LEAST_PROJECTIONS // (d + 1))
        basis = np.hstack([np.linalg.qr(rng.standard_normal((d + 1, d + 1)))[0] for _ in range(turns)])
        self.basis, self.longest, self.unit = basis[:d], longest, longest / math.sqrt(d + 1)
        projected = (vectors @ self.basis + lift[:, None] * basis[d]).T
        # one sorted array for each projection, laid end to end a gap apart, so that one search serves all
        order = np.argsort(projected, axis=1, kind="stable")
        self.gap = np.arange(len(projected)) * 16.0 * longest
        self.ends = np.arange(len(projected) + 1) * n
        self.sorted = (np.take_along_axis(projected, order, axis=1) + self.gap[:, None]).ravel()
        self.order = order.ravel()

    def nearest(self, query: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the *k* nearest of the verified vectors, ties to the smaller id.

        No vector is hashed again. The vectors that collide most in narrow windows around the query's projections are
        verified first. A vector at distance D differs by D / sqrt(d + 1) in a projection on average, so the
        k-th best distance found says how far the windows must reach before no nearer one is likely to be
        outside; they grow to there at once, and what collides often enough is verified once. Counts follow from
        what is new in a window or from what is outside it, whichever is less.
        """
        m, n, order = len(self.gap), len(self.vectors), self.order
        k = min(k, n)
        length = float(np.linalg.norm(query))
        centre = query @ self.basis * (self.longest / length) + self.gap
        first, end = self.ends[:-1], self.ends[1:]
        counts, verified = np.zeros(n, np.int64), np.zeros(n, bool)
        at, score = np.empty(0, np.int64), np.empty(0)
        low = high = np.clip(self.sorted.searchsorted(centre), first, end)
        half, need = START * self.unit, COLLISIONS * m
        while True:
            reach = min(half, 4 * self.longest)
            lower = np.maximum(self.sorted.searchsorted(centre - reach), first)
            upper = np.minimum(self.sorted.searchsorted(centre + reach, "right"), end)
            added = int((upper - lower).sum() - (high - low).sum())
            within = added <= int((end - first - upper + lower).sum())
            parts = ((lower, low), (high, upper)) if within else ((first, lower), (upper, end))
            seen = np.bincount(np.concatenate([order[a:b] for x, y in parts for a, b in zip(x.tolist(), y.tolist())]), minlength=n)
            counts = counts + seen if within else m - seen
            found = counts >= need
            if np.count_nonzero(found) < k:
                # the least count that enough leaders have
                most_first = np.bincount(counts, minlength=m + 1)[::-1].cumsum()
                found = counts >= m - most_first.searchsorted(min(LEADERS * k, n))
            new = np.flatnonzero(found & ~verified)
            verified[new] = True
            at, score = np.append(at, new), np.append(score, self.vectors[new] @ query)
            last = float(np.partition(score, len(at) - k)[len(at) - k])
            distance = math.sqrt(max(0.0, 2 * self.longest ** 2 - 2 * self.longest / length * last))
            wanted = SURE * distance / self.longest * self.unit
            if reach >= wanted or reach < half:
                break
            low, high, half = lower, upper, wanted
        best = np.lexsort((ids[at], -score))[:k]
        return ids[at][best], score[best]


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): double vectors without null, zero and non-finite ones."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return vectors.filter("vec_id IS NOT NULL").select("vec_id", v.alias("v")).filter(fine & F.exists("v", lambda x: x != 0))


def nearest_neighbours(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the *k* nearest rows to each row whose id *every* divides.

    Equal vectors are one candidate with their k + 1 smallest ids, which is all that any list of k can
    show, and equal queries are searched once. Candidates stand in blocks that are indexed each on its
    own; queries meet every block, in blocks themselves, so that a task holds one block of either and
    returns k + 1 rows for a query. Vectors of another length are never compared. Null, zero and
    non-finite vectors and null ids take no part; a repeated row counts once; with no other row a query
    returns nothing.
    """
    rows = cut_lineage(valid(vectors).dropDuplicates())
    rows = rows.withColumn("key", F.sha2(F.to_json(F.struct("v")), 256))
    least = Window.partitionBy("key").orderBy("vec_id")
    copies = rows.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k + 1)
    distinct = cut_lineage(copies.select("key", "vec_id", "n", "v"))
    heads = distinct.filter("n = 1").select(F.col("vec_id").alias("head"), "key", "v", F.size("v").alias("d"))
    longest, count = heads.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), F.count("*")).first()
    if not count:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "key")
    searched = heads.join(asked.select("key").distinct(), "key", "left_semi")
    blocks, query_blocks = -(-count // BLOCK), -(-searched.count() // QUERY_BLOCK)
    left = heads.select(F.col("d"), F.pmod(F.xxhash64("head"), F.lit(blocks)).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(max(query_blocks, 1) - 1))).alias("qb"), "head", "v")
    right = searched.select("d", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"),
                            F.pmod(F.xxhash64("head", F.lit(1)), F.lit(max(query_blocks, 1))).cast("int").alias("qb"), "head", "v")

    def search(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "head": [], "score": []}
        if len(block) and len(queries):
            index, ids = CollisionIndex(np.vstack(block["v"].to_list()), longest), block["head"].to_numpy()
            for head, v in zip(queries["q_head"], queries["q_v"]):
                found, score = index.nearest(np.asarray(v), ids, k + 1)
                out["query"].append(np.full(len(found), head))
                out["head"].append(found)
                out["score"].append(score)
        return pd.DataFrame({c: np.concatenate(x) if x else [] for c, x in out.items()})

    by = ["d", "cb", "qb"]
    found = left.groupBy(*by).cogroup(right.toDF(*[f"q_{c}" for c in right.columns]).groupBy(*[f"q_{c}" for c in by])).applyInPandas(search, "query long, head long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "head")
    found = cut_lineage(found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r"))
    named = found.join(heads.select("head", "key"), "head").join(distinct.select("key", "vec_id"), "key").select("query", "vec_id", "score")
    lists = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("r", F.row_number().over(lists)).filter(F.col("r") <= k + 1)
    whose = heads.join(asked, "key").select(F.col("head").alias("query"), "query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = (named.join(whose, "query").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
