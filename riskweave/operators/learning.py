"""Feature ranking and model fits on Spark ML."""

from __future__ import annotations

import math
import zlib
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.fuzzy import centroid
from riskweave.functions.probability import logistic_score
from riskweave.operators.calibration import bin_of, edge_sets
from riskweave.operators.evaluation import rank_scores
from riskweave.operators.quantiles import bucket_of
from riskweave.session import cut_lineage

#: Quantiles of the rows from which the edges of the bins of a forest are picked.
FINE = 256


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 8) -> DataFrame:
    """Mutual information of each feature (equal-count bins) with a binary label, in nats."""
    edges = edge_sets(df, {c: (c, bins, False) for c in features})
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), bin_of(c, edges[c]).alias("b")) for c in features])
    counts = df.select(F.explode(cells).alias("c"), F.col(label).alias("y")).groupBy("c.feature", "c.b", "y").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("feature"))
    q = F.col("n") / total
    counts = counts.withColumns({"q": q, "qb": F.sum("n").over(Window.partitionBy("feature", "b")) / total,
                                 "qy": F.sum("n").over(Window.partitionBy("feature", "y")) / total})
    return counts.groupBy("feature").agg(F.sum(F.col("q") * F.log(F.col("q") / (F.col("qb") * F.col("qy")))).alias("mi"))


# ---------------------------------------------------------------- batch fits of output terms

def term_statistics(df: DataFrame, strengths: Mapping[str, str], y: str, floor: float = 0.0) -> dict:
    """Sufficient statistics of the term fits in one aggregation.

    The prediction sum(c_t s_t) / sum(s_t) is linear in the centres, so the per-term errors of every
    iteration follow from sum(s_t), sum(y s_t) and sum(s_t s_u / sum(s)): iterating needs no further
    pass over the data. Rows without target or without firing terms are left out.
    """
    names = list(strengths)
    s = {t: F.col(c) for t, c in strengths.items()}
    total = sum(s.values(), F.lit(0.0))
    rows = df.withColumn("__tot", total).filter(F.col(y).isNotNull() & (F.col("__tot") > floor))
    aggs = [F.coalesce(F.sum(s[t]), F.lit(0.0)).alias(f"s|{t}") for t in names] + [F.coalesce(F.sum(F.col(y) * s[t]), F.lit(0.0)).alias(f"y|{t}") for t in names]
    aggs += [F.coalesce(F.sum(s[t] * s[u] / F.col("__tot")), F.lit(0.0)).alias(f"m|{t}|{u}") for i, t in enumerate(names) for u in names[i:]]
    r = rows.agg(*aggs).first().asDict()
    cross = {}
    for i, t in enumerate(names):
        for u in names[i:]:
            cross[t, u] = cross[u, t] = r[f"m|{t}|{u}"]
    return {"terms": names, "s": {t: r[f"s|{t}"] for t in names}, "ys": {t: r[f"y|{t}"] for t in names}, "cross": cross}


def _step(stats: dict, centres: Mapping[str, float], lr: float, min_support: float) -> dict[str, float]:
    """Move of each term: learning rate times the strength-weighted mean error."""
    moves = {}
    for t in stats["terms"]:
        if stats["s"][t] >= min_support:
            predicted = sum(centres[u] * stats["cross"][t, u] for u in stats["terms"])
            moves[t] = lr * (stats["ys"][t] - predicted) / stats["s"][t]
    return moves


def fit_output_terms(df: DataFrame, strengths: Mapping[str, str], y: str, sets: Mapping[str, Sequence[float]], lr: float = 0.3, iterations: int = 12) -> dict[str, list[float]]:
    """Shift whole terms (all knots) by their weighted error; the geometry is kept."""
    stats = term_statistics(df, strengths, y)
    shift = {t: 0.0 for t in strengths}
    first = {t: centroid(sets[t]) for t in strengths}
    for _ in range(iterations):
        for t, d in _step(stats, {t: first[t] + shift[t] for t in strengths}, lr, 1.0).items():
            shift[t] += d
    return {t: [k + shift[t] for k in sets[t]] for t in strengths}


def fit_ordered_centres(df: DataFrame, strengths: Sequence[str], y: str, base: float, lr: float = 0.25, iterations: int = 25) -> list[float]:
    """Ordered output centres: log-spaced start around the base rate, weighted error steps, limits, running maximum."""
    n = len(strengths)
    low, high = math.log(base / 5 + 1e-9), math.log(min(base * 8, 0.9))
    centres = [min(max(math.exp(low + (high - low) * i / (n - 1)), 1e-4), 0.95) for i in range(n)]
    names = {str(i): c for i, c in enumerate(strengths)}
    stats = term_statistics(df, names, y, floor=1e-6)
    for _ in range(iterations):
        moves = _step(stats, {str(i): c for i, c in enumerate(centres)}, lr, 100.0)
        centres = [min(max(c + moves.get(str(i), 0.0), 1e-4), 0.97) for i, c in enumerate(centres)]
        for i in range(1, n):
            centres[i] = max(centres[i], centres[i - 1])
    return centres


# ---------------------------------------------------------------- Spark ML fits

def assemble(df: DataFrame, features: Sequence[str], out: str = "features", scale: bool = False) -> tuple[DataFrame, list]:
    """Vector column of the features (optionally standardised); returns the fitted stages too."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    raw = "__raw" if scale else out
    va = VectorAssembler(inputCols=list(features), outputCol=raw, handleInvalid="skip")
    df = va.transform(df)
    if not scale:
        return df, [va]
    model = StandardScaler(inputCol=raw, outputCol=out, withMean=True, withStd=True).fit(df)
    return model.transform(df), [va, model]


def class_balance(df: DataFrame, y: str, out: str = "__w") -> DataFrame:
    """Weights n / (2 n_class)."""
    n = df.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("p")).first()
    pos, neg = n["n"] / (2.0 * max(n["p"] or 0, 1)), n["n"] / (2.0 * max(n["n"] - (n["p"] or 0), 1))
    return df.withColumn(out, F.when(F.col(y) == 1, pos).otherwise(neg))


def fit_logistic(df: DataFrame, features: Sequence[str], y: str, weight: str | None = None, reg: float = 0.0, l1: float = 0.0, max_iter: int = 100):
    """Logistic regression on standardised features. Returns (intercept, coefficients on the raw features)."""
    from pyspark.ml.classification import LogisticRegression

    data, _ = assemble(df.withColumn("__y", F.col(y).cast("double")), features)
    lr = LogisticRegression(featuresCol="features", labelCol="__y", regParam=reg, elasticNetParam=l1, maxIter=max_iter, standardization=True, tol=1e-9)
    m = (lr.setWeightCol(weight) if weight else lr).fit(data)
    return m.intercept, list(m.coefficients)


def fit_bounded_logistic(df: DataFrame, features: Sequence[str], y: str, weight: str | None = None, low: float = 0.0, high: float = 6.0,
                         intercept=(-8.0, 2.0), reg: float = 0.02, max_iter: int = 100):
    """Weighted logistic regression with box limits on coefficients and intercept and a ridge penalty."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Matrices, Vectors

    n = len(features)
    data, _ = assemble(df.withColumn("__y", F.col(y).cast("double")), features)
    lr = LogisticRegression(featuresCol="features", labelCol="__y", regParam=2 * reg, standardization=False, maxIter=max_iter, family="binomial",
                            lowerBoundsOnCoefficients=Matrices.dense(1, n, [low] * n), upperBoundsOnCoefficients=Matrices.dense(1, n, [high] * n),
                            lowerBoundsOnIntercepts=Vectors.dense(intercept[0]), upperBoundsOnIntercepts=Vectors.dense(intercept[1]))
    m = (lr.setWeightCol(weight) if weight else lr).fit(data)
    return m.intercept, list(m.coefficients)


def predict(df: DataFrame, features: Sequence[str], fitted, out: str = "p") -> DataFrame:
    """Probability of a fitted logistic as a column expression."""
    return df.withColumn(out, logistic_score(features, fitted[1], fitted[0], limit=25.0))


def split_cuts(df: DataFrame, features: Sequence[str], weight: str | None, bins: int) -> dict[str, list[float]]:
    """Inner edges of *bins* bins of about equal weight for each feature, picked from FINE quantiles of its rows."""
    shares = [i / FINE for i in range(1, FINE)]
    fine = df.agg(*[F.percentile_approx(c, shares, 10 * FINE).alias(c) for c in features]).first()
    points = {c: sorted({float(v) for v in fine[c] or []}) for c in features}
    each = F.array(*[F.struct(F.lit(c).alias("feature"), bucket_of(c, points[c]).alias("b")) for c in features])
    held = df.select(F.inline(each), (F.col(weight) if weight else F.lit(1.0)).alias("w")).groupBy("feature", "b").agg(F.sum("w").alias("w"))
    cuts = {c: [] for c in features}
    rows = sorted(held.collect())  # at most FINE for each feature
    for c in features:
        total, below, step = sum(r["w"] for r in rows if r["feature"] == c), 0.0, 1
        for r in (r for r in rows if r["feature"] == c and r["b"] < len(points[c])):
            below += r["w"]
            if below >= total * step / bins:
                cuts[c].append(points[c][r["b"]])
                step = math.floor(below / total * bins) + 1
    return cuts


def bin_cells(df: DataFrame, features: Sequence[str], y: str, weight: str | None, bins: int = 32) -> DataFrame:
    """(features as bin numbers, __y, __v, __n): the rows without missing features that no split can tell apart, with their number."""
    known = df.filter(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in features))
    cuts = split_cuts(known, features, weight, bins)
    key = [*features, "__y", "__v"]
    cells = known.select(*[bin_of(c, cuts[c]).cast("double").alias(c) for c in features], F.col(y).cast("double").alias("__y"),
                         (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("__v"))
    return cells.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).sortWithinPartitions(*key)


def bootstrap(cells: DataFrame, seed: int, weight: str = "__v", rows: str = "__n", out: str = "__w") -> DataFrame:
    """*cells* that a draw of their rows with replacement takes, with the weight of what is taken: a cell of n rows is drawn Poisson(n) times."""
    @F.pandas_udf("long")
    def drawn(n: pd.Series, cell: pd.Series) -> pd.Series:
        return pd.Series(np.random.default_rng([seed, zlib.crc32(cell.to_numpy().tobytes())]).poisson(n))

    taken = cells.withColumn("__t", drawn(F.col(rows), F.xxhash64(*cells.columns)))
    return taken.withColumn(out, F.col("__t") * F.col(weight)).filter(F.col(out) > 0).drop("__t")


def forest_importance(df: DataFrame, features: Sequence[str], y: str, trees: int = 300, depth: int = 6, weight: str | None = None, seed: int = 0) -> list[tuple[str, float]]:
    """Impurity importance of each feature in a random forest: the mean of its trees' normalised importances.

    Splits see rows only by bins, as in Spark's forest, so rows are first merged into cells of equal bins, label and
    weight. Each tree is fitted on its own bootstrap of the rows behind the cells; its cost is bounded by the number
    of cells, however many rows there are. Trees are fitted next to each other, as many as there are cores.
    """
    from pyspark.ml.classification import RandomForestClassifier

    cells = cut_lineage(bin_cells(df, features, y, weight))
    spark = df.sparkSession

    def tree(i):
        data, _ = assemble(bootstrap(cells, seed + i), features)
        data = data.select("features", "__y", "__w").persist()
        try:
            one = RandomForestClassifier(featuresCol="features", labelCol="__y", weightCol="__w", numTrees=1, bootstrap=False,
                                         featureSubsetStrategy="sqrt", maxDepth=depth, seed=seed + i)
            return one.fit(data).featureImportances.toArray()
        finally:
            data.unpersist()

    with ThreadPool(min(trees, spark.sparkContext.defaultParallelism)) as pool:
        total = sum(pool.map(inheritable_thread_target(spark)(tree), range(trees)))
    return [(f, float(v)) for f, v in zip(features, total / (total.sum() or 1.0))]


def rank_sum(df: DataFrame, columns: Sequence[str], out: str = "rank_score") -> DataFrame:
    """Sum of average ranks over several scores of a short feature table."""
    total = F.lit(0.0)
    for c in columns:
        w = Window.partitionBy(F.lit(0)).orderBy(c)
        same = Window.partitionBy(F.lit(0), F.col(c))
        total = total + F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2.0
    return df.withColumn(out, total)


def auc(df: DataFrame, p: str, y: str, weight: str | None = None) -> float | None:
    return rank_scores(df, [], p, y, weight).first()["auc"]


def forward_subset(train: DataFrame, test: DataFrame, ordered: Sequence[str], base: Sequence[str], y: str) -> list[tuple[int, float | None]]:
    """Holdout AUC with the base features plus the first k ranked ones."""
    train = class_balance(train, y)
    out = []
    for k in range(len(ordered) + 1):
        used = [*base, *ordered[:k]]
        out.append((k, auc(predict(test, used, fit_logistic(train, used, y, "__w")), "p", y)))
    return out


def leave_group_out(df: DataFrame, group: str, features: Sequence[str], y: str, weight: str | None = None) -> DataFrame:
    """AUC of every group under a model fitted on the other groups (groups are configured regions)."""
    groups = [r[0] for r in df.select(group).distinct().orderBy(group).collect()]
    scored = None
    for g in groups:
        fitted = fit_bounded_logistic(df.filter(F.col(group) != g), features, y, weight)
        part = predict(df.filter(F.col(group) == g), features, fitted)
        scored = part if scored is None else scored.unionByName(part)
    # scored once: the ranks read the scores several times
    return rank_scores(cut_lineage(scored.select(group, y, "p", *([weight] if weight else []))), [group], "p", y, weight)


def profile_clusters(df: DataFrame, vector: str, k: int, seed: int = 0) -> DataFrame:
    """Hierarchical (bisecting) clusters of standardised profile vectors."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import StandardScaler

    scaled = StandardScaler(inputCol=vector, outputCol="__z", withMean=True, withStd=True).fit(df).transform(df)
    m = BisectingKMeans(featuresCol="__z", predictionCol="cluster", k=k, seed=seed).fit(scaled)
    return m.transform(scaled).drop("__z")
