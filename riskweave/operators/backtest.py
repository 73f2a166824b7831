"""Walk-forward backtests: folds, a ladder of benchmark models, material improvement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators import calibration as cal
from riskweave.operators.evaluation import forecast_metrics
from riskweave.session import cut_lineage


def walk_forward(df: DataFrame, date: str, origins: Sequence[str], years_test: float = 4.0, inner_share: float = 0.55) -> DataFrame:
    """Rows labelled (fold, role): fit and val before the origin, test in the years after it.

    fit and val are split at the *inner_share* quantile of the training dates, which is taken from
    counts per date. A row appears once per fold it belongs to. The fold table has one row per origin
    given, so it is broadcast.
    """
    spark = df.sparkSession
    folds = spark.createDataFrame([(o,) for o in origins], "fold string").withColumn("origin", F.col("fold").cast("date"))
    counts = df.groupBy(date).agg(F.count(F.lit(1)).alias("__n"))
    per_fold = counts.crossJoin(F.broadcast(folds)).filter(F.col(date) < F.col("origin"))
    mids = per_fold.groupBy("fold").agg(F.percentile(F.unix_date(date), inner_share, F.col("__n")).alias("mid"))
    folds = folds.join(mids, "fold").withColumn("until", F.unix_date("origin") + 365.25 * years_test)
    d, o = F.unix_date(date), F.unix_date("origin")
    role = F.when(d < F.col("mid"), "fit").when(d < o, "val").when(d < F.col("until"), "test")
    return df.crossJoin(F.broadcast(folds)).withColumn("role", role).filter("role is not null").drop("origin", "mid", "until")


def ladder(train: DataFrame, test: DataFrame, y: str, rate: str, activity: str, score: str, min_1d: int = 300, min_2d: int = 300, min_3d: int = 250,
           n_rate: int = 5, n_score: int = 4) -> DataFrame:
    """Test metrics of the constant, rate, activity, activity x rate and activity x rate x score models.

    Every model is a binned table of fixed size fitted on the training rows; all of them score the test
    rows in one frame.
    """
    logs = {"__o": F.log1p(activity), "__r": F.log1p(rate)}
    train, test = train.withColumns(logs), test.withColumns(logs)
    base = train.agg(F.avg(y)).first()[0]
    axes = {"r1": (rate, 10, False), "o1": (activity, 10, False), "o2": ("__o", 8, True), "r2": (rate, 8, False), "o3": ("__o", 7, True),
            "r3": ("__r", n_rate, False), "s3": (score, n_score, False)}
    edges = cal.edge_sets(train, axes)
    def binned(df):
        return df.withColumns({b: cal.bin_of(c, edges[b]) for b, (c, _, _) in axes.items()})
    train, test = binned(train), binned(test)
    models = {"rate": ([("r1", 10)], min_1d), "activity": ([("o1", 10)], min_1d), "activity_rate": ([("o2", 7), ("r2", 8)], min_2d), "full": ([("o3", 6), ("r3", n_rate), ("s3", n_score)], min_3d)}
    out = test.withColumn("constant", F.lit(base))
    for name, (bins, need) in models.items():
        out = cal.apply_binned(out, cal.binned_rate(train, bins, y, need), [b for b, _ in bins], name)
    # scored once, read by the thresholds and by the metrics
    long = cut_lineage(out.withColumn("y", F.col(y).cast("double")).unpivot(["y"], ["constant", *models], "model", "p"))
    return forecast_metrics(long, ["model"], "p", "y", base)


def materiality(folds: DataFrame, order: str, base: str, candidate: str, minimum: float = 1e-4) -> DataFrame:
    """Deploy the candidate only when its mean and its latest Brier improvement reach the minimum."""
    d = folds.withColumn("delta", F.col(base) - F.col(candidate))
    g = d.agg(F.avg("delta").alias("mean_delta"), F.max_by("delta", order).alias("last_delta"))
    return g.withColumn("selected", (F.col("mean_delta") >= minimum) & (F.col("last_delta") >= minimum))
