"""Walk-forward runs: per fold, rules mined before the origin, the ladder of models fitted there, metrics behind it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.fuzzy import clip
from riskweave.operators import backtest as bt, mining
from riskweave.operators.scoring import Rule, bipolar
from riskweave.session import cut_lineage


@dataclass(frozen=True)
class Fold:
    origin: str
    mid: float  # days since 1970: fit before, val from here to the origin
    start: int
    end: float


def folds_of(df: DataFrame, date: str, origins: Sequence[str], years_test: float, inner_share: float = 0.55) -> list[Fold]:
    """One fold for each origin, from counts per date; an origin without earlier rows has none."""
    counts = df.groupBy(F.unix_date(date).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    given = df.sparkSession.createDataFrame([(o,) for o in origins], "origin string").withColumn("start", F.unix_date(F.col("origin").cast("date")))
    mids = counts.join(F.broadcast(given), F.col("d") < F.col("start")).groupBy("origin", "start").agg(F.percentile("d", inner_share, F.col("n")).alias("mid")).collect()
    return [Fold(r["origin"], r["mid"], r["start"], r["start"] + 365.25 * years_test) for r in sorted(mids, key=lambda r: r["start"])]


class PeriodCube:
    """Additive statistics of terms and pairs by period: the cuts of all folds end periods, so whatever a fold counts
    is a sum of periods. The rows are read once for all folds."""

    def __init__(self, df: DataFrame, date: str, channels: Sequence[str], y: str, folds: Sequence[Fold], sets: Mapping | None = None):
        self.folds, self.spark = folds, df.sparkSession
        self.cuts = sorted({c for f in folds for c in (f.mid, float(f.start))})
        period = reduce(lambda a, c: a + (F.unix_date(date) >= c).cast("int"), self.cuts, F.lit(0))
        last = max(f.start for f in folds)
        rows = df.filter(F.unix_date(date) < last).withColumn("period", period)
        self.base = cut_lineage(rows.groupBy("period").agg(F.sum(F.col(y).cast("double")).alias("s"), F.count(F.lit(1)).alias("n")))
        self.singles = cut_lineage(mining.support_sums(rows, channels, y, "period", sets))
        self.pairs = cut_lineage(mining.support_sums(rows, channels, y, "period", sets, pairs=True).withColumn("period", F.col("period").cast("int")))

    def _roles(self) -> DataFrame:
        """(fold, role, period): which periods make up the fit and the validation epoch of each fold."""
        rows = [(f.origin, "fit" if p < self.cuts.index(f.mid) + 1 else "val", p) for f in self.folds for p in range(self.cuts.index(float(f.start)) + 1)]
        return F.broadcast(self.spark.createDataFrame(rows, "fold string, role string, period int"))

    def lifts(self, pairs: bool = False) -> DataFrame:
        """Support and lift per fold, role and term (or pair)."""
        names = mining.PAIR if pairs else mining.SINGLE
        base = self.base.join(self._roles(), "period").groupBy("fold", "role").agg((F.sum("s") / F.sum("n")).alias("base"))
        sums = (self.pairs if pairs else self.singles).join(self._roles(), "period").groupBy("fold", "role", *names).agg(F.sum("support").alias("support"), F.sum("hits").alias("hits"))
        return sums.filter("support > 0").join(F.broadcast(base), ["fold", "role"]).withColumn("lift", F.col("hits") / F.col("support") / (F.col("base") + 1e-12))


def fold_rules(cube: PeriodCube, min_fit: float, min_val: float, retain: float = 0.5, min_gain: float = 1.15) -> tuple[DataFrame, DataFrame]:
    """(rules, single terms) of all folds: two-epoch retention inside the training data of each."""
    singles = cut_lineage(mining.two_epochs(cube.lifts(), ["fold", *mining.SINGLE], "role", min_fit, min_val, retain))
    pairs = mining.two_epochs(cube.lifts(pairs=True), ["fold", *mining.PAIR], "role", min_fit, min_val, retain)
    return mining.retained_rules(singles, pairs, min_gain, ["fold"]), singles


def run(df: DataFrame, date: str, y: str, rate: str, activity: str, channels: Sequence[str], origins: Sequence[str], years_test: float = 4.0, min_fit: float = 1000.0,
        min_val: float = 1000.0, min_test: int = 10_000, sets: Mapping | None = None, **ladder) -> tuple[DataFrame, DataFrame]:
    """(rules, metrics) of every fold: rules with their fold, and one row per fold and model of the ladder.

    The score of a fold is the difference of its rules' strongest support and opposition, weighed by its channels'
    mean retention. Folds with fewer than *min_test* test rows are left out. Rules of a fold are at most the pairs of
    terms, so they come to the driver to be compiled.
    """
    df = cut_lineage(df)
    folds = folds_of(df, date, origins, years_test)
    d = F.unix_date(date)
    sizes = df.agg(*[F.count(F.when((d >= f.start) & (d < f.end), 1)).alias(f"n{i}") for i, f in enumerate(folds)]).first() if folds else []
    folds = [f for f, n in zip(folds, sizes) if n >= min_test]
    if not folds:
        raise ValueError("no origin has enough rows behind it")
    rules, singles = fold_rules(PeriodCube(df, date, channels, y, folds, sets), min_fit, min_val)
    rules = cut_lineage(rules)
    influence = {(r["fold"], r["channel"]): r["m"] for r in singles.groupBy("fold", "channel").agg(clip(F.avg(clip("retention", 0.0, 1.0)), 0.2, 1.0).alias("m")).collect()}
    found = rules.collect()
    tables = []
    for f in folds:
        own = [Rule(((r["channel_a"], r["term_a"]),) + (((r["channel_b"], r["term_b"]),) if r["arity"] == 2 else ()), lift=r["lift_fit"]) for r in found if r["fold"] == f.origin]
        score = bipolar(own, {c: influence.get((f.origin, c), 0.3) for c in channels}, sets)["score"]
        # names of the caller do not meet those of the models
        scored = df.filter(d < f.end).select(F.col(date).alias("__date"), F.col(y).alias("__y"), F.col(rate).alias("__rate"), F.col(activity).alias("__activity"), score.alias("__score"))
        before = F.unix_date("__date") < f.start
        scores = bt.ladder(scored.filter(before), scored.filter(~before), "__y", "__rate", "__activity", "__score", **ladder)
        tables.append(cut_lineage(scores.withColumn("fold", F.lit(f.origin)).withColumn("n_rules", F.lit(len(own)))))
    return rules, reduce(DataFrame.unionByName, tables)


def fold_materiality(metrics: DataFrame, base: str = "activity_rate", candidate: str = "full", minimum: float = 1e-4) -> DataFrame:
    """Whether the candidate improves the Brier score enough on average and in the latest fold."""
    wide = metrics.groupBy("fold").agg(*[F.max(F.when(F.col("model") == m, F.col("brier"))).alias(m) for m in (base, candidate)])
    return bt.materiality(wide, "fold", base, candidate, minimum)
