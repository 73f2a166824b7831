"""Causal kernel sums at exact times, for a table of kernels at once, without a pair of events.

The sum of w / (lag + c)^q over all events before a time is split by dyadic buckets. On every level a time meets
only buckets that lie at least two buckets back while their parents do not; their events enter as moments about
the bucket's middle, a power series whose ratio is at most a fifth. The finest buckets are a third of
the smallest *c* wide, so the series holds even within them: there the moments are running totals in order of
time. So the work is a few rows for each time and level, however dense the events are, and a hot entity is
spread over its buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Terms of the series; the first one left out is below 0.2 ** 14, about 2e-10 of the sum.
TERMS = 14
NEAR = 2
#: Events of so many levels of buckets are kept together when they are merged, so that what stands for them on the levels above is one row.
TOGETHER = 6
#: Rows of a task in which moments are made. A row becomes some hundred times as wide there, so sizes before say nothing.
TASK_ROWS = 50_000


def days_since(time: Column, start: Column) -> Column:
    """Exact days between two timestamps."""
    return (F.unix_micros(time.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86400e6)


def _powers(x: Column) -> list[Column]:
    out = [F.lit(1.0), x]
    for _ in range(2, TERMS):
        out.append(out[-1] * x)
    return out


def _series(lag: Column, width: Column, log: bool) -> Column:
    """Sum over a bucket whose middle lies *lag* (c included) back, from its moments in units of *width*."""
    ratio = width / lag
    total = F.lit(0.0)
    if log:
        for k in range(TERMS - 1, 0, -1):
            total = (total - F.col(f"m{k}") / k) * ratio
        return total + F.col("m0") * F.log(lag)
    q = F.col("q")
    coefs = [F.lit(1.0)]
    for k in range(1, TERMS):
        coefs.append(coefs[-1] * ((q + (k - 1)) / k))
    for k in range(TERMS - 1, -1, -1):
        total = total * ratio + coefs[k] * F.col(f"m{k}")
    return total * F.pow(lag, -q)


def kernel_sums(events: DataFrame, targets: DataFrame, kernels: DataFrame, keys: Sequence[str], span: float, c_min: float, log: bool = False,
                out: str = "s") -> DataFrame:
    """(cand, keys, t, out): sum over the events before each target time of w * (at - t_event + c) ** -q.

    *events* has keys, alpha, t (days) and w; *targets* has keys, t and at, where events before t count and the lag is
    taken at *at*, not before t (once for each t); *kernels* is a short table (cand, alpha, c, q). With *log* the
    sum is that of w * ln(lag + c). Times lie from 0 to *span*. Targets without earlier events have no row.

    Moments of all alphas are columns of one row of a bucket, sums of all kernels columns of one row of a target. Events
    are dealt out by stretches of time, so that a task adds up whole buckets before their moments move. The number of
    tasks follows the rows, TASK_ROWS to each: the memory of a task does not grow with the tables.
    """
    k, finest = list(keys), c_min / (NEAR + 1)
    rows = kernels.select("cand", "alpha", "c", "q").orderBy("cand").collect()
    cand = kernels.schema["cand"].dataType
    if not rows:
        return targets.select(F.lit(None).cast(cand).alias("cand"), *k, "t", F.lit(None).cast("double").alias(out)).filter("false")
    alphas = sorted({r["alpha"] for r in rows})
    top = max(0, math.ceil(math.log2(max(span, finest) / finest / (NEAR + 1)))) + 1
    weights = [F.sum(F.when(F.col("alpha") == a, F.col("w"))).alias(f"w{i}") for i, a in enumerate(alphas)]
    placed = events.withColumn("b0", F.floor(F.col("t") / finest)).withColumn("__block", F.shiftright("b0", TOGETHER))
    held = events.count() / len(alphas)
    src = placed.repartition(math.ceil(held / TASK_ROWS) + 1, *k, "__block").groupBy(*k, "__block", "b0", "t").agg(*weights).drop("__block")
    levels = F.sequence(F.lit(0), F.lit(top))
    width = F.lit(finest) * F.pow(F.lit(2.0), F.col("level"))
    up = src.withColumn("level", F.explode(levels)).withColumn("b", F.expr("shiftright(b0, level)")).withColumn("x", F.col("t") / width - F.col("b") - 0.5)
    moments = up.groupBy(*k, "level", "b").agg(*[F.sum(F.col(f"w{i}") * p).alias(f"m{i}_{j}") for i in range(len(alphas)) for j, p in enumerate(_powers(F.col("x")))])

    kern = F.broadcast(kernels.select("cand", "alpha", "c", "q"))  # a short table by contract

    def summed(df, lag, width):
        # the alphas become rows again where their moments have arrived
        each = F.array(*[F.struct(F.lit(a).alias("alpha"), *[F.col(f"m{i}_{j}").alias(f"m{j}") for j in range(TERMS)]) for i, a in enumerate(alphas)])
        spread = df.select(*k, "t", lag.alias("__lag"), width.alias("__width"), F.inline(each)).filter("m0 > 0")
        return spread.join(kern, "alpha").select("cand", *k, "t", _series(F.col("__lag") + F.col("c"), F.col("__width"), log).alias(out))

    places = targets.select(*k, "t", "at").distinct().withColumn("b0", F.floor(F.col("t") / finest))
    far = places.withColumn("level", F.explode(levels)).withColumn("i", F.expr("shiftright(b0, level)"))
    low = F.when(F.col("level") < top, F.greatest(2 * (F.shiftright("i", 1) - NEAR), F.lit(0))).otherwise(F.lit(0)).cast("long")
    high = F.when(F.col("level") > 0, F.col("i") - NEAR - 1).otherwise(F.col("i") - 1).cast("long")
    far = far.withColumns({"low": low, "high": high}).filter("high >= low").withColumn("b", F.explode(F.sequence("low", "high"))).drop("low", "high", "i", "b0")
    # Spark takes the exploded places for as small as the places and would broadcast them
    met = far.join(moments.hint("merge"), [*k, "level", "b"])
    distant = summed(met, F.col("at") - (F.col("b") + 0.5) * width, width)
    # within the finest bucket: running moments, targets before the events of the same time; they are made where the rows are gathered
    names = [f"w{i}" for i in range(len(alphas))]
    own = src.select(*k, "b0", "t", F.lit(None).cast("double").alias("at"), F.lit(1).alias("kind"), *names)
    ask = places.join(src.select(*k, "b0").distinct(), [*k, "b0"], "left_semi").select(
        *k, "b0", "t", "at", F.lit(0).alias("kind"), *[F.lit(None).cast("double").alias(n) for n in names])
    w = Window.partitionBy(*k, "b0").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, -1)
    both = own.unionByName(ask).repartition(math.ceil((held + targets.count()) / TASK_ROWS) + 1, *k, "b0").withColumn("x", F.col("t") / F.lit(finest) - F.col("b0") - 0.5)
    here = both.withColumns({f"m{i}_{j}": F.sum(F.col(n) * p).over(w) for i, n in enumerate(names) for j, p in enumerate(_powers(F.col("x")))}).filter("kind = 0")
    close = summed(here, F.col("at") - (F.col("b0") + 0.5) * finest, F.lit(finest))
    wide = distant.unionByName(close).groupBy(*k, "t").agg(*[F.sum(F.when(F.col("cand") == r["cand"], F.col(out))).alias(f"__s{i}") for i, r in enumerate(rows)])
    each = F.array(*[F.struct(F.lit(r["cand"]).cast(cand).alias("cand"), F.col(f"__s{i}").alias(out)) for i, r in enumerate(rows)])
    return wide.select(*k, "t", F.explode(each).alias("__e")).filter(F.col(f"__e.{out}").isNotNull()).select("__e.cand", *k, "t", f"__e.{out}")
