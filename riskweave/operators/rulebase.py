"""Audits of a rule base against data: coverage and sensitivity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.scoring import Rule, antecedent, centroid_defuzz


def rule_table(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule and antecedent variable (the rule base is configuration)."""
    rows = [(i, v, t, r.output, r.out_term, len(r.antecedent)) for i, r in enumerate(rules) for v, t in r.antecedent]
    return df.sparkSession.createDataFrame(rows, "i int, variable string, term string, output string, out_term string, arity int")


def coverage(df: DataFrame, rules: Sequence[Rule], variables: Sequence[str]) -> DataFrame:
    """Rules per variable and output with the largest firing on the data; unused variables are flagged.

    One aggregation over the data whatever the number of rules.
    """
    spark = df.sparkSession
    peaks = df.agg(*[F.max(antecedent(r)).alias(str(i)) for i, r in enumerate(rules)])
    peaks = peaks.unpivot([], [F.col(f"`{i}`") for i in range(len(rules))], "i", "firing").withColumn("i", F.col("i").cast("int"))
    used = rule_table(df, rules).join(peaks, "i")
    all_vars = spark.createDataFrame([(v,) for v in variables], "variable string")
    g = all_vars.join(used, "variable", "left").groupingSets([["variable", "output"], ["variable"]], "variable", "output").agg(
        F.count("i").alias("n_rules"), F.coalesce(F.max("firing"), F.lit(0.0)).alias("max_firing"), F.grouping("output").alias("__g"))
    return g.filter("__g = 1 OR output IS NOT NULL").withColumn("unused", F.col("n_rules") == 0).drop("__g")


def sensitivity(df: DataFrame, rules: Sequence[Rule], centers: Mapping[str, float], probes: Mapping[str, Sequence[float]]) -> DataFrame:
    """Range of the mean score when one variable is set to each probe value on every row.

    All probes are averages of one pass over the data; a variable that never moves the score is dead.
    """
    cells = {}
    for variable, points in probes.items():
        for n, point in enumerate(points):
            cells[f"{variable}|{n}"] = (variable, point)
    aggs = []
    for name, (variable, point) in cells.items():
        fixed = {t: c for t, c in _strengths_at(rules, variable, point).items()}
        aggs.append(F.avg(centroid_defuzz(fixed, centers)).alias(name))
    wide = df.agg(*aggs).unpivot([], [F.col(f"`{n}`") for n in cells], "cell", "mean")
    g = wide.groupBy(F.split("cell", r"\|")[0].alias("variable")).agg((F.max("mean") - F.min("mean")).alias("sensitivity"))
    return g.withColumn("dead", F.col("sensitivity") <= 1e-9)


def _strengths_at(rules: Sequence[Rule], variable: str, point: float):
    from riskweave.operators.scoring import strongest

    by_term: dict[str, list] = {}
    for r in rules:
        by_term.setdefault(r.out_term, []).append(_antecedent_at(r, variable, point))
    return {t: strongest(cs) for t, cs in by_term.items()}


def _antecedent_at(rule: Rule, variable: str, point: float):
    from riskweave.functions.fuzzy import degree0, sets_for
    from riskweave.operators.scoring import degree

    parts = [degree0(F.lit(float(point)), sets_for(v)[t]) if v == variable else degree(v, t) for v, t in rule.antecedent]
    return F.least(*parts) if len(parts) > 1 else parts[0]
