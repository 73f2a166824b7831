"""Toxicity: boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from riskweave.llm.common import fold
from riskweave.session import cut_lineage

FOLDS = 5
HELD_OUT = 0
CALIBRATION = 4
MAX_LABELLED = 20_000
MAX_TERMS = 400
STEMS = (3, 4, 5, 6)
NEAR = 3
FEATURES = ("words", "hits", "density", "weight", "weight_density", "strongest", "kinds", "near_you", "hidden",
            "hidden_density", "capitals", "shouted", "marks", "punctuation", "digits", "symbols")
#: Second-person words of English, French, German and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre usted tú ti".split())
#: Characters that stand in for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
TOKEN = re.compile(r"[^\W_]+")
HIDING = re.compile(r"[^\W\d_][0-9@$!*._\-]+[^\W\d_]")
SPACED = re.compile(r"\b(?:[^\W\d_][ .\-_*]){3,}[^\W\d_]\b")
UNBROKEN = re.compile(r"\S*")
RUN = re.compile(r"(.)\1{2,}")


def lexicon(labelled: DataFrame, max_terms: int = MAX_TERMS) -> dict[str, float]:
    """Words and word stems that mark the toxic class, with their log odds.

    Counts are documents of *labelled* (text, y) with the term; a term needs four toxic documents, odds
    of twenty to one against its share in the others and a clear chi-square. At most *max_terms* terms
    come to the driver.
    """
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    terms = F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(
        F.array(F.concat(F.lit("="), w)), *[F.when(F.length(w) > n, F.array(F.substring(w, 1, n))).otherwise(F.array().cast("array<string>"))
                                            for n in STEMS]))))
    totals = labelled.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    bad, good = totals[0], totals[1] - totals[0]
    counts = labelled.select("y", F.explode(terms).alias("term")).filter("term <> '='").groupBy("term").agg(
        F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    odds = F.log((F.col("p") + 0.5) / (bad + 1.0)) - F.log((F.col("q") + 0.5) / (good + 1.0))
    expected = (F.col("p") + F.col("q")) * (bad / max(bad + good, 1))
    chosen = (counts.filter("p >= 4").withColumn("odds", odds).withColumn("chi", (F.col("p") - expected) ** 2 / expected)
              .filter(f"odds > {np.log(20.0)} AND chi > 20"))
    rows = chosen.orderBy(F.desc("chi"), "term").limit(max_terms).collect() if bad else []
    return {r["term"]: float(r["odds"]) for r in rows}


def masked_words(text: str) -> Iterator[str]:
    """Words with digits or marks between letters, and single letters set apart.

    One pass whatever the length of a word: a mark is sought first, and its word is taken from the white space before
    to the white space behind, each character once.
    """
    at = 0
    hit = HIDING.search(text)
    while hit:
        before = text[at:hit.start()]
        inside = len(before.rsplit(None, 1)[-1]) if before and not before[-1].isspace() else 0
        start, end = hit.start() - inside, UNBROKEN.match(text, hit.end()).end()
        for m in SPACED.finditer(text, at, start):
            yield m[0]
        yield text[start:end]
        at = end
        hit = HIDING.search(text, end)
    for m in SPACED.finditer(text, at):
        yield m[0]


class Scorer:
    """Dense features of a text under a lexicon."""

    def __init__(self, terms: dict[str, float]):
        self.terms, self.memo = terms, {}

    def weight(self, word: str) -> float:
        found = self.memo.get(word)
        if found is None:
            get = self.terms.get
            found = max([get("=" + word, 0.0), *[get(word[:n], 0.0) for n in STEMS if len(word) > n]])
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[word] = found
        return found

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        words = TOKEN.findall(text.lower())
        n = max(len(words), 1)
        memo, weight = self.memo, self.weight
        found = [(i, w) for i, w in enumerate(memo[x] if x in memo else weight(x) for x in words) if w]
        total = sum(w for _, w in found)
        near = sum(1 for i, _ in found if not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR):i + NEAR + 1]))
        hidden = 0.0
        for word in masked_words(text):
            plain = re.sub(r"[^a-z]", "", RUN.sub(r"\1", word.lower().translate(LOOKALIKES)))
            hidden += weight(plain) > 0 if plain else 0
        bytes_ = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        size = max(int(bytes_.sum()), 1)
        capitals = int(bytes_[65:91].sum())
        letters = max(capitals + int(bytes_[97:123].sum()), 1)
        shouted = len(re.findall(r"\b[A-Z]{3,}\b", text)) if capitals * 50 > letters else 0
        return [np.log1p(n), np.log1p(len(found)), len(found) / n, np.log1p(total), total / n,
                max((w for _, w in found), default=0.0), float(len({words[i] for i, _ in found})), near / n, np.log1p(hidden), hidden / n,
                capitals / letters, shouted / n, int(bytes_[33] + bytes_[63]) / size,
                int(bytes_[33:48].sum() + bytes_[58:65].sum()) / size, int(bytes_[48:58].sum()) / size,
                int(bytes_[[35, 36, 37, 38, 42, 64, 95, 126]].sum()) / size]


def feature_udf(terms: dict[str, float]):
    @F.pandas_udf(ArrayType(FloatType()))
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(terms)
        for texts in batches:
            yield pd.Series([scorer.features(t) for t in texts])

    return features


@dataclass
class ToxicityModel:
    terms: dict[str, float]
    trees: GBTClassificationModel | None
    steps: IsotonicRegressionModel | None
    prior: float

    def raw(self, df: DataFrame) -> DataFrame:
        """*df* with column _raw, the trees' probability of the text."""
        vectors = df.withColumn("_f", _to_vector("_x"))
        scored = self.trees.setFeaturesCol("_f").setPredictionCol("_p").setProbabilityCol("_q").setRawPredictionCol("_r").transform(vectors)
        return scored.withColumn("_raw", vector_to_array("_q")[1]).drop("_f", "_p", "_q", "_r")

    def score(self, docs: DataFrame) -> DataFrame:
        """*docs* with column _score, the calibrated probability; the prior where no model could be fitted."""
        if self.trees is None:
            return docs.withColumn("_score", F.lit(self.prior))
        scored = self.raw(docs.withColumn("_x", feature_udf(self.terms)("text"))).drop("_x")
        if self.steps is None:
            return scored.withColumnRenamed("_raw", "_score")
        out = self.steps.setFeaturesCol("_raw").setPredictionCol("_score").transform(scored).drop("_raw")
        return out.withColumn("_score", F.least(F.greatest("_score", F.lit(0.0)), F.lit(1.0)))


def _to_vector(name: str):
    return array_to_vector(F.col(name).cast("array<double>"))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 42) -> ToxicityModel:
    """Fit on labelled documents outside the held-out fold.

    At most about *max_labelled* labelled rows are used, chosen by a hash of the id; they meet the
    documents as a broadcast of that size. Fold 4 calibrates, folds 1 to 3 give the lexicon and the
    trees. A document with several labels is toxic if one says so; null labels and ids do not count.
    Labels of one class only give a constant score.
    """
    marked = (labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("y"))
              .withColumn("fold", fold(F.col("doc_id"), FOLDS)).filter(F.col("fold") != HELD_OUT))
    n = marked.count()
    share = min(1.0, max_labelled / max(n, 1))
    sample = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = cut_lineage(texts.join(F.broadcast(sample), "doc_id").select("text", F.col("y").cast("int").alias("y"), "fold"))
    count = known.groupBy((F.col("fold") == CALIBRATION).alias("late")).agg(F.count("*").alias("n"), F.sum("y").alias("bad")).collect()
    rows = {r["late"]: (r["n"], r["bad"]) for r in count}
    total, bad = sum(x for x, _ in rows.values()), sum(x for _, x in rows.values())
    prior = (bad + 0.5) / (total + 1.0) if total else 0.0
    early = rows.get(False, (0, 0))
    if not 0 < early[1] < early[0]:
        return ToxicityModel({}, None, None, prior)
    terms = lexicon(known.filter(F.col("fold") != CALIBRATION))
    dense = cut_lineage(known.withColumn("_x", feature_udf(terms)("text")).select("_x", "y", "fold").coalesce(4))
    dense = dense.withColumn("_f", _to_vector("_x")).cache()
    trees = GBTClassifier(featuresCol="_f", labelCol="y", maxIter=12, maxDepth=3, stepSize=0.3, maxBins=32, seed=seed).fit(
        dense.filter(F.col("fold") != CALIBRATION))
    model = ToxicityModel(terms, trees, None, prior)
    late = rows.get(True, (0, 0))
    if 0 < late[1] < late[0]:
        model.steps = IsotonicRegression(featuresCol="_raw", labelCol="y").fit(model.raw(dense.filter(F.col("fold") == CALIBRATION)))
    dense.unpersist()
    return model


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score of one half or more) of every whole text.

    An empty or null text has the features of no words and gets their score. Repeated rows are scored
    alike; other columns of *docs* are not read.
    """
    model = fit(docs, labels)
    scored = model.score(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
                         F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """*docs* without the documents that the classifier rejects; columns of any name stay as they are."""
    model = fit(docs, labels)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return model.score(held).filter("_score < 0.5").select("row.*")
