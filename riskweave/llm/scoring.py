"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.common import fold
from riskweave.session import cut_lineage

FOLDS, HELD_OUT = 7, 2
END = ""  # no word is empty
OWN_UNITS = 79  # most frequent tokens with a unit of their own
CLASS_UNITS = 48  # units that all other tokens share by what stands around their ending
ENDINGS = 4_096  # hashed endings, so that the tables about them stay small
UNITS = OWN_UNITS + CLASS_UNITS + 1  # the last one stands before the text
START = UNITS - 1
ENDING = 3
DICTIONARY = 50_000  # most frequent tokens that every task holds; the rest meet their counts in a join
DIM, NOISE, STEPS, BATCH, RATE = 24, 24, 1_500, 4_096, 0.08
FLOOR = 0.02  # share of the count model in every token's probability
SLICE_BYTES = 2_000_000  # text that a task encodes in one go
FLUSH = 400_000  # distinct words that a task holds before it passes their counts on


def _words(text: str | None) -> list[bytes]:
    """Lower-cased words of the whole text; only A-Z change."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def ending_code(word: bytes) -> int:
    return OWN_UNITS + xxhash.xxh32_intdigest(word.rstrip(b".,;:!?|")[-ENDING:]) % ENDINGS


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c): counts over all texts of *docs*, the end of each text counted as a token."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for frame in batches:
            for text in frame["text"]:
                held.update(_words(text))
                held[END.encode()] += 1
                if len(held) > FLUSH:
                    yield pd.DataFrame({"token": list(held.keys()), "c": list(held.values())})
                    held = Counter()
        if held:
            yield pd.DataFrame({"token": list(held.keys()), "c": list(held.values())})

    parts = docs.select("text").mapInPandas(counted, "token binary, c long")
    return cut_lineage(parts.groupBy("token").agg(F.sum("c").alias("c")))


class Vocabulary:
    """The frequent tokens' codes and counts; all but the first ones have the code of their ending."""

    def __init__(self, rows: list[tuple[bytes, int]]):
        self.entry = {w: (i if i < OWN_UNITS else ending_code(w), c) for i, (w, c) in enumerate(rows)}
        self.entry.setdefault(END.encode(), (ending_code(END.encode()), 0))

    def encode(self, text: str | None) -> tuple[bytes, int, int, float, Counter]:
        """Codes of the tokens, their number, those known and their log10 counts in the dictionary, and the other words."""
        words = _words(text)
        words.append(END.encode())
        get = self.entry.get
        rare: Counter = Counter()
        codes, counts = np.empty(len(words), np.uint16), np.zeros(len(words), np.int64)
        for i, w in enumerate(words):
            e = get(w)
            if e is None:
                codes[i] = ending_code(w)
                rare[w] += 1
            else:
                codes[i], counts[i] = e
        return codes.tobytes(), len(words), int((counts > 0).sum()), float(np.log10(counts + 1.0).sum()), rare


RARE = pa.struct([("token", pa.binary()), ("tf", pa.int64())])
ENCODED = "held_out boolean, codes binary, n_tokens long, known long, logs double, rare array<struct<token: binary, tf: long>>"


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Encoded rows of *docs*, written. A task holds SLICE_BYTES of text, or one longer text, and the words of
    that slice that are not in the dictionary as flat arrays."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column("text")
            ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)))
            at = 0
            while at < batch.num_rows:
                base = ends[at - 1] if at else 0.0
                stop = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
                rows = [own.encode(texts[i].as_py()) for i in range(at, stop)]
                offsets = np.concatenate(([0], np.cumsum([len(r[4]) for r in rows]))).astype(np.int32)
                flat = pa.StructArray.from_arrays([pa.array([w for r in rows for w in r[4]], pa.binary()), pa.array([n for r in rows for n in r[4].values()], pa.int64())],
                                                  fields=list(RARE))
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(at, stop - at), "held_out": batch.column("held_out").slice(at, stop - at),
                    "codes": pa.array([r[0] for r in rows], pa.binary()), "n_tokens": pa.array([r[1] for r in rows], pa.int64()),
                    "known": pa.array([r[2] for r in rows], pa.int64()), "logs": pa.array([r[3] for r in rows], pa.float64()),
                    "rare": pa.ListArray.from_arrays(pa.array(offsets), flat)})
                at = stop

    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(encoded, f"doc_id {kind}, {ENCODED}")
    return cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))


def _summed(encoded: DataFrame, cells_of, size: int) -> DataFrame:
    """(cell, n) over all texts of the cells that *cells_of* makes of a text's codes; at most *size* of them."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(size, np.int64)
        for frame in batches:
            for codes in frame["codes"]:
                np.add.at(table, cells_of(np.frombuffer(codes, np.uint16).astype(np.int64)), 1)
        cells = np.flatnonzero(table)
        yield pd.DataFrame({"cell": cells, "n": table[cells]})

    return encoded.select("codes").mapInPandas(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _beside(codes: np.ndarray) -> np.ndarray:
    """Cells (code, frequent token) of each code and the frequent tokens up to two places away."""
    out = []
    for o in (1, 2):
        for x, y in ((codes[o:], codes[:-o]), (codes[:-o], codes[o:])):
            own = y < OWN_UNITS
            out.append(x[own] * OWN_UNITS + y[own])
    return np.concatenate(out)


def _trigrams(codes: np.ndarray, unit_of: np.ndarray) -> np.ndarray:
    u = np.concatenate(([START, START], unit_of[codes]))
    return (u[:-2] * UNITS + u[1:-1]) * UNITS + u[2:]


def unit_map(encoded: DataFrame, rounds: int = 20, seed: int = 42) -> np.ndarray:
    """The unit of every code: frequent tokens keep theirs, endings are clustered by their company."""
    seen = _summed(encoded, _beside, (OWN_UNITS + ENDINGS) * OWN_UNITS).toPandas()
    beside = np.zeros((OWN_UNITS + ENDINGS) * OWN_UNITS)
    beside[seen["cell"].to_numpy()] = seen["n"].to_numpy()
    beside = beside.reshape(-1, OWN_UNITS)[OWN_UNITS:]
    weight = beside.sum(axis=1)
    overall = (beside.sum(axis=0) + 1) / (beside.sum() + OWN_UNITS)
    company = np.sqrt((beside + 5 * overall) / (weight[:, None] + 5))
    rng = np.random.default_rng(seed)
    chosen = np.argsort(-weight, kind="stable")[:CLASS_UNITS * 4]
    centre = company[rng.permutation(chosen)[:CLASS_UNITS]]
    for _ in range(rounds):
        group = np.argmax(company @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, group, company * (weight[:, None] + 1e-9))
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.maximum(norm, 1e-12), centre)
    return np.concatenate((np.arange(OWN_UNITS), OWN_UNITS + np.argmax(company @ centre.T, axis=1)))


def train(cells: np.ndarray, counts: np.ndarray, steps: int = STEPS, seed: int = 42) -> dict[str, np.ndarray]:
    """Log-bilinear model of the unit after two units, by noise-contrastive estimation.

    A context's vector is the sum of its units' vectors, each weighed by its place; its product with a
    unit's vector plus a bias is the unnormalised log-probability. Positive examples are drawn in
    proportion to the corpus counts, noise from the unit frequencies.
    """
    rng = np.random.default_rng(seed)
    unigram = np.bincount(cells % UNITS, weights=counts, minlength=UNITS) + 1e-3
    noise = unigram / unigram.sum()
    p = {"near": rng.normal(0, 0.1, (UNITS, DIM)), "target": rng.normal(0, 0.1, (UNITS, DIM)),
         "place": np.ones((2, DIM)), "bias": np.log(noise)}
    seen = {k: np.full_like(v, 1e-2) for k, v in p.items()}
    edges = np.cumsum(counts / counts.sum())
    for _ in range(steps):
        cell = cells[np.minimum(np.searchsorted(edges, rng.random(BATCH)), len(cells) - 1)]
        a, b, u = cell // UNITS ** 2, cell // UNITS % UNITS, cell % UNITS
        va, vb = p["near"][a], p["near"][b]
        q = va * p["place"][0] + vb * p["place"][1]
        drawn = rng.choice(UNITS, NOISE, p=noise)
        good = (q * p["target"][u]).sum(1) + p["bias"][u] - np.log(NOISE * noise[u])
        bad = q @ p["target"][drawn].T + p["bias"][drawn] - np.log(NOISE * noise[drawn])
        dg = 1 / (1 + np.exp(good))
        db = -1 / (1 + np.exp(-bad))
        dq = dg[:, None] * p["target"][u] + db @ p["target"][drawn]
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        hot = np.zeros((BATCH, UNITS))
        hot[np.arange(BATCH), u] = dg
        grad["target"] += hot.T @ q
        grad["bias"] += hot.sum(0)
        np.add.at(grad["target"], drawn, db.T @ q)
        np.add.at(grad["bias"], drawn, db.sum(0))
        for at, v, i in ((a, va, 0), (b, vb, 1)):
            hot = np.zeros((BATCH, UNITS))
            hot[np.arange(BATCH), at] = 1
            grad["near"] += hot.T @ (dq * p["place"][i])
            grad["place"][i] += (dq * v).sum(0)
        for k in p:
            g = grad[k] / BATCH
            seen[k] += g * g
            p[k] += RATE * g / np.sqrt(seen[k])
    return p


def unit_table(p: dict[str, np.ndarray]) -> np.ndarray:
    """Normalised probabilities of every unit after every pair of units, by one product for each first unit."""
    out = np.empty((UNITS, UNITS, UNITS), np.float32)
    near = p["near"] * p["place"][1]
    for a in range(UNITS):
        logits = (p["near"][a] * p["place"][0] + near) @ p["target"].T + p["bias"]
        logits[:, START] = -np.inf  # nothing but a beginning
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        out[a] = e / e.sum(axis=1, keepdims=True)
    return out.reshape(-1)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    Counts are taken over all texts outside the held-out fold. The model gives the next unit after two
    units: a frequent token is a unit, all others share units by the company of their
    ending, and a token's share of
    its unit is (c + 1) over the unit's total, in which an unseen token has one. Trigram counts of units over the
    whole training corpus, bounded by the number of units, are all that training sees. A small
    share of the count model is mixed into every token. Tokens outside the dictionary meet their counts
    in a join, so no vocabulary is too large. A null or empty text is one end token; repeated rows count
    as often as they occur; without training rows all counts are zero.
    """
    texts = docs.select("doc_id", "text")
    training = texts.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    counts = token_counts(training)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "token").limit(DICTIONARY).toPandas()
    top = list(zip(top["token"].map(bytes), top["c"].tolist()))
    vocabulary = Vocabulary(top)
    rows = encode(texts, vocabulary)

    @F.pandas_udf(T.IntegerType())
    def codes(words: pd.Series) -> pd.Series:
        return words.map(lambda w: ending_code(bytes(w)))

    learned = rows.filter("NOT held_out")
    unit_of = unit_map(learned)
    mass = np.ones(UNITS)
    for r in counts.groupBy(codes("token").alias("code")).agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[unit_of[r["code"]]] += r["m"]
    for i, (w, c) in enumerate(top[:OWN_UNITS]):
        mass[unit_of[ending_code(w)]] -= c + 1
        mass[i] = c + 1.0
    seen = _summed(learned, lambda c: _trigrams(c, unit_of), UNITS ** 3).orderBy("cell").toPandas()
    seen = seen if len(seen) else pd.DataFrame({"cell": [0], "n": [1]})
    table = unit_table(train(seen["cell"].to_numpy(), seen["n"].to_numpy(dtype=np.float64)))
    everything = total + 1.0 * (distinct + 1)
    shares = np.log10((1 - FLOOR) * table.reshape(-1, UNITS) / mass + FLOOR / everything).astype(np.float32).ravel()
    shared = docs.sparkSession.sparkContext.broadcast(shares)

    @F.pandas_udf(T.DoubleType())
    def in_context(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            out = [float(own[_trigrams(np.frombuffer(x, np.uint16).astype(np.int64), unit_of)].sum(dtype=np.float64)) for x in texts]
            yield pd.Series(out, dtype="float64")

    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.tf")
    late = rare.join(counts, "token").groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    scored = rows.select("row", "doc_id", "held_out", "n_tokens", "known", "logs", in_context("codes").alias("ctx")).join(late, "row", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return scored.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                         F.lit(total).cast("long").alias("train_tokens"),
                         (logs - F.col("n_tokens") * float(np.log10(everything))).alias("base_score"), (logs + F.col("ctx")).alias("score"))
