"""Benchmark decontamination: BM25 retrieval of test items by block-max WAND, then overlap checks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.session import cut_lineage

SEGMENT = 64  # words of an indexed piece of an item; passages are two such blocks, one block apart
K1, B = 1.2, 0.75
THRESHOLD = 0.5  # of the score that a segment has for itself
SHINGLE = 5
SIMILARITY = 0.8
POSTINGS_PER_BLOCK = 2_000_000
BLOCK_MAX = 32  # postings under one maximum
TOKEN = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("passage", T.IntegerType()),
                    T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())])


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words before the last sentence, and of it; an item of one sentence answers with its last third."""
    parts = [w for w in map(tokens, SENTENCE.split(text.strip())) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def segments(words: list[str]) -> list[list[str]]:
    """Pieces of SEGMENT words; the last one reaches back so that it is whole."""
    if len(words) <= SEGMENT:
        return [words]
    cuts = list(range(0, len(words) - SEGMENT, SEGMENT)) + [len(words) - SEGMENT]
    return [words[c:c + SEGMENT] for c in cuts]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _segments(texts: pd.Series) -> pd.Series:
    """Terms of each segment: its adjacent word pairs, which common words alone rarely form."""
    return pd.Series([[[f"{a} {b}" for a, b in zip(s, s[1:])] for s in segments(tokens(t)) if len(s) > 1] for t in texts])


def weighted_postings(benchmark: DataFrame) -> DataFrame:
    """(item_id, seg, term, w): BM25 weights of each segment's terms, as shares of its own score.

    Frequencies and lengths are counted over all items.
    """
    parts = benchmark.filter("text IS NOT NULL").select("item_id", F.xxhash64("text").alias("version"), F.posexplode(_segments("text")).alias("seg", "words"))
    parts = cut_lineage(parts.distinct())
    n, mean = parts.agg(F.count("*"), F.coalesce(F.avg(F.size("words")), F.lit(1.0))).first()
    tf = parts.select("item_id", "version", "seg", F.size("words").alias("dl"), F.explode("words").alias("term")).groupBy(
        "item_id", "version", "seg", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
    raw = tf.join(df, "term").withColumn("w", idf * norm)
    own = raw.groupBy("item_id", "version", "seg").agg(F.sum("w").alias("own"))
    return raw.join(own, ["item_id", "version", "seg"]).select("item_id", "version", "seg", "term", (F.col("w") / F.col("own")).alias("w"))


class BlockMaxIndex:
    """Postings of one block of segments, sorted by segment, with a maximum for each run of postings."""

    def __init__(self, postings: pd.DataFrame, texts: dict[tuple[int, int], str]):
        owners = postings[["item_id", "version", "seg"]].drop_duplicates().sort_values(["item_id", "version", "seg"])
        numbers = {k: i for i, k in enumerate(owners.itertuples(index=False, name=None))}
        self.owner = [(k[0], k[1]) for k in numbers]
        keyed = postings.assign(n=[numbers[k] for k in postings[["item_id", "version", "seg"]].itertuples(index=False, name=None)])
        self.word: dict[str, int] = {}
        terms = []
        for term, part in keyed.sort_values("n").groupby("term", sort=True):
            a, b = (self.word.setdefault(w, len(self.word)) for w in term.split(" "))
            w = part["w"].tolist()
            terms.append(((a << 32) + b, (part["n"].tolist(), w, [max(w[i:i + BLOCK_MAX]) for i in range(0, len(w), BLOCK_MAX)])))
        terms.sort(key=lambda x: x[0])
        self.pair = np.array([x for x, _ in terms] + [1 << 62], np.int64)
        self.lists: list[tuple[list[int], list[float], list[float]]] = [x for _, x in terms]
        self.bound = np.array([max(m) for _, _, m in self.lists] + [0.0])
        self.parts = {}
        for key, text in texts.items():
            q, a = question_and_answer(text)
            self.parts[key] = (_shingles(q), _shingles(a), _shingles(tokens(text)))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All segments that score *threshold* or more for the set *terms*: block-max WAND.

        Cursors stand in the order of their next segment. Up to the pivot the lists' maxima add up to
        the threshold; if the maxima of the blocks there do not, the cursors jump over the blocks.
        """
        cursors = [[self.lists[t][0][0], 0, t] for t in terms]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += self.bound[c[2]]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            lead = cursors[:pivot + 1]
            ahead = [self._block(c, at) for c in lead]
            if sum(m for m, _ in ahead) < threshold:
                nxt = min([e for _, e in ahead] + ([cursors[pivot + 1][0]] if pivot + 1 < len(cursors) else []))
                target = max(nxt, at + 1)
            elif cursors[0][0] == at:
                score = sum(self.lists[c[2]][1][c[1]] for c in lead)
                if score >= threshold:
                    found.append((at, score))
                target = at + 1
            else:
                target = at
            cursors = [c for c in (self._seek(c, target) for c in lead) if c] + cursors[pivot + 1:]
        return found

    def _block(self, cursor: list, target: int) -> tuple[float, int]:
        """Maximum of the block that holds *target* or what follows it, and the first segment after the block."""
        docs, _, tops = self.lists[cursor[2]]
        b, end = cursor[1] // BLOCK_MAX, len(docs)
        while (b + 1) * BLOCK_MAX < end and docs[(b + 1) * BLOCK_MAX - 1] < target:
            b += 1
        if docs[min(end, (b + 1) * BLOCK_MAX) - 1] < target:
            return 0.0, 1 << 60
        return tops[b], docs[min(end, (b + 1) * BLOCK_MAX) - 1] + 1

    def _seek(self, cursor: list, target: int) -> list | None:
        docs, i = self.lists[cursor[2]][0], cursor[1]
        while i < len(docs) and docs[i] < target:
            i += 1
        return [docs[i], i, cursor[2]] if i < len(docs) else None

    def hits(self, text: str | None) -> list[dict]:
        """Items that the text holds: retrieved from a passage, then verified against the text around it."""
        words = tokens(text)
        if not words:
            return []
        get, size = self.word.get, len(self.pair)
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        pair = (ids[known] << 32) + ids[known + 1]
        at = np.searchsorted(self.pair, pair)
        known, at = known[self.pair[at] == pair], at[self.pair[at] == pair]
        pairs = np.unique((known // SEGMENT) * size + at)
        block, term = pairs // size, pairs % size
        blocks = len(words) // SEGMENT + 1
        sums = np.bincount(block, weights=self.bound[term], minlength=blocks + 1)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for p in np.flatnonzero(sums[:-1] + sums[1:] >= THRESHOLD).tolist():
            query = np.unique(term[np.searchsorted(block, p):np.searchsorted(block, p + 2)]).tolist()
            for segment, score in self.search(query, THRESHOLD):
                key = self.owner[segment]
                if key not in best or score > best[key][0]:
                    best[key] = (score, p)
        if not best:
            return []
        have, out = _shingles(words), {}
        small: dict[int, set] = {}
        for key, (score, p) in best.items():
            q, a, whole = (self._share(s, have, words, small) for s in self.parts[key])
            if whole >= SIMILARITY and min(q, a) > 0 and (key[0] not in out or score > out[key[0]]["score"]):
                out[key[0]] = {"item_id": key[0], "score": float(score), "passage": p, "question_overlap": q, "answer_overlap": a}
        return [out[k] for k in sorted(out, key=lambda x: (x is None, x))]

    @staticmethod
    def _share(wanted: frozenset, have: frozenset, words: list[str], small: dict[int, set]) -> float:
        if not wanted:
            return 1.0
        size = len(next(iter(wanted)))
        if size < SHINGLE:
            if size not in small:
                small[size] = {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}
            have = small[size]
        return len(wanted & have) / len(wanted)


def _shingles(words: list[str]) -> frozenset:
    """Shingles of five words; a shorter text is one shingle, no words are none."""
    k = min(SHINGLE, len(words))
    return frozenset(zip(*[words[i:len(words) - k + 1 + i] for i in range(k)])) if k else frozenset()


def _indexes(benchmark: DataFrame) -> Iterator[BlockMaxIndex]:
    """Indexes over the whole benchmark, one after another, each of a bounded number of postings."""
    postings = cut_lineage(weighted_postings(benchmark))
    total = postings.count()
    blocks = -(-total // POSTINGS_PER_BLOCK)
    texts = benchmark.filter("text IS NOT NULL").select("item_id", F.xxhash64("text").alias("version"), "text").distinct()
    for i in range(blocks):
        mine = F.pmod(F.xxhash64("item_id", "version"), F.lit(blocks)) == i
        pairs = {(r["item_id"], r["version"]): r["text"] for r in texts.filter(mine).collect()}
        yield BlockMaxIndex(postings.filter(mine).toPandas().astype({"item_id": object}), pairs)


def _hits_udf(spark, index: BlockMaxIndex):
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf(T.ArrayType(HIT))
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            yield pd.Series([own.hits(t) for t in texts])

    return hits


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, passage, question_overlap, answer_overlap) of each item that a document holds.

    Every passage of every whole text, 128 words each and 64 apart, is a query against the segments of
    all items. Scores are shares of the segment's own BM25 score; all segments at one half or more are
    retrieved, and a pair is kept if the text has four fifths of the item's shingles of five words, with
    some of the question and some of the answer. The benchmark is indexed in blocks of a bounded size,
    each sent to all tasks and passed over once. Null or wordless texts and items of fewer than two words hold nothing; equal
    rows are reported alike; an empty benchmark finds nothing.
    """
    spark, found = docs.sparkSession, None
    for index in _indexes(benchmark):
        hit = docs.select("doc_id", F.explode(_hits_udf(spark, index)("text")).alias("h")).select("doc_id", "h.*")
        found = hit if found is None else found.union(hit)
    return found if found is not None else docs.select("doc_id").limit(0).select(
        "doc_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in HIT.fields])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """*docs* without the documents that hold an item."""
    clean = docs
    for index in _indexes(benchmark):
        clean = clean.filter(F.size(_hits_udf(docs.sparkSession, index)("text")) == 0)
    return clean
