"""Long unbroken texts, clashing columns, bounded slices and the pipeline as a whole."""

import random
import time

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from riskweave.llm import neighbours, quoting, scoring, simhash, toxicity

CLASH = "doc_id long, text string, lang string, source string, n_chars long, _id string, _key long, row string, _score double, _raw double, node long, n int"


def test_masked_words():
    text = "say h3llo to sh!t and w.o.r.d or i d i o t now a1 b-c x.. 1a1 end"
    assert list(toxicity.masked_words(text)) == ["h3llo", "sh!t", "w.o.r.d", "i d i o t", "b-c"]
    assert list(toxicity.masked_words("")) == [] and list(toxicity.masked_words("plain words")) == []


@pytest.mark.parametrize("text", ["x" * 400_000, "ab1" * 200_000, "a-" * 200_000, "a b " * 100_000, ("é" * 50 + "1") * 8_000, "a....." * 60_000])
def test_masked_words_of_unbroken_text_take_one_pass(text):
    start = time.time()
    list(toxicity.masked_words(text))
    assert time.time() - start < 5


def clashing(rows):
    return [(*r, "i", 5, "r", 0.1, 0.2, 7, 1) for r in rows]


def copies(rng):
    base = [" ".join(rng.choice("alpha beta gamma delta omega sigma kappa zeta".split()) + str(rng.randrange(30)) for _ in range(60)) for _ in range(12)]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(base)]
    rows += [(100 + 20 * i + j, t + f" tail{j}", "en", "b", 1) for i, t in enumerate(base[:4]) for j in range(15)]
    return rows + [rows[0], rows[13], (None, base[1], "en", "c", 1), (900, None, None, None, None), (901, "", "en", "c", 0), (902, base[5][:len(base[5]) // 2], "en", "c", 1)]


def jaccard(a, b):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_keep_one_with_clashing_columns(spark):
    rows = copies(random.Random(3))
    docs = spark.createDataFrame(clashing(rows), CLASH).repartition(4)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    up = list(range(len(rows)))
    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                up[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append(r[0])
    want = sorted(min((x for x in g if x is not None), default=None) for g in groups.values())
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_drop_toxic_with_clashing_columns(spark):
    rows = [(i, f"calm text {i}", "en", "a", 1) for i in range(30)]
    docs = spark.createDataFrame(clashing(rows), CLASH)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    out = toxicity.drop_toxic(docs, labels)
    assert out.columns == docs.columns and out.count() == 30


def test_encoding_does_not_depend_on_slices(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(80)))) for i in range(150)] + [(200, None), (201, ""), (None, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    vocabulary = scoring.Vocabulary([(b"w1", 5), (b"w2", 3)])
    def encoded():
        return sorted((str(r["doc_id"]), bytes(r["codes"]), r["n_tokens"], r["known"], r["logs"], sorted((bytes(x["token"]), x["tf"]) for x in r["rare"]))
                      for r in scoring.encode(docs, vocabulary).collect())
    whole = encoded()
    monkeypatch.setattr(scoring, "SLICE_BYTES", 100)
    assert encoded() == whole and len(whole) == 153


def test_pipeline_stages_keep_the_columns_and_drop_what_they_should(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, kept, sf)
        assert after.columns == docs.columns
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in kept.select("doc_id").collect()}
        kept = spark.createDataFrame(after.collect(), docs.schema)
    texts = [r["text"] for r in kept.collect()]
    assert all(jaccard(a, b) < 0.8 for i, a in enumerate(texts) for b in texts[:i])
    final = corpus_pipeline.run(spark, sf)
    rows = final.select("doc_id", "shard", "slot").collect()
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in kept.collect()} and len(rows) > 0
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("n,d,copies", [(500, 64, 1), (2000, 64, 1), (8192, 16, 1), (500, 32, 8)])
def test_neighbour_recall_at_every_size(n, d, copies):
    """By score, so that ties cannot count: the mean of found neighbours is 0.9 or more."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, d))
    x = np.vstack([x + rng.normal(0, 0.05, x.shape) for _ in range(copies)])
    index, ids, found = neighbours.CollisionIndex(x, float(np.sqrt((x ** 2).sum(1)).max())), np.arange(len(x)), []
    for q in range(0, len(x), len(x) // 50):
        score = x @ x[q]
        got, values = index.nearest(x[q], ids, 21)
        assert np.allclose(values, score[got])
        found.append((values >= np.sort(score)[::-1][20] - 1e-9).mean())
    assert np.mean(found) >= 0.9


def test_neighbour_search_counts_less_than_its_windows_hold(monkeypatch):
    """Windows grow once to what the first leaders ask for; no step counts more than half of the projections' entries."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 64))
    index, counted = neighbours.CollisionIndex(x, float(np.sqrt((x ** 2).sum(1)).max())), []
    whole = np.bincount
    monkeypatch.setattr(neighbours.np, "bincount", lambda a, **k: counted.append(len(a)) or whole(a, **k))
    found = []
    for q in range(0, 4000, 100):
        score = x @ x[q]
        found.append((index.nearest(x[q], np.arange(len(x)), 21)[1] >= np.sort(score)[::-1][20] - 1e-9).mean())
    assert np.mean(found) >= 0.9
    assert len(counted) <= 3 * 40 and sum(counted) < 0.62 * 40 * index.order.size


def test_deeper_quotes_serve_where_the_first_level_is_silent(spark, tmp_path):
    rows = [(1, 0, "user", "First thing\nother line"), (1, 1, "assistant", "reply one"), (1, 2, "user", "> > first thing here\n> > first   THING"),
            (1, 3, "assistant", "> unknown\n>> reply one\n> > > First thing"), (1, 4, "user", ">>> First thing\n> reply one"), (1, 5, "user", "> > > nobody said this")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r["reply_to"] for r in quoting.conversations(messages).collect()}
    assert got == {0: None, 1: None, 2: 0, 3: 1, 4: 1, 5: None}
    con = duckdb.connect()
    con.register("conversations", messages.toPandas())
    names = [c[0] for c in con.execute(quoting.ORACLE).description]
    assert {r[names.index("turn")]: r[names.index("reply_to")] for r in con.execute(quoting.ORACLE).fetchall()} == got
