"""Token counts at prefixes against the vocabulary's own library."""

import random

import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
tokens_dir = pytest.importorskip("public_tokenizers")

from riskweave.llm import tokencounts as tc  # noqa: E402

BITS = ["a", "b", "the", " ", "  ", "\n", "'re", "'ll", "'s", "'", "é", "中文", "1", "23", "!", "..", "<|endoftext|>", "<|end", "ing", "er", "\t",
        "😀", "xxxxx", "qz", " token", " ", "\x1c"]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(tokens_dir.path(tc.VOCABULARY))
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


def mixture(rng, n):
    return "".join(rng.choice(BITS) for _ in range(n))


def test_every_prefix_and_every_budget(library):
    rng, counter = random.Random(3), tc.counter()
    for _ in range(400):
        s = mixture(rng, rng.randrange(24))
        expected = [library(s[:i]) for i in range(len(s) + 1)]
        assert counter.prefixes(s).tolist() == expected
        for budget in (0, 1, 3, 8):
            assert counter.fitting(counter.split(s), budget) == max(i for i, n in enumerate(expected) if n <= budget)


@pytest.mark.parametrize("text", ["x7" * 40_000, "字" * 30_000, " " * 20_000, "-=" * 20_000 + "a", "ab " * 20_000])
def test_long_unbroken_texts(library, text):
    assert tc.counter().count(text) == library(text)


def test_documents_and_stored_prefixes(spark, library):
    rng = random.Random(4)
    texts = [None, "", " \n", "<|endoftext|>", "same", "same", *[mixture(rng, 30) for _ in range(40)], mixture(rng, 3000)]
    rows = [(i if i != 4 else None, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, kept_chars long").repartition(3)
    got = sorted(tuple(r) for r in tc.count_documents(docs).select(F.coalesce("doc_id", F.lit(-1)), "n_bytes", "n_tokens", "over_limit").collect())
    want = sorted((-1 if i is None else i, len((t or "").encode()), library(t or ""), library(t or "") > 1024) for i, t, _, _ in rows)
    assert got == want
    stored = tc.prefix_counts(docs.filter("doc_id < 40"))
    asked = stored.select("text", tc.tokens_of_prefix(F.col("prefix_tokens"), 7).alias("seven"), tc.longest_prefix(F.col("prefix_tokens"), 5).alias("five"),
                          tc.pack(F.col("prefix_tokens"), 4).alias("windows"), F.element_at("prefix_tokens", -1).alias("all"))
    for r in asked.collect():
        t = r["text"] or ""
        assert r["seven"] == library(t[:7]) and r["all"] == library(t) and r["windows"] == -(-library(t) // 4)
        assert r["five"] == max(i for i in range(len(t) + 1) if library(t[:i]) <= 5)
    cut = {r["doc_id"]: r["text"] for r in tc.truncate(docs, 6).collect()}
    assert cut[0] is None and all(library(t) <= 6 for t in cut.values() if t)


def test_no_rows(spark):
    out = tc.count_documents(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "kept_chars"] and out.count() == 0
