"""Periodic runs against a plain scan of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from riskweave.llm import periodicity as pr


def plain_runs(words, min_words=6, min_power=4):
    """Every maximal stretch of each period; a stretch keeps its smallest one."""
    n, seen = len(words), {}
    for q in range(1, n // min_power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_words, min_power * q):
                seen.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted([(a, b, q) for (a, b), q in seen.items()], key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for a, b, q in runs for i in range(a + q, a + b)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(rng, size):
    kinds = rng.choice([1, 2, 3, 5, 40])
    w = [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(size))]
    if rng.random() < 0.6 and w:
        p, a = rng.randrange(1, 9), rng.randrange(len(w))
        w = w[:a] + (w[a:a + p] * size)[:len(w) - a] + [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(7))]
    return w


@pytest.mark.parametrize("min_words,min_power", [(6, 4), (2, 2), (12, 3)])
def test_runs_of_one_sequence(min_words, min_power):
    rng = random.Random(min_words)
    for _ in range(500):
        w = periodic(rng, 60)
        got = pr.runs_of(np.array([int(x[1:]) for x in w], np.int64), min_words, min_power)
        assert [tuple(r) for r in got.tolist()] == plain_runs(w, min_words, min_power)


def test_search_of_a_slice_skips_nothing():
    rng = random.Random(9)
    texts = [periodic(rng, 80) for _ in range(400)] + [[], ["w1"] * 5, ["w1"] * 6, []]
    found = pr.search([[x.encode() for x in t] for t in texts])
    assert [[tuple(r) for r in f.tolist()] for f in found] == [plain_runs(t) for t in texts]
    assert sum(len(f) > 0 for f in found) > 50


def test_extensions_are_exact():
    rng = random.Random(2)
    s = [rng.randrange(1, 3) for _ in range(90)]
    e = pr.Extension(*pr.tour(*pr.suffix_tree([*s, 0], 3), 3))
    i, j = np.array([(a, b) for a in range(90) for b in range(90) if a != b]).T
    for a, b, n in zip(i.tolist(), j.tolist(), e(i, j).tolist()):
        assert s[a:a + n] == s[b:b + n] and (max(a, b) + n == 90 or s[a + n] != s[b + n])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = [(i, " \n".join(periodic(rng, 70))) for i in range(200)]
    return out + [(7, out[7][1]), (900, None), (901, ""), (902, " \t"), (None, "a " * 12), (903, "lo ng " * 4000), (904, "x" * 50_000)]


def test_operator_and_its_text(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, runs string, length long").repartition(3)
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in pr.periodic_runs(docs).collect()), key=repr)
    want = []
    for k, t in rows:
        w = (t or "").split()
        runs = plain_runs(w) if len(w) < 1000 else [(0, 8000, 2)]
        want.append((-1 if k is None else k, runs, plain_collapse(w, runs)))
    assert got == sorted(want, key=repr)


def test_digests(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in pr.run_digests(docs).collect()), key=repr)
    want, changed = [], 0
    for k, t in rows:
        w = (t or "").split()
        h = zlib.crc32(str(k).encode())
        if k is not None and h % 10 == 0 and w:
            g = h // 10
            a, n = g % len(w), len(w)
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs = plain_runs(w) if len(w) < 1000 else [(0, 8000, 2)]
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        want.append((k, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
                     hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
                     hashlib.sha256(plain_collapse(w, runs).encode()).hexdigest()))
    assert changed > 10 and got == sorted(want, key=repr)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pr.periodic_runs(none).count() == 0 and pr.run_digests(none).count() == 0
