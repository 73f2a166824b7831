"""Operators against brute force on small tables: nulls, empty texts, ties, repeated rows, clashing names."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from riskweave.llm import (common, decontamination, linededup, mixing, neighbours, quoting, scoring, sharding, simhash,
                           toxicity, warc)
from riskweave.session import shared_root

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "zeta"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randrange(1, 60)), "en", rng.choice(["a", "b", None]), 1) for i in range(120)]
    base = rows[7][1] + " " + words(rng, 80)
    rows += [(200 + i, base + (" x" * (i % 2)), "en", "a", 1) for i in range(30)]
    rows += [(300, None, None, None, None), (301, "", "en", "b", 0), (302, " \t\n", "en", "b", 0), (None, "lonely words here", "en", "a", 1)]
    rows += [rows[3], rows[3], (303, "Only One", "en", "c", 1), (304, words(rng, 30_000), "fr", "c", 1)]
    return spark.createDataFrame(rows, DOC).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def union_groups(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


def test_simhash_groups(spark, corpus):
    rows = [r for r in corpus.select("doc_id", "text").collect()]
    fps = [plain_fingerprint(r.text) for r in rows]
    top = union_groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for r, t in zip(rows, top):
        if r.doc_id is not None:
            least[t] = min(least.get(t, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{f:016x}", least.get(t)) for r, f, t in zip(rows, fps, top))
    got = simhash.near_duplicates(corpus.withColumnRenamed("lang", "fp").withColumnRenamed("source", "key"))
    assert Counter(tuple(r) for r in got.collect()) == want
    kept = simhash.keep_one(corpus)
    assert kept.columns == corpus.columns and kept.count() == len(set(top))


def test_near_copies_by_five_word_shingles(spark):
    rng = random.Random(21)
    texts = []
    for i in range(40):
        x = words(rng, rng.randrange(60, 150)).split()
        y = list(x)
        y[rng.choice([2, len(x) // 2])] = "changed"
        z = [w if k % 9 else "other" for k, w in enumerate(x)]
        texts += [" ".join(x), " ".join(y).upper(), " ".join(z)]
    texts += ["", " \n", "two words", "Two  Words"] + [f"{texts[0]} {n}" for n in range(50)]
    sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    like = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = sorted(set(union_groups(len(texts), like)))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOC).repartition(3)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == want and 80 <= len(want) < 90


def test_split_posting_lists(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2 ** 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 40, (300, 2))} | {int(x) for x in rng.integers(0, 2 ** 62, 200)})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = union_groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    for size in (65_536, 40):
        roots = {r.node: r.root for r in common.components(simhash.links(frame, size)).collect()}
        got = [roots.get(f, f) for f in fps]
        assert [fps[t] for t in want] == got


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 160)] + [(5, 5), (159, 100)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{j: 100 for j in range(100, 160)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 10, 99, 100, 101, 1000])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    steps = sharding.walk_steps(spark, n, 42) if n else 1
    got = spark.range(n).select(sharding.permute(F.col("id"), n, steps, 42).alias("p")).collect() if n else []
    assert sorted(r.p for r in got) == list(range(n))


def test_shards(spark, corpus, empty):
    one, two = (sorted(map(tuple, sharding.shard_documents(d).collect()), key=str) for d in (corpus, corpus.repartition(3)))
    assert one == two and len(one) == corpus.count()
    per = {}
    for doc_id, size, crc, law, shard, slot, grown in one:
        per.setdefault(shard, []).append(slot)
        assert law == "rows" and grown is None
    assert all(sorted(s) == list(range(len(s))) for s in per.values()) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 16, None if r.text is None else zlib.crc32(r.text.encode())) for r in corpus.collect())
    assert Counter(x[:3] for x in one) == texts
    assert sharding.shard_documents(empty).count() == 0


def plain_targets(sizes):
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        free = sum(w[s] for s in sizes if s not in stopped)
        level = (left - sum(2 * sizes[s] for s in stopped)) / free if free else 0
        over = {s for s in sizes if s not in stopped and level * w[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in stopped else level * w[s] for s in sizes}
        stopped |= over


def test_mixing(spark, corpus, empty):
    rows = corpus.collect()
    count = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for r in rows:
        sizes[r.source] += count(r.text)
    goal = plain_targets(dict(sizes))
    got = mixing.mix(corpus).collect()
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(taken[s] == math.floor(goal[s] + 0.5) for s in goal)
    mixed = mixing.mixed_texts(corpus)
    assert mixed.columns == corpus.columns
    again = Counter()
    for r in mixed.collect():
        again[r.source] += count(r.text)
    assert again == +taken
    assert mixing.mix_documents(empty).count() == 0 and mixing.mixed_texts(empty).count() == 0


def test_decontamination(spark, empty):
    rng = random.Random(3)
    items = [(i, words(rng, 12).capitalize() + ". Then " + words(rng, 9) + ".") for i in range(40)] + [(50, None), (51, ""), (52, "single"), (53, words(rng, 300))]
    bench = spark.createDataFrame(items + items[:1], "item_id long, text string")
    docs = [(i, words(rng, 400), "en", "a", 1) for i in range(30)]
    docs += [(100 + i, words(rng, 70) + " " + items[i][1].upper() + " " + words(rng, 50), "en", "a", 1) for i in range(40)]
    docs += [(200, items[43][1], "en", "a", 1), (300, None, None, None, None), (301, "", None, None, None)]
    frame = spark.createDataFrame(docs, DOC)
    got = decontamination.contaminated(frame, bench)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(100 + i, i) for i in range(40)] + [(200, 53)]
    clean = decontamination.decontaminate(frame, bench)
    assert clean.columns == frame.columns and sorted(r.doc_id for r in clean.collect()) == [*range(30), 300, 301]
    assert decontamination.contaminated(frame, bench.limit(0)).count() == 0 and decontamination.contaminated(empty, bench).count() == 0


def test_block_max_wand_finds_all(spark):
    rng = random.Random(9)
    bench = spark.createDataFrame([(i, words(rng, rng.randrange(2, 20))) for i in range(150)], "item_id long, text string")
    index = next(decontamination._indexes(bench))
    weights = {}
    for t, (segs, w, _) in enumerate(index.lists):
        for s, x in zip(segs, w):
            weights.setdefault(s, {})[t] = x
    for _ in range(60):
        query = sorted(rng.sample(range(len(index.lists)), 200))
        for limit in (0.1, 0.3):
            want = {s for s, ts in weights.items() if sum(ts.get(t, 0.0) for t in query) >= limit}
            assert {s for s, _ in index.search(query, limit)} == want


def test_line_dedup(spark, empty):
    rng = random.Random(2)
    common_line = "this very long line of licence words " + words(rng, 40)
    near = common_line.replace("licence", "license")
    docs = [(i, "\n".join([words(rng, 9), common_line if i % 2 else near, "", "  "]), "en", "a", 1) for i in range(20)]
    docs += [(50, None, None, None, None), (51, "", None, None, None), (None, common_line, None, None, None), docs[0], docs[0]]
    frame = spark.createDataFrame(docs, DOC).withColumnRenamed("lang", "node").withColumnRenamed("source", "list")
    rows = linededup.dedup_lines(frame).collect()
    held = [x for r in rows for x in (r.text or "").split("\n") if x in (common_line, near)]
    linked = (int(simhash_of_words(common_line)) ^ int(simhash_of_words(near))).bit_count() <= 3
    assert len(held) == (1 if linked else 2)
    assert sum(1 for r in rows if r.doc_id == 0 and r.n_removed == 0) == 1 and sum(1 for r in rows if r.doc_id == 0 and r.n_removed == 2) == 2
    assert [r.n_lines for r in rows if r.doc_id == 50] == [0] and [r.n_removed for r in rows if r.doc_id is None] == [1]
    assert linededup.dedup_lines(empty).count() == 0


def simhash_of_words(line):
    hs = [xxhash.xxh64_intdigest(w.encode(), 42) for w in set(line.lower().split())]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_line_fingerprints(spark, corpus):
    lines = linededup.lines_of(corpus)
    got = linededup.simhash(lines).select("_id", "_key", "no", "fp")
    joined = lines.select("_id", "_key", "no", "norm").distinct().join(got.distinct(), ["_id", "_key", "no"]).collect()
    assert joined and all(r.fp % 2 ** 64 == simhash_of_words(r.norm) for r in joined if len(r.norm) < 5_000)


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def test_edit_similarity_of_pairs(spark):
    rng = random.Random(8)
    texts, pairs = [], []
    for _ in range(120):
        x = words(rng, rng.randrange(1, 12)).split(" ")
        y = list(x)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(y) + 1)
            y[at:at + rng.randrange(2)] = rng.choice([[], [rng.choice("abc") * rng.randrange(1, 9)], [words(rng, 1)]])
        x, y = " ".join(x), " ".join(y)
        if x != y and y:
            pairs.append((2 * len(pairs), 2 * len(pairs) + 1))
            texts += [(pairs[-1][0], x), (pairs[-1][1], y)]
    norm = dict(texts)
    want = {(a, b) for a, b in pairs if edit_distance(norm[a], norm[b]) <= 0.2 * max(len(norm[a]), len(norm[b])) + 1e-9}
    got = linededup.verified(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(texts, "node long, norm string"))
    assert {(r.a, r.b) for r in got.collect()} == want and 0 < len(want) < len(pairs)


def test_like_lines_reach_the_edit_check(spark):
    rng = random.Random(11)
    lines = []
    for i in range(120):
        x = words(rng, rng.randrange(3, 40))
        y = list(x)
        for _ in range(max(1, int(len(x) * rng.choice([0.01, 0.05, 0.1])))):
            y[rng.randrange(len(y))] = rng.choice("abcdefgh")
        lines += [x, "".join(y)]
    near = [(i, j) for i in range(len(lines)) for j in range(i) if len(set(lines[i].split()) & set(lines[j].split())) * 3 > len(lines[i].split())]
    near = set(near) | {(i, i - 1) for i in range(1, len(lines), 2)}
    like = [(i, j) for i, j in near if edit_distance(lines[i], lines[j]) <= 0.2 * max(len(lines[i]), len(lines[j])) + 1e-9]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    root = {int(r._id): r.root for r in linededup.line_groups(docs).collect()}
    assert len(like) >= 110 and sum(root[i] == root[j] for i, j in like) >= 0.85 * len(like)
    assert len(set(root.values())) >= len(set(union_groups(len(lines), like)))


def test_fingerprints_of_long_lines_and_repeated_rows(spark):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(9000)}" for _ in range(15_000))
    docs = spark.createDataFrame([(1, long + "\nshort  line"), (2, "short line")] + [(3, "same row here")] * 3, "doc_id long, text string")
    rows = linededup.named_lines(docs).collect()
    assert len(long) > linededup.LONG_LINE and len(rows) == 6
    assert Counter(r.fp % 2 ** 64 for r in rows) == Counter(map(simhash_of_words, [long] + ["short line"] * 2 + ["same row here"] * 3))


def test_pairs_of_long_lists_meet_in_cells(spark, monkeypatch):
    monkeypatch.setattr(linededup, "CELL", 8)
    monkeypatch.setattr(linededup, "AT_ONCE", 10)
    rng = random.Random(21)
    norm, root = {}, {}
    for i in range(30):
        x = words(rng, rng.randrange(3, 12))
        norm[2 * i], norm[2 * i + 1] = x, x[:-1] + rng.choice(["", "qq", " and many more words than it had before"])
        root[2 * i], root[2 * i + 1] = 2 * i, 2 * i + rng.randrange(2)
    lists = {7: range(45), 8: range(30, 60), 9: range(3)}
    rows = [(k, i, len(norm[i]), 0, len(held), root[i]) for k, held in lists.items() for i in held]
    rest = spark.createDataFrame(rows, "list long, node long, size int, fp long, n long, root long")
    texts = spark.createDataFrame(list(norm.items()), "node long, norm string").withColumn("part", linededup.part("node", 3))
    want = {(i, j) for held in lists.values() for i in held for j in held if i < j and root[i] != root[j]
            and edit_distance(norm[i], norm[j]) <= 0.2 * max(len(norm[i]), len(norm[j])) + 1e-9}
    for n_texts in (1_000, 80):
        got = linededup.met_in_cells(rest, texts, 3, n_texts, linededup.Stages(spark)).collect()
        assert {(r.a, r.b) for r in got} == want and 3 < len(want) < 30


def bytes_below(*folders):
    return sum(os.lstat(f"{d}/{x}").st_size for top in folders for d, _, names in os.walk(top) for x in names)


def test_texts_of_pairs_are_not_kept(spark):
    rng = random.Random(31)
    lines = ["".join(rng.choice("abc") for _ in range(160)) for _ in range(400)]
    copies = {400 + i: 7 * i for i in range(20)}
    lines += [lines[i][:-3] + "xyz" for i in copies.values()]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    folder = shared_root(spark).removeprefix("file://")
    before = bytes_below(folder)
    root = {int(r._id): r.root for r in linededup.line_groups(docs).collect()}
    assert bytes_below(folder) - before < 2 * sum(map(len, lines))
    assert all(root[i] == root[j] for i, j in copies.items()) and len(set(root.values())) == 400


def test_warc_round_trip(spark):
    rows = [(1, "u", "a\r\n\r\nWARC/1.1 b"), (2, "u", "a\r\n\r\nWARC/1.1 b"), (2, "u", "a\r\n\r\nWARC/1.1 b"), (None, None, None), (7, "é\nx", ""),
            (None, "q", "ü"), (3, "http://x", "\r\n\r\n"), (4, "http://x", "y" * 100_000)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = Counter(tuple(r) for r in warc.page_captures(pages).collect())
    first = {}
    for p, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", p)
    want, used = Counter(), set()
    for p, _, h in rows:
        h = h or ""
        fresh = first[h] == p and h not in used
        used |= {h} if fresh else set()
        want[(p, len(h.encode()), warc.base32_sha1(h.encode()), "response" if fresh else "revisit", None if fresh else first[h])] += 1
    assert got == want
    nested = warc.captures(pages).collect()
    assert all(r.request and r.response and r.metadata and r.response.sound for r in nested) and len(nested) == len(rows)
    assert warc.page_captures(pages.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, x[i].tolist(), 0) for i in range(900)] + [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [math.nan] * 16, 0), (1060, [None] * 16, 0)]
    frame = spark.createDataFrame(rows + rows[:1], "vec_id long, embedding array<float>, label int")
    got = {}
    for r in neighbours.nearest_neighbours(frame).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    d, found = x.astype(np.float64), []
    for q in range(0, 900, 20):
        s = d @ d[q]
        ids = [int(i) for i in np.lexsort((np.arange(900), -np.round(s, 9))) if i != q][:20]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(abs(v - s[i]) < 1e-9 for _, i, v in mine)
        found.append(len(set(ids) & {i for _, i, _ in mine}) / 20)
    assert set(got) == set(range(0, 900, 20)) and np.mean(found) >= 0.9
    assert neighbours.nearest_neighbours(frame.limit(0)).count() == 0


def test_quoting(spark):
    m = [(1, 0, "user", "First thing\nsecond thing"), (1, 1, "assistant", "> first   THING\nanswer one"), (1, 2, "user", "no quotes"),
         (1, 3, "user", "> answer one\n> > First thing\nmore"), (1, 4, "user", "> unknown words\nlost"), (2, 0, "user", None), (2, 1, "user", "> first thing\n"),
         (None, 0, "user", "x"), (3, None, "user", "> x"), (1, 2, "user", "no quotes")]
    got = {(r.conv_id, r.turn): r for r in quoting.conversations(spark.createDataFrame(m, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 1].reply_to == 0 and got[1, 3].reply_to == 1 and got[1, 4].reply_to is None and got[2, 1].reply_to is None
    assert (got[1, 3].thread, got[1, 3].depth, got[1, 3].quote_level, got[1, 3].text) == (0, 2, 2, "more")
    assert got[1, 3].position == 2 and got[1, 0].position == 0 and got[1, 1].position == 1


def test_toxicity(spark, empty):
    rng = random.Random(6)
    docs = [(i, words(rng, 30) + (" you vile wretch " + words(rng, 5) if i % 4 == 0 else ""), "en", "a", 1) for i in range(400)]
    docs += [(900, None, None, None, None), (901, "", None, None, None)]
    frame = spark.createDataFrame(docs, DOC)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_documents(frame, labels).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) / len(held) > 0.95
    assert toxicity.drop_toxic(frame, labels).columns == frame.columns
    assert toxicity.score_documents(frame, labels.limit(0)).count() == len(docs) and toxicity.score_documents(empty, labels).count() == 0


def test_scoring(spark, corpus, empty, monkeypatch):
    monkeypatch.setattr(scoring, "STEPS", 60)
    monkeypatch.setattr(scoring, "DICTIONARY", 100)
    rows = corpus.select("doc_id", "text").collect()
    toks = [(r.text or "").encode().lower().split() + [b""] for r in rows]
    train = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2 for r in rows]
    c = Counter(w for t, k in zip(toks, train) if k for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((r.doc_id, not k, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5))
                   for r, t, k in zip(rows, toks, train))
    got = scoring.score_documents(corpus).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score <= 1e-6 for r in got)
    assert scoring.score_documents(empty).count() == 0


def test_near_copies_of_the_pipeline_start_from_simhashes(spark, monkeypatch):
    """Fingerprints within three bits, equal ones among them, give the first pairs that keep_one verifies."""
    marks = spark.createDataFrame([(1, 0), (2, 0), (3, 0b111), (4, 0b1111 << 20), (5, -1), (6, -2)], "node long, fp long")
    roots = {r.node: r.root for r in common.components(simhash.fingerprint_pairs(marks)).collect()}
    assert roots == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    seen, roots_of = [], simhash.copy_roots
    monkeypatch.setattr(simhash, "copy_roots", lambda lists, texts, pairs: seen.append(pairs.count()) or roots_of(lists, texts, pairs))
    words = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(1, words), (2, words + " end"), (3, "other words stand here " * 9)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3] and seen == [1]


def test_half_alike_texts_are_compared_without_a_row_for_each_pair(spark, monkeypatch):
    """Groups of half-alike texts: the same groups as by brute force, and only the pairs with one member of each list are rows."""
    rng = random.Random(3)
    base, texts = [f"w{i}" for i in range(100)], []
    for _ in range(90):
        words = list(rng.choice(texts)) if texts and rng.random() < 0.5 else list(base)
        for _ in range(rng.randint(2, 5)):
            words[rng.randrange(100)] = f"x{rng.random()}"
        texts.append(words)
    sets = [set(simhash.shingle_hashes(" ".join(t)).tolist()) for t in texts]
    near = [(i, j) for i in range(90) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = list(range(90))
    for _ in range(90):
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    monkeypatch.setattr(simhash, "COPY_CELL", 16)
    tried, check = [], simhash._copy_links
    monkeypatch.setattr(simhash, "_copy_links", lambda pairs, t: tried.append(pairs.count()) or check(pairs, t))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(root)) and 5 < len(set(root)) < 85
    assert sum(tried) < 6 * 90


def test_members_of_a_cell_by_parts():
    """In a cell of two parts only pairs between them count; what is one group already is not compared."""
    words = " ".join(f"w{i}" for i in range(60))
    texts, nodes = [words, words + " a", words + " b", "quite another text"], np.arange(4)
    a, b = simhash.linked_members(nodes, nodes, np.array([0, 0, 1, 1]), texts)
    assert sorted(map(sorted, zip(a, b))) == [[0, 2], [1, 2]]
    assert simhash.linked_members(nodes, np.array([7, 7, 7, 8]), np.zeros(4, int), texts) == ([], [])
    assert len(simhash.linked_members(nodes, nodes, np.zeros(4, int), texts)[0]) == 2
