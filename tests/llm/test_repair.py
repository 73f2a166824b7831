"""Conversation repair against a plain search over whole audits, one conversation at a time."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from riskweave.llm import repair

MESSAGE = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        t = text.strip(WHITE)
        out.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Cost, audit and lines; grammar states by hand: 0 start, 1 system, 2 user, 3 assistant."""
    faults = plain_faults(rows)

    def follow(state, initial):
        return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, initial))

    @lru_cache(None)
    def best(i, state, inserted):
        offers = []
        if i == len(rows):
            if state in (0, 3):
                offers.append((0, "", ()))
        else:
            fault = faults[i]
            offers.append((i + 1, state, 3, "D", None))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                offers.append((i + 1, follow(state, rows[i][1][:1]), int(extra), "K", rows[i][1]))
                offers += [(i + 1, follow(state, r[0]), 2 + extra, "R", r) for r in ("user", "assistant")]
        if inserted < 3:
            offers += [(i, follow(state, r[0]), 2, "I", r) for r in ("user", "assistant")]
        found = [o for o in offers if len(o) == 3]
        for o in offers:
            if len(o) == 5 and o[1] is not None:
                rest = best(o[0], o[1], inserted + 1 if o[3] == "I" else 0)
                if rest:
                    line = () if o[4] is None else (f"{o[4]}:{'' if o[3] == 'I' else rows[i][2]}",)
                    found.append((o[2] + rest[0], o[3] + rest[1], line + rest[2]))
        return min(found) if found else None

    cost, audit, lines = best(0, 0, 0)
    return cost, audit, "\n".join(lines)


def plain_digests(rows, ids):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role, text))
    out = []
    for conv in ids:
        g = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        turns = [r[0] for r in g if r[0] is not None]
        faults = plain_faults(g)
        cost, audit, text = plain_repair(g)
        initials = [r[1][:1] for r in g]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def chats(rng, count):
    rows = []
    for conv in range(count):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["One.", "Two!", "no end", "", " \n", None, "Why?  ", "dots . . .", f"text {turn}.", "ünï"])
            rows.append((conv if conv != 5 else None, turn if rng.random() < 0.9 else None, role, text))
    return rows + rows[7:10]


def got(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_small_conversations(spark):
    rows = chats(random.Random(1), 300)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], MESSAGE + ", cost int, _at string").repartition(3)
    ids = {r[0] for r in rows}
    assert got(repair.repair_damaged(df)) == plain_digests(plain_damage(rows), ids)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got(repair.repair_digests(df)) == plain_digests(clean, ids)


def test_blocks_meet_without_a_seam(spark, monkeypatch):
    """Pieces of four rows give what one piece gives; ties reach across pieces."""
    monkeypatch.setattr(repair, "BLOCK_BITS", 2)
    rows = chats(random.Random(2), 60) + [(500, i, ("user", "assistant", "system")[i * 7 % 3], f"{i % 11}{'.' if i % 3 else ''}") for i in range(120)]
    df = spark.createDataFrame(rows, MESSAGE)
    assert got(repair.repair_damaged(df)) == plain_digests(plain_damage(rows), {r[0] for r in rows})


def test_messages_follow_the_grammar(spark):
    rows = chats(random.Random(3), 80) + [(700, i, "user" if i % 2 else "assistant", "long " * 3000 + f"{i}.") for i in range(1500)]
    out = repair.repaired_messages(spark.createDataFrame(rows, MESSAGE)).orderBy("conv", "position").collect()
    groups = defaultdict(list)
    for r in out:
        groups[r["conv"]].append(r)
    import re
    for g in groups.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in g))
        assert [r["position"] for r in g] == list(range(len(g))) and all((r["edit"] == "I") == (r["text"] == "") for r in g)
    assert len(groups["700"]) == 1502 and [r["edit"] for r in groups["700"]].count("I") == 2


def test_suffixes_are_shared():
    import pyarrow as pa
    shapes = sorted(["8c8c", "c8c", "98c8c", "c8c8c", "xx8c"], key=lambda s: s[::-1])
    made = []
    plain = repair.extend
    repair.extend = lambda choices, after: made.append(1) or plain(choices, after)
    try:
        batch = next(repair.walk(iter([pa.record_batch({"shape": pa.array(shapes)})])))
    finally:
        repair.extend = plain
    assert len(made) == 8  # c, 8c, c8c, 8c8c, 98c8c, c8c8c, x8c, xx8c: 21 rows, eight distinct suffixes
    assert [r["cost"][3] for r in batch.to_pylist()] == [min(x, repair.NEVER) for x in [r["cost"][3] for r in batch.to_pylist()]]


def test_no_rows_and_all_dropped(spark):
    none = spark.createDataFrame([], MESSAGE)
    assert got(repair.repair_damaged(none)) == [] and repair.repaired_messages(none).count() == 0
    gone = next(c for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.")], MESSAGE)
    assert got(repair.repair_damaged(df)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
