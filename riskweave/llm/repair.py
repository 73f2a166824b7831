"""Conversation structure repair: cheapest edits by cost-to-go over a suffix-shared automaton of row signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.session import cut_lineage

BLOCK_BITS = 10  # rows of a conversation in one signature: at most 2 ** 10
SPACES = " \t\n\x0b\x0c\r"
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
#: Grammar (s?(ua)+)? as states: nothing yet, after s, after u, after a; next state by role initial.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
STATES = len(NEXT)
#: Inserts that end a conversation from each state.
ENDINGS = ("", "UA", "A", "")
DELETE, REROLE, INSERT = 3, 2, 2
ROLES = {"u": "user", "a": "assistant"}
NEVER = 1 << 50
#: Edits are kept with their role: U, A insert, u, a rerole, K keep, D delete.
SHOWN = str.maketrans("UAua", "IIRR")


def damage(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults planted by the checksum of ``conv_id:turn``; nulls read as one space.

    Of twenty rows one is dropped, one emptied, one loses its sentence marks, one stands twice and one becomes a user's.
    """
    plain = messages.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = plain.withColumn("_hit", F.crc32(name) % 20).filter("_hit <> 0")
    return hit.select(
        "conv_id", "turn", F.when(F.col("_hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_twice")).drop("_twice")


def _key(conv_id: Column) -> Column:
    """A conversation's name that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def placed(messages: DataFrame) -> DataFrame:
    """Rows in the order of conversation, turn (nulls first), role and text, written with a rising number _at.

    The order is cut into ranges, so a conversation of any size is spread over them; numbers have no gaps
    within a range. Rows that are equal in all four columns are interchangeable and spread by a salt.
    """
    rows = messages.select(_key(F.col("conv_id")).alias("_c"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    keys = ["_c", "turn", "role", "_h", "_salt"]
    ordered = rows.withColumns({"_h": F.md5("text"), "_salt": F.monotonically_increasing_id() % 1024})
    return cut_lineage(ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt").withColumn("_at", F.monotonically_increasing_id()))


def signatures(rows: DataFrame) -> DataFrame:
    """(_c, turn, _at, fault, sign): each row's first fault, and role and fault as one hexadecimal digit.

    A row is a duplicate if its role and text have an earlier row in the conversation: every other row than the
    first of its group. First rows are found by one aggregation and meet the rows by their unique number.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    marks = rows.select("_c", "turn", "_at", "role", "_h", (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"))
    firsts = marks.filter("NOT blank").groupBy("_c", "role", "_h").agg(F.min("_at").alias("_at")).select("_at", F.lit(True).alias("first"))
    fault = (F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(SOUND))
    kind = F.position(F.substring("role", 1, 1), F.lit("sua"))
    kind = F.when(F.col("role") == "", 0).otherwise(kind)
    return marks.join(firsts, "_at", "left").select("_c", "turn", "_at", fault.alias("fault"), F.lower(F.hex(kind * 4 + fault)).alias("sign"))


def blocks(signs: DataFrame) -> DataFrame:
    """(_c, _block, _at of its first row, signs): the rows of a conversation in pieces of at most 2 ** BLOCK_BITS."""
    grouped = signs.groupBy("_c", F.shiftright("_at", BLOCK_BITS).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("_at", "sign"))).alias("l"))
    return grouped.select("_c", "_block", F.col("l")[0]["_at"].alias("_at"), F.array_join(F.transform("l", lambda x: x["sign"]), "").alias("signs"))


def shape(signs: Column) -> Column:
    """Signature for the automaton: the role of a row that must go does not matter."""
    return F.translate(signs, "2367abef", "x" * 8)


def _choices(sign: str) -> list[list[tuple[int, str, int]]]:
    """Per state: (cost, edits, next state) of all ways to take one row, inserts before it included; the best for each next state."""
    must_go = sign == "x"
    value = 0 if must_go else int(sign, 16)
    role, extra = " sua"[value >> 2], int(value & 3 == TRUNCATED)
    out = []
    for s in range(STATES):
        ways, state, paid, before = {}, s, 0, ""
        for _ in range(3):
            steps = [(DELETE, "D", state)]
            if not must_go:
                steps += [(extra, "K", NEXT[state][role])] if role in NEXT[state] else []
                steps += [(REROLE + extra, r, NEXT[state][r]) for r in "ua" if r in NEXT[state]]
            for cost, edit, t in steps:
                offer = (paid + cost, (before + edit).translate(SHOWN), before + edit)
                ways[t] = min(ways.get(t, offer), offer)
            r = "u" if "u" in NEXT[state] else "a"
            state, paid, before = NEXT[state][r], paid + INSERT, before + r.upper()
        out.append([(c, edits, t) for t, (c, _, edits) in sorted(ways.items())])
    return out


class Node:
    """One suffix of signatures: for each state before and after it the least cost, the edits of its first row,
    the state behind that row, and the rank of its audit among all of the node (by ASCII)."""

    __slots__ = ("cost", "edits", "step", "rank")

    def __init__(self, cost, edits, step, rank):
        self.cost, self.edits, self.step, self.rank = cost, edits, step, rank


def end_node() -> Node:
    return Node([0 if s == t else NEVER for s in range(STATES) for t in range(STATES)], [""] * 16, [0] * 16, [0] * 16)


def extend(choices: list[list[tuple[int, str, int]]], after: Node) -> Node:
    """The node of one more row before *after*.

    Audits that start alike are told apart by the ranks of what follows; every row's part ends with one of
    D, K and R, so parts of equal cost never are prefixes of one another.
    """
    cost, edits, step, keys = [], [], [], []
    for s in range(STATES):
        for t in range(STATES):
            best = min((c + after.cost[n * STATES + t], e.translate(SHOWN), after.rank[n * STATES + t], e, n) for c, e, n in choices[s])
            cost.append(min(best[0], NEVER))
            keys.append((best[1], best[2]) if best[0] < NEVER else ("~", 0))
            edits.append(best[3])
            step.append(best[4])
    place = {k: i for i, k in enumerate(sorted(set(keys)))}
    return Node(cost, edits, step, [place[k] for k in keys])


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs, ranks and edits of signatures that come sorted from their ends.

    Signatures that end alike share their nodes: with that order the open path is all of the automaton that
    is needed, and each node is made once.
    """
    known: dict[str, list] = {}
    path, last = [end_node()], ""
    for batch in batches:
        names, costs, ranks, audits = batch.column("shape").to_pylist(), [], [], []
        for name in names:
            back = name[::-1]
            same, most = 0, min(len(back), len(last))
            while same < most and back[same] == last[same]:
                same += 1
            del path[same + 1:]
            for sign in back[same:]:
                if sign not in known:
                    known[sign] = _choices(sign)
                path.append(extend(known[sign], path[-1]))
            last = back
            top = path[-1]
            costs.append(top.cost)
            ranks.append(top.rank)
            found = []
            for i in range(STATES * STATES):
                if top.cost[i] >= NEVER:
                    found.append(None)
                    continue
                parts, s, t = [], i // STATES, i % STATES
                for node in reversed(path[1:]):
                    parts.append(node.edits[s * STATES + t])
                    s = node.step[s * STATES + t]
                found.append("".join(parts))
            audits.append(found)
        yield pa.record_batch({"shape": batch.column("shape"), "cost": pa.array(costs, pa.list_(pa.int64())),
                               "rank": pa.array(ranks, pa.list_(pa.int64())), "edits": pa.array(audits, pa.list_(pa.string()))})


def automaton(shapes: DataFrame) -> DataFrame:
    """(shape, cost, rank, edits) of each distinct signature: arrays by 4 * state before + state behind."""
    back = F.reverse("shape")
    ordered = shapes.repartitionByRange(back).sortWithinPartitions(back)
    return ordered.mapInArrow(walk, "shape string, cost array<long>, rank array<long>, edits array<string>")


def _illegal(signs: str, before: str) -> int:
    initials = before + "".join(" sua"[int(x, 16) >> 2] for x in signs)
    return sum(initials[i:i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of each conversation through its blocks, which come from the last to the first.

    A block is 32 small numbers here; of a conversation only the chosen states of its blocks are kept.
    """
    def finish(name, kept, cost):
        out, s = [], 0
        previous = ""
        for i, (block, at, shape_, signs, picks) in enumerate(reversed(kept)):
            t = picks[s]
            done = i == len(kept) - 1
            out.append((name, block, at, shape_, s * STATES + t, ENDINGS[t] if done else "", cost if i == 0 else 0, _illegal(signs, previous)))
            s, previous = t, " sua"[int(signs[-1], 16) >> 2]
        return out

    names = ["_c", "_block", "_at", "shape", "pick", "tail", "cost", "illegal"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    current, kept, cost, rank = None, [], [], []
    out: list[tuple] = []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("_c", "_block", "_at", "shape", "signs", "cost", "rank")]):
            name, block, at, shape_, signs, costs, ranks = row
            if name != current:
                if kept:
                    out += finish(current, kept, cost[0])
                current, kept = name, []
                cost, rank = [INSERT * len(e) for e in ENDINGS], [len(e) for e in ENDINGS]
            picks, fresh, keys = [], [], []
            for s in range(STATES):
                best = min((costs[s * STATES + t] + cost[t], ranks[s * STATES + t], rank[t], t) for t in range(STATES))
                picks.append(best[3])
                fresh.append(best[0])
                keys.append(best[1:3])
            place = {k: i for i, k in enumerate(sorted(set(keys)))}
            cost, rank = fresh, [place[k] for k in keys]
            kept.append((block, at, shape_, signs, picks))
        if len(out) > 20_000:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out = []
    if kept:
        out += finish(current, kept, cost[0])
    if out:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def edit_plan(rows: DataFrame, signs: DataFrame) -> DataFrame:
    """(_c, _at, edits, tail, cost, illegal) of each block of placed rows: its edits, and the inserts behind the last one."""
    parts = cut_lineage(blocks(signs).withColumn("shape", shape(F.col("signs"))))
    table = cut_lineage(automaton(parts.select("shape").distinct()))
    ready = parts.join(table.select("shape", "cost", "rank"), "shape").repartition("_c").sortWithinPartitions("_c", F.desc("_block"))
    chosen = ready.mapInArrow(choose, "_c string, _block long, _at long, shape string, pick int, tail string, cost long, illegal long")
    return chosen.join(table.select("shape", "edits"), "shape").select(
        "_c", "_at", F.get("edits", F.col("pick")).alias("edits"), "tail", "cost", "illegal")


def _stream(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows and blocks of edits of each conversation in one sorted stream, each block before its rows."""
    texts = rows.select("_c", "_at", F.lit(1).alias("_kind"), "role", "text", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("edits", "string"), ("tail", "string"), ("cost", "long"), ("illegal", "long"))])
    heads = plan.select("_c", "_at", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
                        "edits", "tail", "cost", "illegal")
    return texts.unionByName(heads).repartition("_c").sortWithinPartitions("_c", "_at", "_kind")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, head or None, repaired (edit, role, text)) in order; a conversation's end inserts come last."""
    current, tail, edits, at = None, "", "", 0
    for batch in batches:
        columns = [batch.column(c) for c in ("_c", "_kind", "role", "text", "edits", "tail", "cost", "illegal")]
        for i in range(batch.num_rows):
            name, kind, role, text, e, t, cost, illegal = (c[i].as_py() for c in columns)
            if name != current:
                if current is not None:
                    yield current, None, [(x, ROLES[x.lower()], "") for x in tail]
                current, tail = name, ""
            if kind == 0:
                edits, tail, at = e, t, 0
                yield name, (e + t, cost, illegal), []
                continue
            made = []
            while edits[at] in "UA":
                made.append((edits[at], ROLES[edits[at].lower()], ""))
                at += 1
            x = edits[at]
            at += 1
            if x != "D":
                made.append((x, role if x == "K" else ROLES[x], text))
            yield name, None, made
    if current is not None:
        yield current, None, [(x, ROLES[x.lower()], "") for x in tail]


def repaired_messages(messages: DataFrame) -> DataFrame:
    """The messages of every conversation after its cheapest repair: conv (the id as text, null for a null id),
    position from 0, role, text and edit (K kept, R with another role, I inserted with an empty text).

    A conversation follows the grammar (system? (user assistant)+)? by role initials afterwards; blank rows and
    repetitions are gone. Of plans of equal cost the one with the ASCII-least string of edits is taken. A null role or
    text reads as one space: no role of the grammar, and blank; an empty role has no initial and cannot be
    kept. Rows of one turn are ordered by role and the checksum of the text; repeated rows are duplicates. An empty table gives
    no rows; other columns are not read.
    """
    def run(batches):
        out, current, n = [], None, 0
        for name, _, made in _lines(batches):
            if name != current:
                current, n = name, 0
            for x, role, text in made:
                out.append((name[1:] if name else None, n, role, text, x.translate(SHOWN)))
                n += 1
            if len(out) > 2_000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    names, types = ["conv", "position", "role", "text", "edit"], [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    rows = placed(messages)
    return _stream(rows, edit_plan(rows, signatures(rows))).mapInArrow(run, "conv string, position long, role string, text string, edit string")


def repair_digests(messages: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of *ids* (else of *messages*): conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit and repaired_sha256.

    Faults and edits as in :func:`repaired_messages`; audit has the initials of the edits in order; the
    digest is that of the repaired ``role:text`` lines. A conversation without rows has zeros, an empty audit and
    the digest of nothing. A digest is a chain over its text, so one task streams a conversation's rows; it
    holds no more than a batch of them and the audit.
    """
    def run(batches):
        out = []
        current, audit, digest, cost, illegal, first = None, [], None, 0, 0, True

        def row():
            return (current, illegal, cost, "".join(audit).translate(SHOWN), digest.hexdigest())

        for name, head, made in _lines(batches):
            if name != current:
                if current is not None:
                    out.append(row())
                current, audit, digest, cost, illegal, first = name, [], hashlib.sha256(), 0, 0, True
            if head:
                audit.append(head[0])
                cost += head[1]
                illegal += head[2]
            for _, role, text in made:
                digest.update(((("" if first else "\n") + role) + ":" + text).encode("utf-8", "surrogatepass"))
                first = False
            if len(out) > 2_000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if current is not None:
            out.append(row())
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    names, types = ["_c", "illegal", "cost", "audit", "repaired_sha256"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    rows = placed(messages)
    signs = cut_lineage(signatures(rows))
    edited = _stream(rows, edit_plan(rows, signs)).mapInArrow(run, "_c string, illegal long, cost long, audit string, repaired_sha256 string")
    tally = lambda f: F.sum((F.col("fault") == f).cast("long"))
    counts = signs.groupBy("_c").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        tally(BLANK).alias("blank"), tally(DUPLICATE).alias("duplicate"), tally(TRUNCATED).alias("truncated"))
    every = (messages if ids is None else ids).select("conv_id").distinct().withColumn("_c", _key(F.col("conv_id")))
    found = every.join(counts, "_c", "left").join(edited, "_c", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def repair_damaged(messages: DataFrame) -> DataFrame:
    """Digests of the repair of damaged conversations, for every conversation of *messages*."""
    return repair_digests(damage(messages), messages)
