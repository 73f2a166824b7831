"""Periodic runs of words: Lyndon roots extended both ways by constant-time common extensions on suffix trees."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MIN_WORDS = 6
MIN_POWER = 4
SLICE_BYTES = 4_000_000  # text that is numbered and searched in one go
FAR = np.int64(1) << 40


def suffix_tree(s: list[int], width: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Suffix tree of *s* by Ukkonen's construction: first and end position of each node's edge, and the edges.

    Symbols are below *width*; the last one is 0 and stands nowhere else. Edges are keyed by
    node * width + first symbol; node 0 is the root and a leaf's edge ends with the text.
    """
    n = len(s)
    first, end, link = [0], [0], [0]
    edges: dict[int, int] = {}
    node = edge = length = waiting = 0
    for i, c in enumerate(s):
        waiting += 1
        fresh = 0  # inner node that still needs its suffix link
        while waiting:
            if not length:
                edge = i
            key = node * width + s[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = len(first)
                first.append(i)
                end.append(n)
                link.append(0)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                f = first[child]
                stop = end[child]
                size = (stop if stop <= i else i + 1) - f
                if length >= size:
                    node, length, edge = child, length - size, edge + size
                    continue
                if s[f + length] == c:
                    if fresh:
                        link[fresh] = node
                    length += 1
                    break
                inner = len(first)
                first += (f, i)
                end += (f + length, n)
                link += (0, 0)
                edges[key] = inner
                first[child] = f + length
                edges[inner * width + s[f + length]] = child
                edges[inner * width + c] = inner + 1
                if fresh:
                    link[fresh] = inner
                fresh = inner
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return first, end, edges


def tour(first: list[int], end: list[int], edges: dict[int, int], width: int, downwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order in which an Euler tour meets their leaves, and the depth of the common
    ancestor of each leaf and the one before it (the least depth of the tour between the two).

    Children are met by rising symbols, or by falling ones with *downwards*; the end of the text comes
    first in both.
    """
    keys = np.fromiter(edges.keys(), np.int64, len(edges))
    children = np.fromiter(edges.values(), np.int64, len(edges))
    parents, symbols = np.divmod(keys, width)
    ranks = np.where(symbols > 0, width - symbols, 0) if downwards else symbols
    by = np.lexsort((-ranks, parents))  # pushed last to first
    children, bounds = children[by].tolist(), np.searchsorted(parents[by], np.arange(len(first) + 1)).tolist()
    n = max(end)
    order, shared = [], []
    stack, depths, joins = [0], [0], [0]
    low = 0
    while stack:
        v, above, join = stack.pop(), depths.pop(), joins.pop()
        if join >= 0:
            low = join
        depth = above + end[v] - first[v]
        a, b = bounds[v], bounds[v + 1]
        if a == b:
            order.append(n - depth)
            shared.append(low)
        else:
            stack += children[a:b]
            depths += [depth] * (b - a)
            joins += [depth] * (b - a - 1)
            joins.append(-1)  # the first child keeps what its leaf shares with the leaf before
    return np.array(order, np.int64), np.array(shared, np.int64)


class Extension:
    """Length of the longest common extension of two positions: least shared depth between their leaves."""

    def __init__(self, order: np.ndarray, shared: np.ndarray):
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.levels = [shared.astype(np.int32)]
        step = 1
        while 2 * step <= len(order):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For different positions i and j."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            grid = self.levels[k]
            out[at] = np.minimum(grid[low[at]], grid[high[at] - (1 << int(k))])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """First later position of smaller rank; the length of *rank* where there is none."""
    out = np.full(len(rank), len(rank), np.int64)
    values, open_ = rank.tolist(), []
    for i, r in enumerate(values):
        while open_ and values[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return out


def runs_of(symbols: np.ndarray, min_words: int = MIN_WORDS, min_power: int = MIN_POWER) -> np.ndarray:
    """(start, length, period) of all runs of one sequence, by start and period.

    Each run has a Lyndon word as its root under the order of symbols or the reverse order, and the root is
    the longest Lyndon word at its place: it ends where the next smaller suffix starts. Each such word
    is a candidate; the tree of the sequence extends it to the right, the tree of the reversal to the left.
    *min_power* is 2 or more.
    """
    n = len(symbols)
    if n < max(min_words, min_power):
        return np.empty((0, 3), np.int64)
    _, numbered = np.unique(symbols, return_inverse=True)
    numbered = numbered.astype(np.int64) + 1
    width = int(numbered.max()) + 1
    tree = suffix_tree([*numbered.tolist(), 0], width)
    up, shared = tour(*tree, width)
    down, _ = tour(*tree, width, downwards=True)
    del tree
    right = Extension(up, shared)
    left = Extension(*tour(*suffix_tree([*numbered[::-1].tolist(), 0], width), width))
    found = []
    for order in (up, down):
        rank = np.empty(n + 1, np.int64)
        rank[order] = np.arange(n + 1)
        i = np.arange(n)
        j = next_smaller(rank)[:n]
        period = j - i
        ahead, behind = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = np.flatnonzero(j < n)
        ahead[at] = right(i[at], j[at])
        at = np.flatnonzero(i > 0)
        behind[at] = left(n - i[at], n - j[at])
        length = behind + period + ahead
        good = length >= np.maximum(min_words, min_power * period)
        found.append(np.stack([i - behind, length, period], 1)[good])
    both = np.unique(np.concatenate(found), axis=0)
    return both[np.lexsort((both[:, 2], both[:, 0]))]


def candidate_stretches(words: np.ndarray, starts: np.ndarray, min_words: int = MIN_WORDS, min_power: int = MIN_POWER) -> list[tuple[int, int]]:
    """Stretches of a row of texts outside of which no run can lie, merged where they meet.

    *words* are the word numbers of all texts one after the other, *starts* the texts' first places. In a run
    of period q each word from the q-th on stands at most q words behind its last occurrence, and there
    are at least (min_power - 1) * q of them in a row, and min_words - q. For periods above Q/2 and up to Q
    it suffices to look for rows of words at most Q behind. The bound is exact: a run lies whole in one stretch.
    """
    n = len(words)
    text = np.zeros(n, np.int64)
    text[starts[(starts > 0) & (starts < n)]] = 1  # empty texts share a place with the next one
    by = np.lexsort((words, np.cumsum(text)))
    same = (words[by][1:] == words[by][:-1]) & (np.cumsum(text)[by][1:] == np.cumsum(text)[by][:-1])
    back = np.full(n, FAR)
    back[by[1:][same]] = (by[1:] - by[:-1])[same]
    spans = []
    q_low, q_high = 1, 1
    while q_low * min_power <= n:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (back <= q_high).view(np.int8), [0]])))
        a, b = edges[::2], edges[1::2]
        long = b - a >= max((min_power - 1) * q_low, min_words - q_high)
        spans.append(np.stack([a[long] - q_high, b[long]], 1))
        q_low, q_high = q_high + 1, q_high * 2
    spans = np.concatenate(spans) if spans else np.empty((0, 2), np.int64)
    if not len(spans):
        return []
    owner = np.searchsorted(starts, spans[:, 1] - 1, side="right") - 1
    spans[:, 0] = np.maximum(spans[:, 0], starts[owner])  # a text's first word is never in such a row
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.flatnonzero(np.concatenate([[True], spans[1:, 0] >= reach[:-1]]))
    return list(zip(spans[fresh, 0].tolist(), reach[np.concatenate([fresh[1:] - 1, [len(spans) - 1]])].tolist()))


def search(texts: list[list[bytes]], min_words: int = MIN_WORDS, min_power: int = MIN_POWER) -> list[np.ndarray]:
    """Runs (start, length, period) of each text of a slice, by start and period."""
    known: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    words = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(starts[-1]))
    out = [[] for _ in texts]
    for a, b in candidate_stretches(words, starts[:-1], min_words, min_power) if len(words) else []:
        found = runs_of(words[a:b], min_words, min_power)
        if len(found):
            k = int(np.searchsorted(starts, a, side="right")) - 1
            found[:, 0] += a - starts[k]
            out[k].append(found)
    return [np.concatenate(f) if f else np.empty((0, 3), np.int64) for f in out]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """Words joined by one space, without those that repeat the first period of a run."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def _slices(batches: Iterator[pa.RecordBatch], id_name: str, text: str) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and UTF-8 texts of bounded size together; a text above the bound comes alone."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for key, value in zip(batch.column(id_name), batch.column(text).cast(pa.large_binary())):
            data = value.as_py() or b""
            if texts and size + len(data) > SLICE_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(key.as_py())
            texts.append(data)
            size += len(data)
        if texts:
            yield ids, texts


def periodic_runs(docs: DataFrame, id_name: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_power: int = MIN_POWER) -> DataFrame:
    """Runs of repeated words of every whole text and the text without them.

    Returns the id, runs (array of start, length, period, by start and period) and collapsed: the words joined by one
    space, where of each run only the first period is left. A null or empty text has no runs and an empty
    collapsed text; repeated rows are searched each; other columns are not read. Rows are mapped where
    they lie. A task holds slices of SLICE_BYTES of text, or one longer text, whose trees take about 300 bytes
    for each word that may lie in a run.
    """
    def run(batches):
        for ids, texts in _slices(batches, id_name, text):
            words = [t.split() for t in texts]
            found = search(words, min_words, min_power)
            yield pa.record_batch({
                id_name: pa.array(ids, id_type),
                "runs": pa.array([[{"start": a, "length": b, "period": c} for a, b, c in f.tolist()] for f in found],
                                 pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                "collapsed": pa.array([collapse(w, f).decode("utf-8", "replace") for w, f in zip(words, found)], pa.string())})

    kind = docs.schema[id_name].dataType.simpleString()
    id_type = _arrow(kind)
    return docs.select(id_name, text).mapInArrow(
        run, f"`{id_name}` {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}[kind]


def with_planted_period(doc_id, words: list[bytes]) -> list[bytes]:
    """One text in ten repeats from some word on, by the checksum of its id; an id that is null changes nothing."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a:a + p]
    return words[:a] + (cycle * (-(-(n - a) // p)))[:n - a]


def run_digests(docs: DataFrame, change: Callable[[object, list[bytes]], list[bytes]] = with_planted_period) -> DataFrame:
    """Digest columns of the runs of every text after *change*: doc_id, n_runs, the longest run (start, length, period,
    exponent_milli; ties to the smaller start, then period; null without runs), runs_sha256 and collapsed_sha256.

    Nulls, empty texts, repeated rows and other columns as in :func:`periodic_runs`.
    """
    def run(batches):
        for ids, texts in _slices(batches, "doc_id", "text"):
            words = [change(k, t.split()) for k, t in zip(ids, texts)]
            rows = []
            for key, w, found in zip(ids, words, search(words)):
                lines = b"".join(b"%d,%d,%d\n" % tuple(r) for r in found.tolist())
                top = min(found.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
                rows.append((key, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
                             hashlib.sha256(lines).hexdigest(), hashlib.sha256(collapse(w, found)).hexdigest()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    types = [_arrow(kind), *[pa.int64()] * 5, pa.string(), pa.string()]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"`{c}` long" for c in names[1:6]) + ", runs_sha256 string, collapsed_sha256 string")
