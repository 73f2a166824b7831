"""SimHash near-duplicates through an inverted index of byte positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.common import components
from riskweave.session import cut_lineage

SHINGLE = 3
SEED = 42
MOST_BITS = 3
BYTES = 8
#: Three bits can spoil three of the eight bytes, so a linked pair shares five positions at least.
LEAST_SHARED = BYTES - MOST_BITS
#: Any five of the eight positions hold three of one half, so one of these postings finds the pair.
POSTINGS = tuple(tuple(p for p in range(half, half + 4) if p != out) for half in (0, 4) for out in range(half, half + 4))
#: Longer posting lists are split, and their parts meet in pairs.
LIST_ROWS = 65_536
#: Near copies of the pipeline: five-word shingles, exact Jaccard similarity of pairs that share a band of minima.
#: At 0.8 a pair shares one of the 25 bands with probability 0.999998.
COPY_SHINGLE, SIMILARITY, COPY_BANDS, COPY_ROWS = 5, 0.8, 25, 4
ORDERS = np.random.default_rng(SEED).integers(0, 1 << 63, COPY_BANDS * COPY_ROWS, dtype=np.uint64)
#: Members of a list that are compared in one place; of a longer list each two parts meet in a cell of about so many.
COPY_CELL = 512


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the lower-cased word shingles, repeats included; zero without a word."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1:].tolist())]
    return majority(hashes)


def majority(hashes: list[int] | np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at:at + 65_536], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def postings(fps: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint under each posting, the value of its bytes at three positions."""
    keys = []
    for i, positions in enumerate(POSTINGS):
        key = F.lit(i).cast("long")
        for p in positions:
            key = key * 256 + _byte(F.col("fp"), p)
        keys.append(key)
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def spanning_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the close pairs of one posting list connect, fewer than its members.

    From each reached fingerprint the rest of the list is tallied: pairs that share the guaranteed
    number of positional bytes are kept and verified by their differing bits. What is linked leaves
    the rest, so that a dense list is used up after a few steps.
    """
    rest, left, right = fps, [], []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            differing = rest ^ at
            tally = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            close = tally >= LEAST_SHARED
            close[close] = np.bitwise_count(differing[close].view(np.uint64)) <= MOST_BITS
            if close.any():
                found = rest[close]
                left.append(np.full(len(found), at))
                right.append(found)
                front.extend(found)
                rest = rest[~close]
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def _links_of_lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk lists that arrive in order of (key, cell); a list may run over several frames."""
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        name = frame["key"].to_numpy() * 1_048_583 + frame["cell"].to_numpy()
        cuts = np.flatnonzero(np.diff(name)) + 1
        last = cuts[-1] if len(cuts) else 0
        yield _links(frame["fp"].to_numpy()[:last], cuts[:-1] if len(cuts) else cuts)
        held = frame.iloc[last:]
    if held is not None:
        yield _links(held["fp"].to_numpy(), np.empty(0, np.int64))


def _links(fps: np.ndarray, cuts: np.ndarray) -> pd.DataFrame:
    found = [spanning_links(part) for part in np.split(fps, cuts)] if len(fps) else []
    a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
    b = np.concatenate([y for _, y in found]) if found else np.empty(0, np.int64)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def links(fps: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all pairs at three bits or fewer.

    Lists of more than *list_rows* members are cut into parts by a hash, and each two parts meet in a
    task of their own, so that no task holds a whole hot list. Lists of one are dropped before any
    Python.
    """
    index = postings(fps)
    hot = index.groupBy("key").count().filter(F.col("count") > list_rows)
    hot = hot.select("key", F.ceil(F.col("count") * 2 / list_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.least("part", "other") * F.col("parts") + F.greatest("part", "other"))
    dealt = (index.join(hot, "key", "left").withColumn("part", part).withColumn("other", other)
             .select("key", cell.cast("long").alias("cell"), "fp"))
    members = Window.partitionBy("key", "cell")
    shared = dealt.withColumn("n", F.count("*").over(members)).filter("n > 1").select("key", "cell", "fp")
    return shared.mapInPandas(_links_of_lists, "a long, b long")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp, component_id) for each row of *docs*.

    Equal fingerprints are one node; nodes within three bits are linked; component_id is the least
    doc_id that can be reached. A null or wordless text has fingerprint zero and is linked like any
    other. A null doc_id is never a component's id unless the component has no other. Repeated rows
    give repeated rows. text_key tells rows of one doc_id apart.
    """
    rows = cut_lineage(docs.select("doc_id", F.xxhash64("text").alias("text_key"), fingerprints("text").alias("fp")))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp")))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of *docs*."""
    return groups(docs).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles of the lower-cased text; of all its words if they are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = max(1, len(words) - COPY_SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i:i + COPY_SHINGLE]), SEED) for i in range(n)], np.uint64))


def minima_keys(hashes: np.ndarray) -> list[int]:
    """One key for each band of minima of *hashes* in the orders that an exclusive or gives them."""
    least = np.empty(len(ORDERS), np.uint64)
    for at in range(0, len(ORDERS), COPY_ROWS):
        least[at:at + COPY_ROWS] = (hashes[None, :] ^ ORDERS[at:at + COPY_ROWS, None]).min(axis=1)
    bands = least.reshape(COPY_BANDS, COPY_ROWS)
    return [xxhash.xxh64_intdigest(band.tobytes(), i) - (1 << 63) for i, band in enumerate(bands)]


SKETCH = T.StructType([T.StructField("node", T.LongType()), T.StructField("size", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])


@F.pandas_udf(SKETCH)
def _sketch(texts: pd.Series) -> pd.DataFrame:
    """Node (hash of the shingle set), number of shingles, SimHash and keys of minima of each text."""
    out = []
    for t in texts:
        hashes = shingle_hashes(t)
        out.append((xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63), len(hashes), majority(hashes), minima_keys(hashes)))
    return pd.DataFrame(out, columns=["node", "size", "fp", "keys"])


@F.pandas_udf(T.BooleanType())
def _similar(x: pd.Series, y: pd.Series) -> pd.Series:
    out = []
    for s, t in zip(x, y):
        a, b = shingle_hashes(s), shingle_hashes(t)
        both = len(np.intersect1d(a, b, assume_unique=True))
        out.append(both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9)
    return pd.Series(out, dtype="bool")


def _copy_links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The *pairs* (a, b) whose shingle sets have Jaccard SIMILARITY at least; texts are smaller than their shingles' hashes."""
    sides = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    return cut_lineage(sides.filter(_similar("x", "y")).select("a", "b"))


def fingerprint_pairs(marks: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes that connect all nodes of *marks* (node, fp) whose fingerprints differ in three bits or fewer."""
    marks = marks.select("node", "fp")
    least = cut_lineage(marks.groupBy("fp").agg(F.min("node").alias("m")))
    same = marks.join(least, "fp").filter("node <> m").select("node", "m")
    close = (links(least.select("fp")).join(least.toDF("a", "node"), "a").join(least.toDF("b", "m"), "b").select("node", "m"))
    return same.union(close).select(F.least("node", "m").alias("a"), F.greatest("node", "m").alias("b")).distinct()


def linked_members(nodes: np.ndarray, roots: np.ndarray, parts: np.ndarray, texts: list[str]) -> tuple[list[int], list[int]]:
    """Links of Jaccard SIMILARITY that join the groups *roots* of one cell wherever two of its members have it.

    Members of one group, also of one that a link has just made, are not compared. In a cell of two *parts* members meet
    those of the other part only.
    """
    sets = [shingle_hashes(t) for t in texts]
    sizes = np.array([len(s) for s in sets])
    order = np.lexsort((nodes, sizes, parts))
    nodes, sizes, parts, sets = nodes[order], sizes[order], parts[order], [sets[i] for i in order]
    group = np.unique(roots[order], return_inverse=True)[1]
    known, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(codes, np.cumsum(sizes)[:-1])
    second = int(np.searchsorted(parts, parts[0], "right"))  # where the other part begins
    marked, left, right = np.zeros(len(known), np.int32), [], []
    for i in range(second):
        at = second if second < len(nodes) else i + 1
        low = at + int(np.searchsorted(sizes[at:], sizes[i] * SIMILARITY - 1e-6))
        high = at + int(np.searchsorted(sizes[at:], sizes[i] / SIMILARITY + 1e-6, "right"))
        met = low + np.flatnonzero(group[low:high] != group[i])
        if not len(met):
            continue
        marked[codes[i]] = 1
        starts = np.cumsum(sizes[met]) - sizes[met]
        both = np.add.reduceat(marked[np.concatenate([codes[j] for j in met])], starts)
        marked[codes[i]] = 0
        close = met[both >= SIMILARITY * (sizes[i] + sizes[met] - both) - 1e-9]
        if len(close):
            left.extend([int(nodes[i])] * len(close))
            right.extend(nodes[close].tolist())
            group[np.isin(group, group[close])] = group[i]
    return left, right


def _links_of_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk cells that arrive in order of (list, cell); a cell may run over several frames."""
    def links_of(frame, cuts):
        a, b = [], []
        columns = [frame[c].to_numpy() for c in ("node", "root", "part", "text")]
        for low, high in zip([0, *cuts], [*cuts, len(frame)]):
            if high - low > 1:
                x, y = linked_members(*[c[low:high] for c in columns])
                a += x
                b += y
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        name, cell = frame["list"].to_numpy(), frame["cell"].to_numpy()
        cuts = (np.flatnonzero((name[1:] != name[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist()
        last = cuts[-1] if cuts else 0
        yield links_of(frame.iloc[:last], cuts[:-1])
        held = frame.iloc[last:]
    if held is not None:
        yield links_of(held, [])


def copy_roots(lists: DataFrame, texts: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(node, root) of the nodes that Jaccard similarity links to another.

    *pairs* (a, b) are tried before any list: what they join no longer meets in lists.

    *lists* (list, node, size, degree) has the nodes that share a key of minima, and how many neighbours each has in all
    its lists; *texts* (node, text) has a text of each. All members of a list first meet the one of most neighbours,
    as an original stands nearer to its variants than they to one another; so a list of copies is joined by as
    many pairs as it has members. Lists that are then in more than one group are sent on with their texts, and
    members of different groups are compared where they arrive, so that no pair is a row of its own. A list of
    more than COPY_CELL members is cut into parts, and each two parts meet in a cell.
    """
    def fits(a, b):
        return F.least(a, b) >= F.greatest(a, b) * SIMILARITY - 1e-9

    def placed(roots):
        rooted = lists.withColumn("root", F.col("node")) if roots is None else lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = rooted.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.min_by(
            F.struct("node", "size", "root"), F.struct(-F.col("degree"), "node")).alias("d")).filter("lo <> hi")
        return rooted.join(split.select("list", "n", "d"), "list")

    found = roots = None
    if pairs is not None and not pairs.isEmpty():
        found = _copy_links(pairs, texts)
        roots = components(found)
    met = placed(roots).filter("root <> d.root").filter(fits(F.col("size"), F.col("d.size"))).select(
        F.least("node", "d.node").alias("a"), F.greatest("node", "d.node").alias("b")).distinct()
    stars = _copy_links(met if pairs is None else met.join(pairs, ["a", "b"], "left_anti"), texts)
    found = stars if found is None else cut_lineage(found.union(stars))
    roots = components(found)

    parts = F.when(F.col("n") > COPY_CELL, F.ceil(F.col("n") * 2 / COPY_CELL)).otherwise(1).cast("int")
    dealt = placed(roots).select("list", "node", "root", parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.least("part", "other") * F.col("parts") + F.greatest("part", "other")
    cells = dealt.select("list", cell.alias("cell"), "part", "node", "root").join(texts, "node").repartition("list", "cell").sortWithinPartitions("list", "cell")
    rest = cut_lineage(cells.mapInPandas(_links_of_cells, "a long, b long"))
    return roots if rest.isEmpty() else components(found.union(rest))


def keep_one(docs: DataFrame) -> DataFrame:
    """*docs* with one document of each group of near copies: that of the least doc_id, once if it is repeated.

    Near copies have five-word shingle sets of Jaccard SIMILARITY at least; groups are what such links
    connect. SimHashes of these sets within three bits give the first pairs; as similarity 0.8 can differ in more
    bits, sets that share a band of minima meet after them. Each pair is verified by its exact similarity. Texts without words are one group. The contract of op1 has no part in this. Columns of any name
    stay as they are. Only keys are written for every document; the texts of nodes that share a key are written once, and
    their shingles are made again where a pair is verified.
    """
    key = F.xxhash64("text")
    rows = cut_lineage(docs.select("doc_id", key.alias("text_key"), _sketch("text").alias("s")).select("doc_id", "text_key", "s.*"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    nodes = rows.groupBy("node").agg(F.first("size").alias("size"), F.first("keys").alias("keys"), F.min(order).alias("k"))
    dealt = nodes.select("node", "size", F.explode("keys").alias("list"))
    shared = cut_lineage(dealt.join(dealt.groupBy("list").agg(F.count("*").alias("n")).filter("n > 1"), "list"))
    lists = cut_lineage(shared.join(shared.groupBy("node").agg(F.sum(F.col("n") - 1).alias("degree")), "node").select("list", "node", "size", "degree"))
    pairs = cut_lineage(fingerprint_pairs(cut_lineage(rows.select("node", "fp").distinct())))
    met = lists.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = nodes.join(met, "node", "left_semi").select("node", F.col("k.text_key").alias("text_key"))
    same = docs.select(key.alias("text_key"), F.coalesce("text", F.lit("")).alias("text")).join(wanted, "text_key")
    texts = cut_lineage(same.groupBy("node").agg(F.max("text").alias("text")))
    named = rows.select("doc_id", "text_key", "node").join(copy_roots(lists, texts, pairs), "node", "left")
    first = named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(order).alias("k"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keep = first.select(F.coalesce(F.col("k.doc_id").cast("string"), F.lit("")).alias("id"), F.col("k.text_key").alias("key")).distinct()
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name.alias("id"), key.alias("key"))
    copies = Window.partitionBy("id", "key").orderBy("key")
    kept = held.join(keep, ["id", "key"], "left_semi").withColumn("n", F.row_number().over(copies))
    return kept.filter("n = 1").select("row.*")
