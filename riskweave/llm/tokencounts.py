"""Token counts: the exact count at every prefix of a text by dynamic programming over its bytes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
MEMO = 400_000  # pieces and token pairs that a task remembers at most; a full memory starts anew
LONG_PIECE = 64  # bytes; longer pieces are seldom met again and are not remembered
#: Contractions and the pattern that splits text into pieces before merges.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPACE = r"\p{White_Space}"
PATTERN = "|".join([*CONTRACTIONS, r" ?\p{L}+", r" ?\p{N}+", rf" ?[^{SPACE}\p{{L}}\p{{N}}]+", rf"{SPACE}+(?![^{SPACE}])", rf"{SPACE}+"])
NEVER = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    """Token counts of prefixes under a byte-level BPE vocabulary file.

    For a piece of text, ``count[i] = count[i - len(t)] + 1`` where *t* is the last token of the first
    *i* bytes. It is the one token that ends there and may follow the last token of the prefix before it;
    whether one token may follow another depends on the two only, by the order of merges along their
    border. So one pass gives the count at every prefix, and no prefix is ever encoded again.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if (model.get("type") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space")
                or not before.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges")):
            raise ValueError("only byte-level BPE without normalizer, dropout and added space is supported")
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        added = spec.get("added_tokens") or []
        if any(a.get(k) for a in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take neighbouring text are not supported")
        self.specials = sorted((a["content"] for a in added), key=len, reverse=True)
        ids = {raw(k): v for k, v in model["vocab"].items() if k not in self.specials}
        size = max(ids.values()) + 1
        self.size = size
        self.rank, self.left, self.right, self.merge = [-1] * size, [-1] * size, [-1] * size, {}
        for r, pair in enumerate(model["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            x, y, t = ids[a], ids[b], ids[a + b]
            self.merge.setdefault(x * size + y, r)
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, x, y
        usable = {}
        for token, t in sorted(ids.items(), key=lambda kv: self.rank[kv[1]]):
            if len(token) == 1 or (self.rank[t] >= 0 and self._clean(self.left[t], self.right[t], self.rank[t])):
                usable[token] = t
        self.ids = usable
        tails: dict[bytes, set[int]] = {}
        for token in usable:
            if len(token) > 2:
                tails.setdefault(token[-3:], set()).add(len(token))
        self.tails = {k: tuple(sorted(v | {1, 2}, reverse=True)) for k, v in tails.items()}
        self.follows: dict[int, bool] = {}
        self.states: dict[bytes, tuple[int, int]] = {}
        self.whole = _Memo(self)
        self.pattern = regex.compile(PATTERN)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None

    def _clean(self, a: int, b: int, until: int = NEVER) -> bool:
        """True if merges leave *a* and *b* side by side (until merge *until*, if given).

        Walks back in time along the right edge of a and the left edge of b. Two edge tokens are merged if
        their merge comes before either is taken up by its own parent; of equal merges the left one is first.
        """
        rank, merge, size = self.rank, self.merge, self.size
        x, y, x_ends, y_ends = a, b, until, until
        while True:
            m = merge.get(x * size + y, NEVER)
            if m < x_ends and m <= y_ends and m != until:
                return False
            if rank[x] < 0 and rank[y] < 0:
                return True
            if rank[x] > rank[y]:
                x, x_ends = self.right[x], rank[x]
            else:
                y, y_ends = self.left[y], rank[y]

    def piece(self, data: bytes) -> list[int]:
        """Token counts of the first 0, 1, ... bytes of one piece."""
        n = len(data)
        count, last = [0] * (n + 1), [-1] * (n + 1)
        ids, tails, follows, size = self.ids, self.tails, self.follows, self.size
        for i in range(1, n + 1):
            for length in tails.get(data[max(0, i - 3):i], (2, 1)):
                if length > i:
                    continue
                t = ids.get(data[i - length:i])
                if t is None:
                    continue
                if length < i:
                    key = last[i - length] * size + t
                    ok = follows.get(key)
                    if ok is None:
                        if len(follows) >= MEMO:
                            follows.clear()
                        ok = follows[key] = self._clean(last[i - length], t)
                    if not ok:
                        continue
                count[i], last[i] = count[i - length] + 1, t
                break
        return count

    def state(self, data: bytes) -> tuple[int, int]:
        """Token count and last token of one short piece: the same table as in piece(), filled on demand and
        shared by all pieces that begin alike."""
        n, ids = len(data), self.ids
        found = None
        for length in self.tails.get(data[-3:], (2, 1)):
            if length > n:
                continue
            t = ids.get(data[n - length:])
            if t is None:
                continue
            if length == n:
                found = (1, t)
                break
            head = data[:n - length]
            before = self.states.get(head) or self.state(head)
            key = before[1] * self.size + t
            ok = self.follows.get(key)
            if ok is None:
                if len(self.follows) >= MEMO:
                    self.follows.clear()
                ok = self.follows[key] = self._clean(before[1], t)
            if ok:
                found = (before[0] + 1, t)
                break
        if len(self.states) >= MEMO:
            self.states.clear()
        self.states[data] = found
        return found

    def _parts(self, text: str) -> list[str]:
        """Ordinary stretches at even places, special strings at odd ones."""
        return self.special_pattern.split(text) if self.special_pattern else [text]

    def split(self, text: str) -> list[tuple[list[str], list[int], str]]:
        """Pieces of each ordinary stretch, their token counts, and the special string behind the stretch (or none)."""
        parts = self._parts(text)
        out = []
        for i in range(0, len(parts), 2):
            pieces = self.pattern.findall(parts[i])
            out.append((pieces, list(map(self.whole.__getitem__, pieces)), parts[i + 1] if i + 1 < len(parts) else ""))
        return out

    @staticmethod
    def total(split: list[tuple[list[str], list[int], str]]) -> int:
        return sum(sum(counts) + bool(mark) for _, counts, mark in split)

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        return self.total(self.split(text))

    def _stretch(self, text: str, start: int) -> np.ndarray:
        """Counts at each character prefix of ordinary text, from *start* tokens on."""
        out = np.empty(len(text) + 1, np.int64)
        out[0] = base = start
        space = -1  # first character of the run of white space that is open
        for m in self.pattern.finditer(text):
            s, e = m.span()
            if text[s].isspace() and space < 0 and self._space(text[s]):
                space, at_space = s, base
                run = s + 1
                while run < len(text) and self._space(text[run]):
                    run += 1
                # a prefix that ends within white space has the run so far as its last piece
                out[s + 1:run + 1] = at_space + self._characters(text[s:run])
                space = run
            low = max(s, space) if space >= 0 else s
            counts = self._characters(text[s:e])
            if e - s == 3 and text[s:e] in CONTRACTIONS:
                counts[1] = 2  # a cut contraction is a mark and a letter
            if low < e:
                out[low + 1:e + 1] = base + counts[low - s:]
            base += int(counts[-1])
            if space >= 0 and e >= space:
                space = -1
        return out

    def _space(self, c: str) -> bool:
        return regex.fullmatch(SPACE, c) is not None

    def _characters(self, piece: str) -> np.ndarray:
        """Counts after each character of a piece."""
        data = piece.encode("utf-8", "surrogatepass")
        counts = np.array(self.piece(data), np.int64)
        ends = np.flatnonzero((np.frombuffer(data + b"a", np.uint8) & 0xC0) != 0x80)
        return counts[ends[1:]] if len(ends) > 1 else counts[:0]

    def prefixes(self, text: str) -> np.ndarray:
        """Token count of the first 0, 1, ... characters of *text*, each as if the text ended there."""
        parts = self._parts(text)
        out, base = [np.zeros(1, np.int64)], 0
        for i in range(0, len(parts), 2):
            mark = parts[i + 1] if i + 1 < len(parts) else ""
            # until its last character is there, a special string is ordinary text
            counts = self._stretch(parts[i] + mark[:-1], base)
            out.append(counts[1:])
            if mark:
                base = int(counts[len(parts[i])]) + 1
                out.append(np.array([base]))
        return np.concatenate(out)

    def fitting(self, split: list[tuple[list[str], list[int], str]], budget: int) -> int:
        """Characters of the longest prefix of at most *budget* tokens of a text in its split form."""
        base, done = 0, 0
        for pieces, counts, mark in split:
            size = sum(counts)
            if base + size + bool(mark) > budget:
                # only prefixes that end in the piece that goes over, or in white space before it, are open
                k, at = 0, base
                while k < len(pieces) and at + counts[k] <= budget:
                    at, k = at + counts[k], k + 1
                j = min(k, max(len(pieces) - 1, 0))
                while j > 0 and pieces[j - 1].isspace():
                    j -= 1
                tail = "".join(pieces[j:k + 2]) + (mark[:-1] if k + 2 >= len(pieces) else "")
                fits = np.flatnonzero(self._stretch(tail, base + sum(counts[:j])) <= budget)
                return done + sum(map(len, pieces[:j])) + (int(fits[-1]) if len(fits) else 0)
            base, done = base + size + bool(mark), done + sum(map(len, pieces)) + len(mark)
        return done


class _Memo(dict):
    """Tokens of whole pieces, made on first use."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        data = piece.encode("utf-8", "surrogatepass")
        if len(data) > LONG_PIECE:
            return self.counter.piece(data)[-1]
        if len(self) >= MEMO:
            self.clear()
        n = self[piece] = self.counter.state(data)[0]
        return n


@lru_cache(maxsize=2)
def counter(vocabulary: str = VOCABULARY) -> PrefixCounter:
    """The counter of a vocabulary file; a bare name is one of the installed public ones."""
    if "/" not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    return PrefixCounter(vocabulary)


def prefix_counts(df: DataFrame, text: str = "text", name: str = "prefix_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """*df* with array column *name*: element i (from 0) is the token count of the first i characters.

    A null text counts as empty: one zero. Store the result, and the functions below answer questions
    about truncation and budgets from it, without the text or the tokenizer. A column that already has
    the name is replaced.
    """
    @F.udf(ArrayType(IntegerType()), useArrow=True)
    def counts(value):
        return counter(vocabulary).prefixes(value or "").tolist()

    return df.withColumn(name, counts(F.col(text)))


def tokens_of_prefix(counts: Column, characters: Column | int) -> Column:
    """Tokens of the first *characters* characters; of the whole text if it is shorter."""
    at = F.greatest(F.least(F.lit(characters) if isinstance(characters, int) else characters, F.size(counts) - 1), F.lit(0))
    return F.get(counts, at.cast("int"))


def longest_prefix(counts: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix with at most *budget* tokens (counts can fall again as a word grows)."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    return F.coalesce(F.array_max(F.filter(F.transform(counts, lambda c, i: F.when(c <= limit, i)), lambda i: i.isNotNull())), F.lit(0))


def pack(counts: Column, budget: int) -> Column:
    """Windows of at most *budget* tokens that a text needs when windows start at multiples of the budget."""
    return F.ceil(F.element_at(counts, -1) / F.lit(budget)).cast("long")


def truncate(df: DataFrame, budget: int, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """*df* with *text* cut to its longest prefix of at most *budget* tokens; null stays null."""
    @F.udf("string", useArrow=True)
    def cut(value):
        return value if value is None else value[:counter(vocabulary).fitting(counter(vocabulary).split(value), budget)]

    return df.withColumn(text, cut(F.col(text)))


def count_documents(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than *limit* tokens) and kept_chars, the longest prefix within it.

    Counts are those of the vocabulary's own library without added tokens; special strings in a text
    are special tokens, as its default has it. A null text is empty: no bytes, no tokens. Repeated rows are
    counted each, equal texts alike, so ties cannot arise; an empty table gives no rows; other columns are
    not read. Rows are mapped where they lie, nothing is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(vocabulary)
        for batch in batches:
            texts = batch.column("text")
            tokens, kept = [], []
            for value in texts:
                value = value.as_py() or ""
                split = known.split(value)
                n = known.total(split)
                tokens.append(n)
                kept.append(len(value) if n <= limit else known.fitting(split, limit))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                "n_bytes": pc.coalesce(pc.cast(pc.binary_length(texts.cast(pa.large_binary())), pa.int64()), 0),
                "n_tokens": pa.array(tokens, pa.int64()), "over_limit": pa.array([n > limit for n in tokens], pa.bool_()),
                "kept_chars": pa.array(kept, pa.int64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, kept_chars long")
