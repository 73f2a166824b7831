"""Chat formatting: quoted passages linked to the messages they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import row_numbers
from riskweave.session import cut_lineage

QUOTE = r"^[ \t]*(>[> \t]*)"


def normalised(line: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """*messages* with lines (level, words): the quote level of each line, the number of its leading >, and the rest."""
    prefix = lambda x: F.regexp_extract(x, QUOTE, 1)
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n"), lambda x: F.struct(
        F.length(F.regexp_replace(prefix(x), "[^>]", "")).alias("level"), F.regexp_replace(x, QUOTE, "").alias("words")))
    return messages.withColumn("lines", lines)


def own_text(lines: Column) -> Column:
    """The message without its quoted lines, trimmed."""
    kept = F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["words"])
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, quoted_lines): the message that each quoting message answers.

    Every quoted line is looked up by its conversation and the hash of its normalised words: the message
    it comes from is the last one before the quoting turn with such a line of its own. Lines of level one
    decide; deeper ones serve where those above them find nothing. Within a level most quoted lines win, then the
    later turn. A line that many messages share is walked once in order
    of turn, never paired; its owners are merged to one row for each turn before.
    """
    lines = parse(messages).select("conv_id", "turn", F.explode("lines").alias("l")).select(
        "conv_id", "turn", F.col("l.level").alias("level"), normalised(F.col("l.words")).alias("words")).filter("words <> ''")
    seen = lines.groupBy("conv_id", F.md5("words").alias("h"), "turn").agg(
        F.max((F.col("level") == 0).cast("int")).alias("own"), F.min(F.when(F.col("level") > 0, F.col("level"))).alias("quotes"))
    quoted = cut_lineage(seen)
    needed = quoted.filter("quotes IS NOT NULL").select("conv_id", "h").distinct()
    line = Window.partitionBy("conv_id", "h").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    found = (quoted.join(needed, ["conv_id", "h"], "left_semi").withColumn("origin", F.last(F.when(F.col("own") == 1, F.col("turn")), True).over(line))
             .filter("quotes IS NOT NULL AND origin IS NOT NULL"))
    votes = found.groupBy("conv_id", "turn", "quotes", "origin").agg(F.count("*").alias("n"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("quotes"), "n", "origin")).alias("b"))
    return best.select("conv_id", "turn", F.col("b.origin").alias("reply_to"), F.col("b.n").alias("quoted_lines"))


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of each reply: parents are followed by doubling.

    A reply is always later than what it answers, so chains end; n rounds cover chains of 2 ** n.
    """
    state = cut_lineage(replies.select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = state.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        joined = state.join(above, ["conv_id", "root"], "left")
        if joined.filter("above IS NOT NULL").isEmpty():
            return state
        state = cut_lineage(joined.select("conv_id", "turn", F.coalesce("above", "root").alias("root"),
                                          (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))


def conversations(messages: DataFrame) -> DataFrame:
    """Reply-ordered conversations without quotes, one row for each message.

    Columns: conv_id, turn, role, text (without quoted lines), quote_lines, quote_level (the deepest),
    reply_to (null: no quoted line is known), thread (first turn of the chain of replies), depth, and
    position: threads of a conversation in the order of their first turns, replies by turn, from 0.
    Positions come from one numbering of all rows, so a conversation of any length is never one group.
    A null text is empty; messages without conversation or turn link to nothing; repeated rows keep
    rows of their own, with the reply of their (conv_id, turn).
    """
    replies = cut_lineage(links(messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL")))
    chains = threads(replies).withColumnRenamed("root", "thread")
    named = replies.join(chains, ["conv_id", "turn"])
    clean = parse(messages.select("conv_id", "turn", "role", "text")).select(
        "conv_id", "turn", "role", own_text(F.col("lines")).alias("text"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).alias("quote_lines"), F.array_max(F.transform("lines", lambda x: x["level"])).alias("quote_level"))
    rows = clean.join(named, ["conv_id", "turn"], "left").withColumns({
        "thread": F.coalesce("thread", "turn"), "depth": F.coalesce("depth", F.lit(0))})
    numbered, _ = row_numbers(rows.withColumn("_h", F.md5(F.coalesce("text", F.lit("")))), ["conv_id", "thread", "turn", "role", "_h"], "_n")
    first = numbered.groupBy(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_c")).agg(F.min("_n").alias("_first"))
    placed = numbered.withColumn("_c", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).join(first, "_c")
    return placed.select("conv_id", "turn", "role", "text", "quote_lines", "quote_level", "reply_to", "thread", "depth",
                         (F.col("_n") - F.col("_first")).alias("position"))


ORACLE = r"""
WITH RECURSIVE l AS MATERIALIZED (
  SELECT m, conv_id, turn, role, i, line,
         length(regexp_replace(regexp_extract(line, '^[ \t]*(>[> \t]*)', 1), '[^>]', '', 'g'))::INT AS level,
         regexp_replace(line, '^[ \t]*(>[> \t]*)', '') AS words
  FROM (SELECT m, conv_id, turn, role, unnest(parts) AS line, unnest(range(len(parts))) AS i
        FROM (SELECT row_number() OVER () AS m, conv_id, turn, role,
                     regexp_split_to_array(coalesce(text, ''), '\r?\n') AS parts FROM conversations))),
own AS (
  SELECT m, conv_id, turn, role,
         regexp_replace(coalesce(string_agg(words, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), '^\s+|\s+$', '', 'g') AS text,
         count(*) FILTER (WHERE level > 0)::INT AS quote_lines, max(level)::INT AS quote_level
  FROM l GROUP BY ALL),
n AS (
  SELECT conv_id, turn, level, trim(regexp_replace(lower(words), '\s+', ' ', 'g')) AS w FROM l
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
v AS (
  SELECT q.conv_id, q.turn, q.level, q.w, max(o.turn) AS origin FROM (SELECT conv_id, turn, w, min(level) AS level FROM n WHERE level > 0 AND w <> '' GROUP BY conv_id, turn, w) q
  JOIN (SELECT DISTINCT conv_id, turn, w FROM n WHERE level = 0) o ON o.conv_id = q.conv_id AND o.w = q.w AND o.turn < q.turn
  GROUP BY ALL),
votes AS (SELECT conv_id, turn, level, origin, count(*) AS k FROM v GROUP BY ALL),
reply AS (SELECT conv_id, turn, arg_max(origin, (-level, k, origin)) AS reply_to FROM votes GROUP BY ALL),
chain AS (
  SELECT conv_id, turn, reply_to AS root, 1 AS depth FROM reply
  UNION ALL SELECT c.conv_id, c.turn, r.reply_to, c.depth + 1 FROM chain c JOIN reply r ON r.conv_id = c.conv_id AND r.turn = c.root),
top AS (SELECT conv_id, turn, arg_max(root, depth) AS thread, max(depth) AS depth FROM chain GROUP BY ALL),
j AS (
  SELECT o.*, r.reply_to, coalesce(t.thread, o.turn) AS thread, coalesce(t.depth, 0)::BIGINT AS depth
  FROM own o LEFT JOIN reply r USING (conv_id, turn) LEFT JOIN top t USING (conv_id, turn))
SELECT conv_id, turn, role, text, quote_lines, quote_level, reply_to, thread, depth,
       row_number() OVER (PARTITION BY conv_id ORDER BY thread NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, md5(text)) - 1 AS position
FROM j"""
