"""Collapsing cumulative snapshots of conversations, then rendering what stays. DataFrame functions only.

Logs often hold a conversation once per turn, each time with one more. Each turn gets a hash of the whole prefix up to it: the
hashes of (place, role, text) of its turns, xor-ed as a running window (two hashes, 128 bits). A conversation is a snapshot of
a longer one if its last prefix hash, at its length, is an inner prefix of another: one anti-join on (hash, length) finds all,
with no pairs. Equal conversations are one; the smallest conv_id stays. One shuffle by conv_id serves the removal of repeated
rows, the window and the rendering.

Defined results: turns are ordered by (turn, role, text) with nulls first; a null role or text counts as empty; rows repeated
exactly count once; rows without conv_id are one conversation of that (null) id; an empty table gives no rows; extra columns
are not read; markers that a role or text holds itself stay as they are, so who trains on the result must not take them for
turns. A row of the result holds one conversation, so the longest one must fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with its place (from 1), the conversation's length and two hashes of the prefix that it ends."""
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.repartition("conv_id").dropDuplicates()
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = own.withColumn("place", F.row_number().over(ordered))
    running, whole = ordered.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("conv_id")

    def hashed(seed: int) -> Column:
        return F.bit_xor(F.xxhash64(F.lit(seed), F.col("place"), F.col("role"), F.col("text"))).over(running)

    return placed.withColumn("h1", hashed(1)).withColumn("h2", hashed(2)).withColumn("n", F.max("place").over(whole))


def maximal(turns: DataFrame) -> DataFrame:
    """One row (conv_id, n, copies) for each conversation that no longer one begins with; copies: how many are equal to it."""
    marked = prefixes(turns).select("conv_id", "place", "n", "h1", "h2")
    # whole first: whether a prefix is inner or the end of a conversation, each row is (hash, length), so few columns move
    inner = marked.where("place < n").select("h1", "h2", F.col("place").alias("n")).distinct()
    ends = marked.where("place = n").groupBy("h1", "h2", "n").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    return ends.join(inner, ["h1", "h2", "n"], "left_anti").select("conv_id", F.col("n").cast("bigint").alias("n"), "copies")


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, rendered) of the maximal conversations."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    shown = F.array_join(F.transform(parts, lambda t: rendered_turn(t["role"], t["text"])), "")
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    stay = maximal(turns)
    whole = own.join(stay.select(F.col("conv_id").alias("kept"), "n", "copies"), F.col("conv_id").eqNullSafe(F.col("kept")))
    whole = whole.repartition("conv_id").dropDuplicates()
    return whole.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("copies").alias("copies"), shown.alias("rendered"))


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
  string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE place = n GROUP BY prefix, n),
s AS (SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n AND p.place = e.n AND p.prefix = e.prefix))
SELECT s.conv_id, CAST(s.n AS BIGINT) AS n_turns, CAST(s.copies AS BIGINT) AS copies,
  string_agg('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), '' ORDER BY t.turn NULLS FIRST, t.role, t.text) AS rendered
FROM s JOIN t ON t.conv_id IS NOT DISTINCT FROM s.conv_id GROUP BY s.conv_id, s.n, s.copies
"""
