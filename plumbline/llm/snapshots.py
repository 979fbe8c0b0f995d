"""Cumulative-snapshot collapse of logged conversations, then rendering; DataFrame operations only.

A conversation that is logged after every turn leaves snapshots, each a prefix of the next. Each turn's
prefix hash rolls up the hashes of all turns so far: a turn hashes its place, role and text, and the prefix
combines them by exclusive or, twice with different seeds (128 bits). A conversation is

* a copy, where another one has the same turns: the smallest ``conv_id`` stays;
* a snapshot, where its turns begin a longer one: an anti-join of its last hash with all proper prefixes' hashes
  drops it.

Prefixes shared by a third of all conversations are made distinct before the join (map-side combined), so
both sides have one row per hash and nothing is skewed. Ranks and running hashes of a conversation stream in
turn order; only conversations that stay are gathered, each into its own rendered text.

Turns sort by ``turn`` (nulls first), ties by role and then by the turn's hash. Rows that repeat a conversation's
turn, role and text count once. Null roles and texts hash apart from empty ones and render as empty. Rows without
a ``conv_id`` belong to no conversation and are left out. An empty table gives no rows. Extra columns are ignored.
Texts are shuffled once, to be rendered; all else works on hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _turn_hash(seed: int) -> Column:
    # nulls pass through xxhash64 without effect, hence the flags
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1) and the prefix hash (p, q) of the turns up to each place."""
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", "role", _turn_hash(1).alias("hp"), _turn_hash(2).alias("hq"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "hp", "hq")
    said = F.struct("turn", "role", "hp", "hq")
    once = turns.withColumn("again", F.lag(said).over(order).eqNullSafe(said)).where("not again")
    placed = once.withColumn("place", F.row_number().over(order))
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rolled = [F.bit_xor(F.xxhash64("place", h)).over(so_far).alias(name) for h, name in (("hp", "p"), ("hq", "q"))]
    return placed.select("conv_id", "place", *rolled)


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that no other one repeats or continues."""
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("place", "p", "q"), "place").alias("e"))
    ends = last.groupBy(F.col("e.place").alias("n_turns"), F.col("e.p").alias("p"), F.col("e.q").alias("q")).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")
    )
    longest = last.select("conv_id", F.col("e.place").alias("last"))
    proper = rows.join(longest.withColumnRenamed("conv_id", "of"), F.col("conv_id") == F.col("of")).where("place < last")
    begun = proper.groupBy(F.col("place").alias("b_place"), F.col("p").alias("b_p"), F.col("q").alias("b_q")).agg(F.count("*").alias("n"))
    same = (F.col("n_turns") == F.col("b_place")) & (F.col("p") == F.col("b_p")) & (F.col("q") == F.col("b_q"))
    return ends.join(begun, same, "left_anti").select("conv_id", F.col("n_turns").cast("bigint").alias("n_turns"), "n_copies")


def render(conversations: DataFrame, kept: DataFrame, opening: str = "<|", closing: str = "|>\n", end: str = "\n") -> DataFrame:
    """conv_id, n_turns, n_copies and the chat text: ``<|role|>``, a line break, the turn's text and a line break."""
    line = F.concat(F.lit(opening), F.coalesce("role", F.lit("")), F.lit(closing), F.coalesce("text", F.lit("")), F.lit(end))
    turns = conversations.select("conv_id", F.struct("turn", "role", _turn_hash(1).alias("hp"), _turn_hash(2).alias("hq"), line.alias("line")).alias("said"))
    mine = turns.join(kept.withColumnRenamed("conv_id", "of"), F.col("conv_id") == F.col("of"))
    ordered = F.array_sort(F.array_distinct(F.collect_list("said")))
    text = F.array_join(F.transform(ordered, lambda x: x["line"]), "")
    return mine.groupBy("conv_id", "n_turns", "n_copies").agg(text.alias("chat"))


#: DuckDB: a prefix is the list of its turns itself, so no hash is involved.
ORACLE = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM turns),
prefix AS (SELECT conv_id, place, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY place) AS said FROM placed),
ends AS (SELECT conv_id, max(place) AS n_turns, arg_max(said, place) AS said FROM prefix GROUP BY conv_id),
begun AS (SELECT DISTINCT p.said FROM prefix p JOIN ends e ON p.conv_id = e.conv_id AND p.place < e.n_turns),
kept AS (SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_copies, said FROM ends
  WHERE said NOT IN (SELECT said FROM begun) GROUP BY said)
SELECT k.conv_id, CAST(k.n_turns AS BIGINT) AS n_turns, CAST(k.n_copies AS BIGINT) AS n_copies,
  string_agg('<|' || coalesce(p.role, '') || '|>' || chr(10) || coalesce(p.text, '') || chr(10), '' ORDER BY p.place) AS chat
FROM kept k JOIN placed p ON k.conv_id = p.conv_id GROUP BY k.conv_id, k.n_turns, k.n_copies
"""
