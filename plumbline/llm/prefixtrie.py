"""Prefix trie of conversations, built level by level on DataFrames.

A node of depth d stands for one sequence of d turns; the conversations that begin with it are its members, and the smallest id among
them names it (ids differ within a depth, so (id, depth) is a node's key). Depth by depth, live conversations are grouped by (parent node,
next turn): a group is a node, its least id goes back to its members by a join, and each level is a written table. Afterwards the levels
are walked in reverse: a level's leaves and savings are summed by parent and joined to the level above.

Three things keep levels few and rows even:

* Turns are compared by SHA-256, taken once; texts aren't shuffled at all.
* Conversations with the same turns form one class, which goes through the levels as one row with a weight.
* A class that is alone in its node needs no more grouping: its later turns are a chain of nodes, written in one join at the end.
  So there are as many rounds as the deepest turn that two different classes share, plus one.

A group that holds a third of all conversations combines its least id and sums before the shuffle, and the join that hands the node back
may be split by adaptive execution. A conversation that holds a third of all rows isn't gathered either: turns are dealt by sorted ranges and
numbered inside each range; a range that begins within a conversation goes on from the ranges before it (one number for each range
comes to the driver). The SHA-256 of a class's ids is a chain over sorted ids, so each class's ids pass through one task, as a
stream of sorted integers in constant memory.

Turns sort by ``turn`` (nulls first), ties by role, then by the turn's SHA-256; rows that repeat a turn are turns of their own. Null roles
and texts become empty ones. Rows without a ``conv_id`` belong to no conversation and are left out. Conversations without turns are
members of the root. A table without conversations has no nodes. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import discard, shared_folder, written

#: Next turns that a live conversation carries; after so many levels the following ones are fetched.
AHEAD = 32
NO_IDS = hashlib.sha256().digest()


def turn_rows(conversations: DataFrame, spark: SparkSession) -> DataFrame:
    """conv_id, place (from 1), cum (bytes of text up to the place), key (SHA-256 of role and text) and bytes of every turn; written."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.unhex(F.sha2(said, 256)).alias("key"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    hashed = written(turns.withColumn("spread", F.xxhash64(F.monotonically_increasing_id())), spark)
    order = ["conv_id", "turn", "role", "key", "spread"]  # the last one parts rows that repeat one turn many times
    ranged = hashed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "bytes")
    local = written(ranged.mapInArrow(_number, "conv_id bigint, key binary, bytes bigint, part int, place bigint, cum bigint"), spark)
    discard(hashed, spark)
    end = F.struct("conv_id", "place")
    edges = local.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"), F.max_by("place", end).alias("place"), F.max_by("cum", end).alias("cum"))
    before, going = [], (None, 0, 0)
    for e in sorted(edges.collect(), key=lambda e: e.part):
        if going[0] == e.lo:
            before.append((e.part, e.lo, going[1], going[2]))
        on = going[1:] if going[0] == e.hi else (0, 0)  # the whole range is one conversation that began before it
        going = (e.hi, e.place + on[0], e.cum + on[1])
    if not before:
        return local.drop("part")
    more = F.broadcast(spark.createDataFrame(before, "of int, going bigint, places bigint, cums bigint"))
    joined = local.join(more, (F.col("part") == F.col("of")) & (F.col("conv_id") == F.col("going")), "left")
    place, cum = (F.col(c) + F.coalesce(c + "s", F.lit(0)) for c in ("place", "cum"))
    return joined.select("conv_id", place.alias("place"), cum.alias("cum"), "key", "bytes")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and running bytes of the conversations in one sorted range."""
    part, last, place, cum = TaskContext.get().partitionId(), None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        conv, size = b.column(0).to_numpy(), b.column(2).to_numpy()
        start = np.r_[True, conv[1:] != conv[:-1]]
        first = np.maximum.accumulate(np.where(start, np.arange(len(conv)), 0))
        total = np.cumsum(size)
        places = np.arange(len(conv)) - first + 1
        sums = total - (total - size)[first]
        if conv[0] == last:
            places[first == 0] += place
            sums[first == 0] += cum
        last, place, cum = conv[-1], places[-1], sums[-1]
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(len(conv), part, np.int32)), pa.array(places), pa.array(sums)], names=["conv_id", "key", "bytes", "part", "place", "cum"]
        )


def rebuilt(turns: DataFrame, spark: SparkSession, step: int = 5, longest: int = 8) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, depth, key, bytes, after) and every conv_id with its number of them; both written.

    Conversation c is the first h turns of conversation c - c % step, then its own turns after its first h; h is crc32(c) % (longest + 1).
    ``after`` counts the bytes of a turn and of all later ones.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)).cast("int")
    head = F.array_sort(F.collect_list(F.when(F.col("place") <= longest, F.struct("place", "key", "bytes", "cum"))))
    found = turns.groupBy("conv_id").agg(
        F.max("place").alias("n"), F.max("cum").alias("total"), F.coalesce(F.max(F.when(F.col("place") <= h, F.col("cum"))), F.lit(0)).alias("own_skipped"), head.alias("head")
    )
    convs = written(found, spark)
    bases = convs.where(F.col("conv_id") % step == 0).select(F.col("conv_id").alias("base"), F.col("head").alias("begin"))
    own = convs.withColumns({"h": h, "of": F.col("conv_id") - F.col("conv_id") % step}).drop("head")
    begin = F.when(F.col("begin").isNotNull(), F.slice("begin", 1, F.col("h")))
    joined = own.join(bases, F.col("of") == F.col("base"), "left").withColumn("begin", begin)
    m = F.coalesce(F.size("begin"), F.lit(0))
    convs2 = written(joined.withColumn("m", m).select("conv_id", "h", "m", "n", "total", "own_skipped", "begin"), spark)
    discard(convs, spark)
    left = F.col("total") - F.col("own_skipped")
    first = convs2.where("m > 0").select("conv_id", left.alias("left"), F.element_at("begin", -1)["cum"].alias("all"), F.posexplode("begin").alias("at", "t"))
    first = first.select("conv_id", (F.col("at") + 1).cast("bigint").alias("depth"), "t.key", "t.bytes", (F.col("all") - F.col("t.cum") + F.col("t.bytes") + F.col("left")).alias("after"))
    rest = turns.where(F.col("place") > h).join(convs2.select(F.col("conv_id").alias("c"), "h", "m", "total"), F.col("conv_id") == F.col("c"))
    rest = rest.select("conv_id", (F.col("m") + F.col("place") - F.col("h")).alias("depth"), "key", "bytes", (F.col("total") - F.col("cum") + F.col("bytes")).alias("after"))
    rows = written(first.unionByName(rest), spark)
    lengths = convs2.select("conv_id", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return rows, lengths


def classes(rows: DataFrame, lengths: DataFrame, spark: SparkSession) -> DataFrame:
    """rep (smallest conv_id), n, length and the SHA-256 of the ids of each class of conversations with the same turns; written.

    Sequences are told apart by their length and 128 bits that combine the SHA-256 values and places of all turns.
    """
    said = [F.bit_xor(F.xxhash64(F.lit(seed), "depth", "key")).alias(name) for seed, name in ((1, "p"), (2, "q"))]
    marks = rows.groupBy(F.col("conv_id").alias("c")).agg(*said)
    all_ = lengths.join(marks, F.col("conv_id") == F.col("c"), "left").select("length", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q"), "conv_id")
    ordered = all_.repartition("length", "p", "q").sortWithinPartitions("length", "p", "q", "conv_id")
    return written(ordered.mapInArrow(_chained, "rep bigint, n bigint, length bigint, ends binary"), spark)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a class from rows in order of class and id; the digest goes on from batch to batch."""
    kind = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("length", pa.int64()), ("ends", pa.binary())])
    now, digest, rep, n = None, None, 0, 0
    for b in batches:
        done: list[tuple] = []
        for length, p, q, conv in zip(*(c.to_pylist() for c in b.columns)):
            if (length, p, q) != now:
                if now is not None:
                    done.append((rep, n, now[0], digest.digest()))
                now, digest, rep, n = (length, p, q), hashlib.sha256(b"%d" % conv), conv, 1
            else:
                digest.update(b",%d" % conv)
                n += 1
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), kind)], schema=kind)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((rep, n, now[0], digest.digest()), kind)], schema=kind)


def _ahead(live: DataFrame, rows: DataFrame, depth: int) -> DataFrame:
    """Live classes with their next AHEAD turns after a depth."""
    near = rows.where((F.col("depth") > depth) & (F.col("depth") <= depth + AHEAD))
    turns = near.join(live.select(F.col("rep").alias("r")), F.col("conv_id") == F.col("r"), "left_semi")
    listed = turns.groupBy(F.col("conv_id").alias("r")).agg(F.array_sort(F.collect_list(F.struct("depth", "key", "bytes", "after"))).alias("next"))
    return live.join(listed, F.col("rep") == F.col("r")).drop("r")


def trie(rows: DataFrame, known: DataFrame, spark: SparkSession) -> DataFrame:
    """The nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends (SHA-256, binary)."""
    root = known.agg(F.min("rep").alias("conv_id"), F.sum("n").alias("n"), F.max(F.when(F.col("length") == 0, F.col("ends"))).alias("ends")).first()
    folder = shared_folder(spark)
    grown: list[DataFrame] = []
    live = known.where("length > 0").withColumn("node", F.lit(root.conv_id).cast("bigint"))
    depth = 0
    while True:
        if depth % AHEAD == 0:
            live = written(_ahead(live.drop("next"), rows, depth), spark)
        if live.isEmpty():
            break
        depth += 1
        turn = F.element_at("next", (depth - 1) % AHEAD + 1)
        coming = live.withColumns({"key": turn["key"], "bytes": turn["bytes"], "after": turn["after"]})
        nodes = written(
            coming.groupBy("node", "key").agg(
                F.min("rep").alias("child"),
                F.sum("n").alias("n_convs"),
                F.count("*").alias("n_classes"),
                F.max("bytes").alias("bytes"),
                F.max(F.when(F.col("length") == depth, F.col("ends"))).alias("ends"),
                F.max("length").alias("length"),  # with after, of use where one class is all
                F.max("after").alias("after"),
            ),
            spark,
        )
        grown.append(nodes)
        shared = nodes.where("n_classes > 1").select(F.col("node").alias("of"), F.col("key").alias("turn"), "child")
        same = (F.col("node") == F.col("of")) & (F.col("key") == F.col("turn"))
        further = coming.where(F.col("length") > depth).join(shared, same).select("rep", "n", "length", "ends", F.col("child").alias("node"), "next")
        then = written(further, spark)
        discard(live, spark)
        live = then
    alone, up = F.col("n_classes") == 1, None
    for d in range(len(grown), 0, -1):
        level = grown[d - 1]
        counts = [F.lit(0).cast("bigint").alias(c) for c in ("children", "leaves", "saved")]
        level = level.select("*", *counts) if up is None else level.join(up, F.col("child") == F.col("parent"), "left")
        level.select(
            F.col("child").alias("conv_id"),
            F.lit(d).cast("bigint").alias("depth"),
            F.col("node").alias("parent_conv_id"),
            "n_convs",
            F.when(alone, (F.col("length") > d).cast("bigint")).otherwise(F.coalesce("children", F.lit(0))).alias("n_children"),
            F.when(alone, F.lit(1)).otherwise(F.coalesce("leaves", F.lit(1))).cast("bigint").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.when(alone, F.col("after")).otherwise(F.col("bytes") + 0) + F.when(alone, F.lit(0)).otherwise(F.coalesce("saved", F.lit(0)))).alias("saved_tokens"),
            "ends",
            F.when(alone & (F.col("length") > d), F.col("length")).alias("chain"),
        ).write.parquet(f"{folder}/{d}")
        rolled = spark.read.schema(ROLLED).parquet(f"{folder}/{d}")
        up = rolled.groupBy(F.col("parent_conv_id").alias("parent")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    if root.conv_id is None:
        return spark.createDataFrame([], NODE)
    top = up.first() if up is not None else None
    above = spark.createDataFrame([(root.conv_id, 0, None, root.n, top.children if top else 0, top.leaves if top else 1, top.saved if top else 0, root.ends)], NODE)
    if up is None:
        return above
    levels = spark.read.schema(ROLLED).parquet(*(f"{folder}/{d}" for d in range(1, len(grown) + 1)))
    begun = levels.where("chain is not null").select(F.col("conv_id").alias("rep"), F.col("depth").alias("from"), "n_convs", "chain", F.lit(1).alias("one"))
    ends = begun.join(known.select(F.col("rep").alias("r"), F.col("ends").alias("id_hash")), F.col("rep") == F.col("r"))
    later = rows.join(ends, (F.col("conv_id") == F.col("rep")) & (F.col("depth") > F.col("from")))
    chains = later.select(
        "conv_id",
        "depth",
        F.col("conv_id").alias("parent_conv_id"),
        "n_convs",
        (F.col("depth") < F.col("chain")).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("after")).alias("saved_tokens"),
        F.when(F.col("depth") == F.col("chain"), F.col("id_hash")).alias("ends"),
    )
    return above.unionByName(levels.drop("chain")).unionByName(chains)


NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends binary"
ROLLED = NODE + ", chain bigint"


def prefix_trie(conversations: DataFrame, spark: SparkSession) -> DataFrame:
    """Every node of the trie over rebuilt conversations, with the SHA-256 of the ids that end at it."""
    turns = turn_rows(conversations, spark)
    rows, lengths = rebuilt(turns, spark)
    nodes = trie(rows, classes(rows, lengths, spark), spark)
    ends: Column = F.lower(F.hex(F.coalesce("ends", F.lit(NO_IDS))))
    return nodes.withColumn("ends_sha256", ends).drop("ends")


#: DuckDB: a node is the list of its turns itself. crc32 is its bitwise definition over the decimal digits.
ORACLE = """
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
  {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(said ORDER BY place) AS said FROM turns GROUP BY conv_id),
cut AS (SELECT conv_id, said, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
  lambda c: list_transform(range(8), lambda j: (CAST(ascii(c) AS BIGINT) >> CAST(j AS BIGINT)) & 1)))),
  lambda crc, bit: xor(crc >> 1, CASE WHEN (xor(crc, bit) & 1) = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END)), CAST(4294967295 AS BIGINT)) % 9 AS BIGINT) AS h FROM own),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.said, [])[1:c.h], c.said[c.h + 1:]) AS said FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
member AS (SELECT conv_id, d AS depth, said[1:d] AS path, d = len(said) AS ending FROM rebuilt, unnest(range(len(said) + 1)) AS u(d)),
node AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ending), '') AS ends
  FROM member GROUP BY path, depth),
below AS (SELECT path[1:depth - 1] AS up, count(*) AS n FROM node WHERE depth > 0 GROUP BY up),
flat AS (SELECT n.*, coalesce(b.n, 0) AS n_children, (n.n_convs - 1) * coalesce(strlen(n.path[n.depth].t), 0) AS saved FROM node n LEFT JOIN below b ON b.up = n.path),
summed AS (SELECT path[1:d] AS top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM flat, unnest(range(depth + 1)) AS u(d) GROUP BY top)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM flat f JOIN summed s ON s.top = f.path LEFT JOIN node p ON f.depth > 0 AND p.path = f.path[1:f.depth - 1]
"""
