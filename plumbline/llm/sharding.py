"""Sharding on a consistent-hash ring with virtual nodes and bounded loads; DataFrame operations only.

The ring is cut into ``cells`` equal cells. Every shard owns ``vnodes`` cells (its virtual nodes); a row hashes to
a cell and belongs to the first virtual node at or after it, clockwise. No shard takes more than its capacity:
the n rows are shared out so that capacities differ by one at most and add up to n. Rows that arrive at a full
shard continue clockwise to the next virtual node of a shard with room. Hence the law that holds is ``rows``:
all shards are filled exactly, their counts at most one apart. Between two shard counts only the rows of arcs
that changed owner and what overflows differently move.

Who overflows depends on the rows' number in each cell alone, so the walk runs on at most ``cells`` counts (a
bound that no input raises): cells in clockwise order, and within a cell rows by hash. It yields for every cell
runs of ranks that go to one shard at consecutive slots. Rows then find their run by cell and rank; the ranks are
numbered inside each cell, a ``cells``-th of all rows.

The hash covers id and text, so rows that repeat an id still spread, and copies of a text don't share a cell. Rows equal in both
do. In a cell of over ``HOT`` times its share of rows (and ``FEW``), which at most a ``HOT``-th of the cells are, a row that alone makes up over half of
such a number comes after the other rows; its copies are numbered in ``SALTS`` parts side by side, each part after those before it. Places thus
depend on the rows alone, not on how the input is partitioned.
Null ids and texts hash like any value; a null text has no bytes. Rows equal in id and text are interchangeable:
which of them gets which slot is not defined. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import written

#: A cell is hot where it has over HOT times its share of rows, and over FEW; copies of a row in it are numbered in SALTS parts.
HOT, FEW, SALTS = 16, 1 << 16, 64


def ring(shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in clockwise order; a taken cell passes the node on to the next one."""
    if shards * vnodes > cells:
        raise ValueError("the ring needs a cell for every virtual node")
    owner: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            cell = xxhash.xxh64_intdigest(f"shard {shard} node {v}", 42) * cells >> 64
            while cell in owner:
                cell = (cell + 1) % cells
            owner[cell] = shard
    return sorted(owner.items())


def runs(counts: dict[int, int], shards: int, vnodes: int, cells: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first rank) under bounded loads."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    nodes = ring(shards, vnodes, cells)
    out: list[tuple[int, int, int, int, int]] = []
    at, waiting = 0, []
    for cell in sorted(counts):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        waiting.append((cell, 0, at % len(nodes)))
    while waiting:
        later = []
        for cell, rank, node in waiting:
            shard = nodes[node][1]
            take = min(room[shard] - filled[shard], counts[cell] - rank)
            if take:
                out.append((cell, rank, rank + take, shard, filled[shard]))
                filled[shard] += take
            if rank + take < counts[cell]:
                step = node + 1
                while filled[nodes[step % len(nodes)][1]] == room[nodes[step % len(nodes)][1]]:
                    step += 1
                later.append((cell, rank + take, step % len(nodes)))
        waiting = later
    return out


def _ranked(rows: DataFrame, counts: dict[int, int], limit: int) -> DataFrame:
    """The rows with their number in their cell, from 0: by hash, and in hot cells the rows with very many copies last."""
    order, whole = ("h", "doc_id", "text_crc32"), lambda *by: F.row_number().over(W.partitionBy("cell", *by).orderBy(*order)).cast("bigint") - 1
    hot = [c for c, n in counts.items() if n > limit]
    if not hot:
        return rows.withColumn("rank", whole())
    # no more than 2 * cells / HOT rows can have so many copies
    often = rows.where(F.col("cell").isin(hot)).groupBy("cell", *order).agg(F.count("*").alias("n")).where(F.col("n") > limit // 2)
    often = often.select((whole() + 1).alias("group"), *(F.col(c).alias("often_" + c) for c in ("cell", *order)))
    same = [F.col(c).eqNullSafe(F.col("often_" + c)) for c in ("cell", *order)]
    marked = rows.join(F.broadcast(often), same, "left").fillna(0, ["group"]).withColumn("salt", F.when(F.col("group") > 0, F.col("salt")).otherwise(0))
    parts = marked.where(F.col("cell").isin(hot)).groupBy("cell", "group", "salt").agg(F.count("*").alias("n"))
    before = (F.sum("n").over(W.partitionBy("cell").orderBy("group", "salt")) - F.col("n")).alias("before")
    begins = F.broadcast(parts.select("cell", "group", "salt", before))
    numbered = marked.withColumn("rank", whole("group", "salt")).join(begins, ["cell", "group", "salt"], "left")
    return numbered.withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))


def shard_documents(docs: DataFrame, spark: SparkSession, shards: int = 24, vnodes: int = 64, cells: int = 16384, text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, shard and slot of every row."""
    bits = cells.bit_length() - 1
    if cells != 1 << bits:
        raise ValueError("cells must be a power of two")
    content = F.coalesce(F.col(text), F.lit(""))
    rows = written(
        docs.select(
            "doc_id",
            (F.octet_length(content) + 8).cast("bigint").alias("size"),
            F.crc32(content.cast("binary")).alias("text_crc32"),
            F.xxhash64("doc_id", text).alias("h"),
        ).withColumn("cell", F.shiftrightunsigned("h", 64 - bits).cast("int")).withColumn("salt", F.spark_partition_id() % SALTS),
        spark,
    )
    counts = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    kind = "array<struct<cell:int,first:bigint,stop:bigint,shard:int,slot:bigint>>"
    text_of = json.dumps([dict(zip(("cell", "first", "stop", "shard", "slot"), r)) for r in runs(counts, shards, vnodes, cells)])
    placed = spark.range(1).select(F.inline(F.from_json(F.lit(text_of), kind))).withColumnRenamed("cell", "of_cell")
    ranked = _ranked(rows, counts, max(FEW, HOT * sum(counts.values()) // cells))
    own = (F.col("cell") == F.col("of_cell")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop"))
    return ranked.join(F.broadcast(placed), own).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("rank") - F.col("first")).alias("slot")
    )
