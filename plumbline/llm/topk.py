"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Components become integers, ``floor(scale * x)``. Vectors are dealt in blocks of bounded size; each block sorts one
list per dimension. A query walks all lists together, from the end that its own component favours: after depth
t, no unseen vector can score more than the sum over dimensions of the query's component times the value at depth t.
The walk scores whatever it meets for the first time, and stops when that bound is below the k-th best score
(at equality it goes on, as an unseen vector could win the tie). Depths grow geometrically, so the walk reads
at most ``GROWTH`` times the depth at which it could first have stopped. Blocks give k rows a query at most, and a
limit by rank that combines before the shuffle merges them.

Queries reach the blocks in chunks of about ``chunk`` distinct vectors, dealt by id and vector. One chunk after the other is
broadcast, answered by all blocks, reduced to k rows a query and written, and let go: what is sent, and what the driver holds, has a
fixed bound however many queries there are, and however many share an id. A chunk sorts a block's lists anew, which is little beside
its thousands of walks.

Vectors that are null or hold null or non-finite components take no part; vectors of different lengths have no
product and aren't compared; empty vectors score 0. Rows that share a query's id count as its own row and are no candidates for it.
Repeated query rows ask once. An id with different query vectors asks with each of them: its k best are the k best candidate rows,
each counted once, at the best score that one of its vectors gives it.
Rows without an id take no part. Ties go to the smaller id; repeated candidate rows each take a rank. Scores that 64 bits cannot hold saturate.
Extra columns don't matter; a table without usable rows gives none.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import written

#: Vectors of a block: lists, values and scores of one are in memory at a time.
BLOCK = 8192
FIRST_DEPTH = 16
GROWTH = 2
EXACT = 1 << 53


class Lists:
    """A block of vectors of one length, with a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.by_id, self.ids, self.values = by_id, ids[by_id], values[by_id]
        self.order = np.argsort(self.values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, self.order, 0)
        self.most = int(np.abs(self.values).max(initial=0))

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact products: in floats while every sum stays below 2^53, else in Python's integers."""
        if self.most * int(np.abs(query).max(initial=0)) * max(1, len(query)) < EXACT:
            return (self.values[rows] @ query).astype(np.int64)
        exact = [sum(int(a) * int(b) for a, b in zip(v, query)) for v in self.values[rows]]
        return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in exact], np.int64)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, best first."""
        rows, best = self.best(query, own, k)
        return self.ids[rows], best

    def best_of(self, queries: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows for all of one id's vectors, each at its best score, and these scores."""
        rows, best = (np.concatenate(x) for x in zip(*(self.best(q, own, k) for q in queries)))
        order = np.lexsort((rows, -best))
        order = order[np.sort(np.unique(rows[order], return_index=True)[1])[:k]]
        return rows[order], best[order]

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows and their scores, best first."""
        n, d = self.values.shape
        up = query >= 0
        best_rows, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = self.ids == own
        depth, done = min(n, FIRST_DEPTH), 0
        while True:
            if d:
                met = np.concatenate([self.order[n - depth : n - done][:, up].ravel(), self.order[done:depth][:, ~up].ravel()])
                fresh = np.zeros(n, bool)
                fresh[met] = True
            else:
                fresh = np.ones(n, bool)
            rows = np.nonzero(fresh & ~seen)[0]
            seen |= fresh
            if len(rows):
                best_rows, best = np.r_[best_rows, rows], np.r_[best, self.scores(rows, query)]
                order = np.lexsort((best_rows, -best))[:k]  # rows are in order of id
                best_rows, best = best_rows[order], best[order]
            if depth == n or seen.all():
                break
            if len(best) == k:
                edge = np.where(up, self.sorted[n - depth], self.sorted[depth - 1])
                if sum(int(a) * int(b) for a, b in zip(edge, query)) < int(best[-1]):
                    break
            done, depth = depth, min(n, depth * GROWTH)
        return best_rows, best


def _integers(batch: pa.RecordBatch, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids and whole-number vectors (as floats) of a batch's usable rows, and their places in it, by length."""
    found: dict[int, tuple[list, list, list]] = {}
    for place, (key, vector) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
        if key is None or not vector.is_valid or vector.values.null_count:
            continue
        x = np.asarray(vector.values.to_numpy(zero_copy_only=False), np.float64)
        if np.isfinite(x).all():
            ids, rows, places = found.setdefault(len(x), ([], [], []))
            ids.append(key)
            places.append(place)
            rows.append(np.floor(scale * x))
    return {d: (np.array(ids, np.int64), np.array(rows, np.float64).reshape(len(ids), d), np.array(places, np.int64)) for d, (ids, rows, places) in found.items()}


def top_k(vectors: DataFrame, queries: DataFrame, spark: SparkSession, k: int = 10, scale: float = 1024.0, chunk: int = 16384, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows."""
    usable = lambda df: df.select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("vector")).where("key is not null and vector is not null")
    asked, rows = written(usable(queries).distinct(), spark), usable(vectors)
    # candidate rows are told apart by their place in the table, the same for every chunk of queries
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    count, owners = asked.agg(F.count("*"), F.count_distinct("key")).first()
    chunks = max(1, -(-count // chunk))

    def answer(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            questions = pickle.loads(sent.value)
            waiting: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

            def found(d: int) -> Iterator[pa.RecordBatch]:
                parts = waiting.pop(d)
                ids, values, places = (np.concatenate(x) for x in zip(*parts))
                lists = Lists(ids, values)
                places = places[lists.by_id]
                owners, starts = np.unique(questions[d][0], return_index=True)
                ends = np.r_[starts[1:], len(questions[d][0])]
                for at in range(0, len(owners), 256):
                    some = slice(at, at + 256)
                    tops = [lists.best_of(questions[d][1][x:y], own, k) for own, x, y in zip(owners[some].tolist(), starts[some], ends[some])]
                    best_rows, best = (np.concatenate(x) for x in zip(*tops))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(owners[some], [len(t[0]) for t in tops])), pa.array(lists.ids[best_rows]), pa.array(best), pa.array(places[best_rows])], names=["query_id", "vec_id", "score", "place"])

            for b in batches:
                for at in range(0, b.num_rows, BLOCK):
                    for d, (*part, row) in _integers(b.slice(at, BLOCK), scale).items():
                        if d in questions:
                            part = (*part, np.asarray(b.column(2))[at + row])
                            waiting.setdefault(d, []).append(part)
                            if sum(len(p[0]) for p in waiting[d]) >= BLOCK:
                                yield from found(d)
            for d in list(waiting):
                yield from found(d)

        return run

    def collected(part: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        batches = part.toArrow().combine_chunks().to_batches()
        found = _integers(batches[0], scale) if batches else {}
        by_id = {d: np.argsort(ids, kind="stable") for d, (ids, _, _) in found.items()}
        return {d: (ids[by_id[d]], values[by_id[d]]) for d, (ids, values, _) in found.items()}

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def answered(c: int) -> DataFrame:
        part = collected(asked.where(F.pmod(F.xxhash64("key", "vector"), F.lit(chunks)) == c))
        sent = spark.sparkContext.broadcast(pickle.dumps(part))
        return sent, best(rows.mapInArrow(answer(sent), "query_id bigint, vec_id bigint, score bigint, place bigint"))

    if chunks == 1:
        return answered(0)[1].select("query_id", "rank", "vec_id", "score")
    parts = []
    for c in range(chunks):
        sent, found = answered(c)
        parts.append(written(found.drop("rank"), spark))
        sent.unpersist()
    out = functools.reduce(DataFrame.unionByName, parts)
    if owners < count:  # an id's vectors may be in several chunks
        out = out.groupBy("query_id", "place").agg(F.first("vec_id").alias("vec_id"), F.max("score").alias("score"))
    return best(out).select("query_id", "rank", "vec_id", "score")


#: DuckDB: all products of the queries with all rows, ranked.
ORACLE = """
WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS d, unnest(embedding) AS e FROM embeddings WHERE vec_id IS NOT NULL),
bad AS (SELECT DISTINCT vec_id FROM x WHERE e IS NULL OR NOT isfinite(e)),
v AS (SELECT vec_id, d, CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT) AS e FROM x WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(sum(q.e * v.e) AS BIGINT) AS score FROM v AS q JOIN v ON q.d = v.d AND q.vec_id <> v.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, v.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
