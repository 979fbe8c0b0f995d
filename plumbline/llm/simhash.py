"""SimHash near-duplicates by multi-index hashing.

Fingerprints: every shingle's XXH64 votes on 64 bits; a bit is set where over half of the votes are.
Links: fingerprints at most ``radius`` bits apart. Each fingerprint is cut into two 32-bit segments; two
fingerprints within three bits agree in one segment up to one bit (pigeonhole), so every segment value
is looked up together with the Hamming ball of radius one around it. Fetched table matches are verified on
all 64 bits.

What keeps it linear when a third of all rows are copies of one another:

* equal fingerprints collapse before any lookup (a map-side combined aggregate);
* a lookup bucket emits a spanning forest of its verified links, never its pairs. Large buckets first
  merge what lies one bit apart by sorting masked values, and then compare only table rows with members that are not yet
  in one set, block by block;
* a segment value that over ``HOT`` distinct fingerprints share is indexed again: two of its members within three bits agree in one
  byte of the other segment at least, so its bucket is dealt out by those four bytes, and no task meets all of it;
* of two segment values one bit apart only the one with the bit clear probes, which halves the balls.

Rows with equal fingerprints are linked, null and empty texts included (fingerprint zero). A null
``doc_id`` keeps its row and gets a fingerprint, which links others like any; its component is named by the smallest
id of the whole group, or null when no row of the group has one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import free_name, utf8, written
from plumbline.llm.components import connected_components
from plumbline.llm.minhash import similar_links

SEED = 42
#: Buckets with more members than this merge one-bit neighbours by sorting before they compare blocks.
LARGE_BUCKET = 512
BLOCK = 1024
#: Fingerprints that share a segment value, from which on its bucket is indexed again.
HOT = 4096
ONE = np.uint64(1)
LOW = np.uint64(0xFFFFFFFF)


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the text's word shingles, repeats included; zero where there are no words."""
    words = utf8(text).lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return 0
    shingles: Iterable[bytes] = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    votes, n = np.zeros(64, np.int64), max(1, len(words) - width + 1)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    for start in range(0, n, 1 << 16):
        part = np.fromiter(hashes, np.uint64, min(1 << 16, n - start))
        votes += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text: str = "text", width: int = 3, more: list[str] | None = None) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint's bits as a signed long, and ``more`` columns."""
    more = more or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *more])

    kinds = dict(df.dtypes)
    return df.select("doc_id", text, *more).mapInArrow(run, ", ".join([f"doc_id {kinds['doc_id']}, fp bigint", *(f"{c} {kinds[c]}" for c in more)]))


def hot_values(fps: DataFrame) -> np.ndarray:
    """Buckets (segment and value) that over HOT fingerprints share, ascending. There are at most two for every HOT rows."""
    value = lambda segment: (F.shiftrightunsigned("fp", 32 * segment).bitwiseAND(F.lit(0xFFFFFFFF))) + F.lit(segment << 32)
    counts = fps.select(F.explode(F.array(value(0), value(1))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return np.sort(np.array([r.bucket for r in counts.where(F.col("n") > HOT).select("bucket").collect()], np.int64))


def _probes(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each segment a table row (probe false) and the half ball of values with one more bit set. ``part`` is 0, and in
    hot buckets each of the four bytes of the other segment, with its place."""
    for whole in batches:
        for at in range(0, whole.num_rows, 16384):
            b = whole.slice(at, 16384)
            rep, fp = np.asarray(b.column(0)), np.asarray(b.column(1)).view(np.uint64)
            for segment in (0, 1):
                value = (fp >> np.uint64(32 * segment)) & LOW
                flips = np.arange(32, dtype=np.uint64)
                clear = ((value[:, None] >> flips) & ONE) == 0
                row, bit = np.nonzero(clear)
                keys = np.concatenate([value, value[row] | (ONE << flips[bit])])
                rows = np.concatenate([np.arange(len(fp)), row])
                probe = np.arange(len(rows)) >= len(fp)
                bucket = (keys | np.uint64(segment << 32)).view(np.int64)
                part = np.zeros(len(rows), np.int32)
                again = np.isin(bucket, hot) if len(hot) else np.zeros(len(rows), bool)
                if again.any():
                    other = (fp[rows[again]] >> np.uint64(32 * (1 - segment))) & LOW
                    bytes_ = [((other >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int32) + 256 * k + 1 for k in range(4)]
                    cold = ~again
                    bucket, rows, probe = (np.concatenate([x[cold], *[x[again]] * 4]) for x in (bucket, rows, probe))
                    part = np.concatenate([part[cold], *bytes_])
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(part), pa.array(rep[rows]), pa.array(fp[rows].view(np.int64)), pa.array(probe)], names=["bucket", "part", "rep", "fp", "probe"])


class Forest:
    """Disjoint sets over 0..n-1; ``join`` keeps the links that joined two sets."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                self.links.append((x, y))

    def roots(self) -> np.ndarray:
        return np.fromiter((self.find(i) for i in range(len(self.parent))), np.int64, len(self.parent))


def spanning_links(fp: np.ndarray, radius: int, tables: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints; exact, whatever their number. Of those from ``tables`` on,
    probes, only links with the ones before are looked for."""
    forest, n = Forest(len(fp)), len(fp)
    tables = n if tables is None else tables
    if n > LARGE_BUCKET and radius >= 1:
        for bit in range(64):
            masked = fp & ~(ONE << np.uint64(bit))
            order = np.argsort(masked, kind="stable")
            same = np.nonzero(masked[order][1:] == masked[order][:-1])[0]
            forest.join(order[same], order[same + 1])
        if len(forest.links) == n - 1:
            return forest.links
    root = forest.roots()
    for i in range(0, tables, BLOCK):
        end = min(tables, i + BLOCK)
        for j in range(i, n, BLOCK):
            ri, rj = root[i:end], root[j : j + BLOCK]
            if ri.min() == ri.max() == rj.min() == rj.max():
                continue
            near = (np.bitwise_count(fp[i:end, None] ^ fp[None, j : j + BLOCK]) <= radius) & (ri[:, None] != rj)
            a, b = np.nonzero(near)
            if len(a):
                forest.join(a + i, b + j)
                if len(forest.links) == n - 1:
                    return forest.links
                root = forest.roots()
    return forest.links


def _bucket_links(radius: int):
    def links(key: np.ndarray, rep: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whole buckets, sorted by key, table rows before probes. Buckets without a table row or of one row fetch nothing."""
        start = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
        size = np.diff(np.r_[start, len(key)])
        tables = np.add.reduceat((~probe).astype(np.int64), start)
        left, right = [], []
        small = (size > 1) & (size <= 8) & (tables > 0)
        for gap in range(1, 8):  # small buckets, all at once
            s, n = start[small & (size > gap)], size[small & (size > gap)]
            for at in range(7):
                i = s[n > at + gap] + at
                near = np.bitwise_count(fp[i] ^ fp[i + gap]) <= radius
                left.append(rep[i[near]])
                right.append(rep[i[near] + gap])
        large = (size > 8) & (tables > 0)
        for s, n, t in zip(start[large].tolist(), size[large].tolist(), tables[large].tolist()):
            found = spanning_links(fp[s : s + n], radius, t)
            if found:
                a, b = np.array(found).T
                left.append(rep[s + a])
                right.append(rep[s + b])
        return (np.concatenate(left), np.concatenate(right)) if left else (rep[:0], rep[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            # bucket (33 bits) and part as one key
            key = np.asarray(b.column(0)) * 2048 + np.asarray(b.column(1))
            cols = [key, np.asarray(b.column(2)), np.asarray(b.column(3)).view(np.uint64), b.column(4).to_numpy(zero_copy_only=False)]
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            if cut or waiting and waiting[-1][0][-1] != key[0]:
                waiting.append([c[:cut] for c in cols])
                yield emit(*links(*(np.concatenate(x) for x in zip(*waiting))))
                waiting = []
            waiting.append([c[cut:] for c in cols])
        if waiting:
            yield emit(*links(*(np.concatenate(x) for x in zip(*waiting))))

    def emit(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def near_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) between representatives of distinct fingerprints (rep, fp) that keep every link's
    two ends connected."""
    if not 0 <= radius <= 3:
        raise ValueError("two segments with balls of radius one find distances of up to three")
    hot = hot_values(fps)
    rows = fps.select("rep", "fp").mapInArrow(lambda batches: _probes(batches, hot), "bucket bigint, part int, rep bigint, fp bigint, probe boolean")
    return rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "probe").mapInArrow(_bucket_links(radius), "a bigint, b bigint")


def _roots(fps: DataFrame, spark: SparkSession, radius: int, more: DataFrame | None = None) -> DataFrame:
    """(fp_of, root) of every fingerprint: the least fingerprint of its group. ``more`` are links besides near ones."""
    distinct = written(fps.select("fp").distinct(), spark)
    links = near_links(distinct.select(F.col("fp").alias("rep"), "fp"), radius)
    roots = connected_components(links if more is None else links.unionByName(more), spark)
    return written(distinct.join(roots, distinct.fp == roots.node, "left").select(F.col("fp").alias("fp_of"), F.coalesce("root", "fp").alias("root")), spark)


def simhash_components(docs: DataFrame, spark: SparkSession, text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    fps = written(with_fingerprints(docs, text, width), spark)
    roots = _roots(fps, spark, radius)
    least = fps.groupBy("fp").agg(F.min("doc_id").cast("bigint").alias("least"))
    named = roots.join(least, roots.fp_of == least.fp).groupBy("root").agg(F.min("least").alias("component_id"))
    found = roots.join(named.withColumnRenamed("root", "of"), F.col("root") == F.col("of")).select("fp_of", "component_id")
    return fps.join(found, fps.fp == found.fp_of, "left").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, spark: SparkSession, text: str = "text", width: int = 3, radius: int = 3, similar: float | None = None) -> DataFrame:
    """One row of each group stays: the one of the smallest id; of rows that repeat this id, one. Groups are told apart by
    their fingerprints, so rows of one id with unrelated texts each stand for their own. A row without an id can't
    stand for a group and can't be named as a copy, so it stays; it links others like any row.
    With ``similar``, texts whose five-word shingles have that Jaccard similarity or more are linked as well."""
    name = free_name(docs, "_key")
    keyed = docs.withColumn(name, F.xxhash64(text))
    plain = keyed.select("doc_id", F.col(text).alias("text"), F.col(name).alias("_key"))
    fps = written(with_fingerprints(plain, "text", width, ["_key"]), spark)
    roots = _roots(fps, spark, radius)
    if similar is not None:
        texts = plain.select(F.col("_key").alias("key"), "text").dropDuplicates(["key"])
        texts = written(texts.join(fps.select(F.col("_key").alias("key"), "fp").distinct(), "key"), spark)
        links = similar_links(texts, roots, spark, similar)
        known = roots.select(F.col("fp_of").alias("a"), F.col("root").alias("b"))
        groups = connected_components(known.unionByName(links), spark)
        roots = roots.select("fp_of").join(groups, F.col("fp_of") == groups.node, "left").select("fp_of", F.coalesce("root", "fp_of").alias("root"))
    best = fps.where("doc_id is not null").join(roots, fps.fp == roots.fp_of).groupBy("root").agg(F.min(F.struct("doc_id", "_key")).alias("kept"))
    keep = best.select(F.col("kept.doc_id").alias("kept_id"), F.col("kept._key").alias("kept_key"))
    kept = keyed.join(keep, (keyed.doc_id == keep.kept_id) & (keyed[name] == keep.kept_key), "left_semi").dropDuplicates(["doc_id", name])
    return kept.drop(name).unionByName(docs.where("doc_id is null"))
