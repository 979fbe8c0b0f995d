"""Links between texts whose sets of five-word shingles have a Jaccard similarity of ``least`` or more.

Candidates: each distinct text has ``BANDS`` buckets, each of ``ROWS`` minima of its shingles' hashes. Two texts at similarity s
share none with probability ``(1 - s^ROWS)^BANDS``, at 0.8 six in ten million and less above. Candidates are checked exactly,
on the words themselves. Texts that are known to be in one group are not compared: a first round checks neighbours in each
bucket, and only what these leave apart is compared with the rest of its bucket, so large groups of copies stay linear.

Words are those of the fingerprints; a text of fewer than five is one shingle, and texts without words link to nothing here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import utf8, written
from plumbline.llm.components import connected_components

WIDTH, ROWS, BANDS = 5, 5, 36
_RANDOM = np.random.default_rng(5)
XOR = _RANDOM.integers(0, 1 << 64, ROWS * BANDS, np.uint64)
ODD = _RANDOM.integers(0, 1 << 64, ROWS * BANDS, np.uint64) | np.uint64(1)


def shingles(text: str | None) -> set[bytes]:
    words = utf8(text).lower().split()
    if not words:
        return set()
    return {b" ".join(words)} if len(words) < WIDTH else set(map(b" ".join, zip(*(words[i:] for i in range(WIDTH)))))


def buckets(text: str | None) -> list[int]:
    """A number for each band; none without words."""
    found = shingles(text)
    if not found:
        return []
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[at : at + 2048, None] ^ XOR) * ODD).min(0))
    return [xxhash.xxh3_64_intdigest(band.tobytes(), n) - (1 << 63) for n, band in enumerate(least.reshape(BANDS, ROWS))]


def with_buckets(texts: DataFrame) -> DataFrame:
    """key, fp, bucket of the rows (key, fp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                found = [buckets(t.as_py()) for t in b.column(2)]
                rows = pa.array(np.repeat(np.arange(b.num_rows), list(map(len, found))))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array([x for f in found for x in f], pa.int64())], names=["key", "fp", "bucket"])

    return texts.select("key", "fp", "text").mapInArrow(run, "key bigint, fp bigint, bucket bigint")


def _candidates(rows: DataFrame, neighbours: bool) -> DataFrame:
    """Distinct pairs (a, b) of keys that share a bucket and not a root: neighbours in it, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for b in batches:
            cols = [np.asarray(b.column(k)) for k in range(3)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if len(cols[0]):
                cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last bucket may go on
                rest = [c[cut:] for c in cols]
                yield from pairs(*(c[:cut] for c in cols))
        if rest is not None:
            yield from pairs(*rest)

    def pairs(bucket: np.ndarray, root: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        gaps = range(1, 2 if neighbours else len(bucket))
        for gap in gaps:
            same = bucket[gap:] == bucket[:-gap]
            if not same.any():
                break
            i = np.nonzero(same & (root[gap:] != root[:-gap]))[0]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(key[i], key[i + gap])), pa.array(np.maximum(key[i], key[i + gap]))], names=["a", "b"])

    dealt = rows.select("bucket", "root", "key").repartition("bucket").sortWithinPartitions("bucket", "key")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _checked(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between the fingerprints of the pairs that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = shingles(x.as_py()), shingles(y.as_py())
                both = len(p & q)
                near.append(both > 0 and both >= least * (len(p) + len(q) - both))
            kept = pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"])
            yield kept.filter(pa.array(near, pa.bool_()))

    one, two = (texts.select(F.col("key").alias(k), F.col("fp").alias(f), F.col("text").alias(t)) for k, f, t in (("a", "fp_a", "text_a"), ("b", "fp_b", "text_b")))
    return pairs.join(one, "a").join(two, "b").select("fp_a", "fp_b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def similar_links(texts: DataFrame, roots: DataFrame, spark: SparkSession, least: float) -> DataFrame:
    """Links (a, b) between fingerprints that join all texts (key, fp, text; distinct) at ``least`` or more, beside the groups
    (fp_of, root) already known."""
    placed = written(with_buckets(texts), spark)
    shared = placed.groupBy("bucket").agg((F.min("fp") != F.max("fp")).alias("several")).where("several").select("bucket")
    placed = written(placed.join(shared, "bucket", "left_semi"), spark)
    links, tried = None, None
    for neighbours in (True, False):
        rooted = placed.join(roots, placed.fp == roots.fp_of).select("bucket", "root", "key")
        pairs = _candidates(rooted, neighbours)
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), spark)
        found = written(_checked(pairs, texts, least), spark)
        links, tried = found if links is None else links.unionByName(found), pairs
        if neighbours:
            joined = roots.select(F.col("fp_of").alias("a"), F.col("root").alias("b")).unionByName(links)
            groups = connected_components(joined, spark)
            roots = roots.join(groups, roots.fp_of == groups.node, "left").select("fp_of", F.coalesce(groups.root, "fp_of").alias("root"))
    return links
