"""Benchmark decontamination by a prefix-filtered set join with exact verification.

A window is ``width`` consecutive words of an item (an item of fewer words is one window). A window occurs in
a document only where the document contains all its words, so containment is 1 and the necessary prefix of a
window, its words ordered by rarity, is its single rarest word. The join:

1. document frequencies of the benchmark's words, over all documents (counts leave the map side combined, one row
   per benchmark word and task);
2. every window is filed under its rarest word with that word's offset in the window;
3. each document looks up its words among those; a match fixes where the window would begin. Length and position
   bounds drop windows that would begin before the document or end after it;
4. the remaining ones are verified word by word, and every word inside an occurrence is hit.

Where the benchmark's text has at most ``small`` bytes its windows are broadcast and the documents never move: a hot passage costs the
documents that hold it, and nothing else. A larger benchmark stays distributed, in the same steps: a Bloom filter
of fixed size tells documents which of their words may be prefixes; each of these goes out once a place and text, with the words
around it, and meets the windows of its word in a shuffle join. Windows that pass the bounds and are found in these words are occurrences. Texts are known
there by their SHA-256, so copies of a text and a hot passage move once a task; what a join on a frequent word gets is split by
the executors' adaptive plan, and hits return to the documents by the hash of the text.

Null or empty texts have no words and no hits; empty items match nothing; an empty benchmark hits nothing.
Repeated item rows count once per ``item_id``; items without an id mark words but aren't listed. Every document
row gives one row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import free_name, utf8, written

#: Maps A-Z to a-z, keeps a-z, digits and all bytes from 0x80, and makes all others spaces.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(WORD_BYTES).split()


class Windows:
    """Windows of a block of items, filed under their rarest words."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], rarity: dict[bytes, int], width: int) -> None:
        self.filed: dict[bytes, list[tuple[int, tuple[bytes, ...], set]]] = {}
        found: dict[tuple[bytes, ...], set] = {}
        for item, words in items:
            for i in range(max(1, len(words) - width + 1) if words else 0):
                found.setdefault(tuple(words[i : i + width]), set()).add(item)
        for window, owners in found.items():
            at = min(range(len(window)), key=lambda i: (rarity.get(window[i], 0), window[i], i))
            self.filed.setdefault(window[at], []).append((at, window, owners))
        self.prefix = frozenset(self.filed)

    def occurrences(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of the words that lie in occurrences, and the items these belong to."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        if self.prefix.isdisjoint(words):
            return spans, items
        n, filed = len(words), self.filed
        for i, word in enumerate(words):
            for at, window, owners in filed.get(word, ()):
                start = i - at
                if start >= 0 and start + len(window) <= n and tuple(words[start : start + len(window)]) == window:
                    spans.append((start, start + len(window)))
                    items |= owners
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _frequencies(docs: DataFrame, text: str, vocabulary) -> DataFrame:
    """(word, n): documents that hold each word of the broadcast vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = pickle.loads(vocabulary.value), Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(known.intersection(words_of(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return docs.select(text).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("item_text"))


def _sent(docs: DataFrame, benchmark: DataFrame, spark: SparkSession, width: int, small: int, text: str):
    """A broadcast of all windows where the benchmark is small, else None."""
    items = _items(benchmark)
    if (items.agg(F.sum(F.octet_length("item_text") + 16)).first()[0] or 0) > small:
        return None
    found = [(r.item, words_of(r.item_text)) for r in items.collect()]
    known = frozenset(w for _, words in found for w in words)
    counted = _frequencies(docs, text, spark.sparkContext.broadcast(pickle.dumps(known))).collect() if known else []
    return spark.sparkContext.broadcast(pickle.dumps(Windows(found, {bytes(r.word): r.n for r in counted}, width)))


# a benchmark that isn't broadcast

#: Bits of the filter of prefix words, and how many each word sets.
BLOOM_BITS, BLOOM_HASHES = 1 << 26, 4


def _bloom_places(words: list[bytes]) -> np.ndarray:
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return ((hashes[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(BLOOM_BITS)).astype(np.int64)


def _all_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """(word, n): documents that hold each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(set(words_of(t.as_py())))
                if len(seen) > 1 << 20:
                    yield emit(seen)
                    seen.clear()
        yield emit(seen)

    def emit(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return docs.select(text).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(item, window): the windows of all items, as their words joined by spaces, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(t)
                found = list({b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}) if words else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())], names=["item", "window"])

    return _items(benchmark).mapInArrow(run, "item string, window binary").distinct()


def _filed(windows: DataFrame, docs: DataFrame, text: str, spark: SparkSession) -> DataFrame:
    """(prefix, at, window): every window under its rarest word. Windows of a word that no document has can't occur and are left out."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, x, i) for w in b.column(0).to_pylist() for i, x in enumerate(w.split(b" "))]
            for at in range(0, len(rows), 65536):
                found, words, places = zip(*rows[at : at + 65536])
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(words, pa.binary()), pa.array(places, pa.int32())], names=["window", "word", "at"])

    words = windows.select("window").distinct().mapInArrow(split, "window binary, word binary, at int")
    counted = words.join(_all_frequencies(docs, text).withColumnRenamed("word", "known"), F.col("word") == F.col("known"), "left")
    best = counted.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("least"))
    return written(best.where("least.n > 0").select(F.col("least.word").alias("prefix"), F.col("least.at").alias("at"), "window"), spark)


def _occurrences(docs: DataFrame, windows: DataFrame, spark: SparkSession, width: int, text: str) -> DataFrame:
    """(key, start, stop, window) of the windows that occur, by the SHA-256 of the text."""
    filed = _filed(windows, docs, text, spark)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = np.unique(_bloom_places(b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(places >> 6), pa.array((np.uint64(1) << (places & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    table = np.zeros(BLOOM_BITS // 64, np.uint64)
    set_ = filed.select("prefix").distinct().mapInArrow(bits, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table[set_.column("word").to_numpy()] = set_.column("bits").to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(table)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                words = words_of(t.as_py())
                if not words:
                    continue
                distinct = list(set(words))
                at = _bloom_places(distinct)
                there = ((sent.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(1)
                known = {w for w, x in zip(distinct, there.tolist()) if x}
                where = [i for i, w in enumerate(words) if w in known]
                key = hashlib.sha256(utf8(t.as_py())).digest()
                for k in range(0, len(where), 4096):
                    some = where[k : k + 4096]
                    columns = [pa.array([key] * len(some), pa.binary()), pa.array([words[i] for i in some], pa.binary()), pa.array(some, pa.int32())]
                    around = [pa.array([b" ".join(words[max(0, i - width + 1) : i]) for i in some], pa.binary()), pa.array([b" ".join(words[i : i + width]) for i in some], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns + around, names=["key", "word", "place", "before", "after"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, place, before, after, at, window = (c.to_pylist() for c in b.columns)
            rows = []
            for i, w in enumerate(window):
                n, left = w.count(b" ") + 1, before[i].split(b" ") if before[i] else []
                if at[i] <= len(left) and left[len(left) - at[i] :] + after[i].split(b" ")[: n - at[i]] == w.split(b" "):
                    rows.append((key[i], place[i] - at[i], place[i] - at[i] + n, w))
            found = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.binary()), pa.array(found[1], pa.int32()), pa.array(found[2], pa.int32()), pa.array(found[3], pa.binary())], names=["key", "start", "stop", "window"])

    spots = docs.select(text).mapInArrow(places, "key binary, word binary, place int, before binary, after binary").distinct()
    met = spots.join(filed, F.col("word") == F.col("prefix")).select("key", "place", "before", "after", "at", "window")
    return written(met.mapInArrow(verified, "key binary, start int, stop int, window binary"), spark)


def _key(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def _joined(docs: DataFrame, benchmark: DataFrame, spark: SparkSession, width: int, text: str, kind: str) -> DataFrame:
    """``contamination`` without a broadcast of the windows."""
    windows = written(_windows(benchmark, width), spark)
    hits = _occurrences(docs, windows, spark, width, text)
    items = hits.select("key", "window").distinct().join(windows, "window").where("item is not null").select("key", "item").distinct()
    items = items.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[x for span in merged([(s["start"], s["stop"]) for s in row]) for x in span] for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(pa.int32()))], names=["key", "spans"])

    spans = hits.select("key", "start", "stop").distinct().groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("found")).mapInArrow(union, "key binary, spans array<int>")
    found = spans.join(items.withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left").select("key", "spans", "item_ids")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            counts, keys = [len(words_of(t)) for t in texts], [hashlib.sha256(utf8(t)).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "n_words", "text_key"])

    rows = docs.select("doc_id", text).mapInArrow(counted, f"doc_id {kind}, n_words bigint, text_key binary")
    none = lambda t: F.array().cast(f"array<{t}>")
    return rows.join(found, F.col("text_key") == F.col("key"), "left").select("doc_id", "n_words", F.coalesce("spans", none("int")).alias("spans"), F.coalesce("item_ids", none("string")).alias("item_ids"))


def contamination(docs: DataFrame, benchmark: DataFrame, spark: SparkSession, width: int = 10, small: int = 8 << 20, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings) and spans (start and end word) of every document."""
    kind = dict(docs.dtypes)["doc_id"]
    fields = {"doc_id": kind, "n_words": "bigint", "spans": "array<int>", "item_ids": "array<string>"}
    sent = _sent(docs, benchmark, spark, width, small, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = pickle.loads(sent.value)
        for b in batches:
            counts, spans, ids = [], [], []
            for t in b.column(1):
                words = words_of(t.as_py())
                found, owners = windows.occurrences(words)
                counts.append(len(words))
                spans.append([x for span in merged(found) for x in span])
                ids.append(sorted(o for o in owners if o is not None))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.string()))], names=list(fields))

    if sent is None:
        out = _joined(docs, benchmark, spark, width, text, kind)
    else:
        out = docs.select("doc_id", text).mapInArrow(run, ", ".join(f"{k} {v}" for k, v in fields.items()))
    n_hit = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (s, x) -> s + x)")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), "item_ids", "spans")


def clean_documents(docs: DataFrame, benchmark: DataFrame, spark: SparkSession, width: int = 10, small: int = 8 << 20, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, whose text has no occurrence of a benchmark window."""
    at, sent = docs.columns.index(text), _sent(docs, benchmark, spark, width, small, text)
    if sent is None:
        hits = _occurrences(docs, written(_windows(benchmark, width), spark), spark, width, text)
        name = free_name(docs, "__key")
        return docs.join(hits.select(F.col("key").alias(name)).distinct(), _key(text) == F.col(name), "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = pickle.loads(sent.value)
        for b in batches:
            yield b.filter(pa.array([not windows.occurrences(words_of(t.as_py()))[0] for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
