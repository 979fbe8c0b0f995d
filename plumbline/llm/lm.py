"""N-gram language model in an Elias-Fano trie, built from the corpus and queried in memory-mapped files.

Level 1 is the vocabulary: words' 64-bit hashes in order, as an Elias-Fano sequence; a word's id is its rank, and a
second sequence holds the running sums of counts. Level k maps a context (a node of level k - 1) and a word to a node.
Its nodes are one Elias-Fano sequence of ``rank of the context, word``, ascending:

* its upper half codes the monotone pointers to where each context's successors begin;
* its lower half holds the successors' words, as many bits each as word ids have;
* beside it stand the quantised probability of every node, and of every context the quantised weight of the lower order.

A lookup selects the pointers of a context and its next one, and searches the word's successor between them.
Probabilities are interpolated with absolute discounting,
``max(c - d, 0) / c(context) + weight(context) * p(word | shorter context)``, d estimated from the counts of
counts, down to the smoothed word frequencies ``(c + a) / (N + a * (V + 1))``. N-grams of two words and more that occur
``min_count`` times or more become nodes (the query keeps all of them, with ``min_count`` 1); the mass of the others
goes to the lower order, so every distribution still adds up to one.

How it is built:

1. words are counted over all training rows (by hash, combined in tasks) and written in ranges of the hash;
2. one pass turns every text into word ids, written once to the shared folder;
3. for each order, tasks count n-grams in sorted runs and cut them into ranges of context and word; the ranges' bounds
   are quantiles of distinct n-grams, so no n-gram is hot, and a hot context is cut too. One task merges a range's
   runs and writes its nodes as one file. An n-gram is counted only where both shorter ones are nodes, which loses
   none that could be one (with ``min_count`` above 1 the discounts come from what was counted);
4. the discount follows from all ranges' counts of counts, and one more pass over the files codes probabilities and
   weights. A context that spans files gets its weight from the sum of their parts.

Counts of ranges follow the input: each stage's tasks hold a bounded number of n-grams. Readers map the files, so
processes share them and pages not used stay on disk. Limits: fewer than 2^32 words, and contexts per level (the
highest order's nodes are no contexts, so their number has no such limit).
Words are told apart by 64-bit hashes; that an unseen word is taken for one of V known ones has probability V / 2^64.

Null texts are empty: one token, the end. Rows without an id count as id '' for the split. With no training rows
every word is unknown and has probability one. Repeated rows count and score each. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import discard, discard_folder, shared_folder, shuffled_once, written
from plumbline.llm.eliasfano import EliasFano, Folder, Opened, prefixed
from plumbline.operators.selection import with_rank

U64 = np.uint64
LOW = U64(0xFFFFFFFF)
OOV = 0xFFFFFFFF
#: Words of a vocabulary file, n-grams that a run is counted from, nodes of a level's file (about, at most).
SHARD_WORDS, SHARD_COUNTS, SHARD_NODES = 1 << 20, 1 << 22, 1 << 21
#: Texts are worked off in slices of about so many bytes, or tokens.
SLICE, TOKENS = 1 << 23, 1 << 20
#: Of the n-grams whose quantiles bound a level's files, how many a file.
DRAWN = 256
#: Steps of a decade in the codes of probabilities and weights.
STEPS = 4096


def code(x: np.ndarray) -> np.ndarray:
    """Numbers of at least 1 (or inverse probabilities) in 16 bits, to a thousandth of their value."""
    return np.minimum(np.rint(np.log10(x) * STEPS), 65535).astype(np.uint16)


def decoded(codes: np.ndarray) -> np.ndarray:
    return INVERSE[codes]


#: What the codes stand for, as probabilities.
INVERSE = 10.0 ** (-np.arange(65536) / STEPS)


def hash_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


@dataclass
class Level:
    """Files of one order: the first key (context and word) that each may hold, its first node, and the weights of
    contexts that span files (ascending)."""

    starts: np.ndarray
    offsets: np.ndarray
    spanning: tuple[np.ndarray, np.ndarray]
    discount: float
    nodes: int


@dataclass
class Model:
    uri: str
    words: int
    tokens: int
    rows: int
    bits: int
    first: np.ndarray
    alpha: float = 0.1
    levels: list[Level] = field(default_factory=list)

    @property
    def base(self) -> int:
        """The number that lifts one context's words over the last one's: ids, the end and the start."""
        return self.words + 2

    @property
    def end(self) -> int:
        return self.words

    @property
    def start(self) -> int:
        return self.words + 1

    @property
    def types(self) -> int:
        return self.words + 1 if self.rows else 0

    def base_probability(self, counts: np.ndarray) -> np.ndarray:
        return (counts + self.alpha) / (self.tokens + self.alpha * (self.types + 1))


class Reader:
    """A model's files, opened as they are needed."""

    def __init__(self, model: Model) -> None:
        self.model, self.opened = model, Opened(Folder(model.uri))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words by their hashes, which ascend; -1 where unknown."""
        m, out = self.model, np.full(len(hashes), -1, np.int64)
        if not m.words:
            return out
        shard = (hashes >> U64(64 - m.bits)).astype(np.int64) if m.bits else np.zeros(len(hashes), np.int64)
        for s, a, b in _slices_of(shard):
            if m.first[s + 1] > m.first[s]:
                found = self.opened.get(f"words-{s}", ("hashes", "sums"))["hashes"].find(hashes[a:b] & U64((1 << (64 - m.bits)) - 1))
                out[a:b] = np.where(found >= 0, found + m.first[s], -1)
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of known ids, which ascend; the end counts the rows."""
        m, out = self.model, np.zeros(len(ids), np.float64)
        shard = np.searchsorted(m.first, ids, "right") - 1
        for s, a, b in _slices_of(shard):
            i = ids[a:b]
            if s >= len(m.first) - 1:
                out[a:b] = m.rows
                continue
            sums = self.opened.get(f"words-{s}", ("hashes", "sums"))["sums"]
            i = i - m.first[s]
            out[a:b] = (sums.access(i + 1) - sums.access(i)).astype(np.float64)
        return out

    def nodes(self, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ascending keys of order k (context, word): the node or -1, its probability or 0, and the weight of the
        lower order after the context."""
        level = self.model.levels[k - 2]
        out, prob, weight = np.full(len(keys), -1, np.int64), np.zeros(len(keys)), np.ones(len(keys))
        if not level.nodes:
            return out, prob, weight
        shard = np.maximum(np.searchsorted(level.starts, keys, "right") - 1, 0)
        for s, a, b in _slices_of(shard):
            f = self.opened.get(f"level{k}-{s}", ("nodes",))
            contexts, words = (keys[a:b] >> U64(32)).astype(np.int64) - int(f["contexts"][0]), keys[a:b] & LOW
            new = np.nonzero(np.r_[True, contexts[1:] != contexts[:-1]])[0]
            rank = contexts[new]
            inside = (rank >= 0) & (rank < int(f["contexts"][1]))
            start, end = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            start[inside], end[inside] = f["nodes"].bucket(rank[inside])
            codes = self.opened.get(f"codes{k}-{s}")
            after = np.ones(len(rank))
            after[inside] = decoded(codes["weights"][rank[inside]])
            times = np.diff(np.r_[new, b - a])
            at = f["nodes"].find_within(np.repeat(start, times), np.repeat(end, times), words)
            hit = np.nonzero(at >= 0)[0]
            out[a + hit] = at[hit] + level.offsets[s]
            prob[a + hit] = decoded(codes["probabilities"][at[hit]])
            weight[a:b] = np.repeat(after, times)
        wide, weights = level.spanning
        first, last = np.searchsorted(keys, wide << U64(32)), np.searchsorted(keys, (wide << U64(32)) | LOW, "right")
        for i in np.nonzero(last > first)[0].tolist():
            weight[first[i] : last[i]] = weights[i]
        return out, prob, weight


def _slices_of(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of the runs of an ascending array."""
    if len(shard):
        start = np.nonzero(np.r_[True, shard[1:] != shard[:-1]])[0]
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(shard)]):
            yield int(shard[a]), a, b


class Words:
    """The words of a batch of texts: the distinct ones' hashes, each word's place among these, and where texts begin."""

    def __init__(self, texts: pa.Array) -> None:
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        place, starts = coded.indices.to_numpy(zero_copy_only=False), np.asarray(split.offsets).astype(np.int64)
        starts = starts - starts[0]
        if b"" in distinct:  # beside white space at a text's ends
            empty = distinct.index(b"")
            real = place != empty
            starts = np.r_[0, np.cumsum(real)][starts]
            place = place[real]
            place = place - (place > empty)
            del distinct[empty]
        self.place, self.starts = place, starts
        self.hashes = np.fromiter(map(hash_of, distinct), U64, len(distinct))


def _slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut where a column's values have come to ``most`` bytes."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        done, start = np.cumsum(sizes), 0
        while start < b.num_rows:
            end = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + most, "right")))
            yield b.slice(start, end - start)
            start = end


# 1. the vocabulary


def _word_counts(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 0, SLICE):
            words = Words(b.column(0))
            counts = np.bincount(words.place, minlength=len(words.hashes))
            yield pa.RecordBatch.from_arrays([pa.array(words.hashes.view(np.int64)), pa.array(counts.astype(np.int64))], names=["h", "n"])

    return texts.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def build_vocabulary(texts: DataFrame, spark: SparkSession, uri: str, alpha: float) -> Model:
    counted = written(_word_counts(texts), spark)
    words, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = texts.count()
    if words >= OOV - 2:
        raise ValueError("more words than ids of 32 bits")
    bits = max(0, (words // SHARD_WORDS).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        for b in batches:  # ascending by shard and hash
            shard = np.asarray(b.column(0))
            for s, x, y in _slices_of(shard):
                for old in [o for o in waiting if o != s]:
                    yield store(old, waiting.pop(old))
                waiting.setdefault(s, []).append((np.asarray(b.column(1))[x:y].view(U64), np.asarray(b.column(2))[x:y].astype(U64)))
        for s in list(waiting):
            yield store(s, waiting.pop(s))

    def store(s: int, parts: list) -> pa.RecordBatch:
        hashes, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(hashes)
        hashes, sums = hashes[order] & U64((1 << (64 - bits)) - 1), np.r_[U64(0), np.cumsum(counts[order])]
        arrays = prefixed("hashes", EliasFano.build(hashes, 1 << (64 - bits))) | prefixed("sums", EliasFano.build(sums, int(sums[-1]) + 1))
        Folder(uri).write(f"words-{s}", arrays)
        return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(hashes)], pa.int64())], names=["shard", "n"])

    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    dealt = counted.withColumn("shard", shard).select("shard", "h", "n").repartitionById(1 << bits, "shard").sortWithinPartitions("shard")
    sizes = np.zeros(1 << bits, np.int64)
    for r in dealt.mapInArrow(run, "shard int, n bigint").collect():
        sizes[r.shard] = r.n
    discard(counted, spark)
    return Model(uri, words, int(total) + rows, rows, bits, np.r_[0, np.cumsum(sizes)], alpha)


# 2. texts as ids


def encode(docs: DataFrame, model: Model, text: str, train: Column) -> DataFrame:
    """doc_id, train, ids (32-bit, start and end included), n_tokens, n_known and base_score of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "train", "ids", "n_tokens", "n_known", "base_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        end = np.log10(model.base_probability(np.array([float(model.rows)])))[0]
        for b in _slices(batches, 2, SLICE):
            words, n = Words(b.column(2)), b.num_rows
            order = np.argsort(words.hashes)
            ids = np.full(len(words.hashes), -1, np.int64)
            ids[order] = reader.ids(words.hashes[order])
            counts, known = np.zeros(len(ids)), np.nonzero(ids >= 0)[0]
            by_id = known[np.argsort(ids[known])]
            counts[by_id] = reader.counts(ids[by_id])
            base = np.log10(model.base_probability(counts))
            lengths = np.diff(words.starts)
            first = words.starts[:-1] + 2 * np.arange(n)  # with a start and an end for each text before
            flat = np.empty(len(words.place) + 2 * n, np.uint32)
            flat[first], flat[first + lengths + 1] = model.start, model.end
            flat[np.arange(len(words.place)) + np.repeat(2 * np.arange(n) + 1, lengths)] = np.where(ids < 0, OOV, ids).astype(np.uint32)[words.place]
            sums = lambda x: np.diff(np.r_[0, np.cumsum(x)][words.starts])
            bounds = np.r_[first, len(flat)] * 4
            if bounds[-1] < 1 << 31:
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(flat)])
            else:
                raw = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(flat)]).cast(pa.binary())
            scores = np.array([base[words.place[x:y]].sum() for x, y in zip(words.starts[:-1].tolist(), words.starts[1:].tolist())], np.float64) + end
            known_words = sums((ids >= 0)[words.place]) + (model.rows > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), raw, pa.array(lengths + 1), pa.array(known_words.astype(np.int64)), pa.array(scores)], names=names)

    rows = docs.select("doc_id", train.alias("train"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, train boolean, ids binary, n_tokens bigint, n_known bigint, base_score double")


def _flat(raw: pa.Array) -> np.ndarray:
    """The ids of a column of coded texts, end to end."""
    _, offsets, data = raw.buffers()
    bounds = np.frombuffer(offsets, np.int32)[raw.offset : raw.offset + len(raw) + 1]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].view(np.uint32) if len(raw) and data is not None else np.zeros(0, np.uint32)


def ordered(high: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of numbers in ascending order, as ``high << width | low``, and where each one came from."""
    keys, bits = (high.astype(U64) << U64(width)) | low.astype(U64), max(1, len(high).bit_length())
    if len(keys) and int(high.max()).bit_length() + width + bits <= 64:  # sorting plain numbers is several times faster
        both = np.sort((keys << U64(bits)) | np.arange(len(keys), dtype=U64))
        return both >> U64(bits), (both & U64((1 << bits) - 1)).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    return keys[order], order


class Sentences:
    """Texts of a slice end to end, each from its start to its end, and their nodes order by order.

    ``nodes`` are the distinct nodes of the present order, ascending, and ``at`` has each token's place among them: that
    of the n-gram that ends there, -1 where it is no node.
    """

    def __init__(self, reader: Reader, tokens: np.ndarray) -> None:
        self.reader, self.order, self.tokens = reader, 1, tokens
        self.first = tokens == reader.model.start
        self.at: np.ndarray | None = None

    def _rank_words(self) -> None:
        found, source = ordered(self.tokens, np.zeros(len(self.tokens), U64), 0)
        new = np.r_[True, found[1:] != found[:-1]] if len(found) else np.zeros(0, bool)
        self.words = found[new]
        self.of_word = np.empty(len(found), np.int64)
        self.of_word[source] = np.cumsum(new) - 1
        known = self.words != U64(OOV)  # unknown words come last
        self.nodes = self.words[known]
        self.at = np.where(self.of_word < len(self.nodes), self.of_word, -1)

    def candidates(self) -> np.ndarray:
        """Keys of the next order's n-grams whose two shorter ones are nodes."""
        t = self.tokens
        if self.order == 1:
            here = np.nonzero(~self.first[1:] & (t[1:] != OOV) & (t[:-1] != OOV))[0]
            return (t[here].astype(U64) << U64(32)) | t[here + 1]
        here = np.nonzero(~self.first[1:] & (self.at[1:] >= 0) & (self.at[:-1] >= 0))[0]
        return (self.nodes[self.at[here]].astype(U64) << U64(32)) | t[here + 1]

    def step(self) -> tuple[np.ndarray, np.ndarray]:
        """Goes up one order: each token's discounted probability there, and the weight of what lies below."""
        if self.at is None:
            self._rank_words()
        n, k = len(self.tokens), self.order + 1
        prob, weight, at = np.zeros(n), np.ones(n), np.full(n, -1, np.int64)
        here = np.nonzero(~self.first[1:] & (self.at[:-1] >= 0))[0]
        nodes = np.zeros(0, np.int64)
        if len(here):
            width = len(self.words).bit_length()
            pairs, source = ordered(self.at[here], self.of_word[here + 1], width)
            new = np.r_[True, pairs[1:] != pairs[:-1]]
            distinct = pairs[new]
            keys = (self.nodes[(distinct >> U64(width)).astype(np.int64)].astype(U64) << U64(32)) | self.words[(distinct & U64((1 << width) - 1)).astype(np.int64)]
            found, p, w = self.reader.nodes(k, keys)
            of, place = np.cumsum(new) - 1, here[source] + 1
            prob[place], weight[place] = p[of], w[of]
            at[place] = np.where(found >= 0, np.cumsum(found >= 0) - 1, -1)[of]
            nodes = found[found >= 0]  # nodes ascend as their keys do
        self.nodes, self.at, self.order = nodes, at, k
        return prob, weight


# 3. counting n-grams


def pack_run(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """An ascending run, small: context steps, and words and counts by their bytes."""
    contexts = (keys >> U64(32)).astype(np.int64)
    steps = np.diff(contexts, prepend=contexts[:1])
    narrow = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
    parts = [narrow(steps), (keys & LOW).astype(np.uint32), narrow(counts)]
    planes = [x.view(np.uint8).reshape(len(keys), -1).T.tobytes() for x in parts]
    head = [len(keys), int(contexts[0]) if len(keys) else 0, parts[0].itemsize, parts[2].itemsize]
    return np.array(head, np.int64).tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack_run(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, first, steps, counts = np.frombuffer(raw[:32], np.int64).tolist()
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[32:]), np.uint8)
    turn = lambda a, size: np.ascontiguousarray(flat[a : a + n * size].reshape(size, n).T).view(f"<u{size}").reshape(n)
    contexts = np.cumsum(turn(0, steps), dtype=np.int64) + first
    return (contexts.astype(U64) << U64(32)) | turn(steps * n, 4), turn((steps + 4) * n, counts).astype(np.int64)


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0] if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    start = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0] if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.diff(np.r_[start, len(keys)])


def _keys(batches: Iterator[pa.RecordBatch], reader: Reader, k: int, most: int) -> Iterator[np.ndarray]:
    """Keys of order-k n-grams of coded texts, some ``most`` at a time."""
    waiting, size = [], 0
    for b in _slices(batches, 0, 4 * TOKENS):
        said = Sentences(reader, _flat(b.column(0)))
        while said.order < k - 1:
            said.step()
        waiting.append(said.candidates())
        size += len(waiting[-1])
        if size >= most:
            yield np.concatenate(waiting)
            waiting, size = [], 0
    if size:
        yield np.concatenate(waiting)


def _bounds(coded: DataFrame, model: Model, k: int, parts: int) -> np.ndarray:
    """Keys that cut the order's n-grams into ``parts`` ranges of about equal numbers: quantiles of the distinct n-grams
    of some training rows, numbered over sorted ranges, so that only the bounds come to the driver. Where they fall decides no result."""
    if parts < 2:
        return np.zeros(0, U64)
    wanted = DRAWN * parts
    rows = max(1, model.tokens // (16 * wanted))
    part = coded.where("train").where(F.pmod(F.xxhash64("doc_id", "n_tokens", "base_score"), F.lit(rows)) == 0).select("ids")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys in _keys(batches, Reader(model), k, SHARD_COUNTS):
            keys, _ = _counted(keys)
            keys = keys[(keys * U64(0x9E3779B97F4A7C15)) >> U64(60) == 0]  # a sixteenth, the same in all tasks
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    unsigned = F.col("key").bitwiseXOR(F.lit(-1 << 63)).alias("u")  # in the order of unsigned keys
    ranked = with_rank(part.mapInArrow(draw, "key bigint").distinct().select("key", unsigned), "u", "place")
    drawn = ranked.count()
    # the first bound that is at this place or after it, and whether it is at this place
    numbered = ranked.withColumn("nth", F.expr(f"greatest(1L, (place * {parts}L + {drawn - 1}L) div {max(1, drawn)}L)"))
    here = numbered.where(f"nth < {parts} AND (nth * {drawn}L) div {parts}L = place")
    found = np.sort(here.select("key").toArrow().column(0).to_numpy().view(U64))
    discard(ranked, coded.sparkSession)
    return found


def _runs(batches: Iterator[pa.RecordBatch], reader: Reader, k: int, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted runs of the order-k n-grams of training rows, cut at the bounds."""
    for keys in _keys(batches, reader, k, SHARD_COUNTS):
        keys, counts = _counted(keys)
        cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
        parts = [s for s in range(len(cuts) - 1) if cuts[s + 1] > cuts[s]]
        for at in range(0, len(parts), 64):
            some = parts[at : at + 64]
            packed = [pack_run(keys[cuts[s] : cuts[s + 1]], counts[cuts[s] : cuts[s + 1]]) for s in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=["part", "run"])


# 4. a level's files


def _write_nodes(part: int, runs: list[bytes], model: Model, k: int, least: int) -> dict:
    """One range of n-grams as a file of nodes, with their counts beside it."""
    keys, counts = zip(*map(unpack_run, runs))
    keys, counts = add_up(np.concatenate(keys), np.concatenate(counts))
    ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
    if least > 1:
        keys, counts = keys[counts >= least], counts[counts >= least]
    if not len(keys):
        return {"part": part, "n": 0, "ones": ones, "twos": twos, "first": 0, "last": 0}
    width, first = int(model.base - 1).bit_length(), int(keys[0] >> U64(32))
    rank = (keys >> U64(32)) - U64(first)
    contexts = int(rank[-1]) + 1
    nodes = EliasFano.build((rank << U64(width)) | (keys & LOW), contexts << width, width)
    Folder(model.uri).write(f"level{k}-{part}", prefixed("nodes", nodes) | {"contexts": np.array([first, contexts], np.int64)})
    Folder(f"{model.uri}/counts{k}").write(str(part), {"counts": counts.astype(np.min_scalar_type(int(counts.max())))})
    return {"part": part, "n": len(keys), "ones": ones, "twos": twos, "first": int(keys[0].view(np.int64)), "last": int(keys[-1].view(np.int64))}


def _write_codes(part: int, model: Model, k: int, discount: float) -> list[dict]:
    """Probabilities of a file's nodes and weights of its contexts; returns the kept mass of its outer contexts."""
    opened = Opened(Folder(model.uri))
    f = opened.get(f"level{k}-{part}", ("nodes",))
    counts = Folder(f"{model.uri}/counts{k}").read(str(part))["counts"].astype(np.float64)
    first, contexts = (int(x) for x in f["contexts"])
    start, _ = f["nodes"].bucket(np.arange(contexts))
    sizes = np.diff(np.r_[start, len(counts)])
    some = np.nonzero(sizes)[0]
    totals = _totals(model, k, some + first, opened)
    left = np.maximum(counts - discount, 1e-9)
    probability = np.minimum(left / np.repeat(totals, sizes[some]), 1.0)
    kept = np.add.reduceat(left, start[some])
    weights = np.ones(contexts)
    weights[some] = np.clip(1 - kept / totals, 1e-12, 1.0)
    Folder(model.uri).write(f"codes{k}-{part}", {"probabilities": code(1 / probability), "weights": code(1 / weights)})
    return [{"context": int(some[i]) + first, "kept": float(kept[i]), "total": float(totals[i])} for i in sorted({0, len(some) - 1})]


def _totals(model: Model, k: int, contexts: np.ndarray, opened: Opened) -> np.ndarray:
    """How often each of the ascending contexts of order k occurs before a token."""
    if k == 2:
        out = np.full(len(contexts), float(model.rows))
        words = contexts < model.words
        out[words] = Reader(model).counts(contexts[words])
        return out
    level = model.levels[k - 3]
    shard = np.searchsorted(level.offsets, contexts, "right") - 1
    out = np.zeros(len(contexts))
    for s, a, b in _slices_of(shard):
        out[a:b] = opened.get(f"counts{k - 1}/{s}")["counts"][contexts[a:b] - level.offsets[s]]
    return out


def add_level(coded: DataFrame, model: Model, spark: SparkSession, min_count: int, highest: bool = False) -> None:
    """Counts the n-grams of the next order in the training rows of ``coded`` and adds their level; nodes of the
    highest order are never contexts."""
    k = len(model.levels) + 2
    bounds = _bounds(coded, model, k, max(1, -(-model.tokens // SHARD_NODES)))
    parts = len(bounds) + 1
    runs = coded.where("train").select("ids").mapInArrow(lambda it: _runs(it, Reader(model), k, bounds), "part int, run binary")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[bytes]] = {}
        for b in batches:
            for s, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                waiting.setdefault(s, []).append(run)
        for s in sorted(waiting):
            yield pa.RecordBatch.from_pylist([_write_nodes(s, waiting.pop(s), model, k, min_count)], FILES)

    with shuffled_once(spark):
        files = runs.repartitionById(parts, "part").mapInArrow(merge, "part int, n bigint, ones bigint, twos bigint, first bigint, last bigint").collect()
    nodes, ones, twos = (sum(r[c] for r in files) for c in ("n", "ones", "twos"))
    discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
    if nodes >= OOV and not highest:
        raise ValueError("more contexts than numbers of 32 bits")
    if not nodes:
        model.levels.append(Level(np.zeros(0, U64), np.zeros(1, np.int64), (np.zeros(0, U64), np.zeros(0)), discount, 0))
        return
    full = sorted((r for r in files if r.n), key=lambda r: r.part)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(_write_codes(s, model, k, discount), EDGES)

    known = spark.createDataFrame([(r.part,) for r in full], "part int").repartition(len(full), "part")
    edges: dict[int, list] = {}
    for e in known.mapInArrow(codes, "context bigint, kept double, total double").collect():
        edges.setdefault(e.context, []).append(e)
    # a key goes to the last file that may hold its context, and its word where the context spans files
    sizes, starts = np.zeros(parts, np.int64), np.full(parts, U64(0xFFFFFFFFFFFFFFFF))
    before = -1
    for r in full:
        first, last = r.first & 0xFFFFFFFFFFFFFFFF, r.last & 0xFFFFFFFFFFFFFFFF
        starts[r.part] = U64(first if first >> 32 == before else first >> 32 << 32)
        sizes[r.part], before = r.n, last >> 32
    for s in range(parts - 2, -1, -1):  # a file of no nodes begins where the next one does, and so gets no key
        if not sizes[s]:
            starts[s] = starts[s + 1]
    wide = sorted((c, max(1e-12, 1 - sum(e.kept for e in es) / es[0].total)) for c, es in edges.items() if len(es) > 1)
    spanning = np.array([c for c, _ in wide], U64), np.array([w for _, w in wide], np.float64)
    model.levels.append(Level(starts, np.r_[0, np.cumsum(sizes)], spanning, discount, nodes))


FILES = pa.schema([("part", pa.int32()), *((c, pa.int64()) for c in ("n", "ones", "twos", "first", "last"))])
EDGES = pa.schema([("context", pa.int64()), ("kept", pa.float64()), ("total", pa.float64())])


# scoring


def log10_scores(reader: Reader, tokens: np.ndarray) -> np.ndarray:
    """The model's log10 probability of each coded text."""
    m, said = reader.model, Sentences(reader, tokens)
    if not len(tokens):
        return np.zeros(0)
    steps = [said.step() for _ in m.levels]
    if said.at is None:
        said._rank_words()
    known = said.words < U64(m.start)
    counts = np.zeros(len(said.words))
    counts[known] = reader.counts(said.words[known].astype(np.int64))
    p = m.base_probability(counts)[said.of_word]
    for prob, weight in steps:
        p = prob + weight * p
    logs = np.where(said.first, 0.0, np.log10(p))
    return np.add.reduceat(logs, np.nonzero(said.first)[0])


def language_model_scores(docs: DataFrame, spark: SparkSession, train: Column, order: int = 3, min_count: int = 2, alpha: float = 0.1, text: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of every row, under a model of the rows
    that ``train`` (a column) admits."""
    model = build_vocabulary(docs.where(train).select(text), spark, shared_folder(spark) + "/model", alpha)
    coded = written(encode(docs, model, text, train), spark, "zstd")
    for k in range(2, order + 1):
        add_level(coded, model, spark, min_count, k == order)
        if k > 2:
            discard_folder(f"{model.uri}/counts{k - 1}", spark)
    discard_folder(f"{model.uri}/counts{order}", spark)
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for b in _slices(batches, 5, 4 * TOKENS):
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(log10_scores(reader, _flat(b.column(5))))], names=names)

    rows = coded.select("doc_id", "train", "n_tokens", "n_known", "base_score", "ids")
    scored = rows.mapInArrow(run, f"doc_id {kind}, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("bigint"))
