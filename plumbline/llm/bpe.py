"""Byte-level BPE with a segment tree per piece.

A piece (one match of the splitting pattern) is an array of byte positions. Each live position holds the id of
the token that begins there and, as its key, the rank of the pair it forms with the next live position
(``rank * width + position``, so ties go left). The tree stores the least key of every span: its root is the
leftmost pair of lowest rank. A merge joins that pair, and updates three points: the merged token's key, its left
neighbour's, and the position that died; each climbs a logarithmic number of levels.

Pieces of up to ``WIDE`` bytes run side by side: trees of one width form the rows of a matrix, and each round
performs one merge in every row that still has one. Longer pieces use one tree each. Both give the same merges.

Null texts count as empty: no tokens, and the digests of no bytes. Texts of any length are encoded whole; memory
grows with the longest text of a batch. Rows, repeated ones too, map one to one; an empty table gives none, and extra columns don't
matter.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

WIDE = 256
#: Pieces that a worker remembers before it forgets them all.
MEMORY = 250_000
NONE = np.int64(1) << 62


class Vocabulary:
    """Ranks of a tiktoken file, and the rank of every pair whose bytes join to a token."""

    def __init__(self, path: str) -> None:
        lines = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.decimal = [str(i) for i in range(self.size)]
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self._fill_slots(self.pair_keys, self.pair_ranks)
        #: Of two single bytes, at first * 256 + second.
        self.byte_pairs = self.pair_rank(np.repeat(self.bytes, 256), np.tile(self.bytes, 256))
        self.numbers = list(range(self.size))

    def _fill_slots(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """An open-addressed table of the pairs, a quarter full at most: a pair stands in its slot or in the next free one."""
        bits = max(10, (4 * len(keys)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.slot_keys, self.slot_ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        slot = self._slots(keys)
        while len(keys):
            free = np.nonzero(self.slot_keys[slot] < 0)[0]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.slot_keys[slot[first]], self.slot_ranks[slot[first]] = keys[first], ranks[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, slot = keys[rest], ranks[rest], (slot[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where its bytes are no token."""
        key = left * self.size + right
        slot = self._slots(key)
        found = self.slot_keys[slot]
        out = np.where(found == key, self.slot_ranks[slot], NONE)
        open_ = np.nonzero((found != key) & (found >= 0))[0]
        while len(open_):  # another pair's slot
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.slot_keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.slot_ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _merge_rows(vocab: Vocabulary, pieces: list[bytes], width: int) -> list[list[int]]:
    """Ids of pieces of 2 to ``width`` bytes; width is a power of two."""
    n, levels = len(pieces), width.bit_length() - 1
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    size = np.fromiter(map(len, pieces), np.int64, n)
    place = np.arange(width)
    ids = vocab.bytes[raw]
    alive = place[None, :] < size[:, None]
    ranks = np.full((n, width), NONE, np.int64)
    ranks[:, :-1] = vocab.byte_pairs[raw[:, :-1].astype(np.int64) * 256 + raw[:, 1:]]
    tree = np.full((n, 2 * width), NONE, np.int64)
    paired = (place[None, :] + 1 < size[:, None]) & (ranks < NONE)
    tree[:, width:] = np.where(paired, ranks * width + place, NONE)
    for level in range(levels - 1, -1, -1):
        low, high = 1 << level, 2 << level
        tree[:, low:high] = np.minimum(tree[:, 2 * low : 2 * high : 2], tree[:, 2 * low + 1 : 2 * high : 2])
    after = np.minimum(np.broadcast_to(place + 1, (n, width)), size[:, None]).astype(np.int64)
    before = np.broadcast_to(place - 1, (n, width)).astype(np.int64)
    flat_tree, flat_ids, flat_after, flat_before, flat_alive = (x.reshape(-1) for x in (tree, ids, after, before, alive))

    def climb(node: np.ndarray, base: np.ndarray) -> None:
        for _ in range(levels):
            node = node >> 1
            flat_tree[base + node] = np.minimum(flat_tree[base + 2 * node], flat_tree[base + 2 * node + 1])

    def put(row: np.ndarray, at: np.ndarray, key: np.ndarray) -> None:
        base, leaf = row * (2 * width), at + width
        flat_tree[base + leaf] = key
        climb(leaf, base)

    rows = np.nonzero(tree[:, 1] < NONE)[0]
    while len(rows):
        root = flat_tree[rows * (2 * width) + 1]
        rank, at = root // width, root % width
        base, end = rows * width, size[rows]
        gone = flat_after[base + at]
        then = flat_after[base + gone]
        flat_ids[base + at] = rank
        flat_alive[base + gone] = False
        flat_after[base + at] = then
        more = then < end
        flat_before[(base + then)[more]] = at[more]
        key = np.full(len(rows), NONE, np.int64)
        new = vocab.pair_rank(rank[more], flat_ids[(base + then)[more]])
        key[more] = np.where(new < NONE, new * width + at[more], NONE)
        prior = flat_before[base + at]
        back = prior >= 0
        back_rank = vocab.pair_rank(flat_ids[(base + prior)[back]], rank[back])
        put(rows, gone, np.full(len(rows), NONE, np.int64))
        put(rows, at, key)
        put(rows[back], prior[back], np.where(back_rank < NONE, back_rank * width + prior[back], NONE))
        rows = rows[flat_tree[rows * (2 * width) + 1] < NONE]
    counts = alive.sum(1)
    left = ids[alive].tolist()
    ends = np.cumsum(counts).tolist()
    return [left[end - count : end] for end, count in zip(ends, counts.tolist())]


def _merge_long(vocab: Vocabulary, piece: bytes) -> list[int]:
    """The same for one long piece, with scalar updates of one tree."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    none = int(NONE)
    ids = vocab.bytes[np.frombuffer(piece, np.uint8)]
    ranks = vocab.pair_rank(ids[:-1], ids[1:])
    leaves = np.full(width, NONE, np.int64)
    leaves[: n - 1] = np.where(ranks < NONE, ranks * width + np.arange(n - 1), NONE)
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = [none, *np.concatenate(levels[::-1]).tolist()]
    tokens = ids.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs, size = vocab.pairs, vocab.size

    def put(at: int, key: int) -> None:
        node = at + width
        tree[node] = key
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                break
            tree[node] = least

    while tree[1] < none:
        rank, at = divmod(tree[1], width)
        gone = after[at]
        then = after[gone]
        tokens[at], tokens[gone], after[at] = rank, -1, then
        put(gone, none)
        follow = pairs.get(rank * size + tokens[then]) if then < n else None
        if then < n:
            before[then] = at
        put(at, none if follow is None else follow * width + at)
        prior = before[at]
        if prior >= 0:
            lead = pairs.get(tokens[prior] * size + rank)
            put(prior, none if lead is None else lead * width + prior)
    return [t for t in tokens if t >= 0]


def merge_pieces(vocab: Vocabulary, pieces: list[bytes]) -> list[list[int]]:
    """Ids of each piece. A piece that is a token as a whole needs no merge."""
    out: list[list[int]] = [[]] * len(pieces)
    groups: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        whole = vocab.ranks.get(piece)
        if whole is not None:
            out[i] = [whole]
        elif piece:
            groups.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
    for width, members in groups.items():
        if width > WIDE:
            for i in members:
                out[i] = _merge_long(vocab, pieces[i])
            continue
        step = max(1, (1 << 18) // width)
        for start in range(0, len(members), step):
            part = members[start : start + step]
            for i, ids in zip(part, _merge_rows(vocab, [pieces[i] for i in part], width)):
                out[i] = ids
    return out


class Encoder:
    """Encodes texts; remembers the ids of at most MEMORY pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        self.vocab, self.split, self.known = vocabulary(path), regex.compile(pattern).findall, {}

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        split = [self.split(t) for t in texts]
        new = list({p for pieces in split for p in pieces if p not in self.known})
        if len(self.known) + len(new) > MEMORY:
            self.known = {}
            new = list({p for pieces in split for p in pieces})
        merged = merge_pieces(self.vocab, [p.encode("utf-8", "surrogatepass") for p in new])
        number = self.vocab.numbers.__getitem__  # one object a number
        self.known.update((p, tuple(map(number, ids))) for p, ids in zip(new, merged))
        for pieces in split:
            yield list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.tokens.__getitem__, ids))


def _slices(batch: pa.RecordBatch, column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def encode_table(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every row, and its ids where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        decimal = encoder.vocab.decimal.__getitem__
        for whole in batches:
            for b in _slices(whole, 1):
                counts, coded, decoded, lists = [], [], [], []
                for found in encoder.encode([t or "" for t in b.column(1).to_pylist()]):
                    counts.append(len(found))
                    coded.append(hashlib.sha256(",".join(map(decimal, found)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(encoder.decode(found)).hexdigest())
                    if ids:
                        lists.append(found)
                columns = [b.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
                if ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]
    schema = f"`{key}` {dict(df.dtypes)[key]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return df.select(key, text).mapInArrow(run, schema)
