"""BPE with word ends, encoded in fragments between forced boundaries, and decoding.

A text is normalized and split into words by the tokenizer file's pattern; a word is a sequence of symbols, one a byte, the last of which
is marked as a word's end. Two neighbouring symbols that stand side by side inside no token of the vocabulary can never come to belong to one
token, so a cut between them is certain: merges left of it don't touch those right of it. A table of all pairs of symbols that some token
holds, made once from the vocabulary, marks the cuts of many new words at once. Each fragment between cuts is encoded by itself, and a word's ids are its fragments'
ids one after the other.

Fragments are merged side by side in flat arrays: a round finds each fragment's least rank and merges that pair everywhere in the fragment, from
the left. As every merge builds on earlier ones (checked when the file is read), no new pair can go before the others of that rank, so
rounds give the same tokens as single merges. Fragments of more than ``LONG`` symbols use a heap of pairs instead; both need no more
than n log n steps of a fragment's length in merges.

Null texts count as empty: no tokens, and the digests of no bytes. Texts of any length are encoded whole; memory grows with the longest text of
a batch. Strings of added tokens ("<|endoftext|>") are those tokens wherever they stand, as the file says. White space only parts words. Texts with
characters that this Python's Unicode tables don't know, or with marks and compositions newer than Unicode 3.2, are normalized and split by the
tokenizers library's own steps, whose tables are of other versions; merging is the same. Rows, repeated ones too, map one to one; an empty table gives none, and extra columns don't matter.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import accumulate, chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from plumbline.llm.bpe import _slices

#: Words that a worker remembers before it forgets them all.
MEMORY = 250_000
#: Words that are cut and merged side by side.
TOGETHER = 4096
LONG = 1024
NONE = np.int64(1) << 40
#: Steps before merging that this module carries out; a file with others is refused.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PRE_TOKENIZERS = ["Split", "ByteLevel"]


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it is visible, else the next one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and certain cuts of a tokenizer file. Symbols 0 to 255 are bytes, 256 to 511 bytes that end a word."""

    def __init__(self, path: str) -> None:
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        model, norm, pre = file["model"], file["normalizer"], file["pre_tokenizer"]
        steps = [[s["type"] for s in part.get(name, [])] for part, name in ((norm, "normalizers"), (pre, "pretokenizers"))]
        split = pre["pretokenizers"][0] if steps[1] else {}
        if model["type"] != "BPE" or steps != [NORMALIZERS, PRE_TOKENIZERS] or not (split["invert"] and split["behavior"] == "Removed") or model.get("dropout") or file.get("decoder"):
            raise ValueError(f"{path} is no BPE with word ends of the kind that this module encodes")
        self.path, self.pattern, end = path, split["pattern"]["Regex"], model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in [*ids.items(), *self.added.items()]}
        alphabet = byte_alphabet()
        names = [*alphabet, *(a + end for a in alphabet)]
        self.symbols = np.array([ids[n] for n in names], np.int64)
        self.size = max(ids.values()) + 1
        made = {int(i) for i in self.symbols}
        keys, self.results = [], np.empty(len(model["merges"]), np.int64)
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = ids[left], ids[right], ids[left + right]
            if a not in made or b not in made or c in made:
                raise ValueError(f"merge {rank} of {path} doesn't build on earlier ones alone")
            made.add(c)
            keys.append(a * self.size + b)
            self.results[rank] = c
        self.ranks = {k: r for r, k in enumerate(keys)}
        by_key = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[by_key], by_key.astype(np.int64)
        #: Whether a token holds two symbols side by side, at first * 512 + second.
        self.inside = np.zeros(512 * 512, bool)
        number = {a: b for b, a in enumerate(alphabet)}
        for token in ids:
            whole = token.endswith(end) and len(token) > len(end)
            symbols = [number[c] for c in (token[: -len(end)] if whole else token)]
            if whole:
                symbols[-1] += 256
            for a, b in zip(symbols, symbols[1:]):
                self.inside[a * 512 + b] = True

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where it merges to nothing."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder: tokens as they are written in it, with blanks between them."""
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def fragments(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words, the places where fragments begin, and each word's number of fragments. Words aren't empty."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    symbols[ends - 1] += 256
    cut = np.ones(len(symbols), bool)  # whether a fragment begins here
    cut[1:] = ~vocab.inside[symbols[:-1] * 512 + symbols[1:]]
    cut[ends[:-1]] = True
    return symbols, np.nonzero(cut)[0], np.add.reduceat(cut, ends - sizes, dtype=np.int64)


def merge_fragments(vocab: Vocabulary, symbols: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all fragments, one after the other, and each fragment's number of them."""
    n, size = len(start), np.diff(np.r_[start, len(symbols)])
    of, ids = np.repeat(np.arange(n), size), vocab.symbols[symbols]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    if (size > LONG).any():
        for k in np.nonzero(size > LONG)[0].tolist():
            merged = merge_long(vocab, symbols[start[k] : start[k] + size[k]])
            done.append((np.full(len(merged), k), np.array(merged, np.int64)))
        rest = (size <= LONG)[of]
        of, ids = of[rest], ids[rest]
    rank = np.full(len(ids), NONE, np.int64)
    at = np.nonzero(of[:-1] == of[1:])[0]
    rank[at] = vocab.rank(ids[at], ids[at + 1])
    while len(ids):
        begin = np.nonzero(np.r_[True, of[1:] != of[:-1]])[0]
        least = np.minimum.reduceat(rank, begin)
        length = np.diff(np.r_[begin, len(ids)])
        if (least == NONE).any():
            over = np.repeat(least == NONE, length)
            done.append((of[over], ids[over]))
            ids, of, rank = ids[~over], of[~over], rank[~over]
            length, least = length[least < NONE], least[least < NONE]
            if not len(ids):
                break
        place = np.nonzero(rank == np.repeat(least, length))[0]
        run = np.r_[True, np.diff(place) != 1]  # pairs of a repeated token overlap: every other one counts
        first = np.maximum.accumulate(np.where(run, place, 0))
        place = place[(place - first) % 2 == 0]
        ids[place] = vocab.results[rank[place]]
        keep = np.ones(len(ids), bool)
        keep[place + 1] = False
        place -= np.arange(len(place))  # so many have gone before it
        ids, of, rank = ids[keep], of[keep], rank[keep]
        touched = np.r_[place, place[place > 0] - 1]
        after = np.minimum(touched + 1, len(ids) - 1)
        paired = (after > touched) & (of[touched] == of[after])
        rank[touched] = np.where(paired, vocab.rank(ids[touched], ids[after]), NONE)
    of, ids = (np.concatenate(x) for x in zip(*done))
    return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=n)


def merge_long(vocab: Vocabulary, symbols: np.ndarray) -> list[int]:
    """The same for one long fragment, with a heap of pairs and links between live neighbours."""
    ids, n = vocab.symbols[symbols].tolist(), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ranks, size = vocab.ranks, vocab.size
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(ids[i] * size + ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue  # one of the two has merged since
        ids[i], ids[j], after[i] = int(vocab.results[r]), -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else n
            if right < n and (new := ranks.get(ids[left] * size + ids[right])) is not None:
                heapq.heappush(heap, (new, left, ids[left], ids[right]))
    return [t for t in ids if t >= 0]


def encode_words(vocab: Vocabulary, words: list[bytes]) -> Iterator[list[int]]:
    """Ids of each word: cut at the forced boundaries, merged fragment by fragment, and put together."""
    for at in range(0, len(words), TOGETHER):
        symbols, start, counts = fragments(vocab, words[at : at + TOGETHER])
        ids, sizes = merge_fragments(vocab, symbols, start)
        ends = np.cumsum(np.add.reduceat(sizes, np.cumsum(counts) - counts)).tolist()
        flat = ids.tolist()
        yield from (flat[a:b] for a, b in zip([0, *ends], ends))


def _unsettled(c: str) -> bool:
    """Whether two versions of Unicode may treat a character differently: it is unknown here, or a later mark or composition."""
    kind = unicodedata.category(c)
    return kind == "Cn" or (kind[0] == "M" or bool(unicodedata.decomposition(c))) and unicodedata.ucd_3_2_0.category(c) == "Cn"


class Splitter:
    """Words of a text, between the added tokens in it."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.added = vocab.added
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(vocab.added, key=len, reverse=True))) + ")") if vocab.added else None
        self.find, self.path = regex.compile(vocab.pattern).findall, vocab.path
        self.plain: set[str] = set()
        self._library = None

    def words(self, text: str) -> list[str]:
        """Words without an added token among them."""
        if not text.isascii():
            fresh = set(text) - self.plain
            if any(map(_unsettled, fresh)):
                return self.newer(text)
            self.plain |= fresh
            # a capital sigma has one small form here, wherever in a word it stands
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.find(text.lower())

    def newer(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(self.path)
            self._library = whole.normalizer, whole.pre_tokenizer, {ord(a): b for b, a in enumerate(byte_alphabet())}
        normalizer, pre, byte = self._library
        found = pre.pre_tokenize_str(normalizer.normalize_str(text))
        return [bytes(byte[ord(c)] for c in word).decode() for word, _ in found]

    def split(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """Words, and the added token that follows them."""
        if self.parts is None or not any(a in text for a in self.added):
            yield self.words(text), None
            return
        found = self.parts.split(text)
        for at in range(0, len(found), 2):
            yield self.words(found[at]), self.added[found[at + 1]] if at + 1 < len(found) else None


class Encoder:
    """Encodes texts; remembers at most MEMORY words, each with its ids (32 bits, little-endian) and how they decode."""

    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        self.splitter = Splitter(self.vocab)
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """The ids of each text, and their decoded text."""
        split = [list(self.splitter.split(t)) for t in texts]
        used = set(chain.from_iterable(words for parts in split for words, _ in parts))
        new = list(used.difference(self.ids))
        if len(self.ids) + len(new) > MEMORY:
            self.ids, self.texts, new = {}, {}, list(used)
        found = list(encode_words(self.vocab, [w.encode() for w in new]))
        flat = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        ends = list(accumulate(4 * len(x) for x in found))
        self.ids.update(zip(new, (flat[a:b] for a, b in zip([0, *ends], ends))))
        self.texts.update(zip(new, map(self.vocab.decode, found)))
        code, text = self.ids.__getitem__, self.texts.__getitem__
        for parts in split:
            if len(parts) == 1:
                words = parts[0][0]
                yield b"".join(map(code, words)), " ".join(map(text, words))
                continue
            coded, written = [], []
            for words, added in parts:
                coded.extend(map(code, words))
                written.extend(map(text, words))
                if added is not None:
                    coded.append(added.to_bytes(4, "little"))
                    written.append(self.vocab.tokens[added])
            yield b"".join(coded), " ".join(written)


def encode_table(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = False, decoded: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every row, with its ids and their decoded text where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for whole in batches:
            for b in _slices(whole, 1):
                found = list(encoder.encode([t or "" for t in b.column(1).to_pylist()]))
                columns = [
                    b.column(0),
                    pa.array([len(x) // 4 for x, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x, _ in found], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for _, x in found], pa.string()),
                ]
                if ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x, _ in found], pa.list_(pa.int32())))
                if decoded:
                    columns.append(pa.array([x for _, x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids, *["decoded"] * decoded]
    schema = f"`{key}` {dict(df.dtypes)[key]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    return df.select(key, text).mapInArrow(run, schema)
