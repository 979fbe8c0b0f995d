"""Elias-Fano sequences in flat arrays, queried many at a time, and the files that hold them.

A monotone sequence of n integers below u keeps ``l = log2(u / n)`` low bits of each packed side by side; the high
parts are a bit vector with a one at ``high + index``. Running counts of ones and zeros before every 64 bits lead
selects to a word. All queries take and give NumPy arrays.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import uuid
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np

U64 = np.uint64
#: Position of the k-th one of a byte, at [byte, k].
SELECT_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits side by side in 64-bit words, with one word to spare."""
    if not width or not len(values):
        return np.zeros(2, U64)
    rows = -(-len(values) // 64)  # 64 values fill ``width`` words
    square = np.zeros((rows, 64), U64)
    square.reshape(-1)[: len(values)] = values
    words = np.zeros(rows * width + 2, U64)
    out = words[: rows * width].reshape(rows, width)
    for j in range(64):
        word, off = j * width >> 6, j * width & 63
        out[:, word] |= square[:, j] << U64(off)
        if off + width > 64:
            out[:, word + 1] |= square[:, j] >> U64(64 - off)
    return words


class EliasFano:
    """``arrays`` holds low, high, ones and zeros; ``n``, ``low_bits`` and ``universe`` describe them."""

    @staticmethod
    def build(values: np.ndarray, universe: int, low_bits: int | None = None) -> dict:
        """Parts of the sequence; values are uint64, ascending, below ``universe``."""
        n = len(values)
        l = max(0, (universe // max(1, n)).bit_length() - 1) if low_bits is None else low_bits
        low = _pack(values & U64((1 << l) - 1), l)
        size = n + (universe >> l) + 2
        bits = np.zeros((size // 64 + 1) * 64, np.uint8)
        bits[(values >> U64(l)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(U64)
        ones = np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)]
        zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
        kind = np.int32 if len(bits) < 1 << 31 else np.int64
        return {"low": low, "high": high, "ones": ones.astype(kind), "zeros": zeros.astype(kind), "meta": np.array([n, l], np.int64)}

    def __init__(self, parts: dict) -> None:
        self.low, self.high, self.ones, self.zeros = (parts[k] for k in ("low", "high", "ones", "zeros"))
        self.n, self.low_bits = (int(x) for x in parts["meta"])
        self.mask = U64((1 << self.low_bits) - 1)

    def _select(self, k: np.ndarray, directory: np.ndarray, flip: bool) -> np.ndarray:
        """Positions of the k-th one (or zero) of the high bits, from 0."""
        word = np.searchsorted(directory, k.astype(directory.dtype), "right") - 1
        left = k - directory[word]
        bits = self.high[word]
        if flip:
            bits = ~bits
        base = word * 64
        for width in (32, 16, 8):
            count = np.bitwise_count(bits & U64((1 << width) - 1)).astype(np.int64)
            up = left >= count
            left -= count * up
            base += up * width
            bits >>= up.astype(U64) * U64(width)
        return base + SELECT_IN_BYTE[(bits & U64(255)).astype(np.int64), left]

    def lows(self, i: np.ndarray) -> np.ndarray:
        """Low bits of the i-th values."""
        if not self.low_bits:
            return np.zeros(len(i), U64)
        at = i * self.low_bits
        word, off = at >> 6, (at & 63).astype(U64)
        over = (self.low[word + 1] << U64(1)) << (U64(63) - off)  # two steps, as a shift by 64 isn't defined
        return ((self.low[word] >> off) | over) & self.mask

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        high = self._select(i, self.ones, False) - i
        return (high.astype(U64) << U64(self.low_bits)) | self.lows(i)

    def bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the values of each high part begin and end: the monotone pointers that the upper half codes."""
        before = self._select(np.maximum(high - 1, 0), self.zeros, True) - np.maximum(high - 1, 0)
        return np.where(high > 0, before, 0), self._select(high, self.zeros, True) - high

    def within(self, start: np.ndarray, end: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Index of the first value from ``start`` on whose low bits are at least ``low``, else ``end``."""
        start, end = start.copy(), end.copy()
        open_ = np.nonzero(start < end)[0]
        a, b, x = start[open_], end[open_], low[open_]
        while len(open_):
            middle = (a + b) >> 1
            less = self.lows(middle) < x
            a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
            done = a >= b
            if done.any():
                start[open_[done]] = a[done]
                go = ~done
                open_, a, b, x = open_[go], a[go], b[go], x[go]
        return start

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is at least x; n where there is none. x lies below the universe."""
        if not self.n:
            return np.zeros(len(x), np.int64)
        start, end = self.bucket((x >> U64(self.low_bits)).astype(np.int64))
        return self.within(start, end, x & self.mask)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each x, -1 where it isn't in the sequence."""
        if not self.n:
            return np.full(len(x), -1, np.int64)
        start, end = self.bucket((x >> U64(self.low_bits)).astype(np.int64))
        return self.find_within(start, end, x & self.mask)

    def find_within(self, start: np.ndarray, end: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Index of the value between ``start`` and ``end`` with these low bits, -1 where there is none."""
        at = self.within(start, end, low)
        hit = np.nonzero(at < end)[0]
        out = np.full(len(at), -1, np.int64)
        hit = hit[self.lows(at[hit]) == low[hit]]
        out[hit] = at[hit]
        return out


class Folder:
    """Files in the folder that driver and executors share: mapped into memory where it is mounted, else
    read through the file system of its address and mapped from a copy."""

    def __init__(self, uri: str) -> None:
        parsed = urlparse(uri)
        self.uri = uri.rstrip("/")
        self.path = parsed.path.rstrip("/") if parsed.scheme in ("", "file") else None

    def write(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        """All arrays in one file. It appears whole or not at all, and a repeated task writes the same one."""
        header, at, chunks = {}, 0, []
        for key, a in arrays.items():
            raw = np.ascontiguousarray(a).tobytes()
            header[key] = (a.dtype.str, at, len(raw))
            chunks.append(raw + b"\0" * (-len(raw) % 64))
            at += len(chunks[-1])
        head = json.dumps(header).encode()
        head += b" " * (-(len(head) + 8) % 64)
        content = [len(head).to_bytes(8, "little"), head, *chunks]
        if self.path is not None:
            os.makedirs(self.path, exist_ok=True)
            part = f"{self.path}/.{name}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.writelines(content)
            os.replace(part, f"{self.path}/{name}")
        else:
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(self.uri)
            store.create_dir(root, recursive=True)
            part = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                for c in content:
                    f.write(c)
            store.move(part, f"{root}/{name}")

    def read(self, name: str) -> dict[str, np.ndarray]:
        """The file's arrays, mapped into memory."""
        if self.path is not None:
            with open(f"{self.path}/{name}", "rb") as f:
                raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(self.uri)
            # a copy on this machine's disk, to be mapped; it has no name, so it goes when its last map does
            with store.open_input_stream(f"{root}/{name}") as f, tempfile.TemporaryFile() as copy:
                while chunk := f.read(1 << 20):
                    copy.write(chunk)
                copy.flush()
                raw = mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ)
        size = int.from_bytes(raw[:8], "little")
        header = json.loads(raw[8 : 8 + size])
        return {k: np.frombuffer(raw, np.dtype(kind), length // np.dtype(kind).itemsize, 8 + size + at) for k, (kind, at, length) in header.items()}


class Opened:
    """Files of a folder as they are needed; of more than ``most`` the one used least recently is let go."""

    def __init__(self, folder: Folder, most: int = 1 << 14) -> None:
        self.folder, self.most, self.files = folder, most, OrderedDict()

    def get(self, name: str, sequences: tuple[str, ...] = ()) -> dict:
        found = self.files.get(name)
        if found is None:
            arrays = self.folder.read(name)
            found = self.files[name] = arrays | {s: sequence(arrays, s) for s in sequences}
            if len(self.files) > self.most:
                self.files.popitem(last=False)
        else:
            self.files.move_to_end(name)
        return found


def prefixed(name: str, parts: dict) -> dict:
    return {f"{name}.{k}": v for k, v in parts.items()}


def sequence(arrays: dict, name: str) -> EliasFano:
    return EliasFano({k: arrays[f"{name}.{k}"] for k in ("low", "high", "ones", "zeros", "meta")})
