"""Frames, rate and damage of MP4 files from their boxes, by ranged reads and without a decoder.

A file is a row of boxes, each with a size and a type; some hold boxes themselves. The sample tables of the video track say how many frames there
are (``stsz``), how long they last (``stts``, in units of ``mdhd``) and where they lie (``stco`` or ``co64``). Only headers and tables
are read, in pieces; the frames themselves never are. A box that is cut off, a table that disagrees with another one, and frames that
would lie outside the file are damage.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from plumbline.sources.stores import located

#: Entries of a table that are read at a time.
ENTRIES = 1 << 16
#: Boxes that hold boxes, on the way to the sample tables.
HOLDERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl"))


class Damaged(ValueError):
    """A file that isn't a whole MP4."""


class Box(NamedTuple):
    kind: bytes
    start: int
    end: int


class Probe(NamedTuple):
    frames: int | None
    fps: float | None
    error: str | None


def _read(f: pa.NativeFile, at: int, size: int) -> bytes:
    f.seek(at)
    found = f.read(size)
    if len(found) < size:
        raise Damaged(f"cut off at byte {at + len(found)}")
    return found


def _number(raw: bytes) -> int:
    return int.from_bytes(raw, "big")


def boxes(f: pa.NativeFile, start: int, end: int) -> Iterator[Box]:
    """The boxes between two places; ``start`` of each is where its content begins."""
    while start < end:
        if end - start < 8:
            raise Damaged(f"cut off at byte {end}")
        head = _read(f, start, 8)
        size, kind, content = _number(head[:4]), head[4:], start + 8
        if size == 1:
            size, content = _number(_read(f, content, 8)), content + 8
        stop = end if size == 0 else start + size
        if stop < content or stop > end:
            raise Damaged(f"box {kind.decode('latin-1')} is cut off")
        yield Box(kind, content, stop)
        start = stop


def _inside(f: pa.NativeFile, outer: Box) -> dict[bytes, Box]:
    """The boxes below one, holders opened; of equal kinds the first."""
    found: dict[bytes, Box] = {}
    for b in boxes(f, outer.start, outer.end):
        found.setdefault(b.kind, b)
        if b.kind in HOLDERS:
            found = {**_inside(f, b), **found}
    return found


def _table(f: pa.NativeFile, box: Box, width: int, ahead: int = 0) -> Iterator[np.ndarray]:
    """Rows of big-endian numbers of a table box, some at a time; ``ahead`` bytes stand before its count."""
    count, at = _number(_read(f, box.start + 4 + ahead, 4)), box.start + 8 + ahead
    if at + count * width > box.end:
        raise Damaged(f"table {box.kind.decode('latin-1')} is shorter than its count")
    while count:
        n = min(count, ENTRIES)
        yield np.frombuffer(_read(f, at, n * width), ">u8" if box.kind == b"co64" else ">u4").astype(np.int64).reshape(n, -1)
        at, count = at + n * width, count - n


def _track(f: pa.NativeFile, parts: dict[bytes, Box], size: int) -> Probe:
    if lacking := [k.decode() for k in (b"mdhd", b"stts", b"stsz") if k not in parts]:
        raise Damaged(f"the video track lacks {', '.join(lacking)}")
    head = parts[b"mdhd"]
    scale = _number(_read(f, head.start + (20 if _read(f, head.start, 1)[0] == 1 else 12), 4))
    frames = ticks = 0
    for rows in _table(f, parts[b"stts"], 8):
        frames += int(rows[:, 0].sum())
        ticks += sum(a * b for a, b in rows.tolist())
    sizes = parts[b"stsz"]
    each, count = _number(_read(f, sizes.start + 4, 4)), _number(_read(f, sizes.start + 8, 4))
    if count != frames:
        raise Damaged(f"{frames} frames have times and {count} have sizes")
    taken = each * count if each else sum(int(rows.sum()) for rows in _table(f, sizes, 4, 4))
    if taken > size:
        raise Damaged(f"frames of {taken} bytes in a file of {size}")
    places = parts.get(b"co64") or parts.get(b"stco")
    if places and any((rows >= size).any() for rows in _table(f, places, 8 if places.kind == b"co64" else 4)):
        raise Damaged("frames lie behind the file's end")
    return Probe(frames, frames * scale / ticks if ticks else None, None)


def read_mp4(address: str) -> Probe:
    """Frames and frames a second of the first video track, or what is wrong with the file."""
    store, path = located(address)
    try:
        with store.open_input_file(path) as f:
            size, movie = f.size(), None
            if size < 8 or _read(f, 4, 4) not in (b"ftyp", b"moov", b"mdat", b"free", b"wide", b"skip"):
                raise Damaged("no MP4 file")
            for b in boxes(f, 0, size):
                movie = b if b.kind == b"moov" and movie is None else movie
            if movie is None:
                raise Damaged("no box moov")
            for track in (b for b in boxes(f, movie.start, movie.end) if b.kind == b"trak"):
                parts = _inside(f, track)
                kind = parts.get(b"hdlr")
                if kind and _read(f, kind.start + 8, 4) == b"vide":
                    return _track(f, parts, size)
            raise Damaged("no video track")
    except FileNotFoundError:
        return Probe(None, None, "file not found")
    except (Damaged, OSError) as e:
        return Probe(None, None, str(e))


def is_mp4(address: str) -> bool:
    store, path = located(address)
    with store.open_input_stream(path) as f:
        return f.read(8)[4:] in (b"ftyp", b"moov")
