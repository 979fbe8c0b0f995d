"""JSON arrays in files as rows, one an item: files are read piece by piece, so no row and no task holds a whole file.

A file is an array, or an object whose only field is one (``unwrap``), or else one item. Items are found by an incremental decoder: it keeps the text from the
next item on, reads more where an item isn't complete, and lets each item go with its place. An object is walked once to see
what it is, and once more for its items.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from json import JSONDecodeError, JSONDecoder

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.stores import CHUNK, chunks, listed

SPACE = " \t\n\r"
NUMBER = "0123456789+-.eE"
#: A literal or an escape that is cut off makes an error at most so far before the end of the text.
NEAR = 16


class ArrayError(ValueError):
    """A file that isn't the JSON it should be."""


class Reader:
    """A position in a text that is read as it is needed."""

    def __init__(self, address: str, size: int = CHUNK) -> None:
        self.address, self.pieces = address, chunks(address, size)
        self.decoder, self.json = codecs.getincrementaldecoder("utf-8-sig")(), JSONDecoder()
        self.text, self.at, self.item = "", 0, 0

    def more(self) -> bool:
        """More text after what is left; at least as much again, so that reading over stays in proportion."""
        rest, found = self.text[self.at :], []
        while sum(map(len, found)) <= len(rest):
            piece = next(self.pieces, None)
            found.append(self.decoder.decode(piece or b"", piece is None))
            if piece is None:
                break
        self.text, self.at = rest + "".join(found), 0
        return len(self.text) > len(rest)

    def peek(self) -> str:
        """The next character that isn't white space; none at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in SPACE:
                self.at += 1
            if self.at < len(self.text) or not self.more():
                return self.text[self.at : self.at + 1]

    def take(self, wanted: str) -> str:
        found = self.peek()
        if not found or found not in wanted:
            raise ArrayError(f"{self.address}: item {self.item}: expected one of {wanted} and found {found or 'the end'!r}")
        self.at += 1
        return found

    def value(self) -> str:
        """The text of the next value."""
        self.peek()
        while True:
            try:
                end = self.json.raw_decode(self.text, self.at)[1]
            except JSONDecodeError as e:
                cut = e.msg.startswith("Unterminated string") or e.pos >= len(self.text) - NEAR
                if cut and self.more():
                    continue
                raise ArrayError(f"{self.address}: item {self.item}: {e.msg}") from e
            if len(self.text) - end < NEAR and not self.text[end:].strip(NUMBER) and self.more():  # a number may go on
                continue
            found, self.at = self.text[self.at : end], end
            return found

    def elements(self) -> Iterator[str]:
        self.take("[")
        if self.peek() == "]":
            self.at += 1
            return
        while True:
            yield self.value()
            self.item += 1
            if self.take(",]") == "]":
                return

    def finish(self) -> None:
        if self.peek():
            raise ArrayError(f"{self.address}: more text after the document")


def _wraps_one_array(address: str, size: int) -> bool:
    """Whether an object has one field and that is an array."""
    r = Reader(address, size)
    r.take("{")
    if r.peek() == "}":
        return False
    r.value()
    r.take(":")
    if r.peek() != "[":
        return False
    for _ in r.elements():
        pass
    return r.take(",}") == "}"


def items(address: str, unwrap: bool, size: int = CHUNK) -> Iterator[str]:
    """The texts of a file's items."""
    r = Reader(address, size)
    first = r.peek()
    if first == "[":
        yield from r.elements()
    elif first == "{" and unwrap and _wraps_one_array(address, size):
        r.take("{")
        r.value()
        r.take(":")
        yield from r.elements()
        r.take("}")
    elif unwrap:
        yield r.value()
    else:
        raise ArrayError(f"{address}: a JSON array is needed")
    r.finish()


def array_items(spark: SparkSession, root: str, unwrap: bool = False, pattern: str = "*.json", size: int = CHUNK) -> DataFrame:
    """path, place (from 0) and item (its JSON text) of all files below a folder."""
    kind = pa.schema([("path", pa.string()), ("place", pa.int64()), ("item", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for address in b.column(0).to_pylist():
                texts, place, held = [], 0, 0
                for text in items(address, unwrap, size):
                    texts.append(text)
                    held += len(text)
                    if held >= CHUNK:
                        yield _batch(address, place, texts, kind)
                        place, texts, held = place + len(texts), [], 0
                if texts:
                    yield _batch(address, place, texts, kind)

    return listed(spark, root, pattern).select("path").mapInArrow(run, "path string, place bigint, item string")


def _batch(address: str, place: int, texts: list[str], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([address] * len(texts)), pa.array(range(place, place + len(texts)), pa.int64()), pa.array(texts)], schema=kind)
