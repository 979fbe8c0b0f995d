"""Files of any store, opened where the work is: in the tasks, through the file system of their address."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Bytes that are read at a time.
CHUNK = 1 << 20


def located(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of an address; one without a scheme is a local path."""
    if address.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + address[5:].lstrip("/")
    if "://" not in address:
        return pafs.LocalFileSystem(), address
    return pafs.FileSystem.from_uri(address)


def chunks(address: str, size: int = CHUNK) -> Iterator[bytes]:
    """A file's bytes in pieces."""
    store, path = located(address)
    with store.open_input_stream(path) as f:
        while piece := f.read(size):
            yield piece


def digest(address: str, kind: str = "sha256") -> str:
    """A file's digest in constant memory."""
    import hashlib

    found = hashlib.new(kind)
    for piece in chunks(address):
        found.update(piece)
    return found.hexdigest()


def listed(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """path and length of the files below a folder or of one file; their contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).select("path", "length")


def walked(spark: SparkSession, folder: str) -> DataFrame:
    """name (below the folder), path and length of every file below a folder, empty ones too; hidden ones are left out, as Spark does. One
    task walks the folder, and the files are dealt out evenly."""
    kind = pa.schema([("name", pa.string()), ("path", pa.string()), ("length", pa.int64())])
    address = root(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            store, top = located(address)
            found = store.get_file_info(pafs.FileSelector(top, recursive=True))
            rows = [(f.path[len(top) :].lstrip("/"), f.path, f.size) for f in found if f.is_file]
            rows = [(n, f"{address}/{n}", z) for n, _, z in rows if not any(part[0] in "._" for part in n.split("/"))]
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows[at : at + 10_000]], kind)

    return spark.range(1).coalesce(1).mapInArrow(run, "name string, path string, length bigint").repartition("path")


def root(spark: SparkSession, folder: str) -> str:
    """A folder's address as file listings begin with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def digests(files: DataFrame, path: str = "path", kind: str = "sha256") -> DataFrame:
    """The rows with ``digest`` of the file that each names, read by the task that has the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([digest(row.column(place)[0].as_py(), kind)])], names=[*row.schema.names, "digest"])

    place = files.columns.index(path)
    fields = ", ".join(f"`{n}` {t}" for n, t in files.dtypes)
    return files.mapInArrow(run, f"{fields}, digest string")


def exists(address: str) -> bool:
    store, path = located(address)
    return store.get_file_info(path).type != pafs.FileType.NotFound


def new_parent(address: str) -> None:
    store, path = located(address)
    above = path.rpartition("/")[0]
    if above:
        store.create_dir(above, recursive=True)


def content(address: str) -> bytes:
    """A small file."""
    return b"".join(chunks(address))


def replace(address: str, data: bytes) -> None:
    """A small file that appears whole, in place of what was there."""
    import uuid

    new_parent(address)
    store, path = located(address)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)
