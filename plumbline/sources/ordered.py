"""One text file in order, written by all executors: an offset-placed commit.

Rows are sorted into ranges, and each range is written as a part. The driver learns the parts' sizes, which say where
each part begins in the whole file, and tasks copy the parts to their places side by side. Stores that can't write at an offset join the parts
themselves (``concat`` of a Hadoop file system) or, where they can't do that either, one task streams part after part. The file appears whole, by a
rename; no row passes through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.shared import discard_folder
from plumbline.sources.stores import chunks, exists, listed, located, new_parent


#: Stores whose files can be written from an offset on.
AT_OFFSETS: tuple[type, ...] = (pafs.LocalFileSystem,)


def refuse(address: str, overwrite: bool) -> None:
    if exists(address) and not overwrite:
        raise FileExistsError(f"{address} exists")
    new_parent(address)


def write_ordered(lines: DataFrame, order: str | None, address: str, header: tuple[str, ...] = (), overwrite: bool = False) -> int:
    """The column ``line`` as lines of one file, after header lines and in the order of a column (None: as the rows stand); the number of rows."""
    refuse(address, overwrite)
    spark, seen = lines.sparkSession, Observation()
    parts = f"{address}.parts-{uuid.uuid4().hex}"
    try:
        (lines.orderBy(order) if order else lines).select("line").observe(seen, F.count(F.lit(1)).alias("n")).write.text(parts, lineSep="\n")
        found = sorted((r.path, r.length) for r in listed(spark, parts, "part-*").where("length > 0").collect())
        _join(spark, found, "".join(h + "\n" for h in header).encode(), address)
    finally:
        discard_folder(parts, spark)
    return seen.get["n"]


def _join(spark: SparkSession, parts: list[tuple[str, int]], head: bytes, address: str) -> None:
    whole = f"{address}.part-{uuid.uuid4().hex}"
    store, path = located(whole)
    with store.open_output_stream(path) as f:
        f.write(head)
    size = len(head)
    if isinstance(store, AT_OFFSETS):
        places = []
        for part, length in parts:
            places.append((part, size))
            size += length
        with open(path, "r+b") as f:
            f.truncate(size)
        if places:
            rows = spark.createDataFrame(places, "part string, place bigint").repartition(min(len(places), 200))
            copied = rows.mapInArrow(_placed(path), "size bigint").agg(F.sum("size")).first()[0]
            if copied != size - len(head):
                raise OSError(f"{address}: {copied} of {size - len(head)} bytes were copied")
    elif parts and not _concatenated(spark, whole, [p for p, _ in parts]):
        names = [p for p, _ in parts]
        spark.range(1).coalesce(1).mapInArrow(_streamed(whole, head, names), "size bigint").collect()
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(address).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(fs_path(address)):
        fs.delete(fs_path(address), False)
    if not fs.rename(fs_path(whole), fs_path(address)):
        raise OSError(f"{address} could not take its name")


def _placed(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n = 0
                with open(path, "r+b") as f:  # a task that runs again writes the same bytes to the same place
                    f.seek(row["place"])
                    for piece in chunks(row["part"]):
                        n += f.write(piece)
                yield pa.RecordBatch.from_pylist([{"size": n}], pa.schema([("size", pa.int64())]))

    return run


def _concatenated(spark: SparkSession, whole: str, parts: list[str]) -> bool:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    sources = spark.sparkContext._gateway.new_array(path, len(parts))
    for k, p in enumerate(parts):
        sources[k] = path(p)
    try:
        path(whole).getFileSystem(spark._jsc.hadoopConfiguration()).concat(path(whole), sources)
    except Exception as e:  # not every store has it
        if "UnsupportedOperation" in type(e).__name__ + str(e):
            return False
        raise
    return True


def _streamed(whole: str, head: bytes, parts: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            store, path = located(whole)
            with store.open_output_stream(path) as f:
                f.write(head)
                n = sum(f.write(piece) or len(piece) for p in parts for piece in chunks(p))
            yield pa.RecordBatch.from_pylist([{"size": n}], pa.schema([("size", pa.int64())]))

    return run
