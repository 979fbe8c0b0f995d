"""Tables that a step writes once for the steps after it, in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of this process by the session's setting; they go when the process ends.
_FOLDERS: dict[str | None, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """URI of a fresh folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only on one machine (a local master) a temporary folder stands in where that setting is absent.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base not in _FOLDERS:
        if not base and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"{base.rstrip('/')}/plumbline/{uuid.uuid4().hex}" if base else "file://" + tempfile.mkdtemp(prefix="plumbline-")
        _FOLDERS[base] = root
        atexit.register(_discard_at_exit, root)
    return f"{_FOLDERS[base]}/{uuid.uuid4().hex}"


def _discard_at_exit(uri: str) -> None:
    spark = SparkSession.getActiveSession()
    with contextlib.suppress(Exception):  # the store may be out of reach by now
        if spark is not None:
            discard_folder(uri, spark)
        elif urlparse(uri).scheme in ("", "file"):
            shutil.rmtree(urlparse(uri).path, ignore_errors=True)


def written(df: DataFrame, spark: SparkSession, compression: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read again: later steps neither recompute it nor
    depend on the executors that made it."""
    path = shared_folder(spark) + "/table"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffled_once(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is collected inside go as soon as it has come, not when the driver frees its memory."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def discard(table: DataFrame, spark: SparkSession) -> None:
    """Deletes a table of ``written`` that no later step reads."""
    for file in table.inputFiles()[:1]:
        discard_folder(file.rsplit("/", 1)[0], spark)


def discard_folder(uri: str, spark: SparkSession) -> None:
    """Deletes a folder that no later step reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(uri)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def put_text(spark: SparkSession, uri: str, text: str) -> None:
    """A small text file in any store that Spark knows; it appears whole, in place of what was there."""
    path, part = (spark._jvm.org.apache.hadoop.fs.Path(uri + end) for end in ("", f".{uuid.uuid4().hex}"))
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if store.exists(path):
        store.delete(path, False)
    store.rename(part, path)


def get_text(spark: SparkSession, uri: str) -> str | None:
    """A small text file of ``put_text``; None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.text(uri, wholetext=True).first()[0]


def shared_schema(df: DataFrame) -> dict:
    """A table's schema as a document, every column nullable, as files have it."""
    return {**df.schema.jsonValue(), "fields": [{**f, "nullable": True} for f in df.schema.jsonValue()["fields"]]}


def free_name(df: DataFrame, name: str) -> str:
    """A helper column's name that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
