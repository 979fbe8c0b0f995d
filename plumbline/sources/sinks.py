"""Files that others read: JSON lines, training parquet, id lists, dataset index, checksums.

All of them refuse to overwrite unless they are told to.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources import stores
from plumbline.sources.ordered import refuse, write_ordered
from plumbline.sources.records import DataError
from plumbline.sources.shared import discard_folder, shared_folder

SKIPPED = ("checksums.sha256",)


def json_rows(df: DataFrame, order: str | None = None) -> DataFrame:
    """The rows as JSON objects in the column ``line``, beside the order; ``extra`` is flattened, and wins a clash."""
    variants = [c for c, t in df.dtypes if t == "variant"]
    columns = [c for c in df.columns if c != order]
    texts = df.select(*([order] if order else []), *(F.to_json(c).alias(c) if c in variants else F.col(c) for c in columns))
    first = 1 if order else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = []
            for values in zip(*(c.to_pylist(maps_as_pydicts="strict") for c in b.columns[first:])):
                row = {c: json.loads(v) if c in variants and v is not None else v for c, v in zip(columns, values)}
                extra = row.pop("extra", None) or {}
                lines.append(json.dumps(row | extra, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([*b.columns[:first], pa.array(lines, pa.string())], names=[*([order] if order else []), "line"])

    kind = f"`{order}` {dict(df.dtypes)[order]}, " if order else ""
    return texts.mapInArrow(run, f"{kind}line string")


def write_json_lines(df: DataFrame, path: str, order: str | None = "ord", overwrite: bool = False) -> int:
    """One file with one JSON object a line, non-ASCII text as it is; the number of rows. ``extra`` is flattened, and wins a clash."""
    return write_ordered(_sorted_lines(df, order), None, str(path), overwrite=overwrite)


def _sorted_lines(df: DataFrame, order: str | None) -> DataFrame:
    """The lines in order. Rows are sorted before they are made into text, as a sort runs what comes before it twice, the first time for its bounds."""
    return json_rows(df.orderBy(order) if order else df, order)


def write_json_lines_distributed(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """The same rows as a folder of part files, written by the executors."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def write_rl_parquet(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """id, video_path, prompt and response as Parquet, in the order of ord; labels are text or 64-bit integers.

    Labels that could all be integers are written as such; a list without any label counts as integers.
    """
    kind = "string" if df.select(F.bool_or(F.exists("response", lambda x: x.cast("string").rlike("[^0-9]")))).first()[0] else "bigint"
    out = df.orderBy("ord") if "ord" in df.columns else df
    out = out.select("id", "video_path", "prompt", F.col("response").cast(f"array<{kind}>").alias("response"))
    out.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_id_manifest(df: DataFrame, path: str, header: tuple[str, ...] = (), overwrite: bool = False) -> None:
    """``# header`` lines, then ids in order, in one file. A line break in any of them is an error."""
    refuse(str(path), overwrite)
    if any("\n" in h for h in header) or df.where(F.col("id").contains("\n")).limit(1).count():
        raise DataError("ids and headers must not hold line breaks")
    write_ordered(df.select("ord", F.col("id").cast("string").alias("line")), "ord", str(path), tuple(f"# {h}" for h in header), overwrite)


def chat_dataset_entry(file_name: str) -> dict[str, Any]:
    """The index entry of a chat file."""
    return {
        "file_name": file_name,
        "formatting": "sharegpt",
        "columns": {"messages": "messages", "videos": "videos"},
        "tags": {"role_tag": "role", "content_tag": "content", "user_tag": "user", "assistant_tag": "assistant"},
    }


def upsert_dataset_entry(folder: str, name: str, file_name: str) -> str:
    """Adds or replaces an entry of ``dataset_info.json``."""
    path = f"{str(folder).rstrip('/')}/dataset_info.json"
    index = json.loads(stores.content(path)) if stores.exists(path) else {}
    write_json(path, index | {name: chat_dataset_entry(file_name)})
    return path


def write_json(path: str | Path, value: Any) -> None:
    """A JSON document that appears whole or not at all."""
    stores.replace(str(path), (json.dumps(value, indent=2, ensure_ascii=False, default=str) + "\n").encode())


def file_sha256(path: str | Path, spark: SparkSession | None = None) -> str:
    """A file's digest, read piece by piece: by a task where there is a session, else here."""
    if spark is None:
        return stores.digest(str(path))
    return stores.digests(spark.createDataFrame([(stores.root(spark, str(path)),)], "path string").coalesce(1)).first()["digest"]


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """name (below the folder) and sha256 of every file of any store, read by the workers piece by piece."""
    files = stores.walked(spark, folder).select("name", "path").where(~F.element_at(F.split("name", "/"), -1).isin(*SKIPPED))
    return stores.digests(files).select("name", F.col("digest").alias("sha256"))


def write_checksums(spark: SparkSession, folder: str) -> str:
    out = f"{str(folder).rstrip('/')}/{SKIPPED[0]}"
    found = checksums(spark, folder).select(F.split("name", "/").alias("sort"), F.concat("sha256", F.lit("  "), "name").alias("line"))
    write_ordered(found, "sort", out, overwrite=True)
    return out


def verify_checksums(spark: SparkSession, folder: str) -> list[str]:
    """Listed files that are missing or differ."""
    listed = spark.read.text(f"{folder}/{SKIPPED[0]}").select(F.split("value", "  ", 2).alias("v")).select(F.col("v")[0].alias("want"), F.col("v")[1].alias("name"))
    joined = listed.join(checksums(spark, folder), "name", "left")
    return [r.name for r in joined.where(F.col("sha256").isNull() | (F.col("sha256") != F.col("want"))).orderBy("name").collect()]


def placed_rows(spark: SparkSession, path: str, place: str = "place") -> DataFrame:
    """The rows of Parquet files with their place: the file's name, then the row in it."""
    rows = spark.read.parquet(path)
    return rows.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias(place))


def rows_fingerprint(df: DataFrame, order: str | None = None) -> tuple[str, int]:
    """SHA-256 of the rows in order, one JSON object a line, and their number: the same for any encoding of the same rows.

    Tasks write the lines, as one ordered file of the shared folder, and a task reads the digest off that file piece by piece.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    try:
        path = f"{folder}/rows.jsonl"
        n = write_ordered(_sorted_lines(df.select("id", "prompt", "response", "video_path", *([order] if order else [])), order), None, path)
        return stores.digests(spark.createDataFrame([(path,)], "path string")).first()["digest"], n
    finally:
        discard_folder(folder, spark)
