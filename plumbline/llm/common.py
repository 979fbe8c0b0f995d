"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.shared import discard, discard_folder, free_name, shared_folder, shuffled_once, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark alone, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def about(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """The rows, or where there are more than ``most``, about so many of them, chosen by a hash of some columns and the place."""
    n = rows.count()
    if n <= most:
        return rows
    drawn = F.pmod(F.xxhash64(*keys, F.monotonically_increasing_id()), F.lit(1 << 30))
    name = free_name(rows, "__drawn")
    return rows.withColumn(name, drawn).where(F.col(name) < int(most / n * (1 << 30))).drop(name)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")
