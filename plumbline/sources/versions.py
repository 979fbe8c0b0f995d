"""A small table that several runs keep up to date: versions, and a log whose entries appear once.

A merge writes the next version beside the old ones: the new rows, and of the old ones those with other keys. It then commits
by putting an entry with the next number into the log, which fails if another run has been quicker; the merge is then done again on what that run left, so
no run's rows are lost. Readers go by the highest entry. Versions that no kept entry names are dropped after a commit.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.shared import discard_folder, get_text, put_text
from plumbline.sources.stores import located


class VersionedTable:
    """Rows by key in a folder of any store. ``keep`` older versions stay, for readers that are under way."""

    def __init__(self, folder: str, key: str, keep: int = 2) -> None:
        self.folder, self.key, self.keep = folder.rstrip("/"), key, keep

    def _entry(self, n: int) -> str:
        return f"{self.folder}/log/{n:010d}.json"

    def entries(self, spark: SparkSession) -> list[int]:
        """Numbers of the log's entries, rising."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The table as last committed; None before the first commit."""
        found = self.entries(spark)
        return spark.read.parquet(json.loads(get_text(spark, self._entry(found[-1])))["version"]) if found else None

    def merge(self, rows: DataFrame, spark: SparkSession, tries: int = 20) -> int:
        """Puts rows in, each in place of the row with its key, and commits; the entry's number. Of rows with one key any one is taken."""
        fresh = f"{self.folder}/fresh-{uuid.uuid4().hex}"
        rows.where(f"`{self.key}` is not null").dropDuplicates([self.key]).write.parquet(fresh)  # once, however often the merge is done
        try:
            for _ in range(tries):
                found, new = self.entries(spark), spark.read.parquet(fresh)
                old = self.read(spark)
                whole = new if old is None else new.unionByName(old.join(new.select(self.key), self.key, "left_anti"))
                version, n = f"{self.folder}/version-{uuid.uuid4().hex}", (found[-1] if found else 0) + 1
                whole.write.parquet(version)
                if self._commit(spark, n, json.dumps({"version": version})):
                    self._drop(spark, n)
                    return n
                discard_folder(version, spark)
        finally:
            discard_folder(fresh, spark)
        raise RuntimeError(f"{self.folder}: other runs were quicker {tries} times")

    def _commit(self, spark: SparkSession, n: int, text: str) -> bool:
        """Whether the entry is now there, and ours: it appears whole or not at all, and never in place of another."""
        entry = self._entry(n)
        part = f"{self.folder}/log/part-{uuid.uuid4().hex}"
        put_text(spark, part, text)
        if entry.startswith("file:") or "://" not in entry:
            try:
                os.link(located(part)[1], located(entry)[1])
                return True
            except FileExistsError:
                return False
            finally:
                discard_folder(part, spark)
        to = spark._jvm.org.apache.hadoop.fs.Path
        return bool(to(entry).getFileSystem(spark._jsc.hadoopConfiguration()).rename(to(part), to(entry)))

    def _drop(self, spark: SparkSession, n: int) -> None:
        for old in self.entries(spark):
            if old < n - self.keep and (found := get_text(spark, self._entry(old))):
                discard_folder(json.loads(found)["version"], spark)
                discard_folder(self._entry(old), spark)
