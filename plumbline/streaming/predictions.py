"""Predictions on a stream of inputs, each id once, however often a batch is begun.

A micro-batch's predictions are one folder, written whole, and a small commit file by its number says that it stands. A batch that is broken off has no
commit: its folder is written anew when Spark runs it again. A batch that is committed is passed over. Readers see committed batches only.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.predict import Backend, generate, predictions
from plumbline.sources.shared import get_text, put_text, shared_schema
from plumbline.taxonomy import Taxonomy


class StreamingPredictions:
    """Predicts on the rows (id, video) of a stream, into a folder of any store that Spark knows."""

    def __init__(self, make_backend: Callable[[], Backend], taxonomy: Taxonomy, folder: str, batch_size: int = 8, **parsing: Any) -> None:
        self.make_backend, self.taxonomy, self.folder = make_backend, taxonomy, str(folder).rstrip("/")
        self.batch_size, self.parsing = batch_size, parsing

    def _entry(self, n: int) -> str:
        return f"{self.folder}/commits/{n}.json"

    def committed(self, spark: SparkSession) -> list[int]:
        """Numbers of the batches that stand, rising."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def made(self, spark: SparkSession) -> DataFrame | None:
        """Predictions of the committed batches; None before the first."""
        found = [f"{self.folder}/batch={n}" for n in self.committed(spark)]
        return spark.read.schema(json_schema(spark, self._entry(int(found[0].rpartition("=")[2])))).parquet(*found) if found else None

    def on_batch(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        if get_text(spark, self._entry(batch_id)) is not None:
            return
        todo, before = rows.select(F.col("id").cast("string").alias("id"), "video").dropDuplicates(["id"]), self.made(spark)
        if before is not None:
            todo = todo.join(before.select("id"), "id", "left_anti")
        out = predictions(generate(todo, self.make_backend, self.batch_size), self.taxonomy, **self.parsing)
        out.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")
        put_text(spark, self._entry(batch_id), json.dumps({"batch": batch_id, "schema": shared_schema(out)}))

    def start(self, stream: DataFrame, checkpoint: str, **trigger: Any) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()


def json_schema(spark: SparkSession, entry: str):
    """The schema that a commit names, so that empty batches have one too."""
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(get_text(spark, entry))["schema"])
