"""The reward controller on a stream: every micro-batch is scored with the weights that earlier ones left.

State lies beside the output, in any store that Spark knows, and is committed by one small file that is replaced whole after each batch. Spark may run a
batch again after a failure; a batch whose number is committed already is not counted twice.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import controller as ctl
from plumbline.operators.rewards import RewardSettings, batch_statistics, controller_rates, read_responses, score_read
from plumbline.sources.shared import discard, discard_folder, get_text, put_text, written


class StreamingRewards:
    """Scores the micro-batches of a stream of (response, ground_truth) rows into a Parquet folder per batch."""

    def __init__(self, settings: RewardSettings, folder: str) -> None:
        self.settings, self.folder = settings, str(folder).rstrip("/")
        self.state_path = f"{self.folder}/state.json"

    def load(self) -> dict[str, Any] | None:
        found = get_text(SparkSession.getActiveSession(), self.state_path)
        return None if found is None else json.loads(found)

    def on_batch(self, rows: DataFrame, batch_id: int) -> None:
        saved, spark = self.load(), rows.sparkSession
        if saved and batch_id <= saved["last_batch"]:
            before = saved["before"] if batch_id == saved["last_batch"] else None
            if before is None:
                return
        else:
            before = saved["after"] if saved else None
        read = written(read_responses(rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")), self.settings), spark)
        controller = ctl.Controller(self.settings.controller) if self.settings.controller else None
        if controller and before:
            controller.load_state_dict(before)
        start = controller and controller.state_dict()
        scored = score_read(read, self.settings, controller.state if controller else None)
        scored.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")
        if controller and self.settings.update_controller:
            row = controller_rates(batch_statistics(read, self.settings), self.settings).first()
            if row and row.counted:
                controller.update(row.fp, row.fn)
        put_text(spark, self.state_path, json.dumps({"last_batch": batch_id, "before": start, "after": controller and controller.state_dict()}))
        discard(read, spark)

    def start(self, stream: DataFrame, checkpoint: str, **trigger: Any) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()


class KeyedStreamingRewards:
    """Many runs side by side: rows (run, response, ground_truth) of a stream, and one controller for each run.

    A micro-batch is a batch of every run that has rows in it. The controllers are a table of one row a run; each batch joins its statistics with
    it, and leaves the next version of the table, which a pointer file names. Scores and states of a batch are in place before the
    pointer moves, so a batch that is broken off is done again from the states that it began with, and one that is done is passed over.
    ``initial`` (run, state of type ``controller.STATE_TYPE``) holds runs that don't begin afresh. A null run is a run of its own.
    """

    def __init__(self, settings: RewardSettings, folder: str, key: str = "run", initial: DataFrame | None = None) -> None:
        if not settings.controller:
            raise ValueError("keyed rewards are adaptive ones")
        self.settings, self.folder, self.key, self.initial = settings, str(folder).rstrip("/"), key, initial
        self.pointer = f"{self.folder}/last.json"

    def last(self, spark: SparkSession) -> dict[str, Any] | None:
        """Number, states and runs' scores of the last committed batch."""
        found = get_text(spark, self.pointer)
        return None if found is None else json.loads(found)

    def states(self, spark: SparkSession) -> DataFrame:
        """The controllers as the last committed batch left them."""
        last = self.last(spark)
        if last:
            return spark.read.parquet(last["states"])
        if self.initial is not None:
            return self.initial.select(self.key, "state")
        return spark.createDataFrame([], f"`{self.key}` string, state {ctl.STATE_TYPE}")

    def scores(self, spark: SparkSession) -> DataFrame:
        """Rows of all committed batches."""
        return spark.read.parquet(f"{self.folder}/scored").where(F.col("batch") <= (self.last(spark) or {"batch": -1})["batch"])

    def on_batch(self, rows: DataFrame, batch_id: int) -> None:
        spark, last = rows.sparkSession, self.last(rows.sparkSession)
        if last and batch_id <= last["batch"]:
            return
        read = written(read_responses(rows.withColumn("batch_id", F.col(self.key)), self.settings), spark)
        known = self.states(spark).withColumnRenamed(self.key, "of_run")
        rates = controller_rates(batch_statistics(read, self.settings), self.settings)
        found = rates.join(known, F.col("batch_id").eqNullSafe(F.col("of_run")), "left").drop("of_run")
        moved = written(ctl.advance(found, self.settings.controller, "batch_id", self.settings.update_controller), spark)
        states = f"{self.folder}/states/{batch_id}-{uuid.uuid4().hex}"
        others = known.join(moved.select("batch_id"), F.col("of_run").eqNullSafe(F.col("batch_id")), "left_anti").select(F.col("of_run").alias(self.key), "state")
        moved.select(F.col("batch_id").alias(self.key), F.col("after").alias("state")).unionByName(others).write.parquet(states)
        plain = F.coalesce(F.col("batch_id").cast("string"), F.lit("\0none"))  # the join of scores with states is on equal keys
        scored = score_read(read.withColumn("batch_id", plain), self.settings, diagnostics=False, states=moved.withColumn("batch_id", plain))
        scored.drop("batch_id").write.mode("overwrite").parquet(f"{self.folder}/scored/batch={batch_id}")
        put_text(spark, self.pointer, json.dumps({"batch": batch_id, "states": states}))
        for table in (read, moved):
            discard(table, spark)
        if last:
            discard_folder(last["states"], spark)

    def start(self, stream: DataFrame, checkpoint: str, **trigger: Any) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
