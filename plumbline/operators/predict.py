"""Model predictions: backends that run in Python workers, prediction rows, and resumable runs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.labels import names_for
from plumbline.functions.parsing import missing_categories, parse_response
from plumbline.operators.selection import remaining
from plumbline.plans.inference import run_metadata
from plumbline.sources.shared import put_text
from plumbline.taxonomy import Taxonomy

RUN_FORMAT = "prediction_run/v1"
ERRORS = ("video_error", "generation_error")
#: Inputs of a task, at most about so many: a task for each core, or more where the inputs are many.
TASK_ROWS = 100_000
GENERATED = "id string, video string, response string, status string, error string"


class Backend(Protocol):
    """What a model needs: to prepare a video (which may fail), and to answer a batch of prepared ones.

    An answer is a text, or an exception or None where there is none.
    """

    def prepare(self, video: str) -> object: ...

    def generate(self, requests: Sequence[object]) -> Sequence[str | Exception | None]: ...


def _answers(backend: Backend, requests: list[object]) -> list[str | Exception | None]:
    """The backend's answers; where it fails on a batch as a whole, those to its requests one by one."""
    try:
        found = list(backend.generate(requests))
        if len(found) == len(requests):
            return found
        failure: Exception = RuntimeError(f"{len(found)} answers to {len(requests)} requests")
    except Exception as e:
        failure = e
    return [failure] if len(requests) == 1 else [a for r in requests for a in _answers(backend, [r])]


def generate(inputs: DataFrame, make_backend: Callable[[], Backend], batch_size: int = 8) -> DataFrame:
    """One row for every input: its response, or a video or generation error. Each task makes its backend once.

    Ids must be unique; a video that can't be prepared and an answer that fails concern their own row only. Inputs are dealt out by id over all
    cores, as a small file of inputs would otherwise be one task's work.
    """
    rows, most = inputs.groupBy("id").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    if most is not None and most > 1:
        raise ValueError("ids must be unique")
    size = max(1, batch_size)
    parts = max(1, min(rows or 0, max(inputs.sparkSession.sparkContext.defaultParallelism, -(-(rows or 0) // TASK_ROWS))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = None
        for frame in frames:
            backend = backend or make_backend()
            videos = frame["video"].tolist()
            texts: list[str | None] = [None] * len(videos)
            status: list[str | None] = [None] * len(videos)
            errors: list[str | None] = [None] * len(videos)
            for start in range(0, len(videos), size):
                ready = []
                for k, video in enumerate(videos[start : start + size], start):
                    try:
                        ready.append((k, backend.prepare(video)))
                    except Exception as e:  # a bad video is a result
                        status[k], errors[k] = ERRORS[0], f"{type(e).__name__}: {e}"
                answers = _answers(backend, [r for _, r in ready]) if ready else []
                for (k, _), answer in zip(ready, answers, strict=True):
                    if isinstance(answer, str):
                        texts[k] = answer
                    else:
                        status[k], errors[k] = ERRORS[1], f"{type(answer).__name__}: {answer}" if answer is not None else "no output"
            # one frame for each that came: frames of a batch's few rows cost more than the rows
            yield pd.DataFrame({"id": frame["id"], "video": frame["video"], "response": texts, "status": status, "error": errors})

    return inputs.select("id", "video").repartition(parts, "id").mapInPandas(run, GENERATED)


def _unsafe(labels: Column, partial: Column) -> Column:
    return F.when(F.size(labels) > 0, True).when(~partial, False)


def predictions(generated: DataFrame, taxonomy: Taxonomy, response_format: str = "think_answer", output_style: str = "json", scope: str = "full_response") -> DataFrame:
    """Prediction rows: status, labels, names, decisions, unsafe, missing categories, explanation, raw response, parse, error.

    A partial response is unsafe where something is flagged, and unknown (null) otherwise.
    """
    p = parse_response(F.col("response"), taxonomy, response_format, output_style, scope)
    rows = generated.withColumn("p", F.when(F.col("status").isNull(), p))
    read = F.col("p.status").isin("ok", "partial")
    labels = F.when(read, F.col("p.labels"))
    none = F.array().cast("array<string>")
    info = F.struct(F.lit(scope).alias("scope"), *(F.col(f"p.{c}").alias(c) for c in ("source", "format_ok", "answer_found", "error", "historical_labels")))
    return rows.select(
        "id",
        "video",
        F.coalesce("status", F.when(read, F.col("p.status")).otherwise("parse_error")).alias("status"),
        labels.alias("labels"),
        names_for(labels, taxonomy).alias("label_names"),
        F.when(read, F.col("p.decisions")).alias("decisions"),
        F.when(read, _unsafe(F.col("p.labels"), F.col("p.status") == "partial")).alias("unsafe"),
        F.when(read, missing_categories(F.col("p.decisions"), taxonomy)).otherwise(none).alias("missing_categories"),
        F.col("p.explanation").alias("explanation"),
        F.col("response").alias("raw_response"),
        F.when(F.col("p").isNotNull(), info).alias("parse"),
        F.coalesce("error", F.col("p.error")).alias("error"),
    )


def run_predictions(inputs: DataFrame, make_backend: Callable[[], Backend], taxonomy: Taxonomy, path: str, batch_size: int = 8, resume: bool = False, overwrite: bool = False, **parsing) -> dict:
    """Predictions for all inputs in a Parquet folder; with ``resume``, those it hasn't yet are appended, else
    ``overwrite`` replaces it.

    Returns counts by status, whether the run is complete, and what it depends on, which also stands in ``<path>.meta.json``, from
    the run's start on.
    """
    spark: SparkSession = inputs.sparkSession
    todo, before, exists = inputs, 0, _exists(spark, path)
    if exists and not (resume or overwrite):
        raise FileExistsError(f"{path} exists; resume or overwrite it")
    if exists and resume:
        done = spark.read.parquet(path).select("id")
        before, todo = done.count(), remaining(inputs, done)
    started = datetime.now().astimezone().isoformat(timespec="seconds")
    meta = {"format": RUN_FORMAT, "status": "running", "started": started, "finished": None, "resumed_from": before, "batch_size": batch_size, "parsing": parsing, "taxonomy": taxonomy.name, "taxonomy_fingerprint": taxonomy.fingerprint(), "output": path, **run_metadata()}
    put_text(spark, f"{path}.meta.json", json.dumps(meta, indent=2, ensure_ascii=False))
    made = predictions(generate(todo, make_backend, batch_size), taxonomy, **parsing)
    made.write.mode("append" if resume else "overwrite").parquet(path)
    counts = {r.status: r["count"] for r in spark.read.parquet(path).groupBy("status").count().collect()}
    total, wanted = sum(counts.values()), inputs.count()
    meta |= {"status": "complete" if total == wanted else "incomplete", "counts": counts, "num_records": total, "finished": datetime.now().astimezone().isoformat(timespec="seconds")}
    put_text(spark, f"{path}.meta.json", json.dumps(meta, indent=2, ensure_ascii=False))
    return meta


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
