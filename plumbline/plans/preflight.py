"""Checks of training files and settings before a trainer is launched."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import resolve_video
from plumbline.operators.rewards import RewardError, build_settings
from plumbline.sources import stores
from plumbline.sources.sinks import placed_rows, rows_fingerprint
from plumbline.taxonomy import TaxonomyError


class PreflightError(ValueError):
    """Something that a training run needs isn't there; all that was found is told at once."""

    def __init__(self, problems: list[str]) -> None:
        super().__init__("\n  ".join(["preflight failed:", *problems]))
        self.problems = problems


def _lacks(paths: Mapping[str, Any]) -> list[str]:
    return [f"{name} not found: {value}" for name, value in paths.items() if value is not None and not stores.exists(str(value))]


def _model(reference: str) -> dict[str, str]:
    """A model that is named by a path must be a folder; other names belong to a hub."""
    local = reference.startswith(("/", "./", "../", "~"))
    return {"model path": os.path.expanduser(reference)} if local else {}


def check_rl(spark: SparkSession, train: str, val: str, reward: Mapping[str, Any], model: str = "", optional: Mapping[str, Any] | None = None, image_dir: str | None = None, run_folder: str = ".", pinned: Mapping[str, str] | None = None, videos: int = 20) -> list[str]:
    """Files exist (``file@split`` names a hub's data set), reward settings hold, and the first videos of the training rows are there.

    Returns notes: data files whose fingerprint isn't the pinned one.
    """
    files = {"train_files": train, "val_files": val}
    problems = _lacks({k: v for k, v in files.items() if "@" not in v} | dict(optional or {}) | {"image_dir": image_dir} | _model(model))
    try:
        build_settings(reward)
    except (RewardError, TaxonomyError) as e:
        problems.append(f"reward settings: {e}")
    if problems:
        raise PreflightError(problems)
    local = {k: v for k, v in files.items() if v.endswith(".parquet") and stores.exists(v)}
    notes = [f"{k} isn't the pinned data" for k, v in local.items() if (pinned or {}).get(k) and rows_fingerprint(placed_rows(spark, v), "place")[0] != pinned[k]]
    if "train_files" in local:
        base = image_dir if image_dir and (os.path.isabs(image_dir) or "://" in image_dir) else os.path.join(os.path.abspath(run_folder), image_dir or "")
        first = spark.read.parquet(train).select("video_path").limit(videos)
        paths = [r.p for r in first.select(resolve_video(F.col("video_path"), base).alias("p")).collect()]
        gone = [p for p in paths if "://" not in p and not stores.exists(p)]
        if gone:
            raise PreflightError([f"{len(gone)} of the first {videos} training videos not found, e.g. {gone[:3]}"])
    return notes


def check_chat(dataset_folder: str | None, names: str, model: str = "") -> None:
    """Every data set of a comma-separated list is in the folder's index, with its file."""
    problems = _lacks(_model(model))
    if dataset_folder:
        folder = str(dataset_folder).rstrip("/")
        index = f"{folder}/dataset_info.json"
        entries = json.loads(stores.content(index)) if stores.exists(index) else None
        if entries is None:
            problems.append(f"{index} not found")
        else:
            for name in filter(None, map(str.strip, names.split(","))):
                if name not in entries:
                    problems.append(f"data set {name!r} isn't in {index}")
                else:
                    problems += _lacks({f"file of data set {name!r}": f"{folder}/{entries[name]['file_name']}"})
    if problems:
        raise PreflightError(problems)
