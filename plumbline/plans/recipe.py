"""Recipes: load and validate splits, and build the training files that a YAML document lists."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import expand_variables
from plumbline.operators import builders
from plumbline.operators.records import overlap_messages, validate_records
from plumbline.plans.prompts import resolve_prompt
from plumbline.sources import sinks, stores
from plumbline.sources.records import load_records
from plumbline.sources.shared import discard, written
from plumbline.taxonomy import BUILTINS, load_taxonomy


class RecipeError(ValueError):
    """A recipe that asks for what can't be built."""


def build_output(records: DataFrame, taxonomy, output: Mapping[str, Any], prompt: str) -> DataFrame:
    """The rows of one output."""
    kind, fmt, prefix = output["kind"], output.get("label_format", "id"), output.get("path_prefix")
    if kind in ("rl", "easyr1"):
        rows = builders.rl_rows(records, taxonomy, prompt, fmt, prefix)
        for k in output.get("oversample") or []:
            if fmt != "index":
                raise RecipeError("oversample needs label_format: index")
            rows = builders.oversample(rows, int(k))
        return rows
    if kind in ("chat", "sharegpt"):
        return builders.chat_rows(records, taxonomy, prompt, output["target_style"], output.get("block_name"), fmt, prefix, tuple(output.get("extra_fields") or ()))
    raise RecipeError(f"unknown output kind {kind!r}")


def run_recipe(spark: SparkSession, path: str, variables: Mapping[str, str] | None = None, dry_run: bool = False, overwrite: bool = False) -> dict[str, Any]:
    """Validates all splits, then writes all outputs with their manifests; a summary of both."""
    import yaml

    at = Path(stores.located(str(path))[1])
    raw = yaml.safe_load(stores.content(str(path)))
    defaults = {k: str(v["default"]) for k, v in (raw.pop("variables", None) or {}).items() if isinstance(v, Mapping) and v.get("default") is not None}
    recipe = expand_variables(raw, defaults | dict(variables or {}), keep_type=False)
    spec = recipe["taxonomy"]
    if isinstance(spec, str) and spec not in BUILTINS and not Path(spec).exists():
        spec = str(at.parent / spec)
    taxonomy = load_taxonomy(spec)
    policies, root = recipe.get("validate") or {}, recipe.get("video_root") or None
    splits = {name: load_records(spark, p, taxonomy) for name, p in recipe["splits"].items()}  # written tables
    try:
        reports = {}
        for name, records in splits.items():
            report = validate_records(
                records, taxonomy, root, policies.get("repeated_ids", "error"), policies.get("repeated_videos", "warn"),
                policies.get("check_media", "none"), bool(policies.get("require_all_categories", False)),
            )
            reports[name] = report.to_dict()
            report.raise_if_errors()
        overlap = overlap_messages(splits, root)
        if overlap and policies.get("split_overlap", "error") == "error":
            raise RecipeError("split overlap: " + "; ".join(overlap))
        outputs = [_write(spark, recipe, splits, taxonomy, o, at.parent, dry_run, overwrite) for o in recipe.get("outputs") or []]
    finally:
        for records in splits.values():
            discard(records, spark)
    return {"recipe": path, "taxonomy": taxonomy.name, "taxonomy_fingerprint": taxonomy.fingerprint(), "validation": reports, "split_overlap": overlap, "outputs": outputs}


def _write(spark, recipe, splits, taxonomy, output, base: Path, dry_run: bool, overwrite: bool) -> dict[str, Any]:
    split, target = output["split"], output["path"]
    if split not in splits:
        raise RecipeError(f"unknown split {split!r}")
    prompt, info = resolve_prompt(output["prompt"], taxonomy, base)
    rows = written(build_output(splits[split], taxonomy, output, prompt), spark)
    try:
        rl = "response" in rows.columns
        counts = rows.select(F.explode("response" if rl else "labels").alias("v")).groupBy(F.col("v").cast("string").alias("v")).count().collect()
        sizes = rows.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).first()
        done = {"kind": output["kind"], "split": split, "path": target, "rows": sizes.n, "unique_ids": sizes.ids, "prompt": info, "label_counts": {r.v: r["count"] for r in counts}, "oversample": output.get("oversample") or []}
        if not dry_run:
            if rl:
                sinks.write_rl_parquet(rows, target, overwrite)
                done["files"] = {r.name: r.sha256 for r in sinks.checksums(spark, target).where("name LIKE '%.parquet'").orderBy("name").collect()}
            else:
                sinks.write_json_lines(rows, target, "ord", overwrite)
                done["sha256"] = sinks.file_sha256(target, spark)
                if output.get("dataset_name"):
                    done["dataset_info"] = sinks.upsert_dataset_entry(target.rpartition("/")[0], output["dataset_name"], target.rpartition("/")[2])
            source = recipe["splits"][split]
            done["inputs"] = {split: {"path": str(source), "sha256": sinks.file_sha256(source, spark)}}
            sinks.write_json(f"{target}.manifest.json", done)
    finally:
        discard(rows, spark)
    return done
