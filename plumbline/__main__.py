"""Command line: python -m plumbline COMMAND. Mistakes of the user print one line and exit with 2."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import config
from plumbline.operators import evaluate as E
from plumbline.operators import predict as P
from plumbline.operators import records as R
from plumbline.operators import selection as S
from plumbline.plans import inference
from plumbline.plans.preflight import check_chat, check_rl
from plumbline.plans.recipe import run_recipe
from plumbline.sources import adapters, sinks
from plumbline.sources import records as source
from plumbline.sources.lines import read_id_manifest
from plumbline.taxonomy import load_taxonomy


def _spark() -> SparkSession:
    return SparkSession.builder.appName("plumbline").getOrCreate()


def _pairs(items: list[str]) -> dict[str, str]:
    out = {}
    for item in items or []:
        name, eq, value = item.partition("=")
        if not eq:
            raise ValueError(f"{item!r} is not NAME=VALUE")
        out[name] = value
    return out


def _print(value) -> None:
    print(json.dumps(value, indent=2, ensure_ascii=False, default=str))


def _save(records: DataFrame, a: argparse.Namespace, **info) -> None:
    """The records as JSON lines beside a manifest of what they are."""
    n = sinks.write_json_lines(records, a.output, "ord", a.overwrite)
    unique = records.select("id").distinct().count()
    sinks.write_json(f"{a.output}.manifest.json", {"rows": n, "unique_ids": unique, "sha256": sinks.file_sha256(a.output), **info})
    print(f"{n} records in {a.output}")


def evaluate(a: argparse.Namespace) -> int:
    spark, tax = _spark(), load_taxonomy(a.taxonomy)
    truth = E.ground_truth(source.load_records(spark, a.data, tax), tax).select("ord", "id", "labels")
    schema = "id string, status string, labels array<string>, parse struct<historical_labels:array<string>>"
    made = source.load_json_lines(spark, a.predictions, schema).withColumn("historical_labels", F.col("parse.historical_labels"))
    result = E.evaluate(truth, made, tax, a.invalid_policy, a.missing_policy, a.label_source)
    if a.output:
        sinks.write_json(a.output, result)
    print(E.summary_text(result, tax))
    return 0


def prepare(a: argparse.Namespace) -> int:
    _print(run_recipe(_spark(), a.recipe, _pairs(a.var), a.dry_run, a.overwrite))
    return 0


def validate_data(a: argparse.Namespace) -> int:
    spark, tax = _spark(), load_taxonomy(a.taxonomy)
    splits = {Path(p).stem if len(a.data) > 1 else "data": source.load_records(spark, p, tax) for p in a.data}
    reports = {n: R.validate_records(d, tax, a.video_root, a.repeated_ids, a.repeated_videos, a.check_media, a.require_all_categories) for n, d in splits.items()}
    overlap = R.overlap_messages(splits, a.video_root) if len(splits) > 1 else []
    _print({"splits": {n: r.to_dict() for n, r in reports.items()}, "split_overlap": overlap})
    return int(bool(overlap) or not all(r.ok for r in reports.values()))


def import_data(a: argparse.Namespace) -> int:
    spark, tax = _spark(), load_taxonomy(a.taxonomy)
    made = {
        "annotations": lambda: adapters.folder_annotations(spark, a.input, tax, a.video_type, a.video_prefix),
        "benchmark": lambda: adapters.benchmark_annotations(spark, a.input, tax, a.benign_labels, tuple(a.sources), a.video_prefix),
        "list": lambda: adapters.label_list(spark, a.input, tax, a.video_path, a.video_prefix),
        "rl": lambda: adapters.rl_parquet(spark, a.input, tax, a.path_prefix),
        "chat": lambda: adapters.chat_jsonl(spark, a.input, tax, a.path_prefix, tuple(a.extra_fields)),
    }[a.format]()
    _save(made, a, format=a.format, input=a.input, taxonomy_fingerprint=tax.fingerprint())
    return 0


def filter_media(a: argparse.Namespace) -> int:
    spark, tax = _spark(), load_taxonomy(a.taxonomy)
    module, _, name = a.probe.partition(":")
    records = source.load_records(spark, a.data, tax)
    probes = S.probe_media(records, getattr(importlib.import_module(module), name), a.video_root).persist()
    kept, dropped = S.filter_by_media(records, probes, a.on_unreadable, video_root=a.video_root, max_duration=a.max_duration, min_duration=a.min_duration, min_frames=a.min_frames)
    reasons = {r.reason: r.n for r in S.reason_counts(dropped).collect()}
    _save(kept, a, dropped_by_reason=reasons)
    return 0


def select(a: argparse.Namespace) -> int:
    spark, tax = _spark(), load_taxonomy(a.taxonomy)
    records = source.load_records(spark, a.data, tax)
    if (a.manifest is None) == (a.n is None):
        raise ValueError("give --manifest or --n, one of them")
    chosen = S.select_by_manifest(records, read_id_manifest(spark, a.manifest)) if a.manifest else S.select_records(records, a.n, a.seed, a.method)
    _save(chosen, a, seed=a.seed, method=a.method if a.n else "manifest")
    if a.write_manifest:
        sinks.write_id_manifest(chosen, a.write_manifest, tuple(a.header), a.overwrite)
    return 0


def predict(a: argparse.Namespace) -> int:
    spark, tax = _spark(), load_taxonomy(a.taxonomy)
    module, _, name = a.backend.partition(":")
    inputs = source.load_inputs(spark, a.video or None, a.input, a.video_root)
    _print(P.run_predictions(inputs, getattr(importlib.import_module(module), name), tax, a.output, a.batch_size, a.resume, a.overwrite, response_format=a.response_format, scope=a.parse_scope))
    return 0


def inspect_state(a: argparse.Namespace) -> int:
    saved = json.loads(Path(a.state).read_text(encoding="utf-8"))
    saved = saved.get("controller") or saved.get("after") or saved
    names = ["global"] if saved["mode"] == "global" else saved["category_ids"]
    print(f"{saved['mode']}, {saved['num_updates']} updates")
    for k, n in enumerate(names):
        print(f"  {n}: " + ", ".join(f"{key} {values[k]:.6g}" for key, values in saved["readable"].items()))
    return 0


def show_config(a: argparse.Namespace) -> int:
    tree = config.load_yaml(a.config)
    given = {k: config.parse_scalar(v) for k, v in _pairs(a.var).items()}
    variables = config.resolve_variables(tree.pop("variables", None), given)
    _print(config.expand_variables(tree, variables))
    return 0


def presets(a: argparse.Namespace) -> int:
    _print(inference.load_preset(a.name).to_dict() if a.name else inference.list_presets())
    return 0


def preflight(a: argparse.Namespace) -> int:
    """Checks a training configuration: keys train_files, val_files, reward and what else ``check_rl`` takes, or dataset_dir and dataset."""
    tree = config.load_yaml(a.config)
    tree = config.expand_variables(tree, config.resolve_variables(tree.pop("variables", None), {k: config.parse_scalar(v) for k, v in _pairs(a.var).items()}))
    if "dataset" in tree:
        check_chat(tree.get("dataset_dir"), str(tree["dataset"]), str(tree.get("model_name_or_path", "")))
    else:
        more = {k: tree[k] for k in ("model", "optional", "image_dir", "pinned") if k in tree}
        for note in check_rl(_spark(), tree["train_files"], tree["val_files"], tree["reward"], run_folder=a.run_folder, **more):
            print(f"note: {note}")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(run, *required: str, **options) -> None:
        p = commands.add_parser(run.__name__.replace("_", "-"))
        p.set_defaults(run=run)
        for name in required:
            p.add_argument(f"--{name.replace('_', '-')}", required=True)
        for name, kind in options.items():
            flag = f"--{name.replace('_', '-')}"
            if isinstance(kind, bool):
                p.add_argument(flag, action="store_true")
            elif isinstance(kind, list):
                p.add_argument(flag, nargs="*", default=kind)
            elif isinstance(kind, tuple):
                p.add_argument(flag, choices=kind, default=kind[0])
            elif isinstance(kind, type):
                p.add_argument(flag, type=kind)
            else:
                p.add_argument(flag, default=kind, type=type(kind))

    command(evaluate, "data", "predictions", "taxonomy", "invalid_policy", missing_policy=("error", "negative", "exclude"), label_source=("labels", "historical"), output=str)
    command(prepare, "recipe", var=[], dry_run=False, overwrite=False)
    command(validate_data, "taxonomy", data=[], video_root=str, repeated_ids=("error", "warn", "allow"), repeated_videos=("warn", "error", "allow"), check_media=("none", "exists", "decode"), require_all_categories=False)
    command(import_data, "input", "output", "taxonomy", "format", video_type=("full", "clip", "all"), video_prefix="", benign_labels=("folder", "empty"), sources=["real", "genai"], video_path=("id", "basename"), path_prefix=str, extra_fields=[], overwrite=False)
    command(filter_media, "data", "output", "taxonomy", "video_root", probe="plumbline.operators.selection:probe_video", max_duration=float, min_duration=float, min_frames=int, on_unreadable=("error", "drop"), overwrite=False)
    command(select, "data", "output", "taxonomy", n=int, seed=0, method=("random_sample", "sorted_index_sample"), manifest=str, write_manifest=str, header=[], overwrite=False)
    command(predict, "output", "taxonomy", "backend", video=[], input=str, video_root=str, batch_size=8, resume=False, overwrite=False, response_format=("think_answer", "triple_newline", "plain"), parse_scope=("full_response", "answer_only", "answer_or_full"))
    command(inspect_state, "state")
    command(show_config, "config", var=[])
    command(presets, name=str)
    command(preflight, "config", var=[], run_folder=".")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(a)
    except (ValueError, OSError, KeyError) as e:
        print(f"plumbline: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
