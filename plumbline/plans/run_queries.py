"""Registered queries of whole runs and of settings: predictions by a backend, recipes, media, reward sessions, configuration documents."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import config
from plumbline.operators import controller as ctl
from plumbline.operators import evaluate, metrics, predict, records, rewards, selection
from plumbline.plans import fixtures as X
from plumbline.plans import inference, prompts
from plumbline.plans.recipe import run_recipe
from plumbline.sources import stores
from plumbline.sources.ordered import write_ordered
from plumbline.sources.records import load_records
from plumbline.sources.shared import put_text, shared_folder, written
from plumbline.sources.versions import VersionedTable
from plumbline.streaming.predictions import StreamingPredictions
from plumbline.taxonomy import load_taxonomy

TAX, IDS, K = X.TAXONOMY, X.IDS, X.K
SMALL = {"name": "small", "block_name": "RESULT", "categories": [{"id": "K1", "name": "Knife", "description": "Blades that are drawn."}, {"id": "K2", "name": "Fire"}]}


def _rows(spark: SparkSession, found: Mapping[str, Any]) -> DataFrame:
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in found.items()], "name string, value string")


def _flat(document: Any, name: str = "") -> dict[str, Any]:
    """Leaves of a document by their dotted names."""
    if not isinstance(document, Mapping) or not document:
        return {name: document}
    return {k: v for key, part in document.items() for k, v in _flat(part, f"{name}.{key}".strip(".")).items()}


# predictions


class NumberBackend:
    """Answers by the number in a video's name; some videos can't be opened, and some batches and requests fail."""

    def prepare(self, video: str) -> int:
        n = int(video[1:-4])
        if n % 7 == 0:
            raise OSError("cannot open")
        return n

    def generate(self, requests: list[int]) -> list[str | Exception | None]:
        if len(requests) > 1 and any(n % 11 == 0 for n in requests):
            raise MemoryError("batch too large")
        return [RuntimeError("lost") if n % 5 == 0 else None if n % 13 == 0 else self.text(n) for n in requests]

    @staticmethod
    def text(n: int) -> str:
        said = ", ".join(f'"{key}": {str(n % (k + 2) == 0).lower()}' for k, key in enumerate(X.KEYS[: 3 if n % 17 == 0 else 6]))
        return f"<think>{n}</think><answer>GUARDRAIL: {{{said}}}</answer>"


def predict_run(spark, sf):
    """A run in two halves, the second of which resumes the first."""
    inputs = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("v"), "p_partkey", F.lit(".mp4")).alias("video"))
    path = shared_folder(spark) + "/predictions"
    predict.run_predictions(inputs.where("CAST(id AS INT) % 2 = 0"), NumberBackend, TAX, path, scope="answer_only")
    done = predict.run_predictions(inputs, NumberBackend, TAX, path, resume=True, scope="answer_only")
    made = spark.read.parquet(path)
    return made.select("id", "status", F.array_join("labels", ",").alias("labels"), "unsafe", "explanation", "error", F.lit(done["status"]).alias("run"))


def predict_stream(spark, sf):
    """The same predictions on a stream: one batch, a restart, and another one that repeats some of the ids."""
    root = shared_folder(spark)
    inputs = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("v"), "p_partkey", F.lit(".mp4")).alias("video"))
    for part in (inputs.where("CAST(id AS INT) % 2 = 0"), inputs.where("CAST(id AS INT) % 3 > 0"), inputs):
        part.coalesce(2).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(inputs.schema).parquet(f"{root}/in")
        sink = StreamingPredictions(NumberBackend, TAX, f"{root}/out", scope="answer_only")
        sink.start(stream, f"{root}/checkpoint", availableNow=True).awaitTermination()
    return sink.made(spark).select("id", "status", F.array_join("labels", ",").alias("labels"), "unsafe", "explanation", "error")


def eval_from_records(spark, sf):
    """Metrics of a record file's truth against a prediction for each record, under the strict policies."""
    path = shared_folder(spark) + "/records.jsonl"
    line = F.to_json(F.struct(F.col("sid").alias("id"), F.concat(F.lit("v/"), "sid").alias("video"), F.col("gt").alias("labels"), F.lit(1).alias("rank")))
    rows = written(X.samples(spark, sf).select("sid", "gt", "pred"), spark)
    write_ordered(rows.select("sid", line.alias("line")), "sid", path)
    truth = evaluate.ground_truth(load_records(spark, path, TAX), TAX)
    made = rows.select("sid", F.col("sid").cast("string").alias("id"), F.lit("ok").alias("status"), F.col("pred").alias("labels")).drop("sid")
    for df, what in ((truth, "ground truth"), (made, "prediction")):
        evaluate.require_unique(df, what)
    joined = written(evaluate.join_predictions(truth.select("id", "labels"), made), spark)
    evaluate.check_policies(joined, "error", "error")
    found = metrics.summary(evaluate.apply_policies(joined, "error", "error"), TAX, only=("num_samples", "jaccard_similarity", "exact_match_ratio", "micro_f1"))
    return found.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes))


def eval_summary_text(spark, sf):
    """The text that people read: what was scored under which policies, and a line for each category."""
    rows = X.samples(spark, sf)
    truth = rows.select(F.col("sid").cast("string").alias("id"), F.col("gt").alias("labels"))
    kept = F.when(F.col("sid") % 4 == 3, "parse_error").otherwise("ok")
    made = rows.where("sid % 7 > 0").select(F.col("sid").cast("string").alias("id"), kept.alias("status"), F.col("pred").alias("labels"))
    result = evaluate.evaluate(truth, made, TAX, "exclude", "exclude", listed=5)
    lines = evaluate.summary_text(result, TAX).splitlines()
    return spark.createDataFrame([(k, x) for k, x in enumerate(lines) if k not in (1, 2)], "line int, text string")


DRAWN, SEED = 150, 7


def select_random(spark, sf):
    """A seeded draw of records in the order of the draw."""
    rows = X.samples(spark, sf).select(F.col("sid").alias("ord"), F.col("sid").cast("string").alias("id"), F.lit("kept").alias("rank"))
    return selection.select_records(rows, DRAWN, SEED, "random_sample").select("ord", "id", "rank")


# recipes

RECIPE = """
taxonomy: safewatch
variables: {{rate: {{default: 0}}}}
splits: {{train: "{root}/train.jsonl", val: "{root}/val.jsonl"}}
validate: {{repeated_videos: allow, split_overlap: allow}}
outputs:
  - {{kind: rl, split: train, path: "{root}/rl", label_format: index, path_prefix: /data, oversample: [2, 4], prompt: {{text: "rate ${{rate}}"}}}}
  - {{kind: chat, split: val, path: "{root}/chat.jsonl", target_style: simple, dataset_name: val, prompt: {{text: task}}}}
"""


def _recipe(spark, sf) -> tuple[str, dict[str, Any]]:
    root = shared_folder(spark)
    line = F.to_json(F.struct(F.col("sid").cast("string").alias("id"), F.concat(F.lit("v/"), "sid").alias("video"), F.col("gt").alias("labels")))
    rows = written(X.samples(spark, sf).select("sid", "gt"), spark).select("sid", line.alias("line"))
    for name, part in (("train", rows.where("sid % 10 > 0")), ("val", rows.where("sid % 10 = 0"))):
        write_ordered(part, "sid", f"{root}/{name}.jsonl")
    put_text(spark, f"{root}/recipe.yaml", RECIPE.format(root=root))
    return root, run_recipe(spark, f"{root}/recipe.yaml", {"rate": "3"})


def recipe_rows(spark, sf):
    root, _ = _recipe(spark, sf)
    return spark.read.parquet(f"{root}/rl").select("id", "video_path", "prompt", F.array_join(F.transform("response", lambda x: x.cast("string")), ",").alias("response"))


def recipe_manifests(spark, sf):
    _, summary = _recipe(spark, sf)
    found: dict[str, Any] = {"overlaps": len(summary["split_overlap"]), "fingerprint": summary["taxonomy_fingerprint"] == TAX.fingerprint()}
    for out in summary["outputs"]:
        found |= {f"{out['kind']}.{k}": out[k] for k in ("rows", "unique_ids", "split")} | {f"{out['kind']}.labels": sum(out["label_counts"].values()), f"{out['kind']}.prompt": out["prompt"]["sha256"], f"{out['kind']}.hashed": sorted({"sha256", "files"} & set(out)) != []}
    return _rows(spark, found)


# media


def _media(spark, sf) -> tuple[DataFrame, str]:
    """Records of videos, some of which are there as small files that hold their number of frames."""
    root = shared_folder(spark)
    key = F.col("s_suppkey")
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                stores.replace(f"{root}/v{k}.mp4", str(k).encode())
            yield b

    suppliers.where("s_suppkey % 3 > 0").repartition(8).mapInArrow(run, "s_suppkey bigint").count()
    own = F.when(key % 10 == 0, "s3://b/v").when(key % 5 == 0, F.concat(F.lit("v"), key - key % 2, F.lit(".mp4"))).otherwise(F.concat(F.lit("v"), key, F.lit(".mp4")))
    return suppliers.select(key.alias("ord"), key.cast("string").alias("id"), own.alias("video"), F.array().cast("array<string>").alias("labels")), stores.root(spark, root).removeprefix("file:")


def media_missing(spark, sf):
    found, root = _media(spark, sf)
    return records.media_faults(found, root).select(F.substring_index("video", "/", -1).alias("video"), "fault")


def _frames(path: str) -> tuple[int | None, float | None, str | None]:
    with open(path, encoding="utf-8") as f:
        n = int(f.read())
    return n, 8.0, "odd file" if n % 7 == 0 else None


def media_probes(spark, sf):
    found, root = _media(spark, sf)
    probes = selection.probe_media(found.where("NOT contains(video, '://')"), _frames, root)
    judged = selection.media_reasons(found.where("NOT contains(video, '://')"), probes, root, max_duration=10.0, min_duration=1.0)
    return judged.select("id", "frames", "duration", "reason")


def media_containers(spark, sf):
    """Probes of MP4 files, some of them cut off or without a video track, by a table that two runs share."""
    root, key = shared_folder(spark), F.col("s_suppkey")
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                whole = X.mp4_bytes(k % 50 + 2, 600, 25 * (k % 4 + 1), k % 3 == 0, b"text" if k % 11 == 0 else b"vide")
                stores.replace(f"{root}/v{k}.mp4", whole[: len(whole) - 9] if k % 7 == 0 else whole)
            yield b

    suppliers.repartition(8).mapInArrow(run, "s_suppkey bigint").count()
    found = suppliers.select(key.alias("ord"), key.cast("string").alias("id"), F.concat(F.lit(root + "/v"), key, F.lit(".mp4")).alias("video"))
    table = VersionedTable(f"{root}/probes", "key")
    selection.probe_kept(found.where("ord % 2 = 0"), selection.probe_video, table)
    probes = selection.probe_kept(found, selection.probe_video, table)
    judged = selection.media_reasons(found, probes, min_frames=10)
    return judged.select("id", "frames", F.round("fps", 6).alias("fps"), "error", "reason")


# rewards


def reward_session(spark, sf):
    """The first three batches, scored one after the other by a session whose state goes through JSON in between."""
    from plumbline.plans.queries import CONTROLLER

    given = {"taxonomy": "safewatch", "reward": "adaptive", "answer_only": "true", "mode": "global", "invalid_prediction_policy": "as_empty", **CONTROLLER}
    rows, state, out = X.reward_rows(spark, sf), None, []
    for k in range(3):
        session = rewards.RewardSession()
        if state is not None:
            session.set_state(state)  # before it is configured
        session.configure(**given)
        scored = session.score_batch(rows.where(F.col("batch_id") == k))
        out.append(scored.select("sid", F.round("overall", 6).alias("overall"), F.round("accuracy", 6).alias("accuracy")))
        state = json.loads(json.dumps(session.get_state()))
    return out[0].unionByName(out[1]).unionByName(out[2])


def reward_settings(spark, sf):
    s = rewards.build_settings({"taxonomy": SMALL, "reward": "tversky", "beta": "0.5", "answer_only": "False", "format_weight": 0.25})
    c = ctl.resolve_config({"mode": "category", "c": 2, "target_ratio": {"K1": 1, "K2": 3}, "init_fp_ema": [0.1, 0.2], "invalid_prediction_policy": "exclude"}, ["K1", "K2"])
    return _rows(spark, {**_flat({k: v for k, v in s.describe().items() if "fingerprint" not in k}, "reward"), **_flat(c.to_dict(), "controller"), "controller.sha256": c.fingerprint()})


# settings and texts


def config_documents(spark, sf):
    base = {"a": {"x": 1, "y": [1, 2]}, "lr": "${rate}", "name": "run-${rate}-${tag}", "keep": None}
    merged = config.deep_merge(base, {"a": {"y": [3], "z": {"deep": True}}, "new": "${tag}"})
    variables = config.resolve_variables({"rate": {"default": 0.5}, "tag": {}}, {"tag": "t"})
    found = config.expand_variables(merged, variables, use_env=False)
    scalars = {f"scalar.{t}": config.parse_scalar(t) for t in ("1", "0.5", "true", "[1, x]", "text", "null")}
    paths = {f"path.{p}": config.absolute_local_path(p, True) for p in ("s3://b/x", "/abs/x", "nowhere/x")}
    return _rows(spark, {**_flat(found), **scalars, **paths})


def inference_settings(spark, sf):
    preset, info = inference.resolve_settings("/no/model", preset="safewatch_json", overrides={"video.fps": 2.0, "system_prompt": "Be brief."})
    document = {k: v for k, v in preset.to_dict().items() if k not in ("taxonomy", "prompt", "description", "provenance")}
    return _rows(spark, {**_flat(document), "from": info["source"]})


def request_messages(spark, sf):
    out = {}
    for position, prompt in (("after", "Look."), ("before", "Look."), ("placeholder", "Look at <video> now.")):
        settings = inference.InferenceConfig(load_taxonomy(SMALL), prompt, "plain", {"video": {"position": position, "fps": 2.0}, "system_prompt": "Be brief."})
        for turn in inference.build_messages(settings, "v.mp4"):
            said = turn["content"] if isinstance(turn["content"], str) else "|".join(x.get("text") or f"{x['video']}@{x['fps']}" for x in turn["content"])
            out[f"{position}.{turn['role']}"] = said
    return _rows(spark, out)


def prompt_texts(spark, sf):
    small = load_taxonomy(SMALL)
    task = prompts.render_task_prompt(small, intro="Judge the clip.")
    texts = {"task": task, **{f: prompts.apply_format_template(" Judge it. ", f) for f in prompts.SUFFIXES}}
    return _rows(spark, texts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (predict_run, predict_stream, eval_from_records, eval_summary_text, select_random, recipe_rows, recipe_manifests, media_missing, media_probes, media_containers, reward_session)
}
#: Settings and texts that come from no table: their SQL states what they should be, and a unit test compares the two.
SETTINGS = {f.__name__: f for f in (reward_settings, config_documents, inference_settings, request_messages, prompt_texts)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of these queries."""
    from plumbline.plans import oracle as O  # noqa: N812

    text = lambda s: "'" + s.replace("'", "''") + "'"
    values = lambda rows: "SELECT * FROM (VALUES " + ", ".join(f"({text(k)}, {text(v)})" for k, v in rows.items()) + ") d(name, value)"
    labels = "concat_ws(',', " + ", ".join(f"CASE WHEN n % {k + 1} = 0 AND (n % 17 > 0 OR {k} <= 3) THEN '{i}' END" for k, i in enumerate(IDS, 1)) + ")"
    flagged = "(n % 2 = 0 OR n % 3 = 0 OR n % 4 = 0 OR n % 17 > 0 AND (n % 5 = 0 OR n % 6 = 0 OR n % 7 = 0))"
    train = f"WITH s AS ({X.SAMPLES}), v AS (SELECT *, {O.INDEXES} AS response FROM s WHERE sid % 10 > 0)"
    copies = "SELECT id || '__aug_cls{k}_1' AS id, video_path, prompt, response, t2, t4 FROM {of} WHERE t{k} = 1"
    task = """Judge the clip.

**Analyze the video for the presence of the following categories:**

<BEGIN CATEGORIES>
K1: Knife; K2: Fire;
<END CATEGORIES>

**Refer to the detailed explanations of each category below:**

<BEGIN CATEGORIES EXPLANATIONS>
<box>
K1: Knife:
Blades that are drawn.
</box>
<box>
K2: Fire:
Fire
</box>
<END CATEGORIES EXPLANATIONS>

**Provide the result in the following JSON format:**

RESULT = {
"K1(Knife)": boolean,
"K2(Fire)": boolean
}

**Set the value to true ONLY for the categories present in the video. If none of them is present, set all values to false.**

**The result must be the JSON format of "RESULT", beginning with "RESULT:"**"""
    resolved = {"mode": "category", "category_ids": ["K1", "K2"], "target_ratio": [1.0, 3.0], "rho": 0.05, "eta": 0.01, "epsilon": 1e-08, "scale": 2.0, "logit_leakage": 0.0, "beta_clip": 0.0, "init_logit_u": None, "init_fp_ema": [0.1, 0.2], "init_fn_ema": None, "invalid_prediction_policy": "exclude"}
    as_text = lambda v: v if isinstance(v, str) else json.dumps(v)
    canon = json.dumps(resolved, sort_keys=True, separators=(",", ":"))
    settings = {"taxonomy": "small", "reward": "tversky", "controller": "null", "response_format": "think_answer", "parse_scope": "full_response", "format_weight": "0.25", "alpha": "1.0", "beta": "0.5", "update_controller": "true", "log_classification_metrics": "false"}
    inferred = {
        "format": "inference_config/v1", "taxonomy_fingerprint": "", "response_format": "think_answer", "system_prompt": "Be brief.", "base_model": "null", "max_model_len": "null", "preset": "safewatch_json", "video.fps": "2.0", "video.min_pixels": "12544",
        "video.max_pixels": "200704", "video.image_patch_size": "14", "video.position": "after", "parser.output_style": "json", "parser.scope": "answer_only", "parser.require_block_prefix": "true", "generation.max_new_tokens": "1024",
        "generation.temperature": "0.0", "generation.top_p": "1.0", "generation.top_k": "-1", "generation.repetition_penalty": "1.0", "generation.seed": "null", "processor.source": "checkpoint", "processor.revision": "null", "processor.use_fast": "false", "from": "preset:safewatch_json",
    }
    documents = {
        "a.x": "1", "a.y": "[3]", "a.z.deep": "true", "lr": "0.5", "name": "run-0.5-t", "keep": "null", "new": "t", "scalar.1": "1", "scalar.0.5": "0.5", "scalar.true": "true", "scalar.[1, x]": '[1, "x"]', "scalar.text": "text",
        "scalar.null": "null", "path.s3://b/x": "s3://b/x", "path./abs/x": "/abs/x", "path.nowhere/x": "nowhere/x",
    }
    said = {f"{p}.system": "Be brief." for p in inference.POSITIONS} | {"after.user": "Look.|v.mp4@2.0", "before.user": "v.mp4@2.0|Look.", "placeholder.user": "Look at |v.mp4@2.0| now."}
    predicted = f"""WITH p AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 7 = 0 THEN 'video_error' WHEN p_partkey % 5 = 0 OR p_partkey % 13 = 0 THEN 'generation_error' WHEN p_partkey % 17 = 0 THEN 'partial' ELSE 'ok' END AS status FROM part)
SELECT CAST(n AS VARCHAR) AS id, status, CASE WHEN status IN ('ok', 'partial') THEN {labels} END AS labels, CASE WHEN status NOT IN ('ok', 'partial') THEN NULL WHEN {flagged} THEN true WHEN status = 'ok' THEN false END AS unsafe,
CASE WHEN status IN ('ok', 'partial') THEN CAST(n AS VARCHAR) END AS explanation, CASE WHEN n % 7 = 0 THEN 'OSError: cannot open' WHEN n % 5 = 0 THEN 'RuntimeError: lost' WHEN n % 13 = 0 THEN 'no output' END AS error FROM p"""
    titles = ", ".join(f"({text(c.id)}, {text(c.name)})" for c in TAX.categories)
    scored = f"a AS ({X.SAMPLES}), c AS (SELECT * FROM a WHERE sid % 7 > 0 AND sid % 4 <> 3), k AS ({O.category_rows()}), n(category, name) AS (VALUES {titles})"
    shares = ", ".join(f"100 * ({O.div(a, b)})" for a, b in (("tp", "tp + fp"), ("tp", "tp + fn"), ("2 * tp", "2 * tp + fp + fn")))
    # the draw is Python's generator, so it stands here for each number of orders that the tables have
    draws = ", ".join(f"({total}, {k}, {i})" for total in (1_500, 15_000, 150_000) for k, i in enumerate(random.Random(SEED).sample(range(total), DRAWN)))
    return {
        "predict_stream": predicted,
        "eval_from_records": O.summary_sql(("num_samples", "jaccard_similarity", "exact_match_ratio", "micro_f1")),
        "eval_summary_text": f"""WITH {scored} SELECT CAST(0 AS INTEGER) AS line, 'Scored ' || count(*) FILTER (sid % 7 > 0 AND sid % 4 <> 3) || ' of ' || count(*) || ' samples (invalid ' || count(*) FILTER (sid % 7 > 0 AND sid % 4 = 3)
|| ': exclude, missing ' || count(*) FILTER (sid % 7 = 0) || ': exclude, partial 0)' AS text FROM a UNION ALL SELECT CAST(pos + 2 AS INTEGER), '  ' || category || ' ' || name || ': ' || printf('%.2f/%.2f/%.2f', {shares}) || ' (' || (tp + fn) || ')' FROM k JOIN n USING (category)""",
        "select_random": f"""WITH d(total, k, i) AS (VALUES {draws}), o AS (SELECT o_orderkey AS sid, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS total FROM (SELECT DISTINCT o_orderkey FROM orders))
SELECT CAST(k AS BIGINT) AS ord, CAST(sid AS VARCHAR) AS id, 'kept' AS rank FROM o JOIN d ON o.i = d.i AND o.total = d.total""",
        "predict_run": f"""WITH p AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 7 = 0 THEN 'video_error' WHEN p_partkey % 5 = 0 OR p_partkey % 13 = 0 THEN 'generation_error' WHEN p_partkey % 17 = 0 THEN 'partial' ELSE 'ok' END AS status FROM part)
SELECT CAST(n AS VARCHAR) AS id, status, CASE WHEN status IN ('ok', 'partial') THEN {labels} END AS labels, CASE WHEN status NOT IN ('ok', 'partial') THEN NULL WHEN {flagged} THEN true WHEN status = 'ok' THEN false END AS unsafe,
CASE WHEN status IN ('ok', 'partial') THEN CAST(n AS VARCHAR) END AS explanation, CASE WHEN n % 7 = 0 THEN 'OSError: cannot open' WHEN n % 5 = 0 THEN 'RuntimeError: lost' WHEN n % 13 = 0 THEN 'no output' END AS error, 'complete' AS run FROM p""",
        "recipe_rows": f"""{train}, r AS (SELECT CAST(sid AS VARCHAR) AS id, '/data/v/' || sid AS video_path, 'rate 3 <video>' AS prompt, response, t2, t4 FROM v),
r2 AS (SELECT * FROM r UNION ALL {copies.format(k=2, of='r')}), r4 AS (SELECT * FROM r2 UNION ALL {copies.format(k=4, of='r2')}) SELECT id, video_path, prompt, response FROM r4""",
        "recipe_manifests": f"""{train}, w AS (SELECT *, t1 + t2 + t3 + t4 + t5 + t6 AS l, (1 + t2) * (1 + t4) AS c FROM v), o AS (SELECT t1 + t2 + t3 + t4 + t5 + t6 AS l FROM s WHERE sid % 10 = 0)
SELECT 'overlaps' AS name, '0' AS value UNION ALL SELECT 'fingerprint', 'true' UNION ALL SELECT 'rl.rows', CAST(sum(c) AS VARCHAR) FROM w UNION ALL SELECT 'rl.unique_ids', CAST(sum(c) AS VARCHAR) FROM w
UNION ALL SELECT 'rl.split', 'train' UNION ALL SELECT 'rl.labels', CAST(sum(l * c) AS VARCHAR) FROM w UNION ALL SELECT 'rl.prompt', sha256('rate 3') UNION ALL SELECT 'rl.hashed', 'true'
UNION ALL SELECT 'chat.rows', CAST(count(*) AS VARCHAR) FROM o UNION ALL SELECT 'chat.unique_ids', CAST(count(*) AS VARCHAR) FROM o UNION ALL SELECT 'chat.split', 'val'
UNION ALL SELECT 'chat.labels', CAST(sum(l) AS VARCHAR) FROM o UNION ALL SELECT 'chat.prompt', sha256('task') UNION ALL SELECT 'chat.hashed', 'true'""",
        "media_missing": """WITH v AS (SELECT DISTINCT CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey - s_suppkey % 2 ELSE s_suppkey END AS k FROM supplier WHERE s_suppkey % 10 <> 0)
SELECT 'v' || k || '.mp4' AS video, 'missing' AS fault FROM v WHERE k % 3 = 0 OR k NOT IN (SELECT s_suppkey FROM supplier)""",
        "media_probes": """WITH v AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey - s_suppkey % 2 ELSE s_suppkey END AS k FROM supplier WHERE s_suppkey % 10 <> 0),
x AS (SELECT *, k % 3 > 0 AND k IN (SELECT s_suppkey FROM supplier) AS there FROM v), y AS (SELECT *, there AND k % 7 > 0 AS good FROM x)
SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN there THEN k END AS frames, CASE WHEN good THEN k / 8e0 END AS duration, CASE WHEN NOT good THEN 'unreadable' WHEN k / 8e0 > 10 THEN 'too_long' WHEN k / 8e0 < 1 THEN 'too_short' END AS reason FROM y""",
        "media_containers": """WITH v AS (SELECT s_suppkey AS k, s_suppkey % 50 + 2 AS n, CASE WHEN s_suppkey % 7 = 0 THEN 'box moov is cut off' WHEN s_suppkey % 11 = 0 THEN 'no video track' END AS error FROM supplier)
SELECT CAST(k AS VARCHAR) AS id, CASE WHEN error IS NULL THEN n END AS frames, CASE WHEN error IS NULL THEN 24e0 / (k % 4 + 1) END AS fps, error,
CASE WHEN error IS NOT NULL THEN 'unreadable' WHEN n < 10 THEN 'too_few_frames' END AS reason FROM v""",
        "reward_session": f"SELECT sid, overall, accuracy FROM ({O.ADAPTIVE_GLOBAL} SELECT sid, batch_id, {O.R6('(0.9e0 * (' + O.tversky('al', 'be') + ') + 0.1e0 * fmt)')} AS overall, {O.R6(O.tversky('al', 'be'))} AS accuracy FROM y) WHERE batch_id < 3",
        "reward_settings": values({f"reward.{k}": v for k, v in settings.items()} | {f"controller.{k}": as_text(v) for k, v in resolved.items()}) + f" UNION ALL SELECT 'controller.sha256', sha256({text(canon)})",
        "config_documents": values(documents),
        "inference_settings": values({k: v for k, v in inferred.items() if v}) + " UNION ALL SELECT 'taxonomy_fingerprint', (SELECT sha256 FROM (" + O.ORACLE_SQL["taxonomy_fingerprint"] + ") WHERE taxonomy = 'safewatch')",
        "request_messages": values(said),
        "prompt_texts": values({"task": task, **{f: f"Judge it.{s}" for f, s in prompts.SUFFIXES.items() if s}, "plain": " Judge it. "}),
    }
