"""Registered queries of what reads and writes files: fixture files are made from the benchmark tables in the shared folder, and
the operator's result on them is the query's. Each stands beside its SQL, which is written from the tables alone."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import parsing as P
from plumbline.operators import builders, records, rewards
from plumbline.operators import controller as ctl
from plumbline.plans import fixtures as X
from plumbline.plans.preflight import PreflightError, check_rl
from plumbline.sources import adapters, sinks
from plumbline.sources.lines import read_id_manifest
from plumbline.sources.ordered import write_ordered
from plumbline.sources.records import load_inputs, load_json_lines, load_records, parse_records
from plumbline.sources.shared import put_text, shared_folder
from plumbline.sources.stores import located, new_parent
from plumbline.taxonomy import load_taxonomy

TAX, IDS, K = X.TAXONOMY, X.IDS, X.K
XD = load_taxonomy("xdviolence")


def joined(c: Column) -> Column:
    return F.array_join(c, ",")


def _file(lines: DataFrame, order: str) -> str:
    """One text file of the column ``line``, in order."""
    path = shared_folder(lines.sparkSession) + "/lines.txt"
    write_ordered(lines, order, path)
    return path


def _record_rows(spark, sf) -> DataFrame:
    return X.samples(spark, sf).select(F.col("sid").alias("ord"), F.col("sid").cast("string").alias("id"), F.concat(F.lit("v/"), F.col("sid") % 1000, F.lit(".mp4")).alias("video"), F.col("gt").alias("labels"), (F.col("sid") % 5).alias("grade"))


# records


def source_records(spark, sf):
    rows = _record_rows(spark, sf).withColumn("labels", F.reverse("labels")).withColumn("id", F.when(F.col("ord") % 2 == 0, F.col("ord").cast("string")).otherwise(F.concat(F.lit('"'), "id", F.lit('"'))))
    spelled = F.transform("labels", lambda x: F.when(F.col("ord") % 3 == 0, F.substring(x, 2, 1)).otherwise(F.concat(F.lit('"'), x, F.lit('"'))))
    line = F.concat(F.lit('{"id": '), "id", F.lit(', "video": "'), "video", F.lit('", "labels": ['), F.array_join(spelled, ", "), F.lit('], "grade": '), "grade", F.lit("}"))
    read = load_records(spark, _file(rows.select("ord", line.alias("line")), "ord"), TAX)
    return read.select("ord", "id", "video", joined(F.col("labels")).alias("labels"), F.try_variant_get("extra", "$.grade", "bigint").alias("grade"))


#: Lines of records, some of them bad, and what is said of them.
CASES = {
    "not json": "invalid JSON",
    "[1]": "record must be a JSON object",
    '{"id": "a"}': "missing field(s) video, labels",
    '{"id": "", "video": "v", "labels": []}': "'id' must be a non-empty string",
    '{"id": "a", "video": 5, "labels": []}': "'video' must be a non-empty string",
    '{"id": "a", "video": "v", "labels": "C1"}': "'labels' must be a list (use [] for benign)",
    '{"id": "a", "video": "v", "labels": ["Zed"]}': 'unknown label in ["Zed"]',
    '{"id": "a", "video": "v", "labels": ["C1", 1]}': 'duplicate labels ["C1",1]',
    '{"id": true, "video": "v", "labels": []}': "'id' must be a non-empty string",
    '{"id": 7, "video": "v", "labels": ["C2"]}': None,
}


def source_record_errors(spark, sf):
    cases = F.array(*map(F.lit, CASES))
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("sid"), cases[(F.col("o_orderkey") % len(CASES)).cast("int")].alias("line"))
    return parse_records(rows, TAX).select("sid", "id", "error")


def source_jsonl(spark, sf):
    path = _file(spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.to_json(F.struct("event_id", "event_type", F.col("user_id").alias("who"))).alias("line")), "event_id")
    return load_json_lines(spark, path, "event_id bigint, event_type string, who bigint, absent string").select("event_id", "event_type", "who", "absent")


def source_inputs(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    video = F.concat(F.when(F.col("p_partkey") % 3 == 0, "s3://b/").when(F.col("p_partkey") % 3 == 1, "/abs/").otherwise("rel/"), F.col("p_partkey"), F.lit(".mp4"))
    line = F.to_json(F.struct(F.when(F.col("p_partkey") % 4 > 0, F.concat(F.lit("p"), "p_partkey")).alias("id"), video.alias("video")))
    return load_inputs(spark, path=_file(part.select("p_partkey", line.alias("line")), "p_partkey"), video_root="/data").select("id", "video")


def sink_id_manifest(spark, sf):
    path = shared_folder(spark) + "/ids.txt"
    sinks.write_id_manifest(_record_rows(spark, sf).where("ord % 7 = 3"), path, ("made from orders", "a second line"))
    return read_id_manifest(spark, path)


def sink_checksums(spark, sf):
    folder = shared_folder(spark)
    sinks.write_id_manifest(_record_rows(spark, sf), folder + "/ids.txt", ("all",))
    sinks.write_id_manifest(_record_rows(spark, sf).where("ord % 2 = 0"), folder + "/more/even.txt")
    sinks.write_checksums(spark, folder)
    if sinks.verify_checksums(spark, folder):
        raise ValueError("files changed while they were written")
    return sinks.checksums(spark, folder)


def sink_rl_parquet(spark, sf):
    path = shared_folder(spark) + "/rl"
    sinks.write_rl_parquet(builders.rl_rows(_record_rows(spark, sf), TAX, "task", "index", "/data"), path)
    return spark.read.parquet(path).select("id", "video_path", "prompt", F.array_join(F.transform("response", lambda x: (x * 10).cast("string")), ",").alias("response"))


def sink_rows_fingerprint(spark, sf):
    """Digests of training files' rows, in the order of the files and in that of ids."""
    path = shared_folder(spark) + "/rl"
    sinks.write_rl_parquet(builders.rl_rows(_record_rows(spark, sf), TAX, "task", "index", "/data"), path)
    orders = {"place": sinks.placed_rows(spark, path), "id": spark.read.parquet(path).withColumn("key", F.col("id").cast("bigint"))}
    found = [(k, *sinks.rows_fingerprint(df, "key" if k == "id" else k)) for k, df in orders.items()]
    return spark.createDataFrame(found, "by string, sha256 string, n bigint")


def preflight_rl(spark, sf):
    """What a check of training files against pinned digests notes, with the digests of all their rows."""
    folder = shared_folder(spark)
    rows = builders.rl_rows(_record_rows(spark, sf), TAX, "task", "index", "s3://data")
    for split, part in (("train", rows.where("ord % 5 > 0")), ("val", rows.where("ord % 5 = 0"))):
        sinks.write_rl_parquet(part, f"{folder}/{split}.parquet")
    pinned = {f"{split}_files": sinks.rows_fingerprint(sinks.placed_rows(spark, f"{folder}/{split}.parquet"), "place")[0] for split in ("train", "val")}
    files, reward = (f"{folder}/train.parquet", f"{folder}/val.parquet"), {"taxonomy": "safewatch", "reward": "jaccard"}
    said = {"same": check_rl(spark, *files, reward, pinned=pinned), "swapped": check_rl(spark, *files[::-1], reward, pinned=pinned)}
    try:
        check_rl(spark, files[0], f"{folder}/none.parquet", reward | {"reward": "none"})
    except PreflightError as e:
        said["faults"] = [p.split(":")[0] for p in e.problems]
    return spark.createDataFrame([(k, v) for k, vs in (said | {k: [v] for k, v in pinned.items()}).items() for v in vs], "name string, value string")


def source_rl_parquet(spark, sf):
    path = shared_folder(spark) + "/rl"
    sinks.write_rl_parquet(builders.rl_rows(_record_rows(spark, sf), TAX, "task", "id", "/data"), path)
    return adapters.rl_parquet(spark, path, TAX, "/data").select("id", "video", joined(F.col("labels")).alias("labels"), "source_prompt_sha256")


def source_chat_jsonl(spark, sf):
    path = shared_folder(spark) + "/chat.jsonl"
    rows = builders.chat_rows(_record_rows(spark, sf), TAX, "task", "json", label_format="index", path_prefix="/data/", extra_fields=("grade",))
    sinks.write_json_lines(rows, path)
    read = adapters.chat_jsonl(spark, path, TAX, "/data", ("grade",))
    return read.select("ord", "id", "video", joined(F.col("labels")).alias("labels"), F.try_variant_get("grade", "$", "bigint").alias("grade"))


def sink_dataset_info(spark, sf):
    folder = shared_folder(spark)
    names = [r.r_name for r in spark.read.parquet(f"{sf}/region.parquet").orderBy("r_regionkey").collect()]
    for n in [*names, names[0]]:
        sinks.upsert_dataset_entry(folder, n.lower(), f"{n}.json")
    entry = "struct<file_name:string,formatting:string,columns:map<string,string>,tags:map<string,string>>"
    index = spark.read.text(f"{folder}/dataset_info.json", wholetext=True).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("name", "e"))
    return index.select("name", "e.file_name", "e.formatting", F.col("e.columns")["videos"].alias("videos"), F.col("e.tags")["role_tag"].alias("role_tag"))


# annotations of other projects


def source_label_list(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    line = F.concat(F.lit("dir/p"), "p_partkey", F.lit("_label_B"), F.col("p_size") % 6 + 1, F.when(F.col("p_size") % 3 == 0, "-G").otherwise("-0"), F.lit("-B"), F.col("p_partkey") % 7)
    return adapters.label_list(spark, _file(part.select("p_partkey", line.alias("line")), "p_partkey"), XD, "basename", "/x/").select("id", "video", joined(F.col("labels")).alias("labels"))


def _write_arrays(rows: DataFrame, key: str, item: Column, address: Column, opening: Column | None = None) -> None:
    """Each address gets a file with the JSON array of its items in order, written item by item in the task that has them."""
    named = rows.select(address.alias("address"), key, item.alias("item"), (F.lit("[") if opening is None else opening).alias("opening"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (r for b in batches for r in b.to_pylist())
        for name, group in groupby(found, key=lambda r: r["address"]):
            new_parent(name)
            store, path = located(name)
            with store.open_output_stream(path) as f:
                for k, r in enumerate(group):
                    f.write(((r["opening"] if k == 0 else ",") + r["item"]).encode())
                f.write(b"]" if r["opening"] == "[" else b"]}")
            yield pa.RecordBatch.from_pylist([{"address": name}])

    named.repartition("address").sortWithinPartitions("address", key).mapInArrow(run, "address string").count()


def source_folder_annotations(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    key, root = F.col("c_custkey"), shared_folder(spark)
    video = F.concat(F.lit("dataset/"), F.when(key % 5 == 0, "clip").otherwise("full"), F.lit("/"), key, F.lit(".mp4"))
    folder = F.concat(F.lit("n"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    truth = F.struct(video.alias("video_path"), F.array(F.concat(F.lit("C"), key % 6 + 1)).alias("labels"), F.array(F.col("c_mktsegment")).alias("subcategories"))
    file = lambda name: F.concat(F.lit(root + "/"), folder, F.lit("/" + name))
    _write_arrays(c, "c_custkey", F.to_json(F.struct(key.alias("id"), video.alias("video"))), file("full.json"))
    _write_arrays(c.where("c_custkey % 3 > 0"), "c_custkey", F.to_json(truth), file("full_gt.json"))
    out = adapters.folder_annotations(spark, root, TAX, "full", "/videos/")
    return out.select("ord", "id", "video", joined(F.col("labels")).alias("labels"), joined(F.col("subcategories")).alias("subcategories"))


def source_benchmark_annotations(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    key, root = F.col("s_suppkey"), shared_folder(spark)
    path = F.concat(F.lit("videos/real/C"), F.col("s_nationkey") % 6 + 1, F.lit("/C"), F.col("s_nationkey") % 6 + 1, F.when(key % 4 == 0, "_benign").otherwise("_harm"), F.lit("/"), key, F.when(key % 10 == 9, ".unknown_video").otherwise(".mp4"))
    item = F.struct(path.alias("video_path"), F.when(key % 2 == 0, F.array(F.lit("C1"), F.lit("C3"))).alias("labels"), F.array(F.when(key % 4 == 0, "benign").otherwise("harm")).alias("subcategories"))
    name = F.concat(F.lit("C"), F.col("s_nationkey") % 6 + 1)
    opening = F.when(name < "C4", "[").otherwise('{"items": [')
    _write_arrays(s, "s_suppkey", F.to_json(item), F.concat(F.lit(f"{root}/real/"), name, F.lit("/all_benchmark.json")), opening)
    out = adapters.benchmark_annotations(spark, root, TAX, "empty")
    return out.select("id", "video", joined(F.col("labels")).alias("labels"), joined(F.col("subcategories")).alias("subcategories"), "harmfulness")


# label spaces and reports


def taxonomy_dimension(spark, sf):
    named = [load_taxonomy(n).dimension(spark).select(F.lit(n).alias("taxonomy"), "pos", "id", "name", "output_key") for n in ("safewatch", "xdviolence")]
    custom = load_taxonomy({"name": "custom", "key_template": "{name}:{id}", "categories": [{"id": "K1", "name": "Knife", "aliases": ["knife", 1]}, {"id": "K2", "name": "Fire"}]})
    return named[0].unionByName(named[1]).unionByName(custom.dimension(spark).select(F.lit("custom").alias("taxonomy"), "pos", "id", "name", "output_key"))


def taxonomy_fingerprint(spark, sf):
    rows = [(n, load_taxonomy(n).fingerprint()) for n in ("safewatch", "xdviolence")]
    return spark.createDataFrame(rows, "taxonomy string, sha256 string")


def validation_report(spark, sf):
    rows = _record_rows(spark, sf).withColumn("id", F.when(F.col("ord") % 100 == 7, F.lit("same")).otherwise(F.col("id")))
    rows = rows.withColumn("labels", F.array_remove("labels", "C5"))
    r = records.validate_records(rows, TAX, "/data", "warn", "warn")
    found = {"records": r.num_records, "repeated_ids": len(r.repeated_ids), "rows_of_same": r.repeated_ids["same"], "repeated_videos": len(r.repeated_videos), "warnings": len(r.warnings), "errors": len(r.errors), "benign": r.cardinality_counts.get(0, 0)}
    return spark.createDataFrame([*found.items(), *((f"of_{c}", n) for c, n in r.label_counts.items())], "what string, n bigint")


# parsing


def parse_triple_newline(spark, sf):
    block = F.concat(F.lit("GUARDRAIL: {"), F.concat_ws(", ", *(F.concat(F.lit(f'"{key}": '), F.when(F.col(f"p{k}") == 1, "TRUE").otherwise("false")) for k, key in enumerate(X.KEYS, 1))), F.lit("}"))
    gap = F.when(F.col("sid") % 4 == 0, "\n\n").otherwise("\n\n\n")
    rows = X.responses(spark, sf).select("sid", F.concat(F.lit(" because "), F.col("sid").cast("string"), gap, block, F.lit("\n")).alias("text"))
    p = P.parse_response(F.col("text"), TAX, "triple_newline")
    rows = rows.select("sid", p.alias("p"), P.extract_answer(F.col("text"), "triple_newline").alias("answer"), P.extract_explanation(F.col("text"), "triple_newline").alias("why"))
    return rows.select("sid", F.col("p.status").alias("status"), joined(F.col("p.labels")).alias("labels"), "p.answer_found", "p.format_ok", "p.explanation", "p.error", F.length("answer").cast("bigint").alias("answer_length"), "why")


def parse_answer_or_full(spark, sf):
    p = X.responses(spark, sf).select("sid", P.parse_response(F.col("response"), TAX, scope="answer_or_full").alias("p"))
    return p.select("sid", F.col("p.source").alias("source"), *(F.col("p.decisions")[i].alias(f"d{k}") for k, i in enumerate(IDS, 1)))


# controller states


def _adaptive(**more):
    from plumbline.plans.queries import CONTROLLER

    return rewards.build_settings({"taxonomy": TAX, "reward": "adaptive", "answer_only": True, "mode": "global", "invalid_prediction_policy": "as_empty", **CONTROLLER, **more})


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _statistics(spark, sf, settings) -> DataFrame:
    return rewards.batch_statistics(rewards.read_responses(X.reward_rows(spark, sf), settings), settings)


def controller_resumed(spark, sf):
    """Batches in two halves, with the state saved and loaded between them."""
    settings = _adaptive()
    statistics = _statistics(spark, sf, settings)
    last = statistics.agg(F.floor(F.max("batch_id") / 2)).first()[0]
    first = ctl.Controller(settings.controller)
    for r in statistics.where(F.col("batch_id") <= last).orderBy("batch_id").toLocalIterator():
        first.update([r.batch_fp], [r.batch_fn])
    saved = json.loads(json.dumps(first.state_dict()))
    second = ctl.Controller(settings.controller)
    second.load_state_dict(saved)
    states = rewards.controller_states(statistics.where(F.col("batch_id") > last), settings, second.state)
    return _rounded(ctl.inspect_state(states, settings.controller).select("batch_id", "category", F.col("fp").alias("fp_ema"), F.col("fn").alias("fn_ema"), F.col("u").alias("logit_u"), "alpha", "beta", "ema_ratio"))


def controller_initialised(spark, sf):
    settings = _adaptive(init_fp_ema=0.4, init_fn_ema=0.1)
    states = rewards.controller_states(_statistics(spark, sf, settings), settings)
    return _rounded(ctl.inspect_state(states, settings.controller).select("batch_id", F.col("fp").alias("fp_ema"), F.col("fn").alias("fn_ema"), F.col("u").alias("logit_u")))


def reward_diagnostics(spark, sf):
    scored = rewards.score(X.reward_rows(spark, sf), _adaptive())
    columns = ("coef_alpha", "coef_beta", "ctrl_updated", "ctrl_updates", "ctrl_target_ratio", "ctrl_fp_ema", "ctrl_fn_ema", "ctrl_ema_ratio", "ctrl_logit_u", "invalid_rate", "counted_samples", "batch_fn_fp_ratio")
    return _rounded(scored.select("batch_id", *columns).distinct())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        source_records, source_record_errors, source_jsonl, source_inputs, sink_id_manifest, sink_checksums, sink_rl_parquet, sink_rows_fingerprint, preflight_rl, source_rl_parquet, source_chat_jsonl,
        sink_dataset_info, source_label_list, source_folder_annotations, source_benchmark_annotations, validation_report,
        parse_triple_newline, parse_answer_or_full, controller_resumed, controller_initialised, reward_diagnostics,
    )
}
#: Label spaces come from no table: see ``run_queries.SETTINGS``.
SETTINGS = {f.__name__: f for f in (taxonomy_dimension, taxonomy_fingerprint)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of these queries."""
    from plumbline.plans import oracle as O  # noqa: E741, N812

    names, head = O.names("t"), O.RECORDS
    text = lambda s: "'" + s.replace("'", "''") + "'"
    said = " ".join(f"WHEN {k} THEN {text(e)}" for k, e in enumerate(CASES.values()) if e)
    key = lambda t: f"{t}.s_nationkey % 6 + 1"
    categories = [
        ("safewatch", "{id}({name})", ["C1|Sexual Content", "C2|Harassment & Bullying", "C3|Threats, Violence & Harm", "C4|False & Deceptive Information", "C5|Illegal/Regulated Activities", "C6|Hateful Content & Extremism"]),
        ("xdviolence", "{id}({name})", ["B1|Fighting", "B2|Shooting", "B3|Explosion", "B4|Riot", "B5|Abuse", "B6|Car accident"]),
        ("custom", "{name}:{id}", ["K1|Knife", "K2|Fire"]),
    ]
    split = [(t, k, *c.split("|"), template) for t, template, cs in categories for k, c in enumerate(cs)]
    dimension = ", ".join(f"({text(t)}, {k}, {text(i)}, {text(n)}, {text(x.format(id=i, name=n))})" for t, k, i, n, x in split)
    canon = lambda t, block: json.dumps({"block_name": block, "categories": [[i, n, [str(k + 1)]] for s, k, i, n, _ in split if s == t], "key_template": "{id}({name})", "name": t}, separators=(",", ":"))
    codes = "list_transform(['B' || (p_size % 6 + 1), CASE WHEN p_size % 3 = 0 THEN 'G' ELSE '0' END, 'B' || (p_partkey % 7)], lambda c: CASE WHEN c = 'G' THEN 'B3' ELSE c END)"
    block = "'GUARDRAIL: {' || " + " || ', ' || ".join(f"'\"{k}\": ' || CASE WHEN p{n} = 1 THEN 'TRUE' ELSE 'false' END" for n, k in enumerate(X.KEYS, 1)) + " || '}'"
    ratio = "round((fn_ema + 1e-8) / (fp_ema + 1e-8), 6)"
    started = O.controller_sql("global")
    for a, b in (("0e0 AS fp_ema, 0e0 AS fn_ema, 0e0 AS u", "4e-1 AS fp_ema, 1e-1 AS fn_ema, ln((1e-1 + 1e-8) / (4e-1 + 1e-8) + 1e-8) - ln(2e0 + 1e-8) AS u"), ("f.i = 0", "false")):
        if a not in started:
            raise ValueError("the recursion has another form")
        started = started.replace(a, b)
    indexes = f"concat_ws(', ', {', '.join(f'CASE WHEN t{k} = 1 THEN {k} END' for k in K)})"
    row = f"""'{{{{"id": "' || id || '", "prompt": "task <video>", "response": [' || {indexes} || '], "video_path": "/data/' || video || '"}}}}' || chr(10)"""
    digest = f"sha256(string_agg({row}, '' ORDER BY {{order}}))"
    return {
        "source_records": f"{head} SELECT row_number() OVER (ORDER BY ord) AS ord, id, video, {names} AS labels, ord % 5 AS grade FROM v",
        "source_record_errors": f"SELECT o_orderkey AS sid, CASE WHEN o_orderkey % {len(CASES)} = {len(CASES) - 1} THEN '7' END AS id, CASE o_orderkey % {len(CASES)} {said} END AS error FROM orders",
        "source_jsonl": "SELECT event_id, event_type, user_id AS who, CAST(NULL AS VARCHAR) AS absent FROM events",
        "source_inputs": """WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 's3://b/' WHEN 1 THEN '/abs/' ELSE 'rel/' END || p_partkey || '.mp4' AS v FROM part)
SELECT CASE WHEN k % 4 > 0 THEN 'p' || k ELSE v END AS id, CASE WHEN k % 3 = 2 THEN '/data/' || v ELSE v END AS video FROM p""",
        "sink_id_manifest": f"{head} SELECT row_number() OVER (ORDER BY ord) + 2 AS ord, id FROM v WHERE ord % 7 = 3",
        "sink_checksums": f"""{head} SELECT 'ids.txt' AS name, sha256('# all' || chr(10) || string_agg(id || chr(10), '' ORDER BY ord)) AS sha256 FROM v
UNION ALL SELECT 'more/even.txt', sha256(string_agg(id || chr(10), '' ORDER BY ord)) FROM v WHERE ord % 2 = 0""",
        "sink_rl_parquet": f"{head} SELECT id, '/data/' || video AS video_path, 'task <video>' AS prompt, concat_ws(',', {', '.join(f'CASE WHEN t{k} = 1 THEN {k * 10} END' for k in K)}) AS response FROM v",
        "sink_rows_fingerprint": f"{head}, d AS (SELECT {digest.format(order='ord')} AS sha256, count(*) AS n FROM v) SELECT 'place' AS \"by\", * FROM d UNION ALL SELECT 'id', * FROM d",
        "preflight_rl": f"""{head} SELECT CASE WHEN ord % 5 = 0 THEN 'val_files' ELSE 'train_files' END AS name, {digest.format(order='ord').replace("/data/", "s3://data/")} AS value FROM v GROUP BY 1
UNION ALL VALUES ('swapped', 'train_files isn''t the pinned data'), ('swapped', 'val_files isn''t the pinned data'), ('faults', 'val_files not found'), ('faults', 'reward settings')""",
        "source_rl_parquet": f"{head} SELECT id, video, {names} AS labels, sha256('task <video>') AS source_prompt_sha256 FROM v",
        "source_chat_jsonl": f"{head} SELECT row_number() OVER (ORDER BY ord) AS ord, id, video, {names} AS labels, ord % 5 AS grade FROM v",
        "sink_dataset_info": "SELECT lower(r_name) AS name, r_name || '.json' AS file_name, 'sharegpt' AS formatting, 'videos' AS videos, 'role' AS role_tag FROM region",
        "source_label_list": f"""SELECT 'dir/p' || p_partkey || '_label_B' || (p_size % 6 + 1) || CASE WHEN p_size % 3 = 0 THEN '-G' ELSE '-0' END || '-B' || (p_partkey % 7) || '.mp4' AS id,
'/x/p' || p_partkey || '_label_B' || (p_size % 6 + 1) || CASE WHEN p_size % 3 = 0 THEN '-G' ELSE '-0' END || '-B' || (p_partkey % 7) || '.mp4' AS video,
array_to_string(list_sort(list_distinct(list_filter({codes}, lambda c: c IN ('B1', 'B2', 'B3', 'B4', 'B5', 'B6')))), ',') AS labels FROM part""",
        "source_folder_annotations": """SELECT row_number() OVER (ORDER BY lpad(CAST(c_nationkey AS VARCHAR), 2, '0'), c_custkey) AS ord, 'full/' || c_custkey || '.mp4' AS id, '/videos/full/' || c_custkey || '.mp4' AS video,
CASE WHEN c_custkey % 3 > 0 THEN 'C' || (c_custkey % 6 + 1) ELSE '' END AS labels, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '' END AS subcategories FROM customer WHERE c_custkey % 5 > 0""",
        "source_benchmark_annotations": f"""WITH s AS (SELECT *, 'real/C' || ({key('supplier')}) || '/C' || ({key('supplier')}) || CASE WHEN s_suppkey % 4 = 0 THEN '_benign' ELSE '_harm' END || '/' || s_suppkey || '.mp4' AS id FROM supplier)
SELECT id, id AS video, CASE WHEN s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 2 = 0 THEN 'C1,C3' ELSE 'C' || ({key('s')}) END AS labels, CASE WHEN s_suppkey % 4 = 0 THEN 'benign' ELSE 'harm' END AS subcategories,
CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 1 END AS harmfulness FROM s WHERE s_suppkey % 10 <> 9""",
        "taxonomy_dimension": f"SELECT * FROM (VALUES {dimension}) d(taxonomy, pos, id, name, output_key)",
        "taxonomy_fingerprint": " UNION ALL ".join(f"SELECT '{t}' AS taxonomy, sha256({text(canon(t, b))}) AS sha256" for t, b in (("safewatch", "GUARDRAIL"), ("xdviolence", "DETECTION"))),
        "validation_report": f"""{head}, x AS (SELECT 'records' AS what, count(*) AS n FROM v UNION ALL SELECT 'repeated_ids', 1 UNION ALL SELECT 'rows_of_same', count(*) FROM v WHERE ord % 100 = 7
UNION ALL SELECT 'repeated_videos', count(*) FROM (SELECT video FROM v GROUP BY video HAVING count(*) > 1) UNION ALL SELECT 'warnings', 3 UNION ALL SELECT 'errors', 0
UNION ALL SELECT 'benign', count(*) FROM v WHERE t1 + t2 + t3 + t4 + t6 = 0 {" ".join(f"UNION ALL SELECT 'of_C{k}', {'0' if k == 5 else f'CAST(sum(t{k}) AS BIGINT)'} {'' if k == 5 else 'FROM v'}" for k in K)}) SELECT what, CAST(n AS BIGINT) AS n FROM x""",
        "parse_triple_newline": f"""WITH s AS (SELECT *, sid % 4 > 0 AS ok, {block} AS block FROM ({X.SAMPLES}))
SELECT sid, CASE WHEN ok THEN 'ok' ELSE 'invalid' END AS status, CASE WHEN ok THEN {O.names('p')} END AS labels, ok AS answer_found, ok AS format_ok, CASE WHEN ok THEN 'because ' || sid END AS explanation,
CASE WHEN NOT ok THEN 'answer section not found' END AS error, CASE WHEN ok THEN length(block) END AS answer_length, CASE WHEN ok THEN 'because ' || sid END AS why FROM s""",
        "parse_answer_or_full": f"{O.RESP}, b AS (SELECT *, coalesce(answer, response) AS target FROM a) SELECT sid, CASE WHEN answer IS NULL THEN 'full_response' ELSE 'answer' END AS source, {O.decisions('target')} FROM b",
        "controller_resumed": f"{O.controller_sql('global')} SELECT batch_id, category, round(fp_ema, 6) AS fp_ema, round(fn_ema, 6) AS fn_ema, round(u, 6) AS logit_u, round(alpha, 6) AS alpha, round(beta, 6) AS beta, {ratio} AS ema_ratio FROM z WHERE batch_id > (SELECT floor(max(batch_id) / 2) FROM z)",
        "controller_initialised": f"{started} SELECT batch_id, round(fp_ema, 6) AS fp_ema, round(fn_ema, 6) AS fn_ema, round(u, 6) AS logit_u FROM z",
        "reward_diagnostics": f"""{O.controller_sql('global')}, h AS (SELECT batch_id, avg(CASE WHEN ok THEN 0e0 ELSE 1e0 END) AS bad, count(*) AS n, (avg(fn) + 1e-8) / (avg(fp) + 1e-8) AS r FROM c GROUP BY batch_id)
SELECT z.batch_id, round(coalesce(lag(alpha) OVER (ORDER BY i), 1e0), 6) AS coef_alpha, round(coalesce(lag(beta) OVER (ORDER BY i), 1e0), 6) AS coef_beta, 1e0 AS ctrl_updated, CAST(i AS DOUBLE) AS ctrl_updates, 2e0 AS ctrl_target_ratio,
round(fp_ema, 6) AS ctrl_fp_ema, round(fn_ema, 6) AS ctrl_fn_ema, {ratio} AS ctrl_ema_ratio, round(u, 6) AS ctrl_logit_u, round(bad, 6) AS invalid_rate, CAST(n AS DOUBLE) AS counted_samples, round(r, 6) AS batch_fn_fp_ratio FROM z JOIN h ON h.batch_id = z.batch_id""",
    }
