"""The registered queries: each applies one operator to fixture rows made from the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import labels as L
from plumbline.functions import parsing as P
from plumbline.functions import similarity as S
from plumbline.functions import text as T
from plumbline.operators import builders, evaluate, metrics, records, rewards, selection
from plumbline.operators.predict import predictions
from plumbline.plans import file_queries, run_queries
from plumbline.plans import fixtures as X

TAX, IDS = X.TAXONOMY, X.IDS
DIGITS = 6
CONTROLLER = {"target_ratio": 2.0, "rho": 0.2, "eta": 0.1, "scale": 2.0, "logit_leakage": 0.05, "beta_clip": 0.02}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def joined(c: Column) -> Column:
    return F.array_join(c, ",")


# evaluation


def eval_confusion(spark, sf):
    return metrics.per_category(X.samples(spark, sf), TAX).select("category", "tp", "fp", "fn", "tn", "n_positive_gt", "n_positive_pred")


def eval_per_category(spark, sf):
    return rounded(metrics.per_category(X.samples(spark, sf), TAX).select("category", *metrics.PER_CATEGORY))


def _summary(*names: str):
    return lambda spark, sf: rounded(metrics.summary(X.samples(spark, sf), TAX, only=names))


SUMMARIES = {
    "eval_jaccard_exact_hamming": ("num_samples", "jaccard_similarity", "exact_match_ratio", "hamming_accuracy", "micro_accuracy"),
    "eval_micro": ("micro_precision", "micro_recall", "micro_f1"),
    "eval_macro": tuple(f"macro_{m}" for m in ("accuracy", "precision", "recall", "f1", "specificity", "false_positive_rate", "balanced_accuracy")),
    "eval_sample": ("sample_precision", "sample_recall", "sample_f1"),
    "eval_weighted": ("weighted_precision", "weighted_recall", "weighted_f1"),
    "eval_binary": ("binary_accuracy", "binary_precision", "binary_recall", "binary_f1", "false_refusal_rate", "violation_leakage_rate", "n_benign", "n_unsafe", "n_false_refusal", "n_missed_violation"),
}


def _joined(spark, sf, source: str = "labels") -> DataFrame:
    """Truth and predictions where a 17th of all predictions lacks and a few have other ids."""
    rows = X.responses(spark, sf)
    truth = rows.select(F.col("sid").cast("string").alias("id"), F.col("gt").alias("labels"))
    parsed = rows.where("sid % 17 <> 0").select("sid", P.parse_response(F.col("response"), TAX, scope="answer_only").alias("p"))
    made = parsed.select(
        F.when(F.col("sid") % 101 == 0, F.col("sid") + 1000000).otherwise(F.col("sid")).cast("string").alias("id"),
        F.when(F.col("p.status") == "invalid", "parse_error").otherwise(F.col("p.status")).alias("status"),
        F.col("p.labels").alias("labels"),
        F.col("p.historical_labels").alias("historical_labels"),
    )
    return truth, made, evaluate.join_predictions(truth, made, source)


def _coverage(policy: str, source: str = "labels"):
    def run(spark, sf):
        scored = evaluate.apply_policies(_joined(spark, sf, source)[2], policy, policy)
        return rounded(metrics.summary(scored, TAX, only=("num_samples", "jaccard_similarity", "exact_match_ratio", "micro_f1", "macro_f1")))

    return run


def eval_status_counts(spark, sf):
    return _joined(spark, sf)[2].groupBy("status").agg(F.count("*").alias("n"))


def eval_coverage_report(spark, sf):
    return evaluate.coverage(_joined(spark, sf, "historical")[2])


def eval_extra_ids(spark, sf):
    truth, made, _ = _joined(spark, sf)
    return evaluate.extra_predictions(truth, made)


# parsing


def _decisions(d: Column) -> list[Column]:
    return [d[i].alias(f"d{k}") for k, i in enumerate(IDS, 1)]


def parse_json(spark, sf):
    p = X.responses(spark, sf).select("sid", P.parse_response(F.col("response"), TAX, scope="full_response").alias("p"))
    return p.select("sid", *_decisions(F.col("p.decisions")))


def parse_answer_only(spark, sf):
    p = X.responses(spark, sf).select("sid", P.parse_response(F.col("response"), TAX).alias("p"))
    return p.select("sid", F.col("p.status").alias("status"), joined(F.col("p.labels")).alias("labels"), F.col("p.source").alias("source"), F.col("p.error").alias("error"), *_decisions(F.col("p.decisions")))


def parse_simple(spark, sf):
    rows = X.samples(spark, sf).select("sid", T.sft_target(F.col("pred"), TAX, "simple").alias("text"))
    p = rows.select("sid", P.parse_response(F.col("text"), TAX, "plain", "simple", "full_response").alias("p"))
    return p.select("sid", F.col("p.status").alias("status"), joined(F.col("p.labels")).alias("labels"))


def parse_format_ok(spark, sf):
    return X.responses(spark, sf).select("sid", P.format_ok(F.col("response"), "think_answer").alias("format_ok"), P.format_ok(F.col("response"), "triple_newline").alias("triple_ok"))


def parse_answer(spark, sf):
    return X.responses(spark, sf).select("sid", P.extract_answer(F.col("response"), "think_answer").alias("answer"))


def parse_explanation(spark, sf):
    return X.responses(spark, sf).select("sid", P.extract_explanation(F.col("response"), "think_answer").alias("explanation"))


def parse_status_counts(spark, sf):
    p = X.responses(spark, sf).select("kind", P.parse_response(F.col("response"), TAX).alias("p"))
    return p.groupBy("kind", F.col("p.status").alias("status")).agg(F.count("*").alias("n"))


def parse_conversations(spark, sf):
    rows = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", P.parse_response(F.col("text"), TAX, scope="full_response").alias("p"))
    return rows.groupBy(F.col("p.status").alias("status"), F.col("p.error").alias("error")).agg(F.count("*").alias("n"))


def prediction_rows(spark, sf):
    rows = X.responses(spark, sf)
    none = F.lit(None).cast("string")
    made = rows.select(F.col("sid").cast("string").alias("id"), F.lit("v").alias("video"), "response", F.when(F.col("sid") % 29 == 0, "video_error").alias("status"), none.alias("error"))
    p = predictions(made.withColumn("error", F.when(F.col("status").isNotNull(), "unreadable")), TAX, scope="answer_only")
    return p.select("id", "status", joined(F.col("labels")).alias("labels"), F.array_join("label_names", ";").alias("label_names"), "unsafe", joined(F.col("missing_categories")).alias("missing"), "error")


# rewards


def _reward(**given):
    def run(spark, sf):
        settings = rewards.build_settings({"taxonomy": TAX, "answer_only": True} | given)
        scored = rewards.score(X.reward_rows(spark, sf), settings, diagnostics=False)
        return rounded(scored.select("sid", "overall", "format", "accuracy"))

    return run


def reward_pairs(spark, sf):
    s = X.samples(spark, sf)
    g, p = F.col("gt"), F.col("pred")
    return rounded(s.select("sid", S.exact_match(p, g).alias("exact"), S.jaccard(p, g).alias("jaccard"), S.tversky(p, g, 0.3, 0.7).alias("tversky")))


def _statistics(policy: str = "as_empty", mode: str = "global"):
    return rewards.build_settings({"taxonomy": TAX, "reward": "adaptive", "answer_only": True, "mode": mode, "invalid_prediction_policy": policy, **CONTROLLER})


def batch_stats_global(spark, sf):
    settings = _statistics("exclude")
    out = rewards.batch_statistics(rewards.read_responses(X.reward_rows(spark, sf), settings), settings)
    return rounded(out.select("batch_id", "invalid_rate", "counted_samples", "batch_tp", "batch_fp", "batch_fn", "batch_fn_fp_ratio"))


def batch_stats_category(spark, sf):
    settings = _statistics()
    out = rewards.batch_statistics(rewards.read_responses(X.reward_rows(spark, sf), settings), settings)
    return rounded(out.select("batch_id", *(F.col(f"batch_{x}_{i}").alias(f"batch_{x}_{i}".lower()) for i in IDS for x in ("fp", "fn"))))


def batch_classification(spark, sf):
    settings = _statistics()
    out = rewards.batch_metrics(rewards.read_responses(X.reward_rows(spark, sf), settings), settings)
    return rounded(out.select("batch_id", "macro_precision", "macro_recall", "macro_f1", "micro_precision", "micro_recall", "micro_f1"))


def _states(mode: str, update: bool = True):
    def run(spark, sf):
        from dataclasses import replace

        settings = replace(_statistics(mode=mode), update_controller=update)
        statistics = rewards.batch_statistics(rewards.read_responses(X.reward_rows(spark, sf), settings), settings)
        states = rewards.controller_states(statistics, settings)
        from plumbline.operators.controller import inspect_state

        out = inspect_state(states, settings.controller)
        return rounded(out.select("batch_id", "category", F.col("fp").alias("fp_ema"), F.col("fn").alias("fn_ema"), F.col("u").alias("logit_u"), "alpha", "beta"))

    return run


# records


def validate_repeats(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.md5("text").alias("video"))
    return records.repeats(docs, "video")


def _sample_records(spark, sf) -> DataFrame:
    return X.samples(spark, sf).select(F.col("sid").alias("ord"), F.col("sid").cast("string").alias("id"), F.concat(F.lit("v/"), F.col("sid") % 1000, F.lit(".mp4")).alias("video"), F.col("gt").alias("labels"))


def validate_label_counts(spark, sf):
    return records.label_counts(_sample_records(spark, sf), TAX).select("category", "n")


def validate_cardinality(spark, sf):
    return records.cardinalities(_sample_records(spark, sf))


def split_overlap(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.md5("text").alias("video"), (F.col("doc_id") % 3).alias("s"))
    splits = {n: docs.where(F.col("s") == k).drop("s") for k, n in enumerate(("train", "val", "test"))}
    return records.split_overlap(splits).select("first", "second", "kind", "n", "example")


def resolve_video(spark, sf):
    urls = table(spark, sf, "pages").select(F.col("url").alias("video"))
    names = table(spark, sf, "part").select(F.col("p_name").alias("video"))
    rows = urls.unionByName(names).distinct()
    return rows.select("video", T.resolve_video(F.col("video"), "/data/videos/").alias("path"))


def resolve_spellings(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))).alias("spelled"))
    ids = L.resolve_labels(F.col("spelled"), TAX, strict=False)
    return rows.select("l_orderkey", joined(ids).alias("ids"), joined(L.unknown_labels(F.col("spelled"), TAX)).alias("unknown"), joined(L.to_vector(ids, TAX)).alias("vector"))


def label_list_codes(spark, sf):
    codes = F.concat(F.lit("B"), F.col("p_size") % 8, F.when(F.col("p_size") % 3 == 0, "-G").otherwise("-A"), F.lit("-B"), F.col("p_partkey") % 7)
    return table(spark, sf, "part").select("p_partkey", joined(T.list_codes(codes)).alias("codes"))


# selection and building


def _judged(spark, sf) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").distinct()
    path = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("bigint").cast("string"))
    rows = items.select(F.concat(path, F.when(F.col("l_partkey") % 50 == 0, ".unknown_video").otherwise(".mp4")).alias("video"), "l_linenumber", "l_quantity", "l_partkey")
    probes = rows.where("l_partkey % 40 <> 1").select(F.col("video").alias("path"), F.col("l_quantity").cast("bigint").alias("frames"), (F.col("l_linenumber") % 5).cast("double").alias("fps"), F.lit(None).cast("string").alias("error"))
    recs = rows.select(F.col("video").alias("id"), "video", F.col("l_partkey").alias("ord"))
    return selection.media_reasons(recs, probes, max_duration=20.0, min_duration=2.0, min_frames=5)


def media_filter(spark, sf):
    return rounded(_judged(spark, sf).where("reason is null").select("id", "frames", "fps", "duration"))


def media_filter_reasons(spark, sf):
    return selection.reason_counts(_judged(spark, sf))


def select_manifest(spark, sf):
    recs = _sample_records(spark, sf)
    wanted = recs.where("ord % 7 = 3").select("ord", "id")
    return selection.select_by_manifest(recs, wanted).select("id", "video", joined(F.col("labels")).alias("labels"))


def select_sampled(spark, sf):
    return selection.select_records(_sample_records(spark, sf), 200, 42, "sorted_index_sample").select("ord", "id")


def oversample(spark, sf):
    recs = _sample_records(spark, sf)
    recs = recs.withColumn("id", F.when(F.col("ord") % 11 == 0, F.concat(((F.col("ord") / 11).cast("bigint") * 11 + 1).cast("string"), F.lit("__aug_cls2_1"))).otherwise(F.col("id")))
    rows = builders.rl_rows(recs, TAX, "task", "index")
    return builders.oversample(rows, 2).select("ord", "id", joined(F.col("response")).alias("response"))


def build_rl_rows(spark, sf):
    rows = builders.rl_rows(_sample_records(spark, sf), TAX, " task ", "index", "/data/")
    return rows.select("id", "video_path", "prompt", joined(F.col("response")).alias("response"))


def build_chat_rows(spark, sf):
    rows = builders.chat_rows(_sample_records(spark, sf), TAX, "task", "simple", path_prefix="/data")
    return rows.select("id", F.col("messages")[0]["content"].alias("user"), F.col("messages")[1]["content"].alias("assistant"), F.col("videos")[0].alias("video"), joined(F.col("labels")).alias("labels"))


def _target(style: str):
    return lambda spark, sf: X.samples(spark, sf).select("sid", T.sft_target(F.col("pred"), TAX, style).alias("target"))


def predict_resume(spark, sf):
    inputs = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("video"))
    done = table(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").cast("string").alias("id"))
    return selection.remaining(inputs, done)


def distinct_prompt_check(spark, sf):
    rows = builders.rl_rows(_sample_records(spark, sf), TAX, "task")
    return builders.distinct_prompts(rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "eval_confusion": eval_confusion,
    "eval_per_category": eval_per_category,
    **{k: _summary(*v) for k, v in SUMMARIES.items()},
    "eval_coverage_negative": _coverage("negative"),
    "eval_coverage_exclude": _coverage("exclude"),
    "eval_historical": _coverage("negative", "historical"),
    "eval_status_counts": eval_status_counts,
    "eval_coverage_report": eval_coverage_report,
    "eval_extra_ids": eval_extra_ids,
    "parse_json": parse_json,
    "parse_answer_only": parse_answer_only,
    "parse_simple": parse_simple,
    "parse_format_ok": parse_format_ok,
    "parse_answer": parse_answer,
    "parse_explanation": parse_explanation,
    "parse_status_counts": parse_status_counts,
    "parse_conversations": parse_conversations,
    "prediction_rows": prediction_rows,
    "reward_pairs": reward_pairs,
    "reward_exact": _reward(reward="exact_match"),
    "reward_jaccard": _reward(reward="jaccard"),
    "reward_tversky": _reward(reward="tversky", alpha=0.3, beta=0.7),
    "reward_overall": _reward(reward="jaccard", format_weight=0.25),
    "reward_adaptive_global": _reward(reward="adaptive", mode="global", invalid_prediction_policy="as_empty", **CONTROLLER),
    "reward_adaptive_category": _reward(reward="adaptive", mode="category", invalid_prediction_policy="as_empty", **CONTROLLER),
    "batch_stats_global": batch_stats_global,
    "batch_stats_category": batch_stats_category,
    "batch_classification": batch_classification,
    "controller_global": _states("global"),
    "controller_category": _states("category"),
    "controller_frozen": _states("global", False),
    "validate_repeats": validate_repeats,
    "validate_label_counts": validate_label_counts,
    "validate_cardinality": validate_cardinality,
    "split_overlap": split_overlap,
    "resolve_video": resolve_video,
    "resolve_spellings": resolve_spellings,
    "label_list_codes": label_list_codes,
    "media_filter": media_filter,
    "media_filter_reasons": media_filter_reasons,
    "select_manifest": select_manifest,
    "select_sampled": select_sampled,
    "oversample": oversample,
    "build_rl_rows": build_rl_rows,
    "build_chat_rows": build_chat_rows,
    "sft_target_simple": _target("simple"),
    "sft_target_json": _target("json"),
    "predict_resume": predict_resume,
    "distinct_prompt_check": distinct_prompt_check,
    **file_queries.QUERIES,
    **run_queries.QUERIES,
}
