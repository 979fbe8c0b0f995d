"""Predictions against ground truth: the join, status rules, coverage policies, and the report.

``truth`` has id and labels (ids in category order) and optionally ord, its row order; ``predictions`` has id, status,
labels and optionally historical_labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.labels import resolve_labels
from plumbline.operators import metrics
from plumbline.taxonomy import Taxonomy

POLICIES = ("negative", "exclude", "error")
ID_KINDS = ("missing", "invalid", "partial", "extra_prediction")
#: A prediction beside its sample, as one column.
MADE = "__prediction"


class EvaluationError(ValueError):
    """Predictions and ground truth can't be scored as asked."""


def repeated(df: DataFrame, key: str = "id") -> DataFrame:
    """Keys of more than one row, with their counts."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, what: str, key: str = "id") -> None:
    if found := [r[0] for r in repeated(df, key).orderBy(key).limit(5).collect()]:
        raise EvaluationError(f"duplicate {what} {key}s, e.g. {found}")


def ground_truth(records: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """id and labels in category order; null labels are none."""
    labels = F.coalesce(F.col("labels"), F.array().cast("array<string>"))
    rest = [c for c in records.columns if c not in ("id", "labels")]
    return records.select(F.col("id").cast("string").alias("id"), resolve_labels(labels, taxonomy).alias("labels"), *rest)


def join_predictions(truth: DataFrame, predictions: DataFrame, label_source: str = "labels") -> DataFrame:
    """truth LEFT JOIN predictions: id, gt, pred (null: nothing to score), status, and truth's columns of other names."""
    if label_source not in ("labels", "historical"):
        raise EvaluationError("label_source is 'labels' or 'historical'")
    made = predictions.select(
        F.struct(
            F.col("id").cast("string").alias("id"),
            F.coalesce("status", F.lit("ok")).alias("status"),
            F.col("labels").alias("labels"),
            (F.col("historical_labels") if label_source == "historical" else F.lit(None).cast("array<string>")).alias("history"),
        ).alias(MADE)
    )
    joined = truth.join(made, truth.id == F.col(f"{MADE}.id"), "left")
    of = lambda name: F.col(f"{MADE}.{name}")
    parsed = of("status").isin("ok", "partial")
    pred = F.when(parsed, of("labels"))
    if label_source == "historical":
        fault = F.raise_error(F.concat(F.lit("no historical labels in prediction "), of("id"))).cast("array<string>")
        pred = F.when(parsed | (of("status") == "parse_error"), F.coalesce(of("history"), fault))
    status = F.when(F.col(MADE).isNull(), "missing").when((of("status") == "ok") & pred.isNull(), "invalid").otherwise(of("status"))
    rest = [truth[c] for c in truth.columns if c not in ("id", "labels", "gt", "pred", "status")]
    return joined.select(truth.id, truth.labels.alias("gt"), pred.alias("pred"), status.alias("status"), *rest)


def extra_predictions(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Ids that only predictions have."""
    ids = predictions.select(F.col("id").cast("string").alias("id")).distinct()
    return ids.join(truth.select("id"), "id", "left_anti")


def apply_policies(samples: DataFrame, invalid: str, missing: str = "error") -> DataFrame:
    """The samples to score: where pred is null, an empty prediction or no row at all.

    The 'error' policies are checked by ``check_policies``, which is an action of its own.
    """
    for policy in (invalid, missing):
        if policy not in POLICIES:
            raise EvaluationError(f"a policy is one of {', '.join(POLICIES)}, not {policy!r}")
    policy = F.when(F.col("status") == "missing", F.lit(missing)).otherwise(F.lit(invalid))
    kept = samples.where(F.col("pred").isNotNull() | (policy != "exclude"))
    return kept.withColumn("pred", F.coalesce("pred", F.array().cast("array<string>")))


def check_policies(samples: DataFrame, invalid: str, missing: str) -> None:
    """The 'error' policies: both are counted in one pass."""
    lacking, absent = F.col("pred").isNull(), F.col("status") == "missing"
    kinds = ((missing, "samples have no prediction", lacking & absent), (invalid, "predictions are invalid", lacking & ~absent))
    asked = [(what, rows) for policy, what, rows in kinds if policy == "error"]
    counts = samples.agg(*(F.count_if(rows) for _, rows in asked)).first() if asked else ()
    for (what, rows), n in zip(asked, counts):
        if n:
            raise EvaluationError(f"{n} {what}, e.g. {[r.id for r in samples.where(rows).orderBy('id').limit(5).collect()]}; choose negative or exclude")


def coverage(samples: DataFrame) -> DataFrame:
    """One row: samples, and how many are missing, invalid, partial, or scored although they couldn't be parsed."""
    none, status = F.col("pred").isNull(), F.col("status")
    counts = {
        "ground_truth_samples": F.lit(True),
        "missing": status == "missing",
        "invalid": none & (status != "missing"),
        "partial": status == "partial",
        "parse_errors_scored": ~none & (status == "parse_error"),
    }
    return samples.agg(*(F.count_if(c).alias(k) for k, c in counts.items()))


def coverage_ids(samples: DataFrame, truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """kind, place (the order of ord where there is one, else of ids) and id of what is missing, invalid, partial or extra."""
    none, place = F.col("pred").isNull(), F.col("ord") if "ord" in samples.columns else F.lit(None)
    kinds = {"missing": F.col("status") == "missing", "invalid": none & (F.col("status") != "missing"), "partial": F.col("status") == "partial"}
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items())))
    own = samples.select(F.explode(found).alias("kind"), place.cast("bigint").alias("place"), "id")
    return own.unionByName(extra_predictions(truth, predictions).select(F.lit("extra_prediction").alias("kind"), F.lit(None).cast("bigint").alias("place"), "id"))


def _firsts(ids: DataFrame, n: int) -> DataFrame:
    order = W.partitionBy("kind").orderBy("place", "id")
    first = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return first.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))


def evaluate(truth: DataFrame, predictions: DataFrame, taxonomy: Taxonomy, invalid_policy: str, missing_policy: str = "error", label_source: str = "labels", listed: int = 10_000) -> dict:
    """Everything as one document: metrics, per-category metrics, coverage, and the first ``listed`` ids of each kind that
    ``coverage_ids`` has in full."""
    require_unique(truth, "ground-truth")
    require_unique(predictions, "prediction")
    samples = join_predictions(truth, predictions, label_source).persist()
    try:
        check_policies(samples, invalid_policy, missing_policy)
        scored = apply_policies(samples, invalid_policy, missing_policy)
        found = metrics.summary(scored, taxonomy).first().asDict()
        if not found["num_samples"]:
            raise EvaluationError("no samples are left to evaluate")
        ids = coverage_ids(samples, truth, predictions)
        firsts = {r.kind: list(r.ids) for r in _firsts(ids, listed).collect()}
        found["per_category"] = {r.category: {k: v for k, v in r.asDict().items() if k not in ("pos", "category")} for r in metrics.per_category(scored, taxonomy).collect()}
        cover = coverage(samples).first().asDict() | {
            "scored_samples": found["num_samples"],
            "status_counts": {r.status: r["count"] for r in samples.groupBy("status").count().collect()},
            "invalid_policy": invalid_policy,
            "missing_policy": missing_policy,
            **{f"{kind}_ids": firsts.get(kind, []) for kind in ID_KINDS},
        }
    finally:
        samples.unpersist()
    return {"taxonomy": taxonomy.name, "metrics": found, "coverage": cover}


def summary_text(result: dict, taxonomy: Taxonomy) -> str:
    """The main metrics as percentages, for people."""
    m, c = result["metrics"], result["coverage"]
    pc = lambda *names: "/".join(f"{100 * m[n]:.2f}" for n in names)
    lines = [
        f"Scored {c['scored_samples']} of {c['ground_truth_samples']} samples (invalid {c['invalid']}: {c['invalid_policy']}, missing {c['missing']}: {c['missing_policy']}, partial {c['partial']})",
        f"Jaccard {pc('jaccard_similarity')}, exact match {pc('exact_match_ratio')}, micro P/R/F1 {pc('micro_precision', 'micro_recall', 'micro_f1')}, macro F1 {pc('macro_f1')}",
        f"Binary accuracy/P/R/F1 {pc('binary_accuracy', 'binary_precision', 'binary_recall', 'binary_f1')}, false refusal {pc('false_refusal_rate')}, leakage {pc('violation_leakage_rate')}",
    ]
    for i in taxonomy.ids:
        x = m["per_category"][i]
        lines.append(f"  {i} {taxonomy.category(i).name}: {100 * x['precision']:.2f}/{100 * x['recall']:.2f}/{100 * x['f1_score']:.2f} ({x['n_positive_gt']})")
    return "\n".join(lines)
