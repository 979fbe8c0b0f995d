"""Reward scoring of responses in batches, with fixed or adaptive Tversky weights.

Input rows: batch_id, response, ground_truth (an array of label spellings).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import similarity
from plumbline.functions.labels import resolve_labels, to_vector
from plumbline.functions.parsing import SCOPES, parse_response
from plumbline.operators import controller as ctl
from plumbline.operators.metrics import batch_classification, sample_counts
from plumbline.sources.shared import written
from plumbline.taxonomy import Taxonomy, compact_sha256, load_taxonomy

KINDS = ("exact_match", "jaccard", "tversky", "adaptive")
TRAINING_FORMATS = ("think_answer", "triple_newline")
GENERAL = frozenset("taxonomy reward response_format parse_scope answer_only format_weight update_controller log_classification_metrics alpha beta controller".split())
STATE_FORMAT = "reward_state/v1"


class RewardError(ValueError):
    """Reward settings that contradict each other or are unknown."""


@dataclass(frozen=True)
class RewardSettings:
    taxonomy: Taxonomy
    kind: str
    response_format: str = "think_answer"
    parse_scope: str = "full_response"
    format_weight: float = 0.1
    alpha: float | None = None
    beta: float | None = None
    controller: ctl.ControllerConfig | None = None
    update_controller: bool = True
    log_classification_metrics: bool = False

    def describe(self) -> dict[str, Any]:
        return {
            "taxonomy": self.taxonomy.name,
            "taxonomy_fingerprint": self.taxonomy.fingerprint(),
            "reward": self.kind,
            "controller": self.controller and self.controller.to_dict(),
            **{k: getattr(self, k) for k in ("response_format", "parse_scope", "format_weight", "alpha", "beta", "update_controller", "log_classification_metrics")},
        }

    def fingerprint(self) -> str:
        return compact_sha256(self.describe())

    @property
    def invalid_policy(self) -> str:
        return self.controller.invalid_prediction_policy if self.controller else "as_empty"


def _flag(name: str, value: Any) -> bool:
    if isinstance(value, str) and value.lower() in ("true", "false"):
        return value.lower() == "true"
    if not isinstance(value, bool):
        raise RewardError(f"{name} must be true or false, not {value!r}")
    return value


def build_settings(given: Mapping[str, Any]) -> RewardSettings:
    """Checked settings; those of the controller stand flat among the others or nested under ``controller``."""
    given = dict(given)
    flat = {k: given[k] for k in given if k in ctl.SETTINGS}
    if odd := sorted(set(given) - GENERAL - ctl.SETTINGS):
        raise RewardError(f"unknown reward settings {odd}")
    if "taxonomy" not in given:
        raise RewardError("a taxonomy is required")
    taxonomy, kind = load_taxonomy(given["taxonomy"]), given.get("reward")
    if kind not in KINDS:
        raise RewardError(f"reward is one of {', '.join(KINDS)}, not {kind!r}")
    fmt = given.get("response_format", "think_answer")
    if fmt not in TRAINING_FORMATS:
        raise RewardError(f"response_format is one of {', '.join(TRAINING_FORMATS)}, not {fmt!r}")
    if {"parse_scope", "answer_only"} <= set(given):
        raise RewardError("parse_scope and answer_only say the same; give one")
    scope = given.get("parse_scope", "full_response")
    if "answer_only" in given:
        scope = "answer_only" if _flag("answer_only", given["answer_only"]) else "full_response"
    if scope not in SCOPES:
        raise RewardError(f"parse_scope is one of {', '.join(SCOPES)}, not {scope!r}")
    weight = float(given.get("format_weight", 0.1))
    if not 0 <= weight <= 1:
        raise RewardError("format_weight lies between 0 and 1")
    alpha, beta = given.get("alpha"), given.get("beta")
    if kind == "tversky":
        alpha, beta = (1.0 if x is None else float(x) for x in (alpha, beta))
        if min(alpha, beta) < 0:
            raise RewardError("alpha and beta aren't negative")
    elif alpha is not None or beta is not None:
        raise RewardError("alpha and beta belong to reward 'tversky'")
    nested, config = given.get("controller"), None
    if kind == "adaptive":
        if nested is not None and flat:
            raise RewardError("controller settings stand flat or nested, not both")
        settings = dict(nested) if nested is not None else flat
        if "mode" not in settings:
            raise RewardError("reward 'adaptive' needs a controller mode")
        try:
            config = ctl.resolve_config(settings, taxonomy.ids)
        except ctl.ControllerError as e:
            raise RewardError(f"controller settings: {e}") from e
    elif nested is not None or flat:
        raise RewardError("controller settings belong to reward 'adaptive'")
    return RewardSettings(
        taxonomy, kind, fmt, scope, weight, alpha, beta, config,
        _flag("update_controller", given.get("update_controller", True)),
        _flag("log_classification_metrics", given.get("log_classification_metrics", False)),
    )


def read_responses(rows: DataFrame, settings: RewardSettings) -> DataFrame:
    """The rows with pred (null: unreadable), gt and format_ok. A null or unknown ground truth is an error."""
    fault = F.raise_error(F.lit("a row has no ground truth")).cast("array<string>")
    truth = F.coalesce(F.col("ground_truth").cast("array<string>"), fault)
    parsed = parse_response(F.col("response"), settings.taxonomy, settings.response_format, "json", settings.parse_scope)
    return rows.withColumn("gt", resolve_labels(truth, settings.taxonomy)).withColumn("p", parsed).select("*", F.col("p.labels").alias("pred"), F.col("p.format_ok").alias("format_ok")).drop("p")


def batch_statistics(read: DataFrame, settings: RewardSettings, by: str = "batch_id") -> DataFrame:
    """invalid_rate, counted_samples, mean tp, fp and fn of each batch, in all and by category, and the FN/FP ratio."""
    ids, eps = settings.taxonomy.ids, settings.controller.epsilon if settings.controller else 1e-8
    counts = F.lit(settings.invalid_policy == "as_empty") | F.col("pred").isNotNull()
    empty = F.array().cast("array<string>")
    counted = sample_counts(read.select(by, "gt", F.coalesce("pred", empty).alias("pred"), F.col("pred").isNull().alias("unread"), counts.alias("in")), settings.taxonomy)
    mean = lambda c: F.avg(F.when(F.col("in"), F.col(c)))
    out = counted.groupBy(by).agg(
        F.avg(F.col("unread").cast("int")).alias("invalid_rate"),
        F.count_if("in").cast("double").alias("counted_samples"),
        *(mean(x).alias(f"batch_{x}") for x in ("tp", "fp", "fn")),
        *(mean(f"{x}_{k}").alias(f"batch_{x}_{i}") for k, i in enumerate(ids) for x in ("fp", "fn")),
    )
    return out.withColumn("batch_fn_fp_ratio", (F.col("batch_fn") + eps) / (F.col("batch_fp") + eps))


def batch_metrics(read: DataFrame, settings: RewardSettings, by: str = "batch_id") -> DataFrame:
    """Precision, recall and F1 of each batch's counted samples."""
    kept = read if settings.invalid_policy == "as_empty" else read.where(F.col("pred").isNotNull())
    counted = sample_counts(kept.select(by, "gt", F.coalesce("pred", F.array().cast("array<string>")).alias("pred")), settings.taxonomy)
    return batch_classification(counted, settings.taxonomy, [by])


def controller_states(statistics: DataFrame, settings: RewardSettings, state: ctl.State | None = None) -> DataFrame:
    """Controller states before and after each batch."""
    return ctl.fold_batches(controller_rates(statistics, settings), settings.controller, settings.update_controller, state)


def controller_rates(statistics: DataFrame, settings: RewardSettings) -> DataFrame:
    """batch_id, counted, and the rates that the controller goes by."""
    names = ("",) if settings.controller.mode == "global" else tuple(f"_{i}" for i in settings.taxonomy.ids)
    rates = (F.array(*(F.coalesce(F.col(f"batch_{x}{n}"), F.lit(0.0)) for n in names)).alias(x) for x in ("fp", "fn"))
    return statistics.select("batch_id", F.col("counted_samples").alias("counted"), *rates)


def score(rows: DataFrame, settings: RewardSettings, state: ctl.State | None = None, diagnostics: bool = True) -> DataFrame:
    """The rows with overall, format and accuracy, and the diagnostics of their batch.

    Adaptive weights are those that earlier batches left; a batch never sees its own statistics.
    """
    read = read_responses(rows, settings)
    if diagnostics or settings.kind == "adaptive":  # statistics and scores come from one reading
        read = written(read, rows.sparkSession)
    return score_read(read, settings, state, diagnostics)


def score_read(read: DataFrame, settings: RewardSettings, state: ctl.State | None = None, diagnostics: bool = True, states: DataFrame | None = None) -> DataFrame:
    """``score`` of rows that ``read_responses`` has read, and that are kept somewhere, as they are read more than once. States (batch_id, before and
    after) that are known already aren't folded anew."""
    pred, true, tax = F.col("pred"), F.col("gt"), settings.taxonomy
    statistics = batch_statistics(read, settings) if diagnostics or settings.kind == "adaptive" and states is None else None
    if settings.kind == "exact_match":
        accuracy = similarity.exact_match(pred, true)
    elif settings.kind == "jaccard":
        accuracy = similarity.jaccard(pred, true)
    elif settings.kind == "tversky":
        accuracy = similarity.tversky(pred, true, settings.alpha, settings.beta)
    else:
        states = (controller_states(statistics, settings, state) if states is None else states).withColumnRenamed("batch_id", "of_batch")
        read = read.join(states, F.col("batch_id") == F.col("of_batch"))
        a, b = F.col("before.alpha"), F.col("before.beta")
        if settings.controller.mode == "global":
            accuracy = similarity.tversky(pred, true, a[0], b[0])
        else:
            k = range(len(tax))
            accuracy = similarity.category_tversky(F.when(pred.isNotNull(), to_vector(pred, tax)), to_vector(true, tax), [a[i] for i in k], [b[i] for i in k])
    scored = read.withColumn("accuracy", accuracy)
    scored = scored.withColumn("format", F.coalesce(F.col("format_ok").cast("double"), F.lit(0.0)))
    scored = scored.withColumn("overall", similarity.overall(F.col("accuracy"), F.col("format_ok"), settings.format_weight))
    if settings.kind == "adaptive":
        scored = scored.select(*(c for c in scored.columns if c not in ("of_batch", "before", "after")), *_controller_columns(settings))
    if diagnostics:
        scored = scored.join(statistics, "batch_id")
        if settings.log_classification_metrics:
            scored = scored.join(batch_metrics(read, settings), "batch_id", "left")
    return scored


def _controller_columns(settings: RewardSettings) -> list:
    """``coef_`` columns are those of before the batch, ``ctrl_`` ones those of after it."""
    config = settings.controller
    names = [""] if config.mode == "global" else [f"_{i}" for i in settings.taxonomy.ids]
    before, after, eps = F.col("before"), F.col("after"), config.epsilon
    out = [(after["updates"] > before["updates"]).cast("double").alias("ctrl_updated"), after["updates"].cast("double").alias("ctrl_updates")]
    for k, n in enumerate(names):
        out += [
            before["alpha"][k].alias(f"coef_alpha{n}"),
            before["beta"][k].alias(f"coef_beta{n}"),
            F.lit(config.target_ratio[k]).alias(f"ctrl_target_ratio{n}"),
            after["fp"][k].alias(f"ctrl_fp_ema{n}"),
            after["fn"][k].alias(f"ctrl_fn_ema{n}"),
            ((after["fn"][k] + eps) / (after["fp"][k] + eps)).alias(f"ctrl_ema_ratio{n}"),
            after["u"][k].alias(f"ctrl_logit_u{n}"),
        ]
    return out


class RewardSession:
    """A configured reward that is called batch by batch and keeps its controller between calls."""

    def __init__(self) -> None:
        self.settings: RewardSettings | None = None
        self.given: dict[str, Any] | None = None
        self.pending: Mapping[str, Any] | None = None
        self.controller: ctl.Controller | None = None
        self.batches_scored = 0

    def configure(self, **given: Any) -> RewardSettings:
        """Settings once and for all; the same ones again change nothing, others are an error."""
        if self.settings is not None:
            if given != self.given:
                raise RewardError("the session is configured with other settings")
            return self.settings
        self.settings, self.given = build_settings(given), dict(given)
        if self.settings.controller:
            self.controller = ctl.Controller(self.settings.controller)
        if self.pending is not None:
            self.set_state(self.pending)
            self.pending = None
        return self.settings

    @property
    def is_stateful(self) -> bool:
        return self.controller is not None

    def describe(self) -> dict[str, Any]:
        return self.settings.describe() if self.settings else {}

    def score_batch(self, rows: DataFrame) -> DataFrame:
        """Scores of one batch under the present weights; then one update from the batch's statistics."""
        if self.settings is None:
            raise RewardError("configure the session first")
        one = rows.withColumn("batch_id", F.lit(self.batches_scored).cast("bigint"))
        read = written(read_responses(one, self.settings), rows.sparkSession)
        scored = score_read(read, self.settings, self.controller.state if self.controller else None)
        if self.controller:
            statistics = batch_statistics(read, self.settings).first()
            if statistics and statistics.counted_samples and self.settings.update_controller:
                names = ("",) if self.settings.controller.mode == "global" else tuple(f"_{i}" for i in self.settings.taxonomy.ids)
                self.controller.update(*([statistics[f"batch_{x}{n}"] for n in names] for x in ("fp", "fn")))
        self.batches_scored += 1
        return scored

    def get_state(self) -> dict[str, Any]:
        if self.settings is None:
            raise RewardError("configure the session first")
        return {
            "format": STATE_FORMAT,
            "reward": self.settings.kind,
            "taxonomy": self.settings.taxonomy.name,
            "taxonomy_fingerprint": self.settings.taxonomy.fingerprint(),
            "settings": self.settings.describe(),
            "settings_fingerprint": self.settings.fingerprint(),
            "batches_scored": self.batches_scored,
            "controller": self.controller and self.controller.state_dict(),
        }

    def set_state(self, saved: Mapping[str, Any], allow_config_change: bool = False) -> None:
        if self.settings is None:
            self.pending = saved
            return
        for key, mine in (("format", STATE_FORMAT), ("reward", self.settings.kind), ("taxonomy_fingerprint", self.settings.taxonomy.fingerprint())):
            if saved.get(key) != mine:
                raise ctl.ControllerError(f"saved {key} {saved.get(key)!r} is not {mine!r}")
        if (saved.get("controller") is None) != (self.controller is None):
            raise ctl.ControllerError("the saved state and this reward don't both have a controller")
        if self.controller:
            self.controller.load_state_dict(saved["controller"], allow_config_change)
        self.batches_scored = int(saved.get("batches_scored", 0))
