"""Multi-label classification metrics.

One aggregation over the scored samples gives all integer counts; everything else is arithmetic on that one row. Means
of ratios are sums over the distinct pairs of set sizes, so they don't depend on the order of partitions.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.similarity import ratio
from plumbline.taxonomy import Taxonomy

PER_CATEGORY = ("accuracy", "precision", "recall", "f1_score", "specificity", "false_positive_rate", "balanced_accuracy")


def _total(columns: list[Column]) -> Column:
    return reduce(add, columns)


def _div(a: Column | int, b: Column | int) -> Column:
    return ratio(a if isinstance(a, Column) else F.lit(a), b if isinstance(b, Column) else F.lit(b))


def _mean(columns: list[Column]) -> Column:
    return _total(columns) / F.lit(float(len(columns)))


def sample_counts(samples: DataFrame, taxonomy: Taxonomy, truth: str = "gt", pred: str = "pred") -> DataFrame:
    """Per sample: whether each category is tp, fp or fn, and their numbers; truth and pred are arrays of ids."""
    flags = []
    for k, i in enumerate(taxonomy.ids):
        t, p = F.array_contains(truth, i), F.array_contains(pred, i)
        flags += [(t & p).cast("int").alias(f"tp_{k}"), (~t & p).cast("int").alias(f"fp_{k}"), (t & ~p).cast("int").alias(f"fn_{k}")]
    wide = samples.select("*", *flags)
    n = range(len(taxonomy))
    return wide.select("*", *(_total([F.col(f"{x}_{k}") for k in n]).alias(x) for x in ("tp", "fp", "fn")))


def confusion(counted: DataFrame, weight: str | None = None) -> list[Column]:
    """Aggregates of ``sample_counts`` rows: n, tp, fp, fn, per-category counts, and exact and binary counts.

    With ``weight`` the rows stand for that many samples each, and hold sums of their categories' flags.
    """
    columns = [c for c in counted.columns if c[:3] in ("tp_", "fp_", "fn_") and c[3:].isdigit()]
    unsafe, flagged = (F.col("tp") + F.col("fn")) > 0, (F.col("tp") + F.col("fp")) > 0
    each = F.col(weight) if weight else F.lit(1)
    one = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0).cast("bigint"))
    of = lambda c: one(F.when(c, each))
    return [
        one(each).alias("n"),
        *(one(F.col(c)).alias(c) for c in columns),
        *(one(F.col(c) * each).alias(c) for c in ("tp", "fp", "fn")),
        of((F.col("fp") + F.col("fn")) == 0).alias("n_exact"),
        of(unsafe).alias("n_unsafe"),
        of(unsafe & flagged).alias("n_binary_tp"),
        of(~unsafe & flagged).alias("n_false_refusal"),
        of(unsafe & ~flagged).alias("n_missed_violation"),
    ]


RATIOS = ("jaccard_similarity", "sample_precision", "sample_recall", "sample_f1")


def _ratio_sums() -> Column:
    """Rows of (tp, fp, fn, c) with the ratios of such a sample times c, in order: the same sum for any partitions."""
    tp, fp, fn, c = (F.col(x) for x in ("tp", "fp", "fn", "c"))
    values = (F.when(tp + fp + fn == 0, 1.0).otherwise(_div(tp, tp + fp + fn)), _div(tp, tp + fp), _div(tp, tp + fn), _div(2 * tp, 2 * tp + fp + fn))
    return F.array_sort(F.collect_list(F.struct("tp", "fp", "fn", "c", *((v * c).alias(k) for k, v in zip(RATIOS, values)))))


def category_metrics(row: DataFrame, taxonomy: Taxonomy) -> dict[str, list[Column]]:
    """Per-category counts and ratios as columns over the one row of ``confusion``."""
    out: dict[str, list[Column]] = {m: [] for m in ("tp", "fp", "fn", "tn", "n_positive_gt", "n_positive_pred", *PER_CATEGORY)}
    n = F.col("n")
    for k in range(len(taxonomy)):
        tp, fp, fn = (F.col(f"{x}_{k}") for x in ("tp", "fp", "fn"))
        tn = n - tp - fp - fn
        recall, specificity = _div(tp, tp + fn), _div(tn, tn + fp)
        values = (tp, fp, fn, tn, tp + fn, tp + fp, _div(tp + tn, n), _div(tp, tp + fp), recall, _div(2 * tp, 2 * tp + fp + fn), specificity, _div(fp, fp + tn), (recall + specificity) / 2)
        for m, v in zip(out, values):
            out[m].append(v)
    return out


def per_category(samples: DataFrame, taxonomy: Taxonomy, truth: str = "gt", pred: str = "pred") -> DataFrame:
    """One row for each category, in order: pos, id, counts and ratios."""
    counted = sample_counts(samples, taxonomy, truth, pred)
    row = counted.agg(*confusion(counted))
    found = category_metrics(row, taxonomy)
    structs = [F.struct(F.lit(k).alias("pos"), F.lit(i).alias("category"), *(found[m][k].alias(m) for m in found)) for k, i in enumerate(taxonomy.ids)]
    return row.select(F.inline(F.array(*structs)))


def summary(samples: DataFrame, taxonomy: Taxonomy, truth: str = "gt", pred: str = "pred", only: Sequence[str] | None = None) -> DataFrame:
    """One row with every metric that isn't per category, or those of ``only``, which are then all that is built."""
    counted = sample_counts(samples, taxonomy, truth, pred)
    flags = [c for c in counted.columns if c[:3] in ("tp_", "fp_", "fn_") and c[3:].isdigit()]
    # one pass over the samples: at most one group for each (tp, fp, fn), and the rest works on those
    groups = counted.groupBy("tp", "fp", "fn").agg(F.count("*").alias("c"), *(F.sum(f).alias(f) for f in flags))
    row = groups.agg(*confusion(groups, "c"), _ratio_sums().alias("rs"))
    by = functools.cache(lambda: category_metrics(row, taxonomy))
    n, tp, fp, fn, k = F.col("n"), F.col("tp"), F.col("fp"), F.col("fn"), len(taxonomy)
    unsafe, btp, bfp, bfn = (F.col(c) for c in ("n_unsafe", "n_binary_tp", "n_false_refusal", "n_missed_violation"))

    def weighted(m: str) -> Column:
        support = by()["n_positive_gt"]
        return F.when(_total(support) > 0, _total([_div(s, _total(support)) * v for s, v in zip(support, by()[m])])).otherwise(0.0)

    def mean_ratio(name: str) -> Column:
        return _div(F.aggregate(F.transform("rs", lambda r: r.getField(name)), F.lit(0.0), add), n)

    columns: dict[str, Callable[[], Column]] = {
        "num_samples": lambda: n,
        "exact_match_ratio": lambda: _div(F.col("n_exact"), n),
        "hamming_accuracy": lambda: 1 - _div(fp + fn, n * k),
        "micro_accuracy": lambda: _div(n * k - fp - fn, n * k),
        **{f"macro_{m.removesuffix('_score')}": functools.partial(lambda m: _mean(by()[m]), m) for m in PER_CATEGORY},
        "micro_precision": lambda: _div(tp, tp + fp),
        "micro_recall": lambda: _div(tp, tp + fn),
        "micro_f1": lambda: _div(2 * tp, 2 * tp + fp + fn),
        **{f"weighted_{m.removesuffix('_score')}": functools.partial(weighted, m) for m in ("precision", "recall", "f1_score")},
        "binary_accuracy": lambda: _div(n - bfp - bfn, n),
        "binary_precision": lambda: _div(btp, btp + bfp),
        "binary_recall": lambda: _div(btp, btp + bfn),
        "binary_f1": lambda: _div(2 * btp, 2 * btp + bfp + bfn),
        "false_refusal_rate": lambda: _div(bfp, n - unsafe),
        "violation_leakage_rate": lambda: _div(bfn, unsafe),
        "n_benign": lambda: n - unsafe,
        "n_unsafe": lambda: unsafe,
        "n_false_refusal": lambda: bfp,
        "n_missed_violation": lambda: bfn,
        **{name: functools.partial(mean_ratio, name) for name in RATIOS},
    }
    return row.select(*(columns[name]().alias(name) for name in only or columns))


def batch_classification(counted: DataFrame, taxonomy: Taxonomy, by: list[str]) -> DataFrame:
    """The metrics that batches log. Their F1 is 2PR / (P + R), which rounds unlike the one from counts."""
    row = counted.groupBy(*by).agg(*confusion(counted))
    f1 = lambda p, r: _div(2 * p * r, p + r)
    out, ps, rs, fs = [], [], [], []
    for k, i in enumerate(taxonomy.ids):
        tp, fp, fn = (F.col(f"{x}_{k}") for x in ("tp", "fp", "fn"))
        p, r = _div(tp, tp + fp), _div(tp, tp + fn)
        ps, rs, fs = [*ps, p], [*rs, r], [*fs, f1(p, r)]
        out += [p.alias(f"{i}_precision"), r.alias(f"{i}_recall"), f1(p, r).alias(f"{i}_f1"), (tp + fn).cast("double").alias(f"{i}_support")]
    out += [_mean(x).alias(f"macro_{m}") for x, m in ((ps, "precision"), (rs, "recall"), (fs, "f1"))]
    p, r = _div(F.col("tp"), F.col("tp") + F.col("fp")), _div(F.col("tp"), F.col("tp") + F.col("fn"))
    out += [p.alias("micro_precision"), r.alias("micro_recall"), f1(p, r).alias("micro_f1")]
    return row.select(*by, *out)
