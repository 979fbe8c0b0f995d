"""Set similarities of predicted and true labels; a null prediction scores 0, two empty sets score 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(over: Column, under: Column, none: float = 0.0) -> Column:
    """A quotient, and ``none`` where the denominator isn't positive."""
    return F.when(under > 0, over.cast("double") / under).otherwise(F.lit(none))


def _scored(pred: Column, true: Column, score: Column) -> Column:
    return F.when(pred.isNull(), F.lit(0.0)).when((F.size(pred) == 0) & (F.size(true) == 0), F.lit(1.0)).otherwise(score)


def exact_match(pred: Column, true: Column) -> Column:
    same = (F.size(F.array_except(pred, true)) == 0) & (F.size(F.array_except(true, pred)) == 0)
    return F.coalesce(same.cast("double"), F.lit(0.0))


def jaccard(pred: Column, true: Column) -> Column:
    return _scored(pred, true, ratio(F.size(F.array_intersect(pred, true)), F.size(F.array_union(pred, true))))


def tversky(pred: Column, true: Column, alpha: Column | float, beta: Column | float) -> Column:
    """TP / (TP + alpha * FP + beta * FN); 1 where that has no denominator."""
    tp = F.size(F.array_intersect(pred, true))
    fp, fn = F.size(F.array_except(pred, true)), F.size(F.array_except(true, pred))
    a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (alpha, beta))
    return _scored(pred, true, ratio(tp, tp + a * fp + b * fn, 1.0))


def category_tversky(pred: Column, true: Column, alphas: Sequence[Column], betas: Sequence[Column]) -> Column:
    """The same over indicator vectors, with weights per category, added up in category order."""
    tp = fp = fn = F.lit(0.0)
    for k, (a, b) in enumerate(zip(alphas, betas, strict=True)):
        p, t = pred[k], true[k]
        tp = tp + (p * t).cast("double")
        fp = fp + a * (p * (1 - t))
        fn = fn + b * ((1 - p) * t)
    none = F.forall(pred, lambda x: x == 0) & F.forall(true, lambda x: x == 0)
    return F.when(pred.isNull(), F.lit(0.0)).when(none, F.lit(1.0)).otherwise(ratio(tp, tp + fp + fn, 1.0))


def overall(accuracy: Column, format_ok: Column, weight: float) -> Column:
    """Accuracy and format mixed, the format having the given weight."""
    if not 0 <= weight <= 1:
        raise ValueError("the format weight lies between 0 and 1")
    fmt = F.coalesce(format_ok.cast("double"), F.lit(0.0))
    return F.lit(1.0 - weight) * accuracy + F.lit(weight) * fmt
