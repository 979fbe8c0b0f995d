"""Quality classifier by positive-unlabelled learning.

A linear score over text features minimises the non-negative unbiased risk

    prior * E_P[loss(g, +)] + max(0, E_U[loss(g, -)] - prior * E_P[loss(g, -)])

from trusted positives P, unlabelled web text U and an estimated class prior. Rows labelled bad are never looked at. Where the
estimate of the negative part falls below zero, the step ascends on it instead, which stops the fit from explaining positives
away. The loss is the logistic one, so the score estimates the probability of good text; its ridge shrinks as positives grow.

The prior is estimated from P and U alone: a first fit on one half of both ranks the other half, and the least ratio of what
U and P have above a threshold, with a margin for chance, bounds the share of U that can be like P (best bin estimation).

Features see the text alone: the make-up of its characters, words and lines (symbols, capitals, digits, repeats,
duplicate lines, ...), each cut at quantiles of U and evenly over its range, which lets a linear score bend.

P is about ``sample`` labelled rows at most, chosen by a hash of the id, and of the features where ids repeat. U is every training row: features are computed once over whole
texts and written; each step of the fit is one pass over them that adds up risks, gradients and curvature by task, so what
comes to the driver doesn't grow with U.

Null and empty texts have the features of a text without words and get a score like any other. Labels of null
value, or of rows that aren't there, teach nothing; with fewer than FEWEST positives, every row scores one half. A row that is
labelled twice counts once, with its larger label. Extra columns don't matter.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import about, remainder, utf8, written

LETTERS = bytes(range(97, 123)) + bytes(range(65, 91)) + bytes(range(128, 256))
DIGITS, UPPER, SPACES = b"0123456789", bytes(range(65, 91)), b" \t\n\r\x0b\f"
COMMON = b".,;:'\"-()"
ODD = bytes(c for c in range(33, 127) if c not in LETTERS + DIGITS + COMMON)
ENDS = re.compile(rb"[.!?]\s")
FEATURES = (
    "words", "word_length", "letters", "digits", "upper", "odd", "common", "distinct", "repeated", "top_word",
    "line_words", "same_lines", "ends", "capital_words", "odd_words", "shouted", "long_words", "short_words", "pairs", "high_bytes",
)
BINS = 8
#: Positives that a fit needs at least; ridge of the weights times their number; lengths of a step that are tried.
FEWEST, RIDGE, LENGTHS = 20, 2.0, np.array([1.0, 0.5, 0.2, 0.05])
#: Tasks that add up the sums of all others, so that many tasks send no more to the driver than these few.
ADDERS = 16


def features(text: str | None) -> np.ndarray:
    """What FEATURES names, in that order; a text without words has zeros."""
    raw = utf8(text)
    out = np.zeros(len(FEATURES))
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return out
    drop = lambda kind: (size - len(raw.translate(None, kind))) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = raw.split(b"\n")
    line_counts = Counter(lines)
    same = sum(c for line, c in line_counts.items() if c > 1 and line.strip())
    odd_words = sum(c for w, c in counts.items() if not w.translate(None, LETTERS + DIGITS + COMMON) == b"")
    capital = sum(c for w, c in counts.items() if w[:1].isupper())
    shouted = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    pairs = len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0
    out[:] = (
        np.log1p(n), lengths.mean(), drop(LETTERS), drop(DIGITS), drop(UPPER), drop(ODD), drop(COMMON), len(counts) / n ** 0.8,
        sum(map(bytes.__eq__, words, words[1:])) / n, max(counts.values()) / n, n / len(lines), same / len(lines), len(ENDS.findall(raw)) / n,
        capital / n, odd_words / n, shouted / n, (lengths > 12).mean(), (lengths < 4).mean(), pairs, drop(bytes(range(128, 256))),
    )
    return out


@dataclass
class Model:
    """Cuts of every feature, weights of the bins between them, and the offset."""

    cuts: np.ndarray
    weights: np.ndarray
    offset: float

    def design(self, x: np.ndarray) -> np.ndarray:
        """How far each value has come through each bin, from 0 to 1: piecewise linear in the feature."""
        low, high = self.cuts[None, :, :-1], self.cuts[None, :, 1:]
        return np.clip((x[:, :, None] - low) / np.maximum(high - low, 1e-9), 0, 1).reshape(len(x), -1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights + self.offset

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Sums:
    """What one pass over unlabelled rows adds up at some weights: rows, losses as negatives, gradients and curvature."""

    rows: int
    losses: np.ndarray
    gradients: np.ndarray
    curvature: np.ndarray

    @classmethod
    def of(cls, u: np.ndarray, points: np.ndarray) -> Sums:
        g = u @ points.T
        share = _sigmoid(g)
        bend = share * (1 - share)
        curvature = np.stack([(u * bend[:, [k]]).T @ u for k in range(len(points))])
        return cls(len(u), np.logaddexp(0, g).sum(0), share.T @ u, curvature)

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.rows + other.rows, self.losses + other.losses, self.gradients + other.gradients, self.curvature + other.curvature)


def nn_risk(p: np.ndarray, sums: Sums, prior: float, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive and negative part of the unbiased risk at each point; the risk is the first plus the second where that isn't below 0."""
    g = p @ points.T
    return prior * np.logaddexp(0, -g).mean(0), sums.losses / sums.rows - prior * np.logaddexp(0, g).mean(0)


def risk_gradient(p: np.ndarray, sums: Sums, prior: float, points: np.ndarray, k: int) -> np.ndarray:
    """Direction to descend against at point k: the gradient of the unbiased risk, or that of the negative part turned round
    where this part is below zero."""
    share = _sigmoid(p @ points[k])
    of_negative = sums.gradients[k] / sums.rows - prior * (share @ p) / len(p)
    if nn_risk(p, sums, prior, points)[1][k] < 0:
        return -of_negative
    return of_negative - prior * ((1 - share) @ p) / len(p)


def fit_nnpu(p: np.ndarray, over: Callable[[np.ndarray], Sums], prior: float, ridge: float, steps: int = 12) -> np.ndarray:
    """Weights, the offset last, of least non-negative unbiased risk, by damped Newton steps.

    ``over`` gives the sums of the unlabelled rows at some points: one call a step, which tries several lengths of it.
    """
    pull = np.full(p.shape[1], ridge)
    pull[-1] = 0
    points, best = np.zeros((1, p.shape[1])), np.inf
    weights = points[0]
    for _ in range(steps):
        sums = over(points)
        positive, negative = nn_risk(p, sums, prior, points)
        risks = positive + np.maximum(0, negative) + 0.5 * (pull * points**2).sum(1)
        k = int(np.argmin(risks))
        if not risks[k] < best - 1e-7:
            break
        best, weights = risks[k], points[k]
        downhill = np.linalg.solve(sums.curvature[k] / sums.rows + np.diag(pull + 1e-9), risk_gradient(p, sums, prior, points, k) + pull * weights)
        points = weights - np.outer(LENGTHS, downhill)
    return weights


def estimate_prior(p: np.ndarray, above: Callable[[np.ndarray], tuple[int, np.ndarray]], doubt: float = 0.1) -> float:
    """Upper bound of the share of positives in U by the best bin: p are scores of positives, ``above`` counts unlabelled rows,
    and those of them at or above some thresholds."""
    cuts = np.quantile(p, np.linspace(0, 0.95, 200))
    rows, counts = above(cuts)
    margin = sum(np.sqrt(np.log(4 / doubt) / 2 / n) for n in (rows, len(p)))
    of_p, of_u = (p >= cuts[:, None]).mean(1), counts / rows
    k = int(np.argmin((of_u + margin) / of_p))
    return float(np.clip(of_u[k] / of_p[k], 0.02, 0.98))


def feature_table(docs: DataFrame, spark: SparkSession, text: str = "text") -> DataFrame:
    """doc_id and the features x of every row, written once."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([features(t.as_py()) for t in b.column(1)]).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(range(0, len(found) + 1, len(FEATURES)), pa.int32()), pa.array(found))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "x"])

    return written(docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, x array<double>"), spark)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _reduced(rows: DataFrame, map_: Callable[[np.ndarray], tuple]) -> list:
    """What ``map_`` makes of every batch's features, added up within tasks, then by ADDERS tasks, and then here; None where there are no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                found = map_(_matrix(b.column(0).slice(at, 4096)))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0):
                part = pickle.loads(x.as_py())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["sums"])

    added = rows.select("x").mapInArrow(run, "sums binary").repartition(ADDERS).mapInArrow(add, "sums binary")
    parts = [pickle.loads(r.sums) for r in added.collect()]
    return functools.reduce(lambda a, b: a + b, parts) if parts else None


def learn(docs: DataFrame, labels: DataFrame, spark: SparkSession, train, label: str = "quality", sample: int = 20_000) -> Model:
    """A model from at most ``sample`` positive rows that ``train`` admits, and all rows that it admits as unlabelled ones."""
    return learn_from(feature_table(docs.where(train), spark), labels, spark, train, label, sample)


def learn_from(table: DataFrame, labels: DataFrame, spark: SparkSession, train, label: str = "quality", sample: int = 20_000) -> Model:
    """``learn`` over a table of features."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max(label).alias("y")).where("y = 1")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("of"))
    web = table.where(train)
    # ids that many rows share are rows of their own
    p = about(web.join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("x"), sample, "x").toArrow()
    p = _matrix(p.column("x").combine_chunks()) if p.num_rows else np.zeros((0, len(FEATURES)))
    empty = Model(np.zeros((len(FEATURES), BINS + 1)), np.zeros(len(FEATURES) * BINS), 0.0)
    if len(p) < FEWEST:
        return empty
    p = p[np.lexsort(p.T)]  # the same fit in whatever order rows arrive
    # bins of rare values: half of them by quantile, half by range
    shares = np.linspace(0, 1, BINS // 2 + 2)[1:-1].tolist()
    value = lambda j: F.col("x")[j]
    found = web.agg(*(f(value(j)).alias(f"{n}{j}") for j in range(len(FEATURES)) for n, f in (("low", F.min), ("high", F.max), ("cut", lambda c: F.percentile_approx(c, shares, 10_000))))).first()
    cuts = np.stack([np.sort(np.r_[found[f"cut{j}"], np.linspace(found[f"low{j}"], found[f"high{j}"], BINS // 2 + 1)]) for j in range(len(FEATURES))])
    model = Model(cuts, empty.weights, 0.0)
    design = lambda x: np.c_[model.design(x), np.ones(len(x))]
    p, ridge = design(p), RIDGE / len(p)
    half = F.pmod(F.xxhash64("doc_id", "x"), F.lit(2)) == 0
    over = lambda rows: lambda points: _reduced(rows, lambda x: Sums.of(design(x), points))
    if web.where(half).limit(1).count() and web.where(~half).limit(1).count():
        rank = fit_nnpu(p[::2], over(web.where(half)), 0.5, 2 * ridge, 6)
        above = lambda cuts: tuple(_reduced(web.where(~half), lambda x: np.array([len(x), (design(x) @ rank >= cuts[:, None]).sum(1)], object)))
        prior = estimate_prior(p[1::2] @ rank, above)
    else:
        prior = 0.5
    weights = fit_nnpu(p, over(web), prior, ridge)
    model.weights, model.offset = weights[:-1], float(weights[-1])
    return model


def scores(docs: DataFrame, model: Model, spark: SparkSession, text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    sent, kind = spark.sparkContext.broadcast(pickle.dumps(model)), dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = pickle.loads(sent.value)
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(x))], names=["doc_id", "score"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, score double")


def table_scores(table: DataFrame, model: Model, spark: SparkSession) -> DataFrame:
    """``scores`` of a table of features."""
    sent, kind = spark.sparkContext.broadcast(pickle.dumps(model)), dict(table.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = pickle.loads(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(_matrix(b.column(1))))], names=["doc_id", "score"])

    return table.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, spark: SparkSession, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows, all columns, that score at the threshold or above."""
    sent, at = spark.sparkContext.broadcast(pickle.dumps(model)), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = pickle.loads(sent.value)
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(at)]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(m.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def train_rows(modulus: int, left_out: int):
    """Rows whose crc32 of the id as text, modulo ``modulus``, isn't ``left_out``."""
    return remainder(F.col("doc_id"), modulus) != left_out
