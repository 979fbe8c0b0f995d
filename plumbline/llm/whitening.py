"""Embedding whitening by LOBPCG with distributed covariance products.

The covariance V of the rows is never formed. Each step of LOBPCG needs V times a block of a few directions, which is one pass over the
rows: every task adds up its centred rows times what they give against the block, sums meet in a shuffle by dimension, and a block of d rows
comes to the driver. There Rayleigh-Ritz on the iterate, its residuals and the previous directions, all orthonormal, gives the next iterate; the
products of the last two are carried along with them, so a step costs one product. ``GUARD`` more directions than wanted are
iterated, which separates the wanted ones sooner.

When all wanted residuals are small against the largest eigenvalue, the product is taken anew for the iterate alone, and the residuals that
come of it must be as small: that is the certificate. If they aren't, the iteration goes on from there. A residual r bounds an eigenvalue's error by r, and an
eigenvector's angle by r over the distance to the next eigenvalue. Only then rows are whitened, and the covariance of the whitened rows is
measured in a pass of its own.

Entries c become whole numbers x = floor(scale * c) + shift, sums are whole, and rows are centred before they are multiplied, as x - q - r / n with S = q n + r, so the
shift costs no digits.

Vectors that are null, empty, or hold null or non-finite entries are left out. So are vectors of another length than the commonest one (of
equally common ones the longest). Entries that are no whole number in doubles (2^53 / scale and more) count as the largest such number. Repeated
rows and ids count each. Components whose eigenvalue is no more than rounding (repeated or collinear vectors, one row) can't be whitened and give no rows,
nor does a table without usable rows. ``deviation`` saturates where 64 bits can't hold it. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import written

GUARD = 8
#: Of the largest eigenvalue; what a residual may be at most when the iteration ends, and in its certificate.
SMALL, CERTIFIED = 2e-14, 2e-13
STEPS = 1000
#: Rows that a task multiplies at a time.
ROWS = 4096
WHOLE = float(1 << 53)


@dataclass(frozen=True)
class Centre:
    """Number, quotients and remainders of the sums over all rows by their number."""

    n: int
    quotient: np.ndarray
    remainder: np.ndarray
    scale: float
    shift: int

    def whole(self, vectors: pa.Array) -> np.ndarray:
        """x - q of equally long vectors, as whole numbers."""
        return _whole(vectors, len(self.quotient), self.scale, self.shift) - self.quotient

    def rows(self, vectors: pa.Array) -> np.ndarray:
        """x - S / n of equally long vectors."""
        return self.whole(vectors) - self.remainder / self.n

    def deviations(self, vectors: pa.Array) -> list[int]:
        """Sum over dimensions of (n x - S)^2 of each vector."""
        x = self.whole(vectors)
        if len(x) * x.shape[1] and x.shape[1] * (float(self.n) * (np.abs(x).max() + 1)) ** 2 < 2.0**62:
            return ((self.n * x - self.remainder) ** 2).sum(1).tolist()
        r = self.remainder.tolist()
        return [min(sum((self.n * a - b) ** 2 for a, b in zip(row, r)), (1 << 63) - 1) for row in x.tolist()]


def _whole(vectors: pa.Array, d: int, scale: float, shift: int) -> np.ndarray:
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * flat), -WHOLE, WHOLE).astype(np.int64) + shift


def usable(df: DataFrame, spark: SparkSession, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """key and vector of the rows that take part, written, and the vectors' length (0 if there are none)."""
    kind = dict(df.dtypes)[vector]
    v = F.col("vector")
    entry = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) if "float" in kind or "double" in kind else x.isNotNull()
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where(v.isNotNull() & (F.size(v) > 0)).where(F.forall(v, entry))
    length = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = length.d if length else 0
    return written(rows.where(F.size(v) == d), spark), d


def centre(rows: DataFrame, d: int, scale: float = 1024.0, shift: int = 100_000) -> Centre:
    """The exact sums of all rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for b in batches:
            for at in range(0, b.num_rows, 512):  # 512 times 2^53 fits in 64 bits
                x = _whole(b.column(0).slice(at, 512), d, scale, shift)
                n += len(x)
                sums = [a + c for a, c in zip(sums, x.sum(0).tolist())]
        high = [s >> 32 for s in sums]  # two halves, each summed as a long
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d), pa.array(high), pa.array([s & 0xFFFFFFFF for s in sums])], names=["i", "n", "high", "low"])

    parts = rows.select("vector").mapInArrow(add, "i int, n bigint, high bigint, low bigint")
    found = sorted(parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).collect())
    halves = [divmod((r.high << 32) + r.low, r.n) if r.n else (0, 0) for r in found]
    n = found[0].n if found else 0
    return Centre(n, np.array([q for q, _ in halves], np.int64), np.array([r for _, r in halves], np.int64), scale, shift)


def _summed(rows: DataFrame, shape: tuple[int, int], block) -> np.ndarray:
    """The sum over all rows of matrices, ``block(vectors)`` for some of them at a time: by task, then by the matrix's row."""
    height, width = shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                total += block(b.column(0).slice(at, ROWS))
        yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), *map(pa.array, total.T)], names=["i", *columns])

    columns = [f"c{j}" for j in range(width)]
    parts = rows.select("vector").mapInArrow(add, "i int" + "".join(f", {c} double" for c in columns))
    found = np.zeros(shape)
    for r in parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in columns)).collect():
        found[r.i] = r[1:]
    return found


def product(rows: DataFrame, middle: Centre, block: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance times a block of directions, and its trace: one pass over the rows."""

    def add(vectors: pa.Array) -> np.ndarray:
        x = middle.rows(vectors)
        return np.c_[x.T @ (x @ block), np.einsum("ij,ij->j", x, x)]

    found = _summed(rows, (len(block), block.shape[1] + 1), add) / middle.n
    return found[:, :-1], float(found[:, -1].sum())


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal directions of a block that are also orthogonal to others; those that are no more than rounding fall."""
    block = block / np.maximum(np.linalg.norm(block, axis=0), 1e-300)
    for _ in range(2):
        block = block - against @ (against.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * max(1.0, s.max(initial=0.0))]
    return block


@dataclass(frozen=True)
class Components:
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    steps: int


def leading(rows: DataFrame, middle: Centre, k: int, seed: int = 17) -> Components:
    """The k leading eigenvectors of the rows' covariance, by falling eigenvalue, with certified residuals."""
    d = len(middle.quotient)
    k, width = min(k, d), min(k + GUARD, d)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    vx, trace = product(rows, middle, x)
    p = vp = np.zeros((d, 0))
    exact, steps = True, 0
    x, vx, _, _, values = _ritz([x], [vx], width)
    while True:
        residual = vx - x * values
        size, most = np.linalg.norm(residual[:, :k], axis=0), max(values[0], 0.0)
        if (size <= SMALL * most).all() or exact and (size <= CERTIFIED * most).all():
            if exact:
                return Components(x[:, :k], values[:k], trace, size, steps)
            vx, trace = product(rows, middle, x)
            x, vx, p, vp, values = _ritz([x], [vx], width)
            exact = True
            continue
        steps += 1
        if steps > STEPS:
            raise RuntimeError(f"residuals {size} of eigenvalues {values[:k]} after {STEPS} steps")
        w = _orthonormal(residual, np.c_[x, p])
        if not w.shape[1]:  # the directions span all there is
            w = _orthonormal(np.random.default_rng(seed + steps).standard_normal((d, 1)), np.c_[x, p])
        if w.shape[1]:
            x, vx, p, vp, values = _ritz([x, w, p], [vx, product(rows, middle, w)[0], vp], width)
            exact = False
        else:
            vx, p, vp, exact = product(rows, middle, x)[0], p[:, :0], vp[:, :0], True


def _ritz(parts: list[np.ndarray], products: list[np.ndarray], width: int) -> tuple[np.ndarray, ...]:
    """Rayleigh-Ritz on orthonormal directions: the best ``width`` of their span, the directions that led there, both with products, and values."""
    s, vs = np.hstack(parts), np.hstack(products)
    small = s.T @ vs
    values, c = np.linalg.eigh((small + small.T) / 2)
    c, values = c[:, ::-1][:, :width], values[::-1][:width]
    led = c.copy()
    led[: parts[0].shape[1]] = 0
    led = _orthonormal(led, c) if len(parts) > 1 else led[:, :0]
    x, p = s @ c, s @ led
    return x, vs @ c, p, vs @ led, values


def whiten(rows: DataFrame, middle: Centre, found: Components) -> tuple[DataFrame, float]:
    """key, component, deviation, whitened and explained of every row and component, and the largest deviation of the
    whitened rows' covariance from the identity."""
    kept = found.values > max(1e-12 * found.trace, 0.0)
    basis, explained = found.vectors[:, kept] / np.sqrt(found.values[kept]), found.values[kept] / found.trace if found.trace else found.values[kept]
    m = basis.shape[1]

    def add(vectors: pa.Array) -> np.ndarray:
        z = middle.rows(vectors) @ basis
        return np.c_[z.T @ z, z.sum(0)]

    error = 0.0
    if m:
        sums = _summed(rows, (m, m + 1), add) / middle.n
        error = float(np.abs(sums[:, :-1] - np.outer(sums[:, -1], sums[:, -1]) - np.eye(m)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                z, n = middle.rows(b.column(1)) @ basis, b.num_rows
                take = pa.array(np.repeat(np.arange(n), m))
                deviation = pa.array(middle.deviations(b.column(1)), pa.int64())
                columns = [b.column(0).take(take), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), n)), deviation.take(take), pa.array(z.ravel()), pa.array(np.tile(explained, n))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "component", "deviation", "whitened", "explained"])

    kind = dict(rows.dtypes)["key"]
    return rows.select("key", "vector").mapInArrow(run, f"key {kind}, component int, deviation bigint, whitened double, explained double"), error


def whitened_table(df: DataFrame, spark: SparkSession, components: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error of every usable row and component."""
    rows, d = usable(df, spark, key, vector)
    if not d:
        kind = dict(rows.dtypes)["key"]
        return spark.createDataFrame([], f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    middle = centre(rows, d)
    found, error = whiten(rows, middle, leading(rows, middle, components))
    n = F.lit(middle.n).cast("bigint").alias("n")
    return found.select(F.col("key").alias(key), "component", n, "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
