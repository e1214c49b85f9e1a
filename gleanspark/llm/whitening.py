"""Whitened vectors: leading components of a covariance by Jacobi-Davidson over distributed centred products.

The covariance is never formed. Every product of it with a few vectors is one pass over the rows, summed by partition and then by
Spark. The driver holds a search space of a few dozen vectors: Rayleigh-Ritz picks the best ones in it, a projected correction equation
for each is solved by some steps of MINRES (all of them share their passes), and what has converged is locked. A component is done
when its residual has reached the rounding of a double.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import checkpointed

#: Entries become floor(SCALE * entry); components that are returned at most.
SCALE, COMPONENTS = 256, 4
#: Steps of MINRES for a correction, and the share of the residual at which they end; corrections at a time (a pass over the rows
#: costs the same for several) and vectors of the search space, each at most.
INNER, ENOUGH, WIDTH, SPACE, SEED = 4, 0.02, 8, 64, 12
#: Vectors in a row of the fit list, and bytes of it in a partition.
ROWS, PART = 4096, 32 << 20
_EPS = float(np.finfo(float).eps)
_LOW, _HIGH = -(2.0**63), 2.0**63 - 1024  # doubles that a long can hold

Product = Callable[[np.ndarray], np.ndarray]


class Model(NamedTuple):
    """n vectors of sums `total`; vectors (one a column) and values of the components, all variance, and how far from whitened."""

    n: int
    total: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


# --- rows ---------------------------------------------------------------------------------------


def _quantised(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold `size` finite entries, and their entries as whole numbers; entries beyond a long are its ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    lengths = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, np.int64)
    fits = np.flatnonzero((lengths == size) & np.asarray(column.is_valid()))
    flat = column.take(pa.array(fits)).flatten()
    values = np.asarray(flat.fill_null(np.nan), np.float64).reshape(len(fits), size)
    good = np.isfinite(values).all(axis=1)
    with np.errstate(over="ignore"):
        whole = np.floor(SCALE * values[good])
    return fits[good], np.clip(whole, _LOW, _HIGH).astype(np.int64)


def _packed(x: np.ndarray) -> pa.Array:
    """Every row as bytes: of 16-bit numbers where they suffice, else of 64-bit ones."""
    small = ((x >= -(1 << 15)) & (x < 1 << 15)).all(axis=1)
    narrow = x.astype("<i2")
    return pa.array([(narrow if s else x)[k].tobytes() for k, s in enumerate(small)], pa.binary())


def _unpacked(column: pa.Array, size: int) -> np.ndarray:
    rows = [np.frombuffer(b, "<i2" if len(b) == 2 * size else "<i8") for b in column.to_pylist()]
    return np.array(rows, np.int64).reshape(len(rows), size)


def _blocks(size: int) -> Callable:
    """Vectors as few wide rows: (n, block of doubles, sums of the entries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _unpacked(batch.column("x").slice(at, ROWS), size)
                wide = x.astype(object) if np.abs(x.astype(float)).max() > 1 << 40 else x
                sums = [[Decimal(int(v)) for v in wide.sum(axis=0)]]
                columns = [pa.array([len(x)]), pa.array([x.astype(float).tobytes()], pa.binary()), pa.array(sums, pa.list_(pa.decimal128(38, 0)))]
                yield pa.RecordBatch.from_arrays(columns, ["n", "block", "sums"])

    return run


def _summed(blocks: DataFrame, size: int, terms: Callable[[np.ndarray], np.ndarray], count: int) -> np.ndarray:
    """Sums over all vectors of `terms` (block to `count` numbers): added up in each partition, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(count)
        for batch in batches:
            for block in batch.column("block"):
                total += terms(np.frombuffer(block.as_py(), float).reshape(-1, size)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count, dtype=np.int32)), pa.array(total)], ["at", "value"])

    found = np.zeros(count)
    for r in blocks.select("block").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        found[r.at] = r.value
    return found


# --- Jacobi-Davidson ------------------------------------------------------------------------------


def _orthonormal(v: np.ndarray, against: np.ndarray) -> np.ndarray:
    """The parts of v that are not in the span of `against`, orthonormal; what is hardly there goes."""
    size = np.linalg.norm(v, axis=0)
    v = v[:, size > 0] / size[size > 0]
    kept: list[np.ndarray] = []
    for k in range(v.shape[1]):
        basis = np.column_stack([against, *kept])
        rest = v[:, k]
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
        length = np.linalg.norm(rest)
        if length > 1e-10:
            rest = rest / length
            rest = rest - basis @ (basis.T @ rest)
            kept.append((rest / np.linalg.norm(rest))[:, None])
    return np.column_stack([np.zeros((len(v), 0)), *kept])


def corrections(product: Product, basis: np.ndarray, theta: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Corrections t, orthogonal to the basis, of (covariance - theta) t = -residual, by MINRES for all columns in step."""

    def outside(v: np.ndarray) -> np.ndarray:
        return v - basis @ (basis.T @ v)

    b = outside(-residual)
    beta = np.linalg.norm(b, axis=0)
    start = np.where(beta > 0, beta, 1)
    v, before = b / start, np.zeros_like(b)
    found, w1, w2 = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    left, last = beta.copy(), np.zeros_like(beta)
    c1, s1, c2, s2 = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    live = beta > 0
    for _ in range(INNER):
        if not live.any():
            break
        y = np.zeros_like(v)
        y[:, live] = outside(product(v[:, live]) - theta[live] * v[:, live])
        alpha = (v * y).sum(axis=0)
        y = outside(y - alpha * v - last * before)
        after = np.linalg.norm(y, axis=0)
        # the column of the tridiagonal matrix, turned by the two rotations before and by a new one
        third = s2 * last
        second = c1 * c2 * last + s1 * alpha
        first = c1 * alpha - s1 * c2 * last
        length = np.hypot(first, after)
        turn = np.where(length > 0, length, 1)
        c, s = np.where(length > 0, first / turn, 1), after / turn
        w = (v - second * w1 - third * w2) / turn
        move = live & (length > 0)
        found[:, move] += (c * left * w)[:, move]
        left = np.where(move, -s * left, left)
        w2, w1, c2, s2, c1, s1 = w1, w, c1, s1, c, s
        live &= (np.abs(left) > ENOUGH * beta) & (after > _EPS * np.abs(alpha))
        before, v, last = v, y / np.where(after > 0, after, 1), after
    return outside(found)


def components(product: Product, size: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvectors (one a column) and eigenvalues of a symmetric product, by falling value, to double precision.

    Converged pairs are locked from the top down; in the end all of them are multiplied anew and turned by Rayleigh-Ritz.
    """
    random = np.random.default_rng(SEED)
    count = min(count, size)
    locked = np.zeros((size, 0))
    space = _orthonormal(random.normal(size=(size, min(size, 2 * max(count, WIDTH)))), locked)
    image = product(space)
    best, stuck, scale = np.inf, 0, 0.0
    while True:
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        open_ = count - locked.shape[1]
        width = min(max(open_, WIDTH), len(theta))
        ritz, residual = space[:, :width], image[:, :width] - space[:, :width] * theta[:width]
        residual = residual - locked @ (locked.T @ residual)
        norm = np.linalg.norm(residual, axis=0)
        scale = max(scale, abs(theta[0]), 1e-300)
        enough = 16 * _EPS * scale
        whole = space.shape[1] + locked.shape[1] >= size
        # what no longer falls has met the rounding of the sums
        stuck = stuck + 1 if norm[0] > best / 2 and norm[0] < 1e-10 * scale else 0
        best = min(best, norm[0])
        done = 0
        while done < min(open_, width) and (norm[done] <= enough or whole or (stuck > 2 and done == 0)):
            done += 1
        if done:
            locked = np.column_stack([locked, ritz[:, :done]])
            space, image, best, stuck = space[:, done:], image[:, done:], np.inf, 0
            if locked.shape[1] == count:
                fresh = product(locked)
                small = locked.T @ fresh
                values, turn = np.linalg.eigh((small + small.T) / 2)
                return locked @ turn[:, ::-1], values[::-1]
            if space.shape[1]:
                continue
        if space.shape[1] + width > max(SPACE, 4 * width):
            space, image = space[:, : 2 * width], image[:, : 2 * width]
        if done:  # nothing is left of the space
            target = random.normal(size=(size, width))
        else:
            target = corrections(product, np.column_stack([locked, ritz]), theta[:width], residual)
        more = _orthonormal(target, np.column_stack([locked, space]))
        if not more.shape[1]:
            more = _orthonormal(random.normal(size=(size, 1)), np.column_stack([locked, space]))
        space, image = np.column_stack([space, more]), np.column_stack([image, product(more)])


# --- the fit and the rows it gives ----------------------------------------------------------------


def fit(vectors: DataFrame, size: int, count: int = COMPONENTS) -> Model | None:
    """The components of distinct rows (x); None without rows. The driver keeps sums of `size` numbers and a search space of vectors."""
    blocks = checkpointed(vectors.select("x").distinct().mapInArrow(_blocks(size), "n bigint, block binary, sums array<decimal(38,0)>"))
    n = blocks.agg(F.sum("n")).first()[0]
    if not n:
        return None
    parts = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-n * size * 8 // PART))
    blocks = blocks.coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)
    sums = blocks.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = [int(r.value) for r in sorted(sums)]
    mean = np.array([t / n for t in total])

    def product(v: np.ndarray) -> np.ndarray:
        def terms(x: np.ndarray) -> np.ndarray:
            x = x - mean
            return x.T @ (x @ v)

        return _summed(blocks, size, terms, v.size).reshape(v.shape) / n

    trace = float(_summed(blocks, size, lambda x: ((x - mean) ** 2).sum(), 1)[0] / n)
    if trace == 0:
        blocks.unpersist()
        return Model(n, total, np.zeros((size, 0)), np.zeros(0), 0.0, 0.0)
    basis, values = components(product, size, count)
    real = values > 16 * _EPS * size * trace  # a direction without variance cannot be whitened
    basis, values = basis[:, real], values[real]
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ basis / np.sqrt(values)
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

    found = _summed(blocks, size, moments, k * k + k) / n
    first = found[k * k :]
    error = np.abs(found[: k * k].reshape(k, k) - np.outer(first, first) - np.eye(k)).max() if k else 0.0
    blocks.unpersist()
    return Model(n, total, basis, values, trace, float(error))


def _deviations(x: np.ndarray, model: Model) -> list[int]:
    """Sum over the entries of (n * x - sum)^2, exact."""
    total, n = model.total, model.n
    constant = sum(t * t for t in total)
    if np.abs(x.astype(float)).max(initial=0) < 1 << 15:
        high, low = np.array([t >> 20 for t in total]), np.array([t & 0xFFFFF for t in total])
        squares, high, low = (x * x).sum(axis=1).tolist(), (x @ high).tolist(), (x @ low).tolist()
        return [n * n * a - 2 * n * ((h << 20) + b) + constant for a, h, b in zip(squares, high, low, strict=True)]
    rows = [[int(v) for v in row] for row in x]
    return [n * n * sum(v * v for v in r) - 2 * n * sum(v * t for v, t in zip(r, total, strict=True)) + constant for r in rows]


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """Every vector on the leading components, each divided by its deviation: one row for each vector and component.

    Returns (key, component from 1, n, deviation, whitened, explained, identity_error). Vectors that are null, empty or hold null or
    non-finite entries give no row, nor do those of another length than most vectors have (the longer of equally frequent ones).
    Components are those of the distinct vectors of floor(256 * entry); repeated rows and null keys are returned like others. A component
    without variance is left out, so equal vectors alone give no rows. `deviation` is decimal(38,0), null where that is too short.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = df.select(df[key].alias("key"), df[vector].alias("vector")).where("size(vector) > 0")
    often = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if often is None:
        return df.sparkSession.createDataFrame([], schema)
    size = often["size"]

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = _quantised(batch.column(0), size)
            yield pa.RecordBatch.from_arrays([_packed(x)], ["x"])

    model = fit(rows.select("vector").mapInArrow(quantised, "x binary"), size, count)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, mean = len(model.values), np.array([t / model.n for t in model.total])
        for batch in batches:
            fits, x = _quantised(batch.column("vector"), size)
            z = (x - mean) @ model.vectors / np.sqrt(model.values)
            exact = [Decimal(v) if v < 10**38 else None for v in _deviations(x, model) for _ in range(k)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(np.repeat(fits, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(fits))),
                    pa.array(np.full(len(fits) * k, model.n)),
                    pa.array(exact, pa.decimal128(38, 0)),
                    pa.array(z.ravel()),
                    pa.array(np.tile(model.values / model.trace, len(fits))),
                    pa.array(np.full(len(fits) * k, model.identity_error)),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
