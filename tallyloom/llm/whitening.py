"""Embedding whitening by the polarisation identity.

2 cov(a, b) = var(a + b) - var(a) - var(b): only squares are summed, of each centred dimension and of the sum of each two,
in whole numbers without rounding; the covariances follow by subtraction and go to eigh.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import written

#: What a component c becomes: floor(SCALE * c).
SCALE = 256
#: Bits of a limb, and most rows whose products of limbs are summed in 63 bits.
LIMB, ROWS = 24, 4096
LONG = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id long, x array<long>) of the rows whose vector has components, none of them null or non-finite, and the length that most have (of equally common ones the smaller).

    x is floor(256 * c); beyond the range of long it is the end of that range.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null and size(embedding) > 0")
    rows = rows.where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    usual = rows.groupBy(F.size("embedding").alias("usual")).count().orderBy(F.desc("count"), "usual").limit(1).select("usual")
    whole = lambda v: F.floor(F.least(F.greatest(v * SCALE, F.lit(-(2.0**63))), F.lit(2.0**63)))
    return rows.join(F.broadcast(usual), F.size("embedding") == F.col("usual"), "left_semi").select("vec_id", F.transform("embedding", whole).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exactly: int64 where that fits, else Python integers. sums: Python integers."""
    most = max(-int(x.min()), int(x.max()), 0) * n + max(map(abs, sums))
    return x * n - sums.astype(np.int64) if most <= LONG // 4 else x.astype(object) * n - sums


def limbs(d: np.ndarray) -> list[np.ndarray]:
    """d as a sum of parts times powers of 2^24, lowest first; all but the last part lie in 0 to 2^24 - 1, the last has the sign."""
    out, most = [], max(-int(d.min()), int(d.max()))
    while most >> LIMB:
        out.append((d & ((1 << LIMB) - 1)).astype(np.int64))
        d, most = d >> LIMB, (most >> LIMB) + 1
    return [*out, d.astype(np.int64)]


class Squares:
    """Exact sums over rows of the squares of each dimension, and of the sum of each two, kept as high * 2^31 + low for each power of 2^24."""

    def __init__(self, dimensions: int):
        self.d, self.levels = dimensions, {}
        self.pairs = np.triu_indices(dimensions)

    def add(self, centred_rows: np.ndarray) -> None:
        for at in range(0, len(centred_rows), ROWS):
            part = limbs(centred_rows[at : at + ROWS])
            for i, a in enumerate(part):
                for j in range(i, len(part)):
                    products = np.empty(len(self.pairs[0]), np.int64)
                    to = 0
                    for k in range(self.d):
                        # the first column of a row of pairs is the dimension itself, the others its sums with later ones
                        left, right = a[:, k:] + a[:, k : k + 1], part[j][:, k:] + part[j][:, k : k + 1]
                        left[:, 0], right[:, 0] = a[:, k], part[j][:, k]
                        products[to : to + self.d - k] = np.einsum("rp,rp->p", left, right)
                        to += self.d - k
                    level = self.levels.setdefault(i + j, np.zeros((2, len(products)), np.int64))
                    for _ in range(1 if i == j else 2):
                        level[0] += products >> 31
                        level[1] += products & (1 << 31) - 1
            for level in self.levels.values():
                level[0] += level[1] >> 31
                level[1] &= (1 << 31) - 1

    def rows(self) -> Iterator[pa.RecordBatch]:
        for level, (high, low) in self.levels.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(high), level, np.int32)), pa.array(np.arange(len(high), dtype=np.int64)), pa.array(high), pa.array(low)], ["level", "pair", "high", "low"])


def covariance(squares: DataFrame, dimensions: int, n: int) -> np.ndarray:
    """The covariance matrix, each entry rounded once from a ratio of whole numbers. squares: (level, pair, high, low), summed over all tasks; dimensions squared rows a level reach the driver."""
    sums = np.zeros(dimensions * (dimensions + 1) // 2, object)
    for r in squares.collect():
        sums[r.pair] += ((int(r.high) << 31) + int(r.low)) << LIMB * r.level
    square = np.zeros((dimensions, dimensions), object)
    square[np.triu_indices(dimensions)] = sums
    own, out = square.diagonal().copy(), np.empty((dimensions, dimensions))
    for i in range(dimensions):
        out[i, i] = int(own[i]) / n**3
        for j in range(i + 1, dimensions):
            out[i, j] = out[j, i] = (int(square[i, j]) - int(own[i]) - int(own[j])) / (2 * n**3)
    return out


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of v, at most `most`, falling, and their unit eigenvectors as rows, each with its largest entry positive."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors.T[::-1][:most]
    return values, vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]


def whitened(vectors: DataFrame, most: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row that takes part and each of the first `most` components.

    A row takes part if its vector is not null, not empty, of the length that most have, and without null and
    non-finite components; its id may be null or repeated, and other columns are not read. A component c becomes
    x = floor(256 * c). The fit list has each distinct x once; n is their number. deviation, the sum of (n * x - S)^2, is null
    where it is beyond long. A component whose eigenvalue is no more than rounding (1e-12 of the largest) has no
    scale: its whitened is null, and it is left out of identity_error, which is null if no component has one.
    explained is null if all vectors are one. No row takes part: no rows.

    Equal vectors meet by a hash of all of x, combined before the shuffle. A task sends its sums, dimensions squared
    over two for each of a few powers of 2^24, and these are added exactly; the driver gets as many and no
    vectors. Vectors are read three times: for the fit list, which is written, and for the result, in one narrow pass.
    """
    rows = usable(vectors)
    spark = rows.sparkSession
    fit = written(rows.select("x").distinct(), "fit")
    n = fit.count()
    if not n:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    dimensions = fit.select(F.size("x")).first()[0]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dimensions, np.int64), np.zeros(dimensions, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column(0).slice(at, ROWS))
                high += (x >> 31).sum(0)
                low += (x & (1 << 31) - 1).sum(0)
                high, low = high + (low >> 31), low & (1 << 31) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions, dtype=np.int64)), pa.array(high), pa.array(low)], ["pair", "high", "low"])

    total: Column = F.sum(F.col("high").cast("decimal(38,0)")).alias("high")
    totals = {r.pair: (int(r.high) << 31) + int(r.low) for r in fit.mapInArrow(summed, "pair long, high long, low long").groupBy("pair").agg(total, F.sum("low").alias("low")).collect()}
    sums = np.array([totals[i] for i in range(dimensions)], object)

    def squared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Squares(dimensions)
        for batch in batches:
            if batch.num_rows:
                own.add(centred(_matrix(batch.column(0)), n, sums))
        yield from own.rows()

    squares = fit.mapInArrow(squared, "level int, pair long, high long, low long").groupBy("level", "pair").agg(total, F.sum("low").alias("low"))
    v = covariance(squares, dimensions, n)
    values, axes = principal(v, most)
    scaled = values > 1e-12 * values[0]
    factors = axes[scaled] / (np.sqrt(values[scaled]) * n)[:, None]
    explained = [float(e / np.trace(v)) if np.trace(v) > 0 else None for e in values]

    def projected(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = centred(x, n, sums)
        return d, d.astype(np.float64) @ factors.T

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(factors)
        mean, product = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = projected(_matrix(batch.column(0)))[1]
                mean += w.sum(0)
                product += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k)), pa.array(np.concatenate([mean, product.ravel()]))], ["at", "value"])

    error = None
    if len(factors):
        k = len(factors)
        moments = np.zeros(k + k * k)
        for r in fit.mapInArrow(products, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
            moments[r.at] = r.value / n
        error = float(np.abs(moments[k:].reshape(k, k) - np.outer(moments[:k], moments[:k]) - np.eye(k)).max())
    components = len(values)
    place = np.cumsum(scaled) - 1

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                d, w = projected(_matrix(part.column(1)))
                if d.dtype != object and dimensions * int(np.abs(d).max()) ** 2 > LONG:
                    d = d.astype(object)
                deviation = pa.array([s if s <= LONG else None for s in (d * d).sum(1).tolist()], pa.int64())
                rows, again = part.num_rows, np.repeat(np.arange(part.num_rows), components)
                out = [w[:, place[c]] if scaled[c] else np.full(rows, np.nan) for c in range(components)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), rows)), pa.array(np.full(len(again), n)), deviation.take(pa.array(again)),
                     pa.array(np.stack(out, 1).ravel(), from_pandas=True), pa.array(explained * rows, pa.float64()), pa.array([error] * len(again), pa.float64())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(result, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
