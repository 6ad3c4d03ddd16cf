"""Embedding whitening: leading components by Chebyshev-filtered subspace iteration.

A vector's entries become whole numbers, x = floor(256 c).  The fit list is each distinct x vector
once; it is stored as packed blocks of rows, and every pass of the iteration reads these blocks:
a task multiplies its centred rows X into X^T(XQ) and Spark adds the tasks' matrices row by row, so
the driver sees one matrix of dimensions x columns a pass.

1. A few Lanczos steps find where the spectrum begins.
2. The block of directions goes through a Chebyshev polynomial in the covariance, by its three-term
   recurrence, one distributed pass a degree.  On the unwanted part of the spectrum, from its lower end
   to the block's smallest Ritz value, the polynomial stays within 1; above it grows at once.
3. QR makes the block orthonormal, Rayleigh-Ritz rotates it to eigenvector estimates.
4. The components are certified when their residuals |Vq - eq| are at rounding level in two
   iterations one after the other.  Each iteration puts fresh random directions into the block, so a
   component that the first block missed would show in the second.  A block that makes too little progress is
   widened, at last to all dimensions, where Rayleigh-Ritz is exact; so ties and flat spectra end.

Sums of x are whole numbers, added exactly at any size; the covariance is centred before it is
multiplied.  ``deviation`` is exact and null where it passes 64 bits.

Nulls: a null vector, or one with a null, NaN or infinite entry, is left out; an id may be null.
Entries beyond 64 bits become the nearest long.  Vectors of each length are a fit of their own.
Repeated vectors count once in the fit and each row gets its result.  A component whose eigenvalue is
zero (fewer distinct vectors than components) has no whitened value and gives no row; so do vectors
without entries.  Tied eigenvalues: any orthonormal directions of their space, the same for all
rows.  Long vectors cost memory in proportion to dimensions times columns of the block.  Extra
columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.llm.common import freed, read_table, small_batches, stored

COMPONENTS = 4
SCALE = 256
GUARDS, FRESH, DEGREE, LANCZOS = 12, 2, 10, 8
BLOCK_BYTES = 1 << 20
SEED = 11
_EPS = np.finfo(np.float64).eps

COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of each row whose vector has only finite entries."""
    c = F.col(vector_col)
    finite = F.forall(c, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return table.where(c.isNotNull() & finite).select(F.col(id_col).alias("vec_id"), F.transform(c, lambda v: F.floor(v.cast("double") * SCALE)).alias("x"))


def _rows_of(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _packed(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_BYTES // (8 * d))
        for batch in batches:
            rows = _rows_of(batch.column("x"), d)
            blocks = [rows[i : i + step] for i in range(0, len(rows), step)]
            yield pa.RecordBatch.from_arrays([pa.array(map(len, blocks), pa.int64()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["n", "block"])

    return run


def fit_list(rows: DataFrame, d: int) -> DataFrame:
    """(n, block): the distinct vectors of length ``d`` as packed blocks of rows, stored."""
    distinct = rows.where(F.size("x") == d).select("x").distinct()
    return stored(distinct.mapInArrow(freed(_packed(d)), "n long, block binary"), "whitening-blocks")


def _totals(d: int):
    """Exact sums of each dimension, as high and low halves of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            for blob in batch.column("block").to_pylist():
                x = np.frombuffer(blob, np.int64).reshape(-1, d)
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(high), pa.array(low)], ["dim", "high", "low"])

    return run


def totals(blocks: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""
    n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    big = [F.sum(F.col(c).cast("decimal(19,0)")).alias(c) for c in ("high", "low")]
    found = blocks.mapInArrow(_totals(d), "dim int, high long, low long").groupBy("dim").agg(*big).collect()
    sums = {r.dim: (int(r.high) << 32) + int(r.low) for r in found}
    return n, [sums[i] for i in range(d)]


def summed(blocks: DataFrame, d: int, mean: np.ndarray, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of the matrix that ``of`` makes of a block's centred rows.  A task
    adds its own blocks; Spark adds the tasks' rows by their number."""
    names = [f"c{i}" for i in range(shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for blob in batch.column("block").to_pylist():
                total += of(np.frombuffer(blob, np.int64).reshape(-1, d) - mean)
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), *[pa.array(np.ascontiguousarray(total[:, i])) for i in range(shape[1])]], ["dim", *names])

    parts = blocks.select("block").mapInArrow(run, "dim int, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros(shape)
    for row in parts.groupBy("dim").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[row.dim] = row[1:]
    return out


def _lower_end(times: Callable[[np.ndarray], np.ndarray], d: int, rng: np.random.Generator) -> float:
    """About where the spectrum begins: the least Ritz value of some Lanczos steps, less its residual.
    A bad guess costs passes, not results."""
    v = rng.standard_normal(d)
    basis, diagonal, beside = [v / np.linalg.norm(v)], [], []
    for _ in range(min(LANCZOS, d)):
        w = times(basis[-1][:, None])[:, 0]
        diagonal.append(basis[-1] @ w)
        for _ in range(2):
            for q in basis:
                w = w - (q @ w) * q
        beside.append(np.linalg.norm(w))
        if beside[-1] <= 1e-12 * max(map(abs, diagonal)):
            break
        basis.append(w / beside[-1])
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1))
    return max(0.0, values[0] - abs(beside[-1] * vectors[-1, 0]))


def _filtered(times: Callable[[np.ndarray], np.ndarray], block: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
    """The block under the Chebyshev polynomial that stays within 1 on [low, high], scaled at ``top``."""
    half, centre = max((high - low) / 2, _EPS * top), (high + low) / 2
    first = scale = half / max(top - centre, half)
    before, now = block, (times(block) - centre * block) * (scale / half)
    for _ in range(DEGREE - 1):
        following = 1 / (2 / first - scale)
        before, now = now, (times(now) - centre * now) * (2 * following / half) - (scale * following) * before
        scale = following
    return now


def leading(times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int = COMPONENTS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of the positive matrix that
    ``times`` multiplies a block of columns with."""
    rng = np.random.default_rng(seed)
    wanted, width = min(wanted, d), min(d, wanted + GUARDS)
    low = _lower_end(times, d, rng) if width < d else 0.0
    block = np.linalg.qr(rng.standard_normal((d, width)))[0] if width < d else np.eye(d)
    good, last = 0, np.inf
    while True:
        product = times(block)
        small = block.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, product = block @ turn, product @ turn
        top = max(values[0], 0.0)
        residual = np.linalg.norm(product[:, :wanted] - block[:, :wanted] * values[:wanted], axis=0).max()
        level = 1e-13 * top
        settled = residual <= level or (residual <= 1e-11 * top and residual > last / 2)  # at rounding level
        good, slow, last = good + 1 if settled else 0, residual > last / 5, residual
        if good == 2 or width == d or not top:
            return values[:wanted], block[:, :wanted]
        if slow and not settled:
            width = min(d, 2 * width)
            if width == d:
                block = np.eye(d)
                continue
            block = np.concatenate([block, rng.standard_normal((d, width - block.shape[1]))], axis=1)
        block[:, -FRESH:] = rng.standard_normal((d, FRESH))
        block = np.linalg.qr(block)[0]
        high = values[len(values) - 1 - FRESH]
        block = np.linalg.qr(_filtered(times, block, min(low, high), high, top))[0]


def _projected(d: int, n: int, sums: list[int], mean: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float, error: float):
    """Rows of the result: each vector's components, and its exact deviation."""
    scaled = vectors / np.sqrt(values)
    k = len(values)

    def deviations(x: np.ndarray) -> list[int | None]:
        largest = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
        if d * largest**2 < 2**63:
            off = n * x - np.array(sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist())
        return [v if v < 2**63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows_of(batch.column("x"), d)
            m = len(x)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").cast(pa.int64()).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(((x - mean) @ scaled).ravel()),
                    pa.array(np.tile(values / trace, m)),
                    pa.array(np.full(m * k, error)),
                ],
                [c.split()[0] for c in COLUMNS.split(", ")],
            )

    return run


def _whitened_of_length(rows: DataFrame, d: int, wanted: int) -> DataFrame | None:
    blocks = fit_list(rows, d)
    n, sums = totals(blocks, d)
    mean = np.array([s / n for s in sums])
    trace = summed(blocks, d, mean, (1, 1), lambda x: np.array([[(x * x).sum()]]))[0, 0] / n
    values, vectors = leading(lambda q: summed(blocks, d, mean, q.shape, lambda x: x.T @ (x @ q)) / n, d, wanted)
    real = values > d * _EPS * trace
    values, vectors = values[real], vectors[:, real]
    k = len(values)
    if not k:
        return None
    scaled = vectors / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        z = x @ scaled
        return np.concatenate([z.T @ z, z.sum(axis=0)[:, None]], axis=1)

    found = summed(blocks, d, mean, (k, k + 1), moments) / n
    error = float(np.abs(found[:, :k] - np.outer(found[:, k], found[:, k]) - np.eye(k)).max())
    return rows.where(F.size("x") == d).mapInArrow(freed(_projected(d, n, sums, mean, values, vectors, trace, error)), COLUMNS)


def whitened(table: DataFrame, wanted: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each usable vector and component up to ``wanted``."""
    spark = table.sparkSession
    small_batches(spark)
    rows = whole(table, id_col, vector_col)
    lengths = [r[0] for r in rows.select(F.size("x").alias("d")).distinct().collect()]
    out = [f for d in sorted(lengths) if d > 0 and (f := _whitened_of_length(rows, d, wanted)) is not None]
    if not out:
        return spark.createDataFrame([], COLUMNS)
    first, *others = out
    for f in others:
        first = first.unionByName(f)
    return first


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read_table(spark, sf_dir, "embeddings"))
