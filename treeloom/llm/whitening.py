"""Whitening of embeddings by Chebyshev-filtered subspace iteration (operator 13).

Entries become whole numbers x; the fit list holds each distinct x-vector once.  The leading eigenvectors of its covariance V are
found without ever forming V: a block of vectors Q goes through passes that add up centred XᵀXQ over all partitions.  A Chebyshev
polynomial of V, applied by its three-term recurrence, damps the unwanted end of the spectrum; QR and Rayleigh-Ritz follow, until
the residuals of all wanted pairs certify them.  The lower edge of the spectrum comes from Lanczos steps that ride along in the
first passes as one more column.

A pass sends a row for each dimension and task into one shuffled sum; the driver sees dimensions x block numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.resident import vacate
from treeloom.llm.storage import saved, table

#: Fixed values of the whole numbers: x = floor(SCALE * c) + SHIFT; products beyond LIMIT, far outside any embedding, count as LIMIT.
SCALE, SHIFT, LIMIT = 64, 1_000_000, float(1 << 61)
#: The block has this many columns for each wanted component; the highest degree of a filter; how far a filter may spread the wanted components.
BLOCK, DEGREE, SPREAD = 3, 10, 1e8
#: Residuals, as a share of the largest eigenvalue: wanted, and enough where rounding lets them fall no further.
WANTED, ENOUGH = 1e-14, 1e-11
_LEAST = 1e-12  # eigenvalues under this share of the largest one are none


def whole_numbers(vector: str = "embedding") -> Column:
    """The x-vector of an embedding; null where that is null or holds null or non-finite entries."""
    finite = f"not exists(`{vector}`, c -> c is null or isnan(cast(c as double)) or abs(cast(c as double)) = double('infinity'))"
    return F.expr(f"case when {finite} then transform(`{vector}`, c -> floor(greatest(least({SCALE} * cast(c as double), {LIMIT:.1f}D), -{LIMIT:.1f}D)) + {SHIFT}L) end")


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


class Fit:
    """The fit list, its size, exact sums and centre; passes over it."""

    def __init__(self, vectors: DataFrame, dims: int):
        self.list, self.dims = saved(vectors.select("x").distinct(), "whitening-fit"), dims

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vacate()
            n, total = 0, np.zeros(dims, dtype=object)
            for batch in batches:
                x = _matrix(batch)
                n += len(x)
                small = not len(x) or int(np.abs(x).max()) < (1 << 62) // len(x)
                total += (x if small else x.astype(object)).sum(axis=0)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([str(s) for s in total])], ["dim", "n", "total"])

        parts = self.list.mapInArrow(sums, "dim int, n long, total string")
        found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dim").collect()  # a row for each dimension
        self.n = found[0].n
        self.sums = [int(r.total) for r in found]
        self.centre = np.array([s // self.n for s in self.sums]) + np.array([s % self.n for s in self.sums], dtype=float) / self.n

    def _summed(self, rows: int, columns: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum of ``part``(centred rows), a rows x columns matrix, over the fit list."""
        sums, rest = np.array([s // self.n for s in self.sums]), np.array([s % self.n for s in self.sums], dtype=float) / self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vacate()
            total = np.zeros((rows, columns))
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    total += part(_matrix(batch.slice(at, 4096)) - sums - rest)
            yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), *map(pa.array, total.T)], ["row", *(f"c{j}" for j in range(columns))])

        parts = self.list.mapInArrow(run, ", ".join(["row int", *(f"c{j} double" for j in range(columns))]))
        out = np.zeros((rows, columns))
        for r in parts.groupBy("row").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(columns))).collect():  # a row for each dimension
            out[r[0]] = r[1:]
        return out

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q: one distributed pass."""
        return self._summed(self.dims, q.shape[1], lambda x: x.T @ (x @ q)) / self.n

    def trace(self) -> float:
        return float(self._summed(1, 1, lambda x: np.array([[np.square(x).sum()]]))[0, 0] / self.n)

    def covariance_of(self, projection: np.ndarray) -> np.ndarray:
        """Covariance of the fit list's rows times ``projection``."""

        def part(x: np.ndarray) -> np.ndarray:
            z = x @ projection
            return z.T @ z

        k = projection.shape[1]
        return self._summed(k, k, part) / self.n


class LowEdge:
    """Lanczos steps on a rider column: a lower bound of the spectrum to filter from."""

    def __init__(self, dims: int, rng: np.random.Generator):
        start = rng.standard_normal(dims)
        self.basis, self.alphas, self.betas = [start / np.linalg.norm(start)], [], []

    def column(self) -> np.ndarray:
        return self.basis[-1][:, None]

    def take(self, product: np.ndarray) -> None:
        done = np.array(self.basis)
        self.alphas.append(float(self.basis[-1] @ product))
        rest = product - done.T @ (done @ product)
        rest -= done.T @ (done @ rest)
        size = float(np.linalg.norm(rest))
        self.betas.append(size)
        self.basis.append(rest / size if size > 0 else np.zeros_like(rest))

    def value(self) -> float:
        if not self.alphas or not all(self.betas[:-1]):
            return 0.0
        t = np.diag(self.alphas) + np.diag(self.betas[:-1], 1) + np.diag(self.betas[:-1], -1)
        return max(0.0, float(np.linalg.eigvalsh(t)[0]) - self.betas[-1])


def _degree(top: float, last: float, low: float, high: float) -> int:
    """Degree of the next filter: as high as the wanted components' spread allows."""
    at = [np.arccosh(max(1.0, (2 * v - low - high) / (high - low))) for v in (top, last)]
    return int(np.clip(np.log(SPREAD) / max(at[0] - at[1], 1e-9), 1, DEGREE))


def leading_pairs(times: Callable[[np.ndarray], np.ndarray], dims: int, components: int, max_rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) at the top of a symmetric positive V given by ``times``, certified; pairs of no size are left out."""
    rng = np.random.default_rng(13)
    wanted, width = min(components, dims), min(dims, BLOCK * components)
    edge = LowEdge(dims, rng)
    q = np.linalg.qr(rng.standard_normal((dims, width)))[0]
    best = np.inf
    for _ in range(max_rounds):
        product = times(q)
        values, turn = np.linalg.eigh((q.T @ product + product.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, product = q @ turn, product @ turn
        keep = values[:wanted] > _LEAST * max(values[0], 0.0)
        if values[0] <= 0:
            return values[:0], q[:, :0]
        residual = float(np.linalg.norm(product - q * values, axis=0)[:wanted][keep].max()) / values[0]
        if residual <= WANTED or residual <= ENOUGH and residual > best / 2:
            vectors = q[:, :wanted][:, keep]
            return values[:wanted][keep], vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])
        best = min(best, residual)
        # The Chebyshev recurrence on [low, high]; the first product is at hand.
        high, low = float(values[-1]), edge.value()
        low = min(low, high)
        centre, half = (high + low) / 2, max((high - low) / 2, 1e-6 * values[0])
        before, now = q, (product - centre * q) / half
        for _ in range(_degree(values[0], values[wanted - 1], centre - half, centre + half) - 1):
            riding = len(edge.alphas) < 2 * DEGREE and edge.column().any()
            made = times(np.hstack([now, edge.column()]) if riding else now)
            if riding:
                edge.take(made[:, -1])
            before, now = now, 2 * (made[:, : q.shape[1]] - centre * now) / half - before
        q = np.linalg.qr(now / np.maximum(np.linalg.norm(now, axis=0), np.finfo(float).tiny))[0]
    raise RuntimeError(f"residual {best} after {max_rounds} rounds")


def whitened(vectors: DataFrame, components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row of ``vectors`` (vec_id, embedding) and component.

    Rows whose vector is null or holds null or non-finite entries are dropped.  Repeated rows and null ids are returned each; the fit
    list counts equal vectors once.  Shorter vectors (empty ones too) are filled up to the longest with entries of 0.  Components
    of no variance are left out, so one distinct vector, or vectors without entries, give no rows; neither does an empty table.  deviation is null where it leaves 64 bits.  A column's sign makes the
    largest entry of its eigenvector positive.
    """
    rows = vectors.select("vec_id", whole_numbers().alias("x")).where("x is not null")
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sizes = rows.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    dims = sizes.most or 0
    none = vectors.sparkSession.createDataFrame([], schema)
    if not dims:
        return none
    if sizes.least < dims:
        rows = rows.withColumn("x", F.expr(f"concat(x, array_repeat({SHIFT}L, {dims} - size(x)))"))
    fit = Fit(rows, dims)
    values, axes = leading_pairs(fit.times, dims, components)
    if not len(values):
        return none
    projection = axes / np.sqrt(values)
    error = float(np.abs(fit.covariance_of(projection) - np.eye(len(values))).max())
    explained = values / fit.trace()
    n, sums, k = fit.n, fit.sums, len(values)
    whole, rest = np.array([s // n for s in sums]), np.array([s % n for s in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                offset = _matrix(part) - whole
                z = (offset - rest / n) @ projection
                # n x - S = n offset - rest; in 64 bits where that is safe, else in whole numbers of any size
                if len(offset) and (int(np.abs(offset).max()) + 1) * n < 1 << 61 and ((int(np.abs(offset).max()) + 1) * n) ** 2 * dims < 1 << 62:
                    deviation = np.square(offset * n - rest).sum(axis=1).tolist()
                else:
                    exact = [sum((int(o) * n - int(r)) ** 2 for o, r in zip(row, rest, strict=True)) for row in offset]
                    deviation = [d if d < 1 << 63 else None for d in exact]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)),
                        pa.array(np.full(part.num_rows * k, n, dtype=np.int64)),
                        pa.array([d for d in deviation for _ in range(k)], pa.int64()),
                        pa.array(z.ravel()),
                        pa.array(np.tile(explained, part.num_rows)),
                        pa.array(np.full(part.num_rows * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_embedding_whitening over the whole of ``embeddings``."""
    return whitened(table(spark, sf_dir, "embeddings"))
