"""Embedding whitening: principal components of a vector table by contour integration.

1. Vectors become whole numbers, `floor(scale * c) + offset`; each distinct vector counts once (the fit list).
2. Spark sums the fit list: first n and S per dimension, then the products of vectors centred at the rounded
   mean. Partial sums leave the tasks as one row per dimension and are added in two levels.
3. Eigenvalue intervals: counts of eigenvalues above a shift (inertia of the shifted covariance) are bisected
   until intervals of few eigenvalues cover the largest ones.
4. On each interval, quadrature over a circle of complex shifted solves projects a random block on to the
   eigenvectors inside, and Rayleigh-Ritz extracts them; this repeats until residuals vanish. An interval must
   yield as many eigenvalues as the inertia says, or its block grows; so none is missed.
5. Every row is centred, projected and scaled in place; the same sums over the fit list give the largest
   entry of the whitened covariance less the identity.

The driver holds the covariance only: dims x dims doubles, at most `MAX_DIMS` squared.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries go; vectors count as of the
table's dimension, the most frequent length (of equally frequent ones the largest), and others go too; a null or
repeated id is kept as it is, one result per row; components without variance are left out (so a table of
one distinct vector, or an empty one, gives no rows); entries beyond 2**40 after scaling, and deviations beyond
a long, raise an error; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.llm.store import written

COMPONENTS = 16
SCALE = 64
OFFSET = 1_000_000
MAX_DIMS = 4096
SALTS = 64  # parts in which partial sums are added before they meet
NODES = 16  # quadrature nodes on the upper half of the circle
GROUP = 8  # eigenvalues that one contour holds, unless they lie too close to part
FLAT = 1e-12  # eigenvalues below this share of the trace count as no variance


# ---- dense helpers, on dims x dims matrices


def below(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of a symmetric matrix below a shift: the negative pivots of its symmetric elimination."""
    a = matrix - shift * np.eye(len(matrix))
    count = 0
    while len(a):
        size = np.abs(a)
        d = int(np.argmax(np.diag(size)))
        i, j = divmod(int(np.argmax(size - np.diag(np.diag(size)))), len(a))
        top = size[i, j] if i != j else 0.0
        if size[d, d] == 0 and top == 0:
            return count
        picked = [d] if size[d, d] >= 0.64 * top else sorted((i, j))
        rest = np.setdiff1d(np.arange(len(a)), picked)
        pivot, side = a[np.ix_(picked, picked)], a[np.ix_(rest, picked)]
        count += int((np.linalg.eigvalsh(pivot) < 0).sum())
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(pivot, side.T)
        a = (a + a.T) / 2
    return count


def contour_pairs(matrix: np.ndarray, low: float, high: float, expected: int, *, rounds: int = 40, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The `expected` eigenvalues in (low, high), falling, and their eigenvectors as columns."""
    n = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max()) or 1.0
    x, weight = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi * (x + 1) / 2  # upper half; the lower half is its conjugate
    middle, radius = (low + high) / 2, (high - low) / 2
    turn = radius * np.exp(1j * angle)
    size = min(n, expected + max(4, expected // 2))
    while True:
        block = np.random.default_rng(seed).standard_normal((n, size))
        for _ in range(rounds):
            filtered = np.zeros((n, block.shape[1]))
            for z, w in zip(turn, weight, strict=True):
                filtered += (w / 2) * np.real(z * np.linalg.solve((middle + z) * np.eye(n) - matrix, block.astype(complex)))
            basis, _ = np.linalg.qr(filtered)
            values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ turned
            inside = np.flatnonzero((values > low) & (values < high))[::-1]
            found = block[:, inside]
            residual = np.abs(matrix @ found - found * values[inside]).max(initial=0.0)
            if len(inside) == expected and residual <= 1e-13 * norm * max(1.0, np.sqrt(n) / 8):
                return values[inside], found
        if size == n:
            raise ArithmeticError(f"{len(inside)} eigenvalues found in ({low}, {high}), the inertia says {expected}")
        size = min(n, 2 * size)


def _intervals(matrix: np.ndarray, low: float, high: float, over: int, under: int) -> list[tuple[float, float, int]]:
    """(low, high) split until each part holds `GROUP` eigenvalues at most or is too narrow to split."""
    if over - under <= 0:
        return []
    if over - under <= GROUP or high - low <= 1e-9 * max(abs(high), abs(low)):
        return [(low, high, over - under)]
    best = None
    for share in (0.5, 0.45, 0.55, 0.4, 0.6):  # a cut with room on both sides
        cut = low + share * (high - low)
        gap = 1e-7 * (high - low)
        here = below(matrix, cut)
        best = best or (cut, here)
        if here == below(matrix, cut - gap) == below(matrix, cut + gap):
            best = (cut, here)
            break
    cut, here = best
    return _intervals(matrix, cut, high, over, here) + _intervals(matrix, low, cut, here, under)


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues with positive variance, falling, and their eigenvectors as columns."""
    n, trace = len(matrix), float(np.trace(matrix))
    if n == 0 or trace <= 0:
        return np.zeros(0), np.zeros((n, 0))
    scaled = matrix / trace
    high = float(np.abs(scaled).sum(axis=1).max()) * 1.001 + 1e-6
    floor = FLAT
    wanted = min(k, n - below(scaled, floor))
    if wanted <= 0:
        return np.zeros(0), np.zeros((n, 0))
    low, top, at_low = floor, high, below(scaled, floor)
    for _ in range(60):  # raise the floor while enough eigenvalues stay above it
        if n - at_low <= wanted + 4 or top - low <= 1e-9 * top:
            break
        middle = (low + top) / 2
        here = below(scaled, middle)
        if n - here >= wanted:
            low, at_low = middle, here
        else:
            top = middle
    pairs = [contour_pairs(scaled, a, b, m) for a, b, m in _intervals(scaled, low, high, n, at_low)]
    basis, _ = np.linalg.qr(np.concatenate([v for _, v in pairs], axis=1))
    values, turned = np.linalg.eigh(basis.T @ scaled @ basis)  # the parts together, so that all are orthogonal
    order = np.argsort(-values)[:wanted]
    return values[order] * trace, (basis @ turned)[:, order]


# ---- sums over the fit list


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _summed(rows: DataFrame, partial: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], dims: int, kind: type = np.float64) -> np.ndarray:
    """Sum over all vectors x of `partial`, an array of `shape` for a block of vectors."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                mine = partial(_matrix(batch.column("x"), dims))
                total = mine if total is None else total + mine
        if total is not None:
            salt = TaskContext.get().partitionId() % SALTS
            yield pa.record_batch(
                [pa.array(np.arange(shape[0], dtype=np.int32)), pa.array(np.full(shape[0], salt, np.int32)), pa.array([r.tobytes() for r in total], pa.binary())],
                names=["i", "salt", "v"],
            )

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, kind) for v in table.column("v").to_pylist())
        return table.slice(0, 1).set_column(2, "v", pa.array([total.tobytes()], pa.binary()))

    sums = rows.mapInArrow(part, "i int, salt int, v binary")
    for keys in (["i", "salt"], ["i"]):
        sums = sums.groupBy(*keys).applyInArrow(added, "i int, salt int, v binary")
    out = np.zeros(shape, kind)
    for r in sums.collect():
        out[r.i] = np.frombuffer(r.v, kind)
    return out


@dataclass
class Whitening:
    """The fit: vectors of the fit list, their sums, the rounded mean, components and their variances."""

    n: int
    sums: np.ndarray  # per dimension, whole numbers
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def centre(self) -> np.ndarray:
        return self.sums // max(1, self.n)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        rest = (self.sums - self.n * self.centre) / max(1, self.n)
        return ((x - self.centre) - rest) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> np.ndarray:
        far = self.n * (x - self.centre) - (self.sums - self.n * self.centre)
        if len(far) and (far.astype(np.float64) ** 2).sum(axis=1).max() >= 2.0**63:
            raise OverflowError("a deviation exceeds a long")
        return (far * far).sum(axis=1)


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str, scale: int = SCALE, offset: int = OFFSET) -> tuple[DataFrame, int]:
    """vec_id, x array<long> of the rows that count, and the table's dimension."""
    c = F.col(embedding)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(2.0**40 / scale)))
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    good = vectors.where(c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(True)))
    lengths = good.groupBy(F.size(c).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dims = lengths[0].d if lengths else 0
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} entries; at most {MAX_DIMS} are handled")
    x = F.transform(c, lambda v: (F.floor(v.cast("double") * F.lit(float(scale))) + F.lit(offset)).cast("long"))
    checked = F.when(finite, x).otherwise(F.raise_error(F.lit("an entry is beyond 2**40 after scaling")))
    return good.where(F.size(c) == dims).select(F.col(vec_id).alias("vec_id"), checked.alias("x")), dims


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """Components of the distinct vectors of `rows` (x array<long>)."""
    distinct = written(rows.select("x").distinct(), "whitening-fit")
    first = _summed(distinct, lambda x: np.stack([np.full(dims, len(x)), x.sum(axis=0)]), (2, dims), dims, np.int64) if dims else np.zeros((2, 0), np.int64)
    n = int(first[0, 0]) if dims else 0
    sums = first[1]
    centre = sums // max(1, n)

    def products(x: np.ndarray) -> np.ndarray:
        far = (x - centre).astype(np.float64)
        return far.T @ far

    if n == 0:
        return Whitening(0, sums, np.zeros(0), np.zeros((dims, 0)), 0.0)
    rest = (sums - n * centre) / n
    covariance = _summed(distinct, products, (dims, dims), dims) / n - np.outer(rest, rest)
    values, found = leading_pairs(covariance, components)
    model = Whitening(n, sums, values, found, float(np.trace(covariance)))
    k = len(values)
    if k:

        def check(x: np.ndarray) -> np.ndarray:
            w = model.whitened(x)
            return np.concatenate([w.T @ w, w.sum(axis=0)[None]])

        sums_of = _summed(distinct, check, (k + 1, k), dims)
        mean = sums_of[k] / n
        model.identity_error = float(np.abs(sums_of[:k] / n - np.outer(mean, mean) - np.eye(k)).max())
    return model


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue."""
    rows, dims = whole_vectors(vectors, vec_id, embedding)
    model = fit(rows, dims, components)
    kind = rows.schema["vec_id"].dataType
    schema = f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column("x"), dims)
                each = np.repeat(np.arange(part.num_rows), k)
                across = lambda v: pa.array(np.tile(v, part.num_rows))  # noqa: E731, B023
                yield pa.record_batch(
                    [
                        part.column("vec_id").take(pa.array(each)),
                        across(np.arange(1, k + 1, dtype=np.int32)),
                        across(np.full(k, model.n, np.int64)),
                        pa.array(model.deviation(x)[each]),
                        pa.array(model.whitened(x).reshape(-1)),
                        across(model.values / model.trace),
                        across(np.full(k, model.identity_error)),
                        across(model.values),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"],
                )

    return rows.mapInArrow(run, schema)
