"""Whitening of embeddings by FEAST contour integration.

Entries become whole numbers, floor(scale * c).  The fit list is each distinct vector once; its
covariance is summed by Spark tasks around a whole-number centre, in whole
numbers, so that the matrix is exact up to one last rounding.

The largest eigenvalues are bracketed by inertia: the signs of an L D L^T factorisation of V - s I tell how many
eigenvalues lie below s.  Each bracketed interval gets a circle in the complex plane; quadrature over it of
the solves (z I - V)^-1 Y projects a block of vectors onto the interval's eigenspace, Rayleigh-Ritz extracts the pairs, and
the projection is repeated on them until residuals are down to rounding.  The solves, one per interval and quadrature node, are
Spark tasks.  An interval that yields another number of eigenvalues than its inertia says is done again with a larger block.

The driver holds matrices of dimension x dimension, whatever the number of rows.

Defined cases: rows whose vector is null or empty, or holds null or non-finite entries, are dropped, and so are those
whose length isn't the commonest one (of equally common ones the greatest); repeated rows count once in the fit and are all
returned; null ids stay null.  Components without variance can't be whitened and give no rows, so equal vectors or an
empty table give an empty result.  deviation is null where it exceeds 64 bits.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.llm.common import materialise

#: Quadrature nodes on the upper half of an interval's circle.
NODES = 8
#: Projections of an interval before its block is made larger, and such enlargements.
ROUNDS, TRIES = 12, 4
_EXACT = 1 << 53

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"


def whole_numbers(vector: Column, scale: float) -> Column:
    """floor(scale * c) of each entry as long; null for vectors with null or non-finite entries."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c.cast("double")))
    return F.when(fine & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long")))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _wide(x: np.ndarray, bound: int) -> np.ndarray:
    """x as Python's whole numbers where sums up to the bound would not fit 62 bits."""
    return x if bound < 1 << 62 else x.astype(object)


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def _longs(x: np.ndarray) -> pa.Array:
    """x as longs, null beyond 64 bits."""
    return pa.array(x) if x.dtype != object else pa.array((int(v) if v < 1 << 63 else None for v in x), pa.int64())


def column_sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors (column x) and exact sum of each dimension."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for batch in batches:
            x = _matrix(batch.column(0), size)
            n += len(x)
            total = [a + int(b) for a, b in zip(total, _wide(x, _most(x) * len(x)).sum(axis=0))]
        yield pa.RecordBatch.from_pydict({"dim": [-1, *range(size)], "total": [str(v) for v in (n, *total)]}, pa.schema([("dim", pa.int32()), ("total", pa.string())]))

    rows = fit.select("x").mapInArrow(summed, "dim int, total string")
    found = {r.dim: int(r.total) for r in rows.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    return found.get(-1, 0), [found.get(d, 0) for d in range(size)]


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance (divisor n) of the vectors x, each entry rounded once.

    x is centred at the rounded mean before multiplying; products of whole numbers are added exactly,
    and what the centre is off from the mean is taken out exactly.
    """
    size = len(sums)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    upper = np.triu_indices(size)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(upper[0]), object)
        for batch in batches:
            x = _matrix(batch.column(0), size)
            y = _wide(x, _most(x) + max(map(abs, centre))) - np.array(centre, object if max(map(abs, centre)) >> 62 else np.int64)
            most = max(1, _most(y))
            step = _EXACT // most**2  # products of so many rows add up exactly in double
            for at in range(0, len(y), max(1, min(step, 1 << 14))):
                part = y[at : at + max(1, min(step, 1 << 14))]
                made = (part.astype(float).T @ part.astype(float))[upper].astype(np.int64) if step else (part.astype(object).T @ part.astype(object))[upper]
                total += made.astype(object)
        yield pa.RecordBatch.from_pydict({"place": np.arange(len(total), dtype=np.int64), "total": [str(v) for v in total]})

    rows = fit.select("x").mapInArrow(products, "place long, total string").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    off = [s - n * c for s, c in zip(sums, centre)]
    out = np.zeros((size, size))
    for r in rows.collect():  # size * (size + 1) / 2 rows
        i, j = int(upper[0][r.place]), int(upper[1][r.place])
        out[i, j] = out[j, i] = (n * int(r.total) - off[i] * off[j]) / n**2
    return out


def below(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues below the shift: negative pivots of L D L^T of matrix - shift I (Sylvester), with complete pivoting in blocks of one or two."""
    a = matrix - shift * np.eye(len(matrix))
    negative = 0
    while len(a):
        diagonal, off = np.abs(np.diagonal(a)), np.abs(a - np.diag(np.diagonal(a)))
        i, (p, q) = int(diagonal.argmax()), np.unravel_index(off.argmax(), off.shape)
        if not diagonal[i] and not off[p, q]:
            break
        if diagonal[i] >= 0.64 * off[p, q]:  # the bound (1 + sqrt 17) / 8 on growth
            order = [i, *(k for k in range(len(a)) if k != i)]
            a = a[np.ix_(order, order)]
            negative += a[0, 0] < 0
            a = a[1:, 1:] - np.outer(a[1:, 0], a[0, 1:]) / a[0, 0]
        else:
            order = [p, q, *(k for k in range(len(a)) if k not in (p, q))]
            a = a[np.ix_(order, order)]
            negative += 1  # such a block has a negative determinant
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
        a = (a + a.T) / 2
    return int(negative)


def brackets(matrix: np.ndarray, most: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside), falling, that hold the `most` largest eigenvalues or a few more.

    Bisection by inertia closes in on each eigenvalue; ends are put in the middle of gaps, and eigenvalues with no clear gap share an interval.
    """
    size, scale = len(matrix), float(np.trace(matrix))
    top = float(np.abs(matrix).sum(axis=1).max())  # no eigenvalue is above it
    tiny = scale * size * np.finfo(float).eps
    narrow = 1e-3 * top

    def located(k: int) -> tuple[float, float]:
        """An interval of width `narrow` at most, with the k-th largest eigenvalue."""
        low, high = -tiny - narrow, top + narrow
        while high - low > narrow:
            mid = (low + high) / 2
            low, high = (mid, high) if size - below(matrix, mid) >= k else (low, mid)
        return low, high

    places = [located(k) for k in range(1, min(size, most + 1) + 1)]
    ends = [top + 2 * narrow]
    for k in range(1, len(places)):
        gap = places[k - 1][0] - places[k][1]
        if gap > 0:
            ends.append(places[k - 1][0] - gap / 2)
    if len(places) <= most or len(ends) == 1 or size - below(matrix, ends[-1]) < most:  # all are wanted, or the last ones are close together
        extra = most + 1
        while extra < size and located(extra)[1] >= places[-1][0]:
            extra += 1
        last = places[-1] if extra >= size else located(extra)
        ends.append((last[1] + places[-1][0]) / 2 if last[1] < places[-1][0] else min(-tiny, -narrow) - narrow)
    counts = [size - below(matrix, e) for e in ends]
    return [(low, high, b - a) for high, low, a, b in zip(ends, ends[1:], counts, counts[1:]) if b > a]


def _contour(low: float, high: float) -> list[tuple[complex, complex]]:
    """Nodes z and weights of Gauss-Legendre quadrature over the upper half circle on [low, high]."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi * (1 - x) / 2)
    radius = (high - low) / 2
    return [((low + high) / 2 + radius * t, v * radius * t / 2) for t, v in zip(turn, w)]


def _projected(spark, shared, blocks: dict[int, np.ndarray], spans: list[tuple[float, float, int]]) -> dict[int, np.ndarray]:
    """Each block projected onto its interval: one task per interval and node, their sum in the driver (dimension x block)."""
    nodes = [(k, n) for k in blocks for n in range(NODES)]
    held = spark.sparkContext.broadcast(blocks)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                z, weight = _contour(*spans[k][:2])[n]
                matrix = shared.value
                part = (weight * np.linalg.solve(z * np.eye(len(matrix)) - matrix, held.value[k].astype(complex))).real
                yield pa.RecordBatch.from_pydict({"span": [k], "part": [part.tobytes()]}, pa.schema([("span", pa.int32()), ("part", pa.binary())]))

    rows = spark.createDataFrame(nodes, "span int, node int").repartition(len(nodes)).mapInArrow(solved, "span int, part binary").collect()
    out = {k: np.zeros_like(b) for k, b in blocks.items()}
    for r in sorted(rows, key=lambda r: (r.span, bytes(r.part))):  # one order, so reruns agree
        out[r.span] += np.frombuffer(r.part).reshape(out[r.span].shape)
    held.unpersist()
    return out


def _ritz(matrix: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz values (falling) and vectors in the span of the block."""
    left, size, _ = np.linalg.svd(block, full_matrices=False)
    basis = left[:, size > size[0] * 1e-13] if size[0] else left[:, :0]
    basis, _ = np.linalg.qr(basis)
    small = basis.T @ matrix @ basis
    values, turned = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], (basis @ turned)[:, ::-1]


def components(spark, matrix: np.ndarray, most: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues, falling, and their unit eigenvectors as columns; fewer if the others are zero to rounding."""
    size = len(matrix)
    norm = float(np.trace(matrix))
    if not norm > 0:
        return np.empty(0), np.empty((size, 0))
    unit = matrix / norm
    spans = brackets(unit, most)
    draw = np.random.default_rng(seed)
    shared = spark.sparkContext.broadcast(unit)
    width = {k: min(size, 2 * inside + 4) for k, (_, _, inside) in enumerate(spans)}
    blocks = {k: draw.standard_normal((size, w)) for k, w in width.items()}
    done: dict[int, np.ndarray] = {}
    noise, tries = 32 * size * np.finfo(float).eps * np.abs(unit).sum(axis=1).max(), 0
    while blocks:
        tries += 1
        worst = dict.fromkeys(blocks, np.inf)
        for _ in range(ROUNDS):
            blocks = _projected(spark, shared, blocks, spans)
            for k in list(blocks):
                low, high, inside = spans[k]
                values, vectors = _ritz(unit, blocks[k])
                hit = (values > low) & (values < high)
                left = np.linalg.norm(unit @ vectors[:, hit] - vectors[:, hit] * values[hit], axis=0).max(initial=0.0)
                if hit.sum() == inside and (left <= noise or left >= worst[k] / 2 and left <= 1e3 * noise):
                    done[k] = vectors[:, hit]
                    del blocks[k]
                else:
                    blocks[k], worst[k] = vectors, left if hit.sum() == inside else np.inf
            if not blocks:
                break
        else:
            if tries > TRIES:
                raise RuntimeError(f"{len(blocks)} eigenvalue intervals did not settle")
        blocks = {k: draw.standard_normal((size, min(size, b.shape[1] * 2 + 2))) for k, b in blocks.items()}
    shared.unpersist()
    values, vectors = _ritz(unit, np.hstack([done[k] for k in sorted(done)]))
    keep = values[:most] > size * np.finfo(float).eps
    return values[:most][keep] * norm, vectors[:, :most][:, keep]


def _whitener(n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray):
    mean = np.array([s / n for s in sums])
    scaled = vectors / np.sqrt(values)

    def whitened(x: np.ndarray) -> np.ndarray:
        return (x.astype(float) - mean) @ scaled

    return whitened


def identity_error(fit: DataFrame, whitened, size: int, k: int) -> float:
    """Largest entry of the whitened vectors' covariance less the identity; tasks centre before multiplying, and their sums are merged by moving centres."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = whitened(_matrix(batch.column(0), size))
            if len(w):
                own = w.mean(axis=0)
                n, mean, spread = _merged((n, mean, spread), (len(w), own, (w - own).T @ (w - own)))
        yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tolist()], "spread": [spread.ravel().tolist()]})

    total = (0, np.zeros(k), np.zeros((k, k)))
    rows = fit.select("x").mapInArrow(moments, "n long, mean array<double>, spread array<double>")
    for r in rows.toLocalIterator():  # k * k numbers a task
        total = _merged(total, (r.n, np.array(r.mean), np.array(r.spread).reshape(k, k)))
    return float(np.abs(total[2] / total[0] - np.eye(k)).max())


def _merged(a: tuple, b: tuple) -> tuple:
    n = a[0] + b[0]
    if not n:
        return a
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def whiten(rows: DataFrame, *, most: int = 4, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 11) -> DataFrame:
    """A row per remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue."""
    spark = rows.sparkSession
    whole = rows.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col), scale).alias("x")).where("x is not null")
    whole = materialise(whole, "whiten-rows")
    lengths = whole.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    common = lengths.agg(F.max(F.struct("n", "d")).alias("m")).first().m
    if common is None:
        return spark.createDataFrame([], SCHEMA)
    size = int(common.d)
    whole = whole.where(F.size("x") == size)
    fit = materialise(whole.select("x").distinct(), "whiten-fit")
    n, sums = column_sums(fit, size)
    matrix = covariance(fit, n, sums)
    values, vectors = components(spark, matrix, min(most, size), seed)
    k = len(values)
    if not k:
        return spark.createDataFrame([], SCHEMA)
    whitened = _whitener(n, sums, values, vectors)
    error, explained = identity_error(fit, whitened, size, k), values / np.trace(matrix)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), size)
            away = n * _most(x) + max(map(abs, sums))
            wide = _wide(x, size * away**2)
            deviation = ((n * wide - np.array(sums, wide.dtype)) ** 2).sum(axis=1)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)),
                _longs(np.repeat(deviation, k)), pa.array(whitened(x).ravel()),
                *(pa.array(np.tile(v, len(x))) for v in (explained, np.full(k, error), values)),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 4))], names)

    return whole.mapInArrow(out, SCHEMA)
