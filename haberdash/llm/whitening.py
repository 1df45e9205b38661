"""Embedding whitening by QDWH spectral divide and conquer.

Vectors are rounded down to whole 256ths, so that sums, means and deviations are exact.
The fit list holds each distinct vector once. Its covariance is split without an
eigenvalue routine: the polar factor of the covariance minus a shift, by dynamically
weighted Halley iterations (QR steps first, Cholesky steps once well conditioned), is
the matrix sign, and (sign + 1) / 2 the spectral projector on the components above the
shift. An orthonormal basis of the projector's range and its complement turn the matrix
into two blocks, which are split again until each holds one value. Every row is then
projected on the first components with a small broadcast matrix.

Spark does all work that grows with the table: distinct vectors (collapsed in the map
tasks), sums, products of centred vectors, and the projection. Products are added up
inside each task and then by place of the matrix, so the driver gets one matrix of
dimension times dimension, whatever the number of rows.

Defined cases: vectors that are NULL, empty, or hold NULL or non-finite components, or
components too large for 256ths in a long, take no part; neither do vectors of another
length than most of the others have (ties: the longer). Repeated rows are projected
each, also those with NULL or repeated id. Components without variance (below 1e-13 of
the trace) cannot be whitened and are left out, so one distinct vector gives no rows, as
does an empty table. A deviation beyond a long is NULL. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haberdash.llm.tables import stored, table

COMPONENTS = 4
STEPS = 256
# Shares of the trace below this are rounding.
LEAST_SHARE = 1e-13
_EPS = np.finfo(np.float64).eps


# -- the spectral split, on one matrix --------------------------------------------------


def polar_factor(matrix: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix without a zero eigenvalue, by QDWH."""
    n = len(matrix)
    x = matrix / np.linalg.norm(matrix)
    # A lower bound of the smallest singular value, from its reciprocal's norm.
    try:
        least = 0.9 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        least = _EPS
    least = min(max(least, _EPS), 1.0)
    one = np.eye(n)
    for _ in range(60):
        square = least * least
        d = (4 * (1 - square) / (square * square)) ** (1 / 3)
        root = np.sqrt(1 + d)
        a = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0.0))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        if c > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(c) * x, one]))[0]
            after = b / c * x + (a - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        else:
            lower = np.linalg.cholesky(one + c * (x.T @ x))
            solved = np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
            after = b / c * x + (a - b / c) * solved
        after = (after + after.T) / 2
        moved = np.linalg.norm(after - x)
        x, least = after, min(least * (a + b * square) / (1 + c * square), 1.0)
        if moved < _EPS ** (1 / 3) and 1 - least < 10 * _EPS:
            break
    return x


def _split(matrix: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the components above and below a shift."""
    n = len(matrix)
    places = np.diag(matrix)
    mean, spread = places.mean(), np.linalg.norm(matrix - places.mean() * np.eye(n)) / np.sqrt(n)
    shifts = [np.median(places), mean, *(mean + spread * rng.uniform(-0.5, 0.5, 20))]
    for shift in shifts:
        sign = polar_factor(matrix - shift * np.eye(n))
        size = round((np.trace(sign) + n) / 2)
        if not 0 < size < n or np.linalg.norm(sign @ sign - np.eye(n)) > 1e-10 * n:
            # All on one side, or a component lies at the shift.
            continue
        projector = (sign + np.eye(n)) / 2
        above = np.linalg.qr(projector @ rng.standard_normal((n, size)))[0]
        whole = np.linalg.qr(projector @ above, mode="complete")[0]
        return whole[:, :size], whole[:, size:]
    raise ArithmeticError("no shift splits the matrix")


def spectrum(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and their unit vectors (columns) of a symmetric matrix, by QDWH splits."""
    n = len(matrix)
    matrix = (matrix + matrix.T) / 2
    scale = np.linalg.norm(matrix)
    rng = np.random.default_rng(n)
    open_blocks, bases = [np.eye(n)], []
    while open_blocks:
        basis = open_blocks.pop()
        block = basis.T @ matrix @ basis
        block = (block + block.T) / 2
        rest = block - np.trace(block) / len(block) * np.eye(len(block))
        if np.linalg.norm(rest) <= 4 * _EPS * np.sqrt(n) * scale:
            # One value, once or several times.
            bases.append(basis)
            continue
        open_blocks += [basis @ part for part in _split(block, rng)]
    vectors = np.linalg.qr(np.hstack(bases))[0] if n else np.zeros((0, 0))
    values = np.einsum("ij,ij->j", vectors, matrix @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# -- the table --------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """What is broadcast: number, exact sums, and projection of the fit list."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def shares(self) -> np.ndarray:
        return self.values / self.trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: longs where they suffice, else Python's integers."""
        most = max((abs(s) for s in self.sums), default=0)
        if x.size and self.n * float(np.abs(x.astype(np.float64)).max()) + most >= 2.0**62:
            x = x.astype(object)
        return self.n * x - np.array(self.sums, x.dtype)

    def projected(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ (self.vectors / np.sqrt(self.values))


def deviation(centred: np.ndarray) -> list[int | None]:
    """Exact sums of squares; None beyond a long."""
    if centred.dtype != object and float(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] >= 2.0**62:
        centred = centred.astype(object)
    totals = (centred * centred).sum(axis=1).tolist()
    return [t if t < 1 << 63 else None for t in totals]


def _rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row's id, length, packed longs) of the vectors that take part."""
    for batch in batches:
        lists = batch.column(1).cast(pa.large_list(pa.float64()))
        sizes = lists.value_lengths().fill_null(0).to_numpy()
        flat = lists.flatten()
        bad = flat.is_null().to_numpy(zero_copy_only=False)
        flat = np.nan_to_num(flat.fill_null(0).to_numpy(zero_copy_only=False), nan=np.inf) * STEPS
        bad |= ~(np.abs(flat) < 2.0**63)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        wrong = np.concatenate([[0], np.cumsum(bad)])
        good = np.flatnonzero((wrong[ends[1:]] == wrong[ends[:-1]]) & (sizes > 0))
        x = np.floor(np.where(bad, 0, flat)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(good)),
                pa.array(sizes[good].astype(np.int32)),
                pa.array([x[ends[i] : ends[i + 1]].tobytes() for i in good.tolist()], pa.binary()),
            ],
            names=["vec_id", "dim", "x"],
        )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dim)


def _sums(dim: int):
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            exact = x if float(np.abs(x.astype(np.float64)).max(initial=0)) * len(x) < 2.0**62 else x.astype(object)
            n, sums = n + len(x), [s + int(t) for s, t in zip(sums, exact.sum(axis=0).tolist())]
        if n:
            columns = [range(dim), sums, [n] * dim]
            types = [pa.int32(), pa.decimal128(38, 0), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["i", "total", "n"])

    return total


def _products(dim: int, width: int, centre: Callable[[np.ndarray], np.ndarray]):
    """Sums of products of the ``width`` columns that ``centre`` makes, and at j = -1 their sums."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            z = centre(_matrix(batch.column(0), dim))
            products += z.T @ z
            sums += z.sum(axis=0)
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([i, np.arange(width)]).astype(np.int32)),
                pa.array(np.concatenate([j, np.full(width, -1)]).astype(np.int32)),
                pa.array(np.concatenate([products[i, j], sums])),
            ],
            names=["i", "j", "total"],
        )

    return total


def _covariance(fit: DataFrame, dim: int, width: int, n: int, centre: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    parts = fit.mapInArrow(_products(dim, width, centre), "i int, j int, total double")
    products, means = np.zeros((width, width)), np.zeros(width)
    for row in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        if row["j"] < 0:
            means[row["i"]] = row["total"] / n
        else:
            products[row["i"], row["j"]] = products[row["j"], row["i"]] = row["total"] / n
    # Columns are centred already; what is left of their means is rounding.
    return products - np.outer(means, means)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, DataFrame]:
    """The whitening of ``vectors`` (vec_id, dim, x), all of one length, and their fit list."""
    dim = vectors.select("dim").first()["dim"]
    distinct = stored(vectors.select("x").distinct(), "fit-list")
    sums = distinct.mapInArrow(_sums(dim), "i int, total decimal(38,0), n long")
    rows = sorted(sums.groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())
    n, totals = rows[0]["n"], tuple(int(r["total"]) for r in rows)
    plain = Whitening(n, totals, np.zeros(0), np.zeros((dim, 0)), 0.0)
    covariance = _covariance(distinct, dim, dim, n, lambda x: (plain.centred(x) / n).astype(np.float64))
    trace = float(np.trace(covariance))
    values, found = spectrum(covariance) if trace > 0 else (np.zeros(0), np.zeros((dim, 0)))
    kept = int((values[:components] > LEAST_SHARE * trace).sum())
    return Whitening(n, totals, values[:kept], found[:, :kept], trace), distinct


def rounded(frame: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, dim, x): the vectors that take part, as packed longs; stored."""
    kind = dict(frame.dtypes)[key]
    found = frame.select(F.col(key), F.col(vector)).mapInArrow(_rounded, f"vec_id {kind}, dim int, x binary")
    found = stored(found, "rounded")
    sizes = found.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    return found.where(F.col("dim") == (sizes[0]["dim"] if sizes else 0))


def whiten(frame: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector and component: the whitened value, and what it is measured by."""
    vectors = rounded(frame, key, vector)
    schema = (
        f"vec_id {dict(vectors.dtypes)['vec_id']}, component int, n long, deviation long, "
        "whitened double, explained double, identity_error double"
    )
    if not vectors.limit(1).count():
        return frame.sparkSession.createDataFrame([], schema)
    model, distinct = fit(vectors, components)
    width, dim = len(model.values), len(model.sums)
    if not width:
        return frame.sparkSession.createDataFrame([], schema)
    check = _covariance(distinct, dim, width, model.n, lambda x: model.projected(model.centred(x)))
    error = float(np.abs(check - np.eye(width)).max())
    shares = model.shares

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            centred = model.centred(_matrix(batch.column(1), dim))
            whole = pa.array(np.repeat(np.arange(count), width))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(whole),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * width, model.n)),
                    pa.array(deviation(centred), pa.int64()).take(whole),
                    pa.array(model.projected(centred).ravel()),
                    pa.array(np.tile(shares, count)),
                    pa.array(np.full(count * width, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.select("vec_id", "x").mapInArrow(project, schema)


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened components of all embeddings."""
    return whiten(table(spark, folder, "embeddings"))
