"""Nearest vectors by inner product: one-bit codes of rotated vectors, bounds, exact reranking.

A vector minus the common centre is normalised and turned by a random rotation; the
signs are its code, one packed bit per dimension, with two scalars: its length and the
inner product of code and vector. ``ROTATIONS`` such codes are averaged. Queries are turned
alike and rounded to ``QUERY_BITS`` bits, so counts of common bits of packed words give
an estimate of the inner product without bias, and its error is bounded with high
probability. A vector is reranked on the original components if its upper bound reaches
the 20th best seen, at first among the rows of ``SEEDS`` times as many best estimates.

Vectors lie in blocks of about ``BLOCK_BYTES`` chosen by hash, fewer while cores are idle,
queries in smaller ones. A task gets the pieces of a block of vectors once, and then the
blocks of queries one by one, so neither side is ever gathered, a block of queries moves once for a
large block of vectors, and what is compared at once is a piece with a block of queries. Every row is
indexed; the centre alone comes from a sample of ``SAMPLE`` rows.

Defined cases: NULL ids, and NULL, empty, zero vectors or those with NULL or non-finite
components take no part; vectors of different length are not compared; repeated rows
count as they stand, of repeated query ids one row (the smallest vector) asks, and rows with the query's own id are not its neighbours; ties go to
the smaller id; with few candidates all are returned; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haberdash.llm.tables import stored, table

NEIGHBOURS = 20
QUERY_STEP = 20
# Bytes of a block of the index, and rows that are worth a block while cores are idle.
BLOCK_BYTES = 21 << 20
BLOCK = 4096
# Bytes of vectors, and rows, of a piece of a block, at most.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 4096
QUERY_BLOCK = 512
# One-bit codes of a vector, each by its own rotation.
ROTATIONS = 4
# Bits that a component of a query is rounded to, and queries compared at once.
QUERY_BITS = 4
QUERY_ROWS = 16
# Rows of best estimates, in multiples of those asked for, whose scores say what is in reach.
SEEDS = 8
# Rows, of smallest hash, whose mean is the centre.
SAMPLE = 4096
# Standard errors of an estimate that its bound allows for.
ERRORS = 3.0
# Query blocks of which a task holds the best rows so far.
HELD = 64

_INDEX = "block long, dim int, ids binary, vectors binary, codes binary, length binary, lean binary"
_QUERIES = "part long, dim int, ids binary, vectors binary"
# Pieces of the index come before the queries of their block.
_PIECE = -1


@lru_cache(maxsize=32)
def rotation(dim: int, turn: int) -> np.ndarray:
    """A fixed random rotation."""
    turned, scale = np.linalg.qr(np.random.default_rng([dim, turn]).standard_normal((dim, dim)))
    return (turned * np.sign(np.diag(scale))).astype(np.float64)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits of each row in whole 64-bit words."""
    short = np.packbits(bits, axis=-1)
    room = np.zeros((*short.shape[:-1], -(-short.shape[-1] // 8) * 8), np.uint8)
    room[..., : short.shape[-1]] = short
    return room.view(np.uint64)


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs by rotation, length of the rest, and inner products of codes and direction."""
    rest = vectors.astype(np.float64) - centre
    length = np.linalg.norm(rest, axis=1)
    rest /= np.where(length > 0, length, 1)[:, None]
    codes, lean = [], []
    for turn in range(ROTATIONS):
        turned = rest @ rotation(vectors.shape[1], turn).T
        codes.append(_packed(turned > 0))
        lean.append(np.where(length > 0, np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1]), 1.0))
    return np.stack(codes, axis=1), length, np.stack(lean, axis=1)


def _planes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rounded queries: packed bits from the highest, least value and step; and what rounding lost."""
    low = turned.min(axis=1)
    step = (turned.max(axis=1) - low) / (2**QUERY_BITS - 1)
    level = np.rint((turned - low[:, None]) / np.where(step > 0, step, 1)[:, None]).astype(np.uint8)
    planes = np.stack([_packed(level >> b & 1) for b in reversed(range(QUERY_BITS))])
    lost = np.linalg.norm(turned - low[:, None] - step[:, None] * level, axis=1)
    return planes, low, step, lost


def _counts(planes: np.ndarray, codes: np.ndarray, total: np.ndarray) -> None:
    """Sums of query levels where the code has a one, queries by vectors, into ``total``."""
    both, ones = np.empty(total.shape, np.uint64), np.empty(total.shape, np.uint8)
    total[:] = 0
    for plane in planes:
        np.add(total, total, out=total)
        for word in range(codes.shape[1]):
            np.bitwise_and(plane[:, word, None], codes[None, :, word], out=both)
            np.add(total, np.bitwise_count(both, out=ones), out=total)


def _rounded(queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Queries turned by each rotation and rounded."""
    return [_planes(queries.astype(np.float64) @ rotation(queries.shape[1], turn).T) for turn in range(ROTATIONS)]


def bounds(
    queries: np.ndarray, codes: np.ndarray, length: np.ndarray, lean: np.ndarray, centre: np.ndarray, rounded=None
) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products, queries by vectors, and their errors, from packed bits and scalars."""
    dim, kind = queries.shape[1], queries.dtype
    exact = queries.astype(np.float64)
    norm = np.linalg.norm(exact, axis=1)
    rounded = rounded or _rounded(queries)
    scale = length[:, None] / (lean * np.sqrt(dim) * ROTATIONS)
    columns = [np.ascontiguousarray(codes[:, turn].T).T for turn in range(ROTATIONS)]
    # What does not need the bits of both sides is one product of few columns.
    left, right = [exact @ centre], [np.ones(len(codes))]
    for turn, (planes, low, step, _) in enumerate(rounded):
        level = sum(np.bitwise_count(p).sum(axis=1).astype(float) * 2**b for b, p in enumerate(planes[::-1]))
        left += [2 * low, -(dim * low + step * level)]
        right += [np.bitwise_count(codes[:, turn]).sum(axis=1) * scale[:, turn], scale[:, turn]]
    estimate = (np.stack(left, axis=1) @ np.stack(right)).astype(kind)
    room = np.uint16 if dim * 2**QUERY_BITS < 2**16 else np.uint32
    for start in range(0, len(queries), QUERY_ROWS):
        some = slice(start, start + QUERY_ROWS)
        total = np.empty((len(queries[some]), len(codes)), room)
        for turn, (planes, _, step, _) in enumerate(rounded):
            _counts(planes[:, some], columns[turn], total)
            part = total * scale[:, turn].astype(kind)
            part *= (2 * step[some]).astype(kind)[:, None]
            estimate[some] += part
    away = np.sqrt((np.maximum(0, 1 - lean**2) / lean**2).sum(axis=1)) / ROTATIONS / np.sqrt(max(1, dim - 1))
    spread = ERRORS * length * away + 1e-5 * (length + np.linalg.norm(centre))
    lost = np.sqrt(sum(r[3] ** 2 for r in rounded) / ROTATIONS)
    blur = ERRORS * np.sqrt((scale**2).sum(axis=1))
    error = np.stack([norm, lost, np.ones(len(norm))], axis=1) @ np.stack([spread, blur, np.full(len(codes), 1e-9)])
    return estimate, error.astype(kind)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, components added in order."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i].astype(np.float64) * b[:, i].astype(np.float64)
    return total


def _usable(batch: pa.Table, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, ids and vectors, one array per dimension."""
    batch = batch.select(["vec_id", "embedding"]).drop_null().combine_chunks()
    dims = pc.list_value_length(batch["embedding"])
    for dim in sorted(pc.unique(dims).to_pylist()):
        if not dim:
            continue
        own = batch.filter(pc.equal(dims, dim))
        flat = pc.list_flatten(own["embedding"]).cast(pa.from_numpy_dtype(kind))
        # NULL components become no numbers.
        vectors = flat.to_numpy().reshape(-1, dim)
        ids = own["vec_id"].cast(pa.int64()).to_numpy()
        good = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
        if good.any():
            yield dim, ids[good], vectors[good]


def _few_of_each(ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Rows to keep: of equal vectors only the smallest ids can be among the nearest."""
    order = np.argsort(ids, kind="stable")
    plain = np.ascontiguousarray(vectors[order] + vectors.dtype.type(0)).view(f"V{vectors.itemsize * vectors.shape[1]}").ravel()
    _, kind = np.unique(plain, return_inverse=True)
    by_kind = np.argsort(kind, kind="stable")
    place = np.arange(len(kind)) - np.searchsorted(kind[by_kind], kind[by_kind])
    return order[by_kind[place < most]]


def _indexer(centres: dict[int, np.ndarray], most: int, kind: type):
    def index(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        out = []
        for dim, ids, vectors in _usable(group, kind):
            keep = _few_of_each(ids, vectors, most)
            rows = max(1, min(PIECE_ROWS, PIECE_BYTES // (dim * vectors.itemsize)))
            for at in range(0, len(keep), rows):
                some = keep[at : at + rows]
                coded = encode(vectors[some], centres.get(dim, np.zeros(dim)))
                arrays = (ids[some], vectors[some], *coded)
                out.append((key[0].as_py(), dim, *(np.ascontiguousarray(x).tobytes() for x in arrays)))
        names = ["block", "dim", "ids", "vectors", "codes", "length", "lean"]
        return _blobs(names, out)

    return index


def _query_blocks(kind: type):
    def blocks(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        out = [(key[0].as_py(), dim, ids.tobytes(), vectors.tobytes()) for dim, ids, vectors in _usable(group, kind)]
        return _blobs(["part", "dim", "ids", "vectors"], out)

    return blocks


def _blobs(names: list[str], rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int32()] + [pa.binary()] * (len(names) - 2)
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})


class _Best:
    """The best rows so far of each query of a block."""

    def __init__(self, query_ids: np.ndarray, k: int) -> None:
        self.query_ids, self.k = query_ids, k
        self.least = np.full(len(query_ids), -np.inf)
        self.rows = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = (np.concatenate(x) for x in zip(self.rows, (query, ids, score)))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        last = place == self.k - 1
        self.least[query[last]] = score[last]
        self.rows = (query[keep], ids[keep], score[keep])

    def batch(self) -> pa.RecordBatch:
        query, ids, score = self.rows
        return pa.RecordBatch.from_arrays(
            [pa.array(self.query_ids[query]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"]
        )


def _searcher(centres: dict[int, np.ndarray], k: int, kind: type):
    """Rows sorted by block, dimension and part: pieces of the index, then query blocks, to their best rows."""

    def piece(row: dict, dim: int) -> tuple[np.ndarray, ...]:
        ids, vectors = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], kind).reshape(-1, dim)
        codes = np.frombuffer(row["codes"], np.uint64).reshape(len(ids), ROTATIONS, -1)
        return ids, vectors, codes, np.frombuffer(row["length"]), np.frombuffer(row["lean"]).reshape(len(ids), ROTATIONS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], _Best] = {}
        at, pieces = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                dim = row["dim"]
                if (row["block"], dim) != at:
                    at, pieces = (row["block"], dim), []
                if row["part"] == _PIECE:
                    pieces.append(piece(row, dim))
                    continue
                if not pieces:
                    continue
                key = (row["part"], dim)
                queries = np.frombuffer(row["vectors"], kind).reshape(-1, dim)
                query_ids = np.frombuffer(row["ids"], np.int64)
                if key not in held:
                    if len(held) >= HELD:
                        yield held.pop(next(iter(held))).batch()
                    held[key] = _Best(query_ids, k)
                centre, rounded = centres.get(dim, np.zeros(dim)), _rounded(queries)
                for ids, vectors, *coded in pieces:
                    guess = bounds(queries, *coded, centre, rounded)
                    _search_block(held[key], queries, query_ids, ids, vectors, guess)
        for best in held.values():
            yield best.batch()

    return search


def _search_block(best: _Best, queries, query_ids, ids, vectors, guess) -> int:
    """Rank the rows whose bound reaches the best so far; returns how many that were."""
    estimate, error = guess
    own = query_ids[:, None] == ids[None, :]
    # What cannot be told, beyond the range of numbers, stays.
    high = ~(estimate + error < _reach(best, queries, vectors, estimate, own)[:, None])
    high &= ~own
    found = [_single(queries[q], vectors, np.flatnonzero(high[q]), best.k, best.least[q]) for q in range(len(queries))]
    query = np.repeat(np.arange(len(queries)), [len(f) for f in found])
    row = np.concatenate(found)
    best.add(query, ids[row], products(queries[query], vectors[row]))
    return int(high.sum())


def _reach(best: _Best, queries, vectors, estimate, own) -> np.ndarray:
    """A score that the ``k`` best of each query reach: of the best so far, else among the best estimates."""
    reach, most = best.least.copy(), SEEDS * best.k
    for q in np.flatnonzero(np.isneginf(reach)):
        guess = np.where(own[q] | np.isnan(estimate[q]), -np.inf, estimate[q])
        rows = np.argpartition(guess, -most)[-most:] if len(guess) > most else np.arange(len(guess))
        rows = rows[~own[q, rows]]
        if len(rows) >= best.k:
            score, slack = _scores(queries[q], vectors[rows])
            reach[q] = np.partition(score, -best.k)[-best.k] - slack
    return np.where(np.isnan(reach), -np.inf, reach)


def _scores(query: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Inner products in the vectors' own precision, and more than they are wrong by."""
    longest = float(np.sqrt((vectors * vectors).sum(axis=1).max())) if len(vectors) else 0.0
    return vectors @ query, 1e-5 * float(np.linalg.norm(query)) * longest


def _single(query: np.ndarray, vectors: np.ndarray, rows: np.ndarray, k: int, least: float) -> np.ndarray:
    """Of the chosen rows those that single precision leaves in reach of the ``k`` best."""
    score, slack = _scores(query, vectors[rows])
    if len(rows) > k:
        least = max(least, float(np.partition(score, -k)[-k]))
    return rows[~(score < least - 2 * slack)]


def centres_of(vectors: DataFrame, kind: type, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """The mean vector of each dimension, from a bounded sample."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    return {dim: x.astype(np.float64).mean(axis=0) for dim, _, x in _usable(rows, kind)}


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product for each row of ``queries``.

    Both have ``vec_id`` and ``embedding``.
    """
    vectors = vectors.select("vec_id", "embedding").where("vec_id IS NOT NULL AND size(embedding) > 0")
    # Of repeated ids one row asks.
    queries = queries.where("vec_id IS NOT NULL AND size(embedding) > 0").groupBy("vec_id")
    queries = queries.agg(F.min("embedding").alias("embedding"))
    # Components keep their precision.
    single = {dict(f.dtypes)["embedding"] for f in (vectors, queries)} == {"array<float>"}
    kind = np.float32 if single else np.float64
    centres = centres_of(vectors, kind)
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    idle = min(vectors.sparkSession.sparkContext.defaultParallelism, -(-size["n"] // BLOCK))
    dim = size["dim"] or 0
    # An id, a vector, a length, and for each rotation a code and how much it leans.
    room = size["n"] * (16 + dim * np.dtype(kind).itemsize + ROTATIONS * (-(-dim // 64) * 8 + 8))
    blocks = max(1, idle, -(-room // BLOCK_BYTES))
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    index = stored(
        vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        .groupBy("block")
        # One more than asked: the query itself may be among equal vectors.
        .applyInArrow(_indexer(centres, k + 1, kind), _INDEX),
        "vector-index",
    )
    asked = (
        queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
        .groupBy("part")
        .applyInArrow(_query_blocks(kind), _QUERIES)
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    )
    pieces = index.withColumn("part", F.lit(_PIECE).cast("long"))
    met = pieces.unionByName(asked, allowMissingColumns=True).repartition("block")
    found = met.sortWithinPartitions("block", "dim", "part").mapInArrow(
        _searcher(centres, k, kind), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
