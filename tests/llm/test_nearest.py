from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from haberdash.llm import nearest as near


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, block int, dim string")


def product(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def brute(rows, queries, k):
    out = []
    for q, a in queries:
        scored = sorted((-product(a, b), i) for i, b in rows if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_neighbours_equal_brute_force(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(near, "BLOCK", 64)
        monkeypatch.setattr(near, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(1)
    data = rng.standard_normal((900, 24)).astype(np.float32) + 0.5
    data[100:400] = data[7]  # a third of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    frame = vectors(spark, [(i, v, 0, 0, "") for i, v in rows])
    found = near.nearest(frame, frame.where("vec_id % 20 = 0")).collect()
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found)
    expected = brute(rows, rows[::20], 20)
    assert len(got) == len(expected)
    hits = len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in expected})
    assert hits >= 0.99 * len(expected)
    assert {g[3] for g in got if g[0] == 0} <= {e[3] for e in brute(rows, rows[:1], 900)}


def test_recall_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r[0], r[1]) for r in rows]
    expected = {(q, i) for q, _, i, _ in brute(rows, [r for r in rows if r[0] % 20 == 0], 20)}
    found = {(r["query_id"], r["vec_id"]) for r in near.op8_nearest(spark, folder).collect()}
    assert len(found & expected) >= 0.99 * len(expected)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]),
        (7, [inf, 1.0]), (8, [None, 1.0]), (None, [9.0, 9.0]), (20, [1.0, 1.0, 1.0]), (40, [0.0, 0.0]), (9, [-1.0, 5.0]),
        (0, [1.0, 0.0]),
    ]
    frame = vectors(spark, [(i, v, 0, 0, "") for i, v in rows])
    found = near.nearest(frame, frame.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 9, -1.0)]
    assert near.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    data, queries = (rng.standard_normal((n, 64)).astype(np.float32) for n in (2000, 20))
    centre = data.mean(axis=0).astype(np.float64)
    estimate, error = near.bounds(queries, *near.encode(data, centre), centre)
    exact = queries.astype(np.float64) @ data.astype(np.float64).T
    assert (np.abs(estimate - exact) <= error).mean() > 0.99


def test_double_components_keep_their_precision(spark):
    rng = np.random.default_rng(8)
    data = rng.standard_normal((300, 8))
    # Alike in single precision, and beyond its range.
    data[50:80] = data[50] + np.arange(30)[:, None] * 1e-12
    data[90] *= 1e60
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = near.nearest(frame, frame.where("vec_id % 20 = 0")).collect()
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found)
    assert got == brute(rows, rows[::20], 20)


@pytest.mark.parametrize("dim", [1, 5, 64, 100])
def test_counts_of_packed_bits(dim):
    rng = np.random.default_rng(dim)
    turned, bits = rng.standard_normal((7, dim)), rng.random((30, dim)) > 0.5
    planes, low, step, lost = near._planes(turned)
    total = np.empty((7, 30), np.uint16)
    near._counts(planes, near._packed(bits), total)
    level = np.rint((turned - low[:, None]) / np.where(step > 0, step, 1)[:, None]).astype(int)
    assert np.array_equal(total, level @ bits.T.astype(int))
    assert (lost <= step / 2 * np.sqrt(dim) + 1e-12).all()


def test_few_rows_are_reranked(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").toPandas()
    data, ids = np.array(rows["embedding"].tolist(), np.float32), rows["vec_id"].to_numpy()
    ask = ids % 20 == 0
    centre = data.mean(axis=0).astype(np.float64)
    best = near._Best(ids[ask], 20)
    guess = near.bounds(data[ask], *near.encode(data, centre), centre)
    reranked = near._search_block(best, data[ask], ids[ask], ids, data, guess)
    assert reranked < 0.2 * ask.sum() * len(ids)
    exact = data[ask].astype(float) @ data.T.astype(float)
    exact[ids[ask][:, None] == ids] = -np.inf
    found = set(zip(best.rows[0].tolist(), best.rows[1].tolist()))
    expected = {(q, int(ids[i])) for q, row in enumerate(exact) for i in np.argsort(-row)[:20]}
    assert len(found & expected) >= 0.99 * len(expected)


def _table(ids, data):
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(data.ravel()), data.shape[1]).cast(pa.list_(pa.float32()))
    return pa.table({"vec_id": pa.array(ids), "embedding": vectors})


def test_a_block_is_searched_piece_by_piece():
    rng = np.random.default_rng(6)
    data, ids = rng.standard_normal((40_000, 16)).astype(np.float32), np.arange(40_000)
    centres = {16: data.mean(axis=0).astype(np.float64)}
    index = near._indexer(centres, 21, np.float32)((pa.scalar(0),), _table(ids, data)).to_pylist()
    assert max(len(r["vectors"]) for r in index) <= near.PIECE_BYTES
    asked = near._query_blocks(np.float32)((pa.scalar(0),), _table(ids[:512], data[:512])).to_pylist()
    kinds = [("block", pa.int64()), ("dim", pa.int32()), ("part", pa.int64())]
    kinds += [(name, pa.binary()) for name in ("ids", "vectors", "codes", "length", "lean")]
    rows = [r | {"part": -1} for r in index] + [r | {"block": 0} for r in asked]
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))
    tracemalloc.start()
    try:
        found = pa.Table.from_batches(near._searcher(centres, 20, np.float32)(iter([batch])))
        # All estimates of the block at once would take 512 * 40,000 * 8 bytes.
        assert tracemalloc.get_traced_memory()[1] < 512 * 40_000 * 4
    finally:
        tracemalloc.stop()
    exact = data[:512].astype(float) @ data.T.astype(float)
    exact[np.arange(512), np.arange(512)] = -np.inf
    expected = {(q, int(i)) for q in range(512) for i in np.argsort(-exact[q])[:20]}
    got = {(r["query_id"], r["vec_id"]) for r in found.to_pylist()}
    assert len(got & expected) >= 0.99 * len(expected)
