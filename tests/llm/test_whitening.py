from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from haberdash.llm import whitening as white

SCHEMA = "vec_id long, embedding array<double>, x string, dim int, n string, component int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1, "b", 2) for i, v in rows], SCHEMA)


def brute(rows, components=4):
    """Expected rows by exact sums and a library's eigenvalues."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    trace = np.trace(centred.T @ centred / n)
    out = {}
    for i, x in kept:
        exact = sum((n * a - int(s)) ** 2 for a, s in zip(x, total))
        out[i] = (n, exact, (np.array(x) - total / n) @ basis / np.sqrt(values), values / trace)
    return out


def test_rows_equal_an_eigenvalue_routine(spark):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((500, 12)) @ np.diag(np.linspace(3, 0.2, 12))
    data[100:260] = data[5]  # a third of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    expected = brute(rows)
    found = white.whiten(vectors(spark, rows)).collect()
    assert len(found) == 4 * len(rows)
    signs = {}
    for r in found:
        n, exact, values, shares = expected[r["vec_id"]]
        c = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, exact) and n == 500 - 160
        if abs(values[c]) > 1e-6:
            assert signs.setdefault(c, np.sign(values[c] * r["whitened"])) == np.sign(values[c] * r["whitened"])
        assert abs(abs(values[c]) - abs(r["whitened"])) < 1e-9
        assert abs(r["explained"] / shares[c] - 1) < 1e-9
        assert r["identity_error"] < 1e-10


def test_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    expected = brute(rows)
    found = white.op13_whitening(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == 4 * len(rows)
    for r in found:
        n, exact, values, shares = expected[r["vec_id"]]
        assert (r["n"], r["deviation"]) == (n, exact)
        assert abs(abs(values[r["component"] - 1]) - abs(r["whitened"])) < 1e-7
        assert abs(r["explained"] / shares[r["component"] - 1] - 1) < 1e-6 and r["identity_error"] < 1e-4


@pytest.mark.parametrize(
    "values",
    [
        [5.0, 3.0, 1.0, 0.5],
        [1.0] * 6,
        [7.0, 7.0, 7.0, 2.0, 2.0],
        [1e8, 1.0, 1e-3, 1e-8, 0.0, 0.0],
        [3.0],
        list(np.geomspace(1, 1e-12, 40)),
        [0.0, 0.0, 0.0],
    ],
)
def test_spectrum(values):
    rng = np.random.default_rng(len(values))
    turn = np.linalg.qr(rng.standard_normal((len(values),) * 2))[0]
    matrix = turn @ np.diag(values) @ turn.T
    found, basis = white.spectrum(matrix)
    scale = max(map(abs, values))
    assert np.allclose(found, sorted(values, reverse=True), rtol=0, atol=1e-13 * scale)
    assert np.allclose(basis.T @ basis, np.eye(len(values)), atol=1e-13)
    assert np.allclose(basis @ np.diag(found) @ basis.T, matrix, rtol=0, atol=1e-13 * max(scale, 1e-300))


@pytest.mark.parametrize("seed", range(4))
def test_polar_factor_is_the_sign(seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    values, basis = np.linalg.eigh(a)
    assert np.allclose(white.polar_factor(a), basis @ np.diag(np.sign(values)) @ basis.T, atol=1e-10)


def test_awkward_rows(spark):
    bad = [None, [], [1.0, None, 0.0], [math.nan, 0.0, 0.0], [math.inf, 0.0, 0.0], [1e300, 0.0, 0.0], [1.0, 2.0]]
    good = [[0.1, -0.2, 0.3], [0.5, 0.1, -0.9], [0.1, -0.2, 0.3], [-0.3, 0.0, -0.0]]
    rows = [(i, v) for i, v in enumerate(bad + good)] + [(None, good[0])]
    found = white.whiten(vectors(spark, rows)).collect()
    # Three distinct vectors span two dimensions.
    assert {r["component"] for r in found} == {1, 2} and {r["n"] for r in found} == {3}
    assert sorted({-1 if r["vec_id"] is None else r["vec_id"] for r in found}) == [-1, 7, 8, 9, 10]
    expected = brute([(i, v) for i, v in rows if i in (7, 8, 9, 10)], 2)
    assert all(r["deviation"] == expected[r["vec_id"]][1] for r in found if r["vec_id"] is not None)
    assert white.whiten(vectors(spark, [])).collect() == []
    assert white.whiten(vectors(spark, [(1, good[0]), (2, good[0])])).collect() == []
    assert white.whiten(vectors(spark, [(1, None)])).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error",
    ]


def test_large_components_are_exact(spark):
    rows = [(1, [2.0**40, 1.0]), (2, [-(2.0**40), 2.0]), (3, [3.0, 5.0])]
    found = {r["vec_id"]: r for r in white.whiten(vectors(spark, rows)).collect()}
    scaled = [[256 * Fraction(c) for c in v] for _, v in rows]
    for i, x in enumerate(scaled, 1):
        exact = sum((3 * a - sum(y[k] for y in scaled)) ** 2 for k, a in enumerate(x))
        assert found[i]["deviation"] == (int(exact) if exact < 2**63 else None)
    assert found[1]["deviation"] is None and found[3]["deviation"] is not None
