from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SMALL
from tramwise.llm import whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def reference(x):
    """(projections, shares) by eigh of the covariance, falling."""
    centred = x - x.mean(0)
    values, turn = np.linalg.eigh(centred.T @ centred / len(x))
    values, turn = values[::-1], turn[:, ::-1]
    return centred @ turn / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()


def pivoted(rows):
    table = pd.DataFrame([r.asDict() for r in rows])
    return table.pivot(index="vec_id", columns="component", values="whitened")


def test_whole_table_as_eigh(spark):
    path = f"{SMALL}/embeddings.parquet"
    given = pd.read_parquet(path)
    x = np.floor(64 * np.stack(given.embedding).astype(float))
    n = len(x)
    rows = whitening.whiten(spark.read.parquet(path)).collect()
    assert len(rows) == 32 * n and {r.n for r in rows} == {n}
    expected, shares = reference(x)
    found = pivoted(rows).loc[given.vec_id].to_numpy()
    sign = np.sign((found * expected[:, :32]).sum(0))
    assert np.abs(found * sign - expected[:, :32]).max() < 1e-8
    assert {(r.component, round(r.explained, 12)) for r in rows} == {
        (k + 1, round(s, 12)) for k, s in enumerate(shares[:32].tolist())
    }
    assert max(r.identity_error for r in rows) < 1e-12
    whole = x.astype(int).astype(object)
    exact = ((n * whole - whole.sum(0)) ** 2).sum(1)
    assert {(r.vec_id, int(r.deviation)) for r in rows} == set(zip(given.vec_id.tolist(), exact.tolist()))


def test_polynomial_of_an_integer_matrix(spark):
    draw = np.random.default_rng(5)
    a = draw.integers(-(10**6), 10**6, (9, 9)).astype(object)
    a = a.T @ a
    c = whitening.characteristic_polynomial(spark, a.tolist())
    # Newton's identities over exact traces.
    power, traces = np.identity(9, dtype=int).astype(object), []
    for _ in range(9):
        power = power @ a
        traces.append(sum(power[i, i] for i in range(9)))
    e = [Fraction(1)]
    for k in range(1, 10):
        e.append(sum((-1) ** (i - 1) * e[k - i] * traces[i - 1] for i in range(1, k + 1)) / k)
    assert c == [int((-1) ** k * e[k]) for k in range(9, -1, -1)]


def test_hessenberg_with_zero_pivots():
    a = np.array([[2, 0, 0, 0], [0, 3, 0, 1], [0, 0, 3, 0], [0, 1, 0, 5]])
    p = 1009
    # (x - 2)(x - 3)((x - 3)(x - 5) - 1)
    expected = np.polymul(np.polymul([1, -2], [1, -3]), [1, -8, 14])[::-1] % p
    assert whitening.polynomial_modulo(a.astype(np.int64), p).tolist() == expected.tolist()


def test_roots_are_counted_and_isolated():
    c = np.array([1], object)
    for root in (1, 5, 5, 7, 10**9):
        c = np.convolve(c, np.array([-root, 1], object))
    c = [int(v) for v in c]
    assert [whitening.roots_above(c, at, 0) for at in (0, 1, 4, 5, 7, 10**9)] == [5, 4, 4, 2, 1, 0]
    assert whitening.roots_above(c, 9, 1) == 4 and whitening.distinct_roots(c) == 4
    pieces, gap = whitening.isolate(c, 5)
    assert [times for *_, times in pieces] == [1, 1, 2, 1] and 0 < gap <= 2
    roots = [whitening.narrow(c, *piece, 20) for piece in pieces]
    assert [r / 2**20 for r in roots] == [10**9, 7, 5, 1]


@pytest.mark.parametrize("spread", [1, 1000])
def test_repeated_and_missing_variances(spark, spread):
    """Two equal variances, one place without any."""
    corners = [(a, b, 3, c * 2) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]
    rows = [(k, [float(v * spread) for v in corner]) for k, corner in enumerate(corners)]
    found = whitening.whiten(vectors(spark, rows)).collect()
    assert {r.component for r in found} == {1, 2, 3}
    assert sorted({round(r.explained, 9) for r in found}) == [round(1 / 6, 9), round(2 / 3, 9)]
    assert max(r.identity_error for r in found) < 1e-12
    own = pivoted(found).to_numpy()
    assert np.abs(own.T @ own / 8 - np.identity(3)).max() < 1e-12


def test_nearly_equal_variances(spark):
    draw = np.random.default_rng(8)
    x = draw.integers(-1000, 1000, (60, 6))
    rows = [(k, [float(v) / 64 for v in row]) for k, row in enumerate(np.r_[x, -x, x[:1] * 0].tolist())]
    found = whitening.whiten(vectors(spark, rows), count=6).collect()
    expected, shares = reference(np.array([r for _, r in rows]) * 64)
    assert np.allclose(sorted({r.explained for r in found}, reverse=True), shares, rtol=1e-9)
    assert max(r.identity_error for r in found) < 1e-12


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0]), (6, []), (7, [-inf, 0.0])]
    good = [(8, [1.0, 2.0]), (9, [3.0, -1.0]), (9, [3.0, -1.0]), (None, [0.5, 0.25]), (10, [2.0, 2.0])]
    clash = vectors(spark, rows + good).withColumns({c: F.lit("x") for c in ("vector", "n", "component", "k", "d")})
    found = whitening.whiten(clash).collect()
    assert sorted((r.vec_id or 0, r.component) for r in found) == sorted(
        (i or 0, k) for i, _ in good for k in (1, 2)
    )
    assert {r.n for r in found} == {5}
    assert whitening.whiten(vectors(spark, rows[:4])).count() == 0
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])).count() == 0


def test_very_large_entries(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [1e15, -7.0]), (4, [0.0, 5.0])]
    found = whitening.whiten(vectors(spark, rows)).collect()
    assert len(found) == 8 and max(r.identity_error for r in found) < 1e-9
    assert {r.deviation for r in found if r.vec_id == 1} == {None}
    small = whitening.whiten(vectors(spark, [(1, [1e12, 1.0]), (2, [-1e12, 2.0]), (3, [5.0, 5.0])])).collect()
    y = np.array([[64 * 10**12, 64], [-64 * 10**12, 128], [320, 320]], object)
    exact = ((3 * y - y.sum(0)) ** 2).sum(1)
    assert {(r.vec_id, int(r.deviation)) for r in small} == set(zip((1, 2, 3), exact.tolist()))
