"""Whitening next to numpy's own eigenvectors and next to exact whole numbers."""

from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from tabwright.llm import queries, whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, x string, component string, n int"


def against_numpy(rows, vectors, count=16):
    """Compare result rows with what (id, vector) pairs of usable rows must give."""
    cells = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in vectors]
    distinct = sorted(set(tuple(x) for _, x in cells))
    n, x = len(distinct), np.array(distinct, float)
    sums = [sum(int(v[k]) for v in distinct) for k in range(len(distinct[0]))]
    centred = x - x.mean(axis=0)
    values, components = np.linalg.eigh(centred.T @ centred / n)
    values, components = values[::-1], components[:, ::-1]
    kept = min(count, int((values > 1e-11 * values[0]).sum()))
    assert len(rows) == kept * len(cells)
    wanted = sorted(
        ((i, k + 1, sum((n * v - s) ** 2 for v, s in zip(c, sums))) for i, c in cells for k in range(kept)),
        key=repr,
    )
    assert sorted(((r["vec_id"], r["component"], r["deviation"]) for r in rows), key=repr) == wanted
    assert {r["n"] for r in rows} == {n}
    (error,) = {r["identity_error"] for r in rows}
    assert error < 1e-8
    place = {}
    for i, c in cells:
        place.setdefault(i, []).append(c)
    signs = {}
    for r in rows:
        k = r["component"] - 1
        assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
        if len(place[r["vec_id"]]) > 1:
            continue
        exact = [float(v - Fraction(s, n)) for v, s in zip(place[r["vec_id"]][0], sums)]
        expected = np.array(exact) @ components[:, k] / np.sqrt(values[k])
        gap = min(abs(values[k] - v) for m, v in enumerate(values) if m != k)
        if gap > 1e-6 * values[0] and abs(expected) > 1e-6:
            sign = signs.setdefault(k, np.sign(expected * r["whitened"]))
            assert sign * r["whitened"] == pytest.approx(expected, rel=1e-6, abs=1e-8)
    assert signs


def test_whole_table(spark):
    given = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    rows = queries.whitened_embeddings(spark, SF).collect()
    against_numpy(rows, [(r["vec_id"], r["embedding"]) for r in given])


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x", "c", 1) for i, v in vectors], SCHEMA)


def test_odd_rows_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    good = [(i, (rng.normal(size=5) * [9, 5, 3, 2, 1]).tolist()) for i in range(80)]
    good += [(7, good[7][1]), (100, good[7][1]), (None, good[8][1])]
    bad = [
        (200, None), (201, []), (202, [None] + [1.0] * 4), (203, [float("nan")] * 5),
        (204, [float("inf")] + [0.0] * 4), (205, [1.0, 2.0]), (206, [1e300] * 5),
    ]
    rows = whitening.whitened(frame(spark, good + bad)).collect()
    assert {r["component"] for r in rows} == {1, 2, 3, 4, 5}
    against_numpy(rows, good)


def test_rank_below_width(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-200, 200, size=(40, 3))
    wide = base @ rng.integers(-3, 4, size=(3, 12))
    rows = whitening.whitened(frame(spark, [(i, (v / 64).tolist()) for i, v in enumerate(wide)])).collect()
    assert {r["component"] for r in rows} == {1, 2, 3}
    against_numpy(rows, [(i, v / 64) for i, v in enumerate(wide)])


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, vectors):
    found = whitening.whitened(frame(spark, vectors))
    assert found.collect() == []
    assert found.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    ]


def test_factor_and_rotations():
    rng = np.random.default_rng(5)
    for size, rank in ((1, 1), (2, 2), (9, 9), (33, 20), (64, 64)):
        a = rng.normal(size=(size, rank)) * np.geomspace(1, 1e-4, rank)
        matrix = a @ a.T
        factor = whitening.pivoted_cholesky(matrix)
        assert factor.shape == (size, rank)
        assert np.abs(factor @ factor.T - matrix).max() < 1e-12 * np.abs(matrix).max()
        order = np.argsort([np.flatnonzero(row)[-1] for row in factor], kind="stable")
        below = np.triu(factor[order][:rank], 1)
        assert rank < size or np.abs(below).max(initial=0.0) == 0.0
        vectors, values = whitening.one_sided_jacobi(factor)
        assert np.abs(vectors.T @ vectors - np.eye(rank)).max() < 1e-12
        expected = np.linalg.eigvalsh(matrix)[::-1][:rank]
        assert values == pytest.approx(expected, rel=1e-7, abs=1e-13 * values[0])
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * values[0]


def test_deviations_past_a_double_are_exact_and_past_a_long_an_error():
    model = whitening.Whitening(10**6, np.array([10**12 + 7, 0]), np.eye(2), np.ones(2), 2.0)
    x = np.array([[1_000_900, 1_001], [1_000_003, 2_000]])
    exact = [(10**6 * int(a) - 10**12 - 7) ** 2 + (10**6 * int(b)) ** 2 for a, b in x]
    assert whitening.deviations(x, model).tolist() == exact
    with pytest.raises(OverflowError):
        whitening.deviations(x * 4_000, model)
