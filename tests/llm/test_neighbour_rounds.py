"""The two rounds of visits next to all distances."""

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from tabwright.llm import neighbours


def plain(query_ids, queries, bounds, ids, vectors, count):
    out = []
    for i, q, bound in zip(query_ids, queries, bounds):
        nearest = {}
        for j, v in zip(ids, vectors):
            gap = float(np.sqrt(((v - q) ** 2).sum()))
            if j != i and gap <= bound:
                nearest[j] = min(gap, nearest.get(j, gap))
        best = sorted((d, j) for j, d in nearest.items())[:count]
        out += [(i, j, round(d, 9)) for d, j in best]
    return sorted(out)


def test_block_with_bounds_ties_and_repeated_ids(monkeypatch):
    monkeypatch.setattr(neighbours, "PAIRS", 500)
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (200, 3)).astype(float)
    ids = np.arange(200)
    ids[150:] = ids[:50]
    queries, query_ids = vectors[:40], ids[:40]
    for bounds in (np.full(40, np.inf), np.full(40, 1.0), np.zeros(40), rng.random(40) * 3):
        got = neighbours._top(query_ids, query_ids, queries, bounds, ids, vectors, 7)
        rows = sorted(
            (i, j, round(d, 9)) for i, j, d in zip(got["query_id"], got["vec_id"], got["score"])
        )
        assert rows == plain(query_ids, queries, bounds, ids, vectors, 7)


def test_a_cell_is_cut_no_finer_than_its_vectors_allow():
    rng = np.random.default_rng(4)
    tree = neighbours.fit_tree(rng.normal(size=(5_000, 16)))
    assert 5_000 / neighbours.LEAF <= tree.leaves <= 4 * 5_000 / neighbours.LEAF


def test_two_rounds_find_what_all_distances_give(spark, monkeypatch):
    """Isotropic vectors, which no tree can prune, with a crowd of equal ones and ties:
    more leaves than the first round visits, and blocks smaller than the crowd."""
    monkeypatch.setattr(neighbours, "TARGET_RECALL", 1.0)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(2_400, 12))
    vectors[:800] = vectors[0]
    vectors[900:930] = vectors[930:960]
    frame = spark.createDataFrame(
        pd.DataFrame({"vec_id": np.arange(2_400), "embedding": vectors.tolist(), "leaf": "x"})
    )
    is_query = F.col("vec_id") % 100 == 0
    found = neighbours.search(frame, is_query, target_blocks=(100, 5)).collect()
    got = sorted((r["query_id"], r["vec_id"], round(r["score"], 9)) for r in found)
    asked = np.arange(0, 2_400, 100)
    wanted = plain(asked, vectors[asked], [np.inf] * 24, np.arange(2_400), vectors, 10)
    assert len(got) == len(wanted) == 240
    assert len(set(got) & set(wanted)) >= 0.95 * len(wanted)
    for query in asked:
        ranks = sorted((r["rank"], r["score"], r["vec_id"]) for r in found if r["query_id"] == query)
        assert [r for r, _, _ in ranks] == list(range(1, 11))
        assert [x[1:] for x in ranks] == sorted(x[1:] for x in ranks)
