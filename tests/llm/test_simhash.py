"""Near-duplicates against brute force over every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm import simhash
from tabwright.llm.links import components
from tests_llm_help import brute_components, texts_frame


@pytest.mark.parametrize("radius", [1, 3, 7])
def test_masks_cover(radius):
    rng = np.random.default_rng(0)
    masks = simhash.covering_masks(radius, 0)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(500):
        flips = sum(1 << int(i) for i in rng.choice(64, radius, replace=False))
        assert any(flips & m == 0 for m in masks)


def test_components(spark):
    edges = [(5, 3), (3, 9), (9, 5), (7, 8), (20, 20), (-4, 7), *((i, i + 1) for i in range(100, 140))]
    found = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == brute_components(edges)


@pytest.mark.parametrize("bucket", [2, 512])
def test_links_join_what_is_near(spark, bucket):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30)
    values = {int(b) ^ sum(1 << int(i) for i in rng.choice(63, 3)) for b in base for _ in range(6)}
    values |= {int(b) for b in base} | {0, 7}
    frame = spark.createDataFrame([(v,) for v in sorted(values)], "fp long")
    found = simhash.links(frame, 3, bucket).collect()
    assert all(bin(u ^ v).count("1") <= 3 for u, v in found)
    near = [(u, v) for u in values for v in values if u > v and (u ^ v).bit_count() <= 3]
    assert brute_components(found) == brute_components(near)


def test_documents(spark):
    docs, texts = texts_frame(spark)
    rows = simhash.digest_rows(simhash.near_duplicates(docs)).collect()
    assert len(rows) == len(texts)
    prints = [simhash.fingerprint(t, 3) for _, t in texts]
    near = [
        (i, j)
        for i in range(len(texts))
        for j in range(i)
        if (prints[i] ^ prints[j]).bit_count() <= 3
    ]
    roots = brute_components(near)
    group = [roots.get(i, i) for i in range(len(texts))]
    want = []
    for i, (doc_id, _) in enumerate(texts):
        ids = [texts[j][0] for j in range(len(texts)) if group[j] == group[i] and texts[j][0] is not None]
        want.append((doc_id, f"{prints[i]:016x}", min(ids) if ids else None))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_near_copies_by_shingles(spark):
    words = [f"w{i}" for i in range(400)]
    copy = [*words[:200], "changed", *words[201:]]
    other = [f"v{i}" for i in range(400)]
    rows = [(4, " ".join(words)), (2, " ".join(copy)), (1, " ".join(other)), (9, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert found == {4: 2, 2: 2, 1: 1, 9: 8, 8: 8}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert docs.select(F.lit(1)).count() == 0
