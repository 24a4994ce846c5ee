"""Large groups of near copies, and copies with blocks cut or added, in the copies stage."""

import random
from itertools import combinations

import pyarrow.parquet as pq
import pytest

from tabwright.llm import simhash
from test_similar import similar_pairs
from tests_llm_help import brute_components

SF = "/root/testdata/sf0.01"


def found_in(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}


def substituted(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return words


@pytest.mark.parametrize("copies", [200, 1000])
def test_copies_alike_to_their_original_only(spark, copies):
    rng = random.Random(copies)
    original = [f"w{i}" for i in range(261)]
    texts = [" ".join(substituted(rng, original, 5)) for _ in range(copies)]
    texts.insert(copies // 2, " ".join(original))
    sets = [set(simhash.shingles(t, 5).tolist()) for t in texts]
    pairs = combinations(range(len(sets)), 2)
    alike = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    roots = brute_components(alike)
    assert sum(root == 0 for root in roots.values()) > 0.95 * copies
    assert found_in(spark, texts) == {i: roots.get(i, i) for i in range(len(texts))}


def edits(rng, words):
    n = len(words)
    cut, more = max(1, n * 15 // 100), [f"new{rng.random()}" for _ in range(n * 15 // 100)]
    at = rng.randrange(n - cut)
    return {
        "end cut": words[:-cut],
        "start cut": words[cut:],
        "middle cut": words[:at] + words[at + cut :],
        "appended": words + more,
        "put before": more + words,
        "substituted": substituted(rng, words, max(1, n // 50)),
    }


def test_copies_with_blocks_cut_or_added(spark):
    rng = random.Random(11)
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["text"]).to_pylist()
    texts = [t for t in (r["text"] for r in rows) if t and 60 <= len(t.split()) <= 1000][:150]
    kinds = []
    for i, text in enumerate(texts[:]):
        for kind, words in edits(rng, text.split()).items():
            kinds.append((kind, i, len(texts)))
            texts.append(" ".join(words))
    found = found_in(spark, texts)
    sets = [set(simhash.shingles(t, 5).tolist()) for t in texts]
    wanted, kept = {}, {}
    for kind, i, j in kinds:
        alike = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
        wanted[kind] = wanted.get(kind, 0) + alike
        kept[kind] = kept.get(kind, 0) + (alike and found[i] == found[j])
    print("wanted", wanted, "kept", kept)
    assert min(wanted.values()) > 50 and kept == wanted
    same = [(i, j) for i in range(len(texts)) for j in range(i) if simhash.words_of(texts[i]) == simhash.words_of(texts[j])]
    roots = brute_components([*similar_pairs(sets), *same])
    assert found == {i: roots.get(i, i) for i in range(len(texts))}
