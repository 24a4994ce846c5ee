"""The copies stage's operator against all pairs of shingle sets of the given documents."""

from collections import Counter, defaultdict
from itertools import combinations

import pyarrow.parquet as pq

from tabwright.llm import simhash
from tests_llm_help import brute_components

SF = "/root/testdata/sf0.01"


def similar_pairs(sets):
    """Index pairs of the different sets whose Jaccard similarity is 0.8 or more."""
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for shingle in s:
            holders[shingle].append(i)
    common = Counter(p for held in holders.values() for p in combinations(held, 2))
    return [
        (i, j) for (i, j), c in common.items() if c >= 0.8 * (len(sets[i]) + len(sets[j]) - c)
    ]


def test_given_documents(spark):
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert set(found) == {r["doc_id"] for r in rows}
    sets = [set(simhash.shingles(r["text"], 5).tolist()) for r in rows]
    pairs = [(rows[i]["doc_id"], rows[j]["doc_id"]) for i, j in similar_pairs(sets)]
    together = sum(found[u] == found[v] for u, v in pairs)
    print("links", len(pairs), "kept", together)
    assert pairs and together >= 0.95 * len(pairs)
    whole = brute_components(pairs)
    for doc_id, component in found.items():  # nothing is joined that is not linked
        assert component == doc_id or whole.get(doc_id) == whole.get(component)


def test_same_words_in_another_order_stay(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(reversed(words))), (3, " ".join(words).upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 1}
