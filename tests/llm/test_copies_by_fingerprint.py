"""The copies stage links by SimHash fingerprints before anything else."""

from itertools import combinations

import corpus_pipeline
from tabwright.llm import simhash
from tests_llm_help import brute_components, texts_frame


def test_pairs_connect_near_fingerprints(spark):
    docs, texts = texts_frame(spark)
    prints = {simhash.whole_text(t): simhash.fingerprint(t, 3) for _, t in texts}
    near = [p for p in combinations(prints, 2) if (prints[p[0]] ^ prints[p[1]]).bit_count() <= 3]
    found = [tuple(r) for r in simhash.fingerprint_pairs(docs).collect()]
    assert all(u > v for u, v in found)
    assert brute_components(found) == brute_components(near)


def test_fingerprints_alone_find_their_copies(spark, monkeypatch):
    words = [f"w{i}" for i in range(3_000)]
    copies = [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in (500, 1_500, 2_500)]
    prints = [simhash.fingerprint(t, 3) for t in (" ".join(words), *copies)]
    close = [1, *(i for i, p in enumerate(prints[1:], 2) if (p ^ prints[0]).bit_count() <= 3)]
    assert len(close) > 1
    other = " ".join(f"v{i}" for i in range(300))
    rows = [(i, t) for i, t in enumerate((" ".join(words), *copies), 1) if i in close] + [(9, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = lambda roots, similarity: lambda batches: (b.iloc[:0].reindex(columns=["u", "v"]) for b in batches)
    monkeypatch.setattr(simhash, "_open_pairs", none)
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 9]


def test_links_that_the_shingles_do_not_bear_out_are_dropped(spark):
    line = "the same words " * 4_000
    rows = [(1, line + " ".join(f"a{i}" for i in range(20))), (2, line + " ".join(f"b{i}" for i in range(20)))]
    prints = [simhash.fingerprint(t, 3) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= 3
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2]
