"""Repeated ids in the search, repeated ledger rows, and columns with names used inside."""

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from tabwright.llm import ledger, neighbours


def test_repeated_ids_of_queries_and_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1, 400)]
    rows += [(100, rows[99][1])] * 2 + [(200, rng.normal(size=6).tolist())]
    rows += [(i, rows[i - 1][1]) for i in range(1, 60)] + [(7, rows[100][1]), (None, rows[0][1])]
    bad = [(500, None), (600, []), (700, [0.0] * 6), (800, [1.0] * 5)]
    schema = "vec_id long, embedding array<double>"
    frame = spark.createDataFrame(rows + bad, schema)
    found = neighbours.search(frame, F.col("vec_id") % 100 == 0).collect()
    usable = [(i, v) for i, v in rows if i is not None]
    wanted = []
    for i, v in {(i, tuple(v)) for i, v in usable if i % 100 == 0}:
        nearest = {}
        for j, u in usable:
            if j != i:
                gap = float(np.sqrt(((np.array(u) - v) ** 2).sum()))
                nearest[j] = min(gap, nearest.get(j, gap))
        best = sorted((d, j) for j, d in nearest.items())[:10]
        wanted += [(i, rank, j, round(d, 9)) for rank, (d, j) in enumerate(best, 1)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in found)
    assert len(got) == len(wanted) == 40
    assert len(set(got) & set(wanted)) >= 0.9 * len(wanted)
    none = neighbours.search(frame.limit(0), F.col("vec_id") % 100 == 0)
    assert none.collect() == []


def test_a_pair_that_is_in_the_ledger_twice_gives_one_row_each(spark):
    docs = spark.createDataFrame(
        [(1, "password = abcdefgh1", "s", b"b", 5.0), (2, "clean", "t", None, 6.0)],
        "doc_id long, text string, spans string, blob binary, score double",
    )
    known = ledger.scan_unseen(docs, ledger.empty_ledger(spark))
    found = ledger.findings(docs, known.unionByName(known)).orderBy("doc_id").collect()
    assert [(r["doc_id"], len(r["spans"]), r["blob"], r["score"]) for r in found] == [
        (1, 1, b"b", 5.0), (2, 0, None, 6.0),
    ]
    assert ledger.scan_unseen(docs, known).collect() == []
    assert ledger.scan_unseen(docs, known, "other rules").count() == 2


def test_the_toxicity_stage_hands_on_a_column_called_score(spark):
    docs = spark.createDataFrame([(1, "some words", 5.0, "x")], "doc_id long, text string, score double, _toxic string")
    left = corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.001")
    assert [tuple(r) for r in left.collect()] == [(1, "some words", 5.0, "x")]
