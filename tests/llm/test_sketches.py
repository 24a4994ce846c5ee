"""Sketches of shingle sets, which keep most texts of the copies stage from being fetched."""

import random

import numpy as np

from tabwright.llm import simhash


def test_sketches_never_put_sets_further_apart_than_they_are():
    rng = np.random.default_rng(3)
    for size, other, common in [(0, 0, 0), (0, 9, 0), (1, 1, 1), (40, 900, 30), (500, 500, 460), (500, 500, 0), (20_000, 19_000, 18_500)]:
        drawn = rng.integers(-(1 << 63), 1 << 63, size + other - common)
        a, b = np.sort(drawn[:size]), np.sort(drawn[size - common :])
        found = simhash.apart(simhash.sketch(a), simhash.sketch(b))
        truth = len(np.setxor1d(a, b))
        assert found == simhash.apart(simhash.sketch(b), simhash.sketch(a)) <= truth
        assert 2 * found >= truth or size != other  # and tell sets of one size apart
        assert len(simhash.sketch(a)) <= max(8, size)


def test_only_texts_that_may_be_similar_are_fetched(spark, monkeypatch):
    rng, kept, saved = random.Random(7), {}, simhash.saved

    def noted(df, name, *rest):
        kept.setdefault(name, []).append(table := saved(df, name, *rest))
        return table

    monkeypatch.setattr(simhash, "saved", noted)
    passages = [[f"p{i}.{k}" for k in range(100)] for i in range(30)]  # each in two texts
    texts = [" ".join([f"a{rng.random()}" for _ in range(60)] + passages[i // 2]) for i in range(60)]
    texts += [f"{texts[0]} more words", f"{texts[1]} others", texts[2].upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert found == {i: {60: 0, 61: 1, 62: 2}.get(i, i) for i in range(63)}
    assert sum(table.count() for table in kept["pairs"]) > 20
    assert {r["fp"] for table in kept["shingles"] for r in table.collect()} == {
        simhash.whole_text(texts[i]) for i in (0, 1, 60, 61)
    }


def test_sketches_are_made_once(spark, capsys):
    texts = ["a b c d e f g", "A b c d  e f g", "x y z", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = spark.createDataFrame([(simhash.whole_text(t),) for t in texts[1:3]], "fp long")
    made = simhash._sketches(docs, wanted, 5)
    made.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    found = {r["fp"]: (r["n"], bytes(r["sketch"])) for r in made.collect()}
    sets = {simhash.whole_text(t): simhash.shingles(t, 5) for t in texts[1:3]}
    assert found == {fp: (len(s), simhash.sketch(s)) for fp, s in sets.items()}
