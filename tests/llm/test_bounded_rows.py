"""What a worker holds of texts at once is bounded: counted grams and sets of shingles."""

from collections import Counter

import numpy as np
import pandas as pd

from tabwright.llm import grams, mixing, simhash


def test_grams_are_handed_on_before_there_are_too_many(monkeypatch):
    monkeypatch.setattr(grams, "COUNTED", 100, raising=False)
    texts = [f"one two word{i} other{i % 7}" for i in range(60)]
    batch = pd.DataFrame({"text": texts, "label": [i % 2 for i in range(60)]})
    frames = list(grams._count(lambda: grams.words_of)(iter([batch])))
    assert max(map(len, frames)) < 150
    counts: Counter = Counter()
    for frame in frames:
        for gram, label, n in frame[["gram", "label", "n"]].itertuples(index=False):
            counts[gram, label] += n
    plain: Counter = Counter()
    for text, label in zip(texts, batch["label"]):
        plain.update((g, label) for g in {g for w in text.split() for g in grams.grams_of(w)})
    assert counts == plain


def test_texts_are_taken_in_slices():
    batch = pd.Series([f"text {i}" for i in range(2 * simhash.SLICE + 3)])
    parts = list(simhash._slices(iter([batch])))
    assert [len(p) for p in parts] == [simhash.SLICE, simhash.SLICE, 3]
    assert pd.concat(parts).tolist() == batch.tolist()


def test_posteriors_of_arrow_texts(spark):
    model = grams.GramModel({"=red": (1.0, -1.0, 0.0), "^blu": (0.0, 2.0, 0.5)}, (0.1, 0.2, 0.3))
    rows = [(0, "red blue"), (1, None), (2, ""), (3, "Red red\tgreen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = model.scorer()
    found = {r["doc_id"]: r for r in mixing.with_posteriors(docs, model).collect()}
    for i, text in rows:
        words = list(grams.words_of(text or ""))
        assert found[i]["tokens"] == len(words)
        assert np.allclose(found[i]["posterior"], score(words))
