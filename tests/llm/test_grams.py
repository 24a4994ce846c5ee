"""The classifier's two ways to score a text."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tabwright.llm import grams

ODD = ["", None, "  ", "ab", "a", "Straße STRASSE", "İstanbul ΟΔΟΣ", "x\x1cy\u3000z \u2028", "é" * 40, " lead trail "]


def test_many_texts_at_a_time_as_one_by_one():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() + ODD
    words = sorted({w for t in texts if t for w in grams.words_of(t)})
    rng = np.random.default_rng(1)
    names = sorted({g for w in words[::9] for g in grams.grams_of(w)})
    weights = {g: tuple(rng.normal(size=3).tolist()) for g in names}
    for model in (grams.GramModel(weights, (0.1, 0.2, -0.3)), grams.GramModel({}, (0.5, 0.1, 0.0))):
        score = model.scorer()
        counts, shares = model.shares(pa.array(texts, pa.large_string()))
        for text, count, share in zip(texts, counts, shares, strict=True):
            own = list(grams.words_of(text)) if text else []
            assert count == len(own)
            assert np.abs(share - score(own)).max() < 1e-9


def test_blocks_of_texts_and_one_longer_than_a_block(monkeypatch):
    model = grams.GramModel({"=ab": (0.0, 1.0), "^fuz": (1.0, 0.0), "$zz": (0.5, 0.25)}, (0.0, 0.1))
    texts = ["ab fuzz", None, "", "x " * 400 + "fuzzy Ab", "fuzz ab ab", " ", "ab", "y" * 300] * 5
    whole = model.shares(pa.array(texts, pa.large_string()))
    for block in (1, 7, 64, 500):
        monkeypatch.setattr(grams, "BLOCK_BYTES", block)
        counts, shares = model.shares(pa.array(texts, pa.large_string()))
        assert counts.tolist() == whole[0].tolist() == [len((t or "").split()) for t in texts]
        assert np.allclose(shares, whole[1], rtol=1e-14)
    assert [x.tolist() for x in model.shares(pa.array([], pa.large_string()))] == [[], []]
