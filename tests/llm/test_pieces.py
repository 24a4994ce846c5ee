"""Blocks of texts against the tokenizer itself: every piece goes to it once a block."""

import numpy as np
import pytest

from tabwright.llm import queries, tokenfile, tokens

TEXTS = [
    "The fox, the fox. The FOX!\nThe fox", "x\n\ny \nz", "\nlead", "trail\n", "a  b", "q ", None, "",
    "\u0140\u00b2\n\n", "\u00bd\u0131\u0178 half\u00bd", "na\u00efve, \u00c9t\u00e9; \u017fo", "\0Hello \0", "don't 3.14",
    "<|endoftext|> a", "wide\u3000 gap", "\u65e5\u672c fox", "fox_fox [x] {y}",
]


@pytest.mark.parametrize("name,lower", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
@pytest.mark.parametrize("block", [20, 1 << 22])
def test_ids_are_those_of_whole_texts(monkeypatch, name, lower, block):
    monkeypatch.setattr(tokens, "BLOCK_CHARS", block)
    reader = tokens.Words(queries.tokenizer_path(name), lower)
    for text, found in zip(TEXTS * 2, reader.texts(TEXTS * 2), strict=True):
        assert found == (reader.encode(text) if text else b""), text


@pytest.mark.parametrize("name,lower", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_plain_words_are_cut_by_column_and_never_one_by_one(monkeypatch, name, lower):
    reader = tokens.Words(queries.tokenizer_path(name), lower)
    asked = []
    monkeypatch.setattr(reader, "_learn", asked.append)
    texts = [f"So Word{chr(97 + i % 26)}{chr(97 + i // 26)}, the fox.\nAnd so" for i in range(600)]
    found = list(reader.texts(texts))
    assert found == [reader.encode(t) for t in texts]
    assert set().union(*asked) <= {"\0\n"} and len(reader) < 20


def test_blocks_of_ids_come_back():
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.geometric(0.01, 3_000), np.zeros(700), [2**60 - 1, 2**60, 5]])
    data, before = tokenfile.encode(values.astype(np.uint64))
    assert (tokenfile.decode(data, len(values)) == values.astype(np.uint64)).all() and before[0] == 0
