"""What a worker remembers of pieces, and where the words of a stream of ids begin."""

import numpy as np
import pytest

from tabwright.llm import queries, tokenfile, tokens


@pytest.mark.parametrize("name,lower", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_of_earlier_blocks_are_not_encoded_again(monkeypatch, name, lower):
    reader = tokens.Words(queries.tokenizer_path(name), lower)
    asked, encoded = [], reader._encoded
    monkeypatch.setattr(reader, "_encoded", lambda p: asked.append(p.to_pylist()) or encoded(p))
    texts = [f"An old word, and new{chr(97 + i)}; Étés!" for i in range(20)]
    assert list(reader.texts(texts, 1)) == [reader.encode(t) for t in texts]
    asked = [x for pieces in asked for x in pieces]
    assert len(asked) == len(set(asked)) and sum("old" in x for x in asked) == 1


@pytest.mark.parametrize("bound", [0, 60, 400])
def test_pieces_of_most_blocks_are_kept_within_the_bound(monkeypatch, bound):
    monkeypatch.setattr(tokens, "PIECE_BYTES", bound)
    reader = tokens.Words(queries.tokenizer_path("byte_bpe_50k.json"), False)
    texts = [f"x often and new{chr(97 + i % 26)}{chr(97 + i // 26)}, often" for i in range(60)]
    for text, found in zip(texts, reader.texts(texts, 1)):
        assert found == reader.encode(text)
        assert len(reader.known) <= bound // tokens.PIECE_ROW
        assert reader.known_sizes.sum() == len(reader.known_ids)
    assert bound < 400 or "often" in reader.known.to_pylist()


@pytest.mark.parametrize("window", [1, 7, 1 << 17])
def test_words_begin_where_a_walk_says(monkeypatch, window):
    monkeypatch.setattr(tokenfile, "WINDOW", window)
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 40, 3_000):
        step = rng.choice(np.array([1, 2, 3, 4, 60, 240], np.uint8), n)
        walk, i = [], 0
        while i < n:
            walk.append(i)
            i += int(step[i])
        assert tokenfile._starts(step).tolist() == walk
