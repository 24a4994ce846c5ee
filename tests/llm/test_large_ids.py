"""Ids that a double cannot hold, beside rows without an id; words learnt in blocks."""

import zlib

import numpy as np
import pytest

from tabwright.llm import packing, queries, tokenfile, tokens

BIG = [2**53 + 1, 2**53 + 2, 2**53, -(2**53) - 1, None, 2**63 - 1, 0, None]


def frame(spark):
    rows = [(i, f"text number {k} of it", "x", 1) for k, i in enumerate(BIG)]
    return spark.createDataFrame(rows, "doc_id long, text string, named string, ids int").coalesce(1)


def plain_ids(path, text, end):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, end], "<u4")


def test_token_files_keep_every_id(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    rows = tokenfile.digest_rows(tokenfile.written_and_read(frame(spark), path)).collect()
    wanted = sorted((i, k) for k, i in enumerate(BIG) if i is not None)
    found = sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in found] == [i for i, _ in wanted]
    for r, (_, k) in zip(found, wanted):
        ids = plain_ids(path, f"text number {k} of it", 2)
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    assert sum(r["doc_id"] is None for r in rows) == 2
    starts = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


@pytest.mark.parametrize("length", [4, 2048])
def test_every_piece_holds_its_documents_ids(spark, length):
    path = queries.tokenizer_path("word_bpe_49k.json")
    pieces = packing.pack(frame(spark), path, length=length, loss_tokens=length).collect()
    known = {}
    for k, i in enumerate(BIG):
        known.setdefault(i, []).append(plain_ids(path, f"text number {k} of it", 1))
    places = {}
    for r in pieces:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and r["doc_id"] in known
        whole = [w for w in known[r["doc_id"]] if len(w) == r["doc_tokens"]]
        assert any(np.array_equal(w[r["start"] :][: len(ids)], ids) for w in whole)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in pieces) == sum(len(w) for v in known.values() for w in v)
    for spans in places.values():
        spans.sort()
        assert [a for a, _ in spans] == np.cumsum([0, *(n for _, n in spans[:-1])]).tolist()
        assert sum(n for _, n in spans) <= length


@pytest.mark.parametrize("memo", [1_000, 20_000, tokens.MEMO_BYTES])
@pytest.mark.parametrize("name,lower", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_blocks_of_words_give_the_ids_of_whole_texts(monkeypatch, name, lower, memo):
    monkeypatch.setattr(tokens, "MEMO_BYTES", memo)
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 300)
    odd = [
        "The quick  brown\n fox's don't", " lead", "trail ", "a\tb c", "É école İstanbul ǅ ﬁne",
        "é x́y Ġ Ġa </w> a</w>b", "x=1;y==2 !!!wow", "\0nul \0 z", "12 345 6a7", None, "",
        " ", "　wide　 gap", "don't DON'T Σας ΟΔΟΣ", "<|endoftext|> a <|startoftext|>b", "a" * 900,
    ]
    texts = odd * 3 + [f"{a} {b}" for a in odd for b in odd]
    path = queries.tokenizer_path(name)
    reader = tokens.Words(path, lower)
    for text, found in zip(texts, reader.texts(texts), strict=True):
        assert found == (reader.encode(text) if text else b""), text
