"""Packing, token files and secret scans of odd documents against plain versions."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from tabwright.llm import ledger, packing, tokenfile
from tabwright.llm.queries import tokenizer_path
from tests_llm_help import texts_frame


def plain_ids(name, text, end):
    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark):
    docs, texts = texts_frame(spark)
    rows = packing.pack(docs, tokenizer_path("word_bpe_49k.json")).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in pieces.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048 and len(spans) <= packing.SEGMENTS
    want = [plain_ids("word_bpe_49k.json", t, 1) for _, t in texts]
    assert sum(r["length"] for r in rows) == sum(map(len, want))


def test_token_files(spark):
    docs, texts = texts_frame(spark)
    read = tokenfile.written_and_read(docs, tokenizer_path("byte_bpe_50k.json"))
    rows = sorted(tokenfile.digest_rows(read).collect(), key=lambda r: r["start"])
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert order == sorted(order)
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1]]
    want = [(i, crc(plain_ids("byte_bpe_50k.json", t, 2))) for i, t in texts]
    found = [(r["doc_id"], r["ids_crc32"]) for r in rows]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_secrets(spark):
    rows = [(1, "é token = 'abcdefgh1' AKIA" + "B" * 16), (2, None), (3, "0" * 40), (None, "x")]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    found = ledger.scan_corpus(docs)
    spans = {r["doc_id"]: r["spans"] for r in ledger.digest_rows(found).collect()}
    assert spans == {1: "assign:2:20,access:22:42", 2: "", 3: "hex:0:40", None: ""}
    texts = {r["doc_id"]: r["text"] for r in ledger.redacted(found).collect()}
    assert texts == {1: "é [secret]' [secret]", 2: None, 3: "[secret]", None: "x"}
