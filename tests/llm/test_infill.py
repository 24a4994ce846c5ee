"""Fill-in-middle examples next to a plain version of the contract."""

import hashlib
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tabwright.llm import infill, queries

SF = "/root/testdata/sf0.01"
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text, text
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def digested(row):
    *head, output, text = row
    return (*head, *(hashlib.sha256(x.encode()).hexdigest() for x in (output, text)))


def test_whole_table(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    wanted = sorted(digested(plain_version(d["doc_id"], d["text"])) for d in docs)
    found = sorted(tuple(r) for r in queries.infilled(spark, SF).collect())
    assert found == wanted
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


ODD = [
    None, "", " ", "\n\t \x0b", "one", " one", "one ", "a b", "é  ß　ü x \U0001f600 y",
    "has <M> inside", "<P", ">", "almost < P> <<S", "S>", "x<", "<", "P>", "<<<>>>", "<P<S<M",
    "word " * 50_000, " " * 3_000, "é" * 9_000, "a\x00b \x1c c",
]


@pytest.mark.parametrize("block", [1, 64, infill.BLOCK_BYTES])
def test_odd_texts_in_any_block(spark, monkeypatch, block):
    monkeypatch.setattr(infill, "BLOCK_BYTES", block)
    rows = [(i, t) for i in range(0, 40) for t in ODD if i < 6 or len(t or "") < 99]
    rows += [(None, "null id with some words"), (None, None), rows[0], rows[9]]
    h = [infill.np.array(x, "int64") for x in zip(*(draw(i) for i, _ in rows))]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([t or "" for _, t in rows]), *map(pa.array, h)], names=["t", "1", "2", "3", "4"]
    )
    found, at = [], 0
    for part in infill._in_blocks(iter([batch.slice(0, 7), batch.slice(7)]), "t"):
        made = infill.cut_block(part.column("t"), [part.column(k).to_numpy() for k in "1234"])
        back = infill.restore_block(made["output"], made["form"])
        found += zip(*(c.to_pylist() for c in made.values()), back.to_pylist())
    for row, (doc_id, text) in zip(found, rows, strict=True):
        assert row == plain_version(doc_id, text)[1:]


def draw(doc_id):
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def test_frames_with_clashing_columns_nulls_and_no_rows(spark):
    names = ["n", "form", "output", "restored", "kept", "_text", "_h1"]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)
    rows = [(i, t, *("x" for _ in names)) for i in range(8) for t in ODD[:12]]
    rows += [(None, "a b c", *(None for _ in names)), rows[5]]
    docs = spark.createDataFrame(rows, schema)
    made = infill.restored(infill.fill_in_middle(docs, keep=docs.columns))
    found = sorted(
        ((r["kept"]["doc_id"], *list(r)[1:6], r["restored"]) for r in made.collect()), key=repr
    )
    assert found == sorted((plain_version(r[0], r[1]) for r in rows), key=repr)
    assert made.select("kept.*").columns == docs.columns
    none = infill.digest_rows(infill.fill_in_middle(docs.limit(0)))
    assert none.collect() == [] and none.columns[0] == "doc_id"
    null_id = docs.selectExpr("doc_id", "text").where("doc_id is null")
    assert infill.digest_rows(infill.fill_in_middle(null_id)).first()["doc_id"] is None


def test_an_output_without_its_marks_is_an_error():
    with pytest.raises(ValueError, match="exactly one"):
        infill.restore_block(pa.array(["<P>a<S>b"]), pa.array(["psm"]))
