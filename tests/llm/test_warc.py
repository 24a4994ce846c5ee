"""Archives: pages next to a plain version of the contract, foreign files, predicates,
and jobs that end badly."""

import base64
import gzip
import hashlib
import io
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabwright.llm import queries, warc

SF = "/root/testdata/sf0.01"


def plain_version(pages, min_bytes=0):
    """Rows of (page_id, html) to the digest rows."""
    groups = defaultdict(list)
    for page_id, html in pages:
        groups[(html or "").encode()].append(page_id)
    out = []
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        head = max(ids, key=lambda i: (i is not None, i))
        left = Counter(ids)
        if len(payload) >= min_bytes:
            left[head] -= 1
            out.append((head, len(payload), digest, "response", None))
            out += [(i, len(payload), digest, "revisit", head) for i in left.elements()]
        else:
            out += [(i, len(payload), digest, "response", None) for i in left.elements()]
    return sorted(out, key=repr)


def test_whole_table(spark):
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    rows = [tuple(r) for r in queries.archived_pages(spark, SF).collect()]
    assert sorted(rows, key=repr) == plain_version([(p["page_id"], p["html"]) for p in pages])


@pytest.mark.parametrize("min_bytes", [0, 4, 10**9])
def test_copies_nulls_and_clashing_columns(spark, monkeypatch, min_bytes):
    monkeypatch.setattr(warc, "CHUNK", 3)
    rng = random.Random(2)
    texts = [None, "", "a", "WARC/1.1\r\n\r\n", "é" * 70_000, "\r\n\r\n", "the same page", "x\0y"]
    pages = [(i, rng.choice(texts)) for i in range(300)]
    pages += [(i, "the same page") for i in range(300, 800)] + [(900, f"own {i}") for i in range(5)]
    pages += [(7, "often")] * 10 + [(None, "often")] * 4 + [(None, "only null id")] * 2
    schema = "page_id long, url string, html string, payload string, content int, n int, head string"
    urls = [None, "http://a/\r\nX-Page-Id: 5", "http://b/ü"]
    docs = spark.createDataFrame(
        [(i, rng.choice(urls), t, "p", 1, 2, "h") for i, t in pages], schema
    )
    found = warc.archived(docs, min_bytes)
    rows = [tuple(r) for r in warc.digest_rows(found).collect()]
    assert sorted(rows, key=repr) == plain_version(pages, min_bytes)
    texts_back = {r["payload"] for r in found.where("record_type = 'response'").collect()}
    assert texts_back == {(t or "").encode() for _, t in pages}
    ids = [r["record_id"] for r in found.select("record_id").collect()]
    assert len(set(ids)) == len(ids)
    answered = {r["refers_to"] for r in found.where("record_type = 'revisit'").collect()}
    assert answered <= {r["record_id"] for r in found.where("record_type = 'response'").collect()}


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.digest_rows(warc.archived(none)).collect() == []


KINDS = ("response", "request", "metadata", "resource")


def foreign(folder, packed, count=60):
    """An archive as others write it: no lengths in its members, folded and odd headers."""
    out, wanted = b"", []
    for i in range(count):
        body = bytes([i]) * (i * 977) if i % 7 else b""
        kind = KINDS[i % 4]
        block = b"HTTP/1.1 200 OK\r\nX: " + b"h" * (9_000 * (i % 3)) + b"\r\n\r\n" + body
        fields = [("WARC-Type", kind), ("WARC-Target-URI", f"http://h{i % 5}/ü{i}"), ("X-Odd", f"a:{i}")]
        if kind == "response":
            fields.append(("Content-Type", "application/http; msgtype=response"))
        data = warc.record(fields, block if kind == "response" else body)
        data = data.replace(b"X-Odd: ", b"x-odd:\r\n\t ")
        out += gzip.compress(data) if packed else data
        wanted.append((kind, f"http://h{i % 5}/ü{i}", f"a:{i}", body))
    (folder / ("f.warc.gz" if packed else "f.warc")).write_bytes(out)
    return wanted


@pytest.mark.parametrize("packed", [True, False])
def test_foreign_archives_and_predicates(spark, tmp_path, packed):
    wanted = foreign(tmp_path, packed)
    read = warc.read_archives(spark, str(tmp_path), ["X-Odd"])
    columns = ["record_type", "target_uri", "x_odd", "payload"]
    found = [tuple(r) for r in read.select(*columns).collect()]
    assert [(k, u, o, bytes(p)) for k, u, o, p in found] == wanted
    tests = [
        (F.col("record_type") == "response", lambda r: r[0] == "response"),
        (F.col("record_type").isin("request", "metadata"), lambda r: r[0] in KINDS[1:3]),
        (F.col("target_uri").startswith("http://h3/"), lambda r: r[1].startswith("http://h3/")),
        (F.col("x_odd") > "a:3", lambda r: r[2] > "a:3"),
        (F.col("x_odd").contains("5") & (F.col("record_type") != "resource"),
         lambda r: "5" in r[2] and r[0] != "resource"),
        (F.col("refers_to").isNull() & (F.col("payload_bytes") > 9_999), lambda r: len(r[3]) > 9_999),
        (F.col("payload_digest") == "x", lambda r: False),
    ]
    for condition, plain in tests:
        some = read.where(condition).select(*columns).collect()
        assert [tuple(r) for r in some] == [r for r in wanted if plain(r)]
    bare = warc.read_archives(spark, str(tmp_path), payload=False)
    sizes = [(r["payload_bytes"], r["payload"]) for r in bare.collect()]
    assert sizes == [(len(w[3]), None) for w in wanted]


class Counted(io.BytesIO):
    """A file that says how many bytes were read."""

    taken = 0

    def size(self):
        return len(self.getvalue())

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


@pytest.mark.parametrize("packed", [True, False])
def test_payloads_that_are_not_wanted_are_not_read(packed):
    body = random.Random(1).randbytes(3_000_000)
    both = [warc.record([("WARC-Type", k)], body) for k in ("resource", "metadata", "resource")]
    file = Counted(b"".join(warc.member(r) if packed else r for r in both))
    tests = [warc.EqualTo(("record_type",), "metadata")]
    window = warc.Window(file, 4_096)
    found = list(warc.records(window, warc.FIELDS, tests, True))
    assert [r["payload"] for r in found] == [body]
    assert file.taken < 1.5 * len(body)
    file = Counted(file.getvalue())
    found = list(warc.records(warc.Window(file, 4_096), warc.FIELDS, tests, False))
    assert [r["payload"] for r in found] == [None] and file.taken < 100_000


def test_predicates_reach_the_reader_and_only_those_it_decides():
    reader = warc.WarcReader({"path": "/x", "headers": "X-One"})
    known = [
        warc.EqualTo(("record_type",), "response"),
        warc.Not(warc.In(("x_one",), ("a", "b"))),
        warc.GreaterThan(("block_bytes",), 5),
    ]
    left = [warc.EqualTo(("payload_bytes",), 5), warc.IsNull(("archive",))]
    assert list(reader.pushFilters([*known, *left])) == left and reader.tests == known
    assert warc.holds(known[1], {"x_one": None}) is None
    assert warc.holds(known[1], {"x_one": "c"}) is True
    assert warc.holds(warc.EqualNullSafe(("a",), None), {"a": None}) is True


def test_files_of_a_job_that_did_not_end_are_not_read(spark, tmp_path):
    rows = spark.createDataFrame([("resource", bytearray(b"one"))], "record_type string, payload binary")
    warc.write_archives(rows, str(tmp_path), compression="none")
    lost = warc.WarcWriter({"path": str(tmp_path)})
    batch = pa.RecordBatch.from_pylist([{"record_type": "resource", "payload": b"lost"}])
    message = lost.write(iter([batch]))
    read = warc.read_archives(spark, str(tmp_path))
    assert [bytes(r["payload"]) for r in read.collect()] == [b"one"]
    lost.abort([message, None])
    assert not list(tmp_path.glob(f"*{lost.job}*"))
    warc.write_archives(rows, str(tmp_path))
    read = warc.read_archives(spark, str(tmp_path))
    assert [bytes(r["payload"]) for r in read.collect()] == [b"one"] * 2
    with pytest.raises(Exception, match="never written over"):
        rows.write.format("warc").mode("overwrite").save(str(tmp_path))


def test_files_are_planned_by_bytes(tmp_path):
    for i, size in enumerate((10, 20, 90, 5, 200, 1)):
        (tmp_path / f"{i}.warc").write_bytes(b"x" * size)
    reader = warc.WarcReader({"path": f"file://{tmp_path}", "partition_bytes": "100"})
    plan = [[p[-6] for p in part.paths] for part in reader.partitions()]
    assert plan == [["0", "1"], ["2", "3"], ["4"], ["5"]]


@pytest.mark.parametrize("packed", [True, False])
def test_cut_and_changed_archives_are_errors(packed):
    data = warc.record([("WARC-Type", "resource")], b"abc" * 5_000)
    data = warc.member(data) if packed else data
    for cut in (3, 40, len(data) // 2):
        with pytest.raises((EOFError, ValueError)):
            list(warc.records(warc.Window(Counted(data[:cut])), warc.FIELDS, [], True))
    good = {"payload": b"abc", "payload_digest": "sha1:" + base64.b32encode(hashlib.sha1(b"abc").digest()).decode()}
    assert warc._agrees(good) and not warc._agrees(good | {"payload": b"abd"})
