"""WARC archives as a data source of Spark's Python API, and pages written with each
payload stored once.

Reading plans partitions over the archive files, small ones together; the writer keeps
its files below a partition's size, and a foreign one, which has no marks to cut it by,
is a partition of its own. A record's headers are read first. Predicates on them that
Spark pushes down (see ``_OPERATORS``) decide there, and a record that fails is skipped:
by a seek where it isn't compressed or its gzip member says its length (the field ``sl``,
which the writer sets), else by inflating it to nowhere. ``payload`` "false" leaves all
payloads where they are. A file is read through a window, never as a whole; a record's
payload is held whole while it is handed on.

Writing appends. A task writes files of its own; the job's end writes a list of those
that count, and a reader takes a written file only if such a list names it, so tasks
that were lost, run twice or never committed leave nothing that is read. Files that
bear other names are taken as they are.

Paths are those of a file system that every machine sees: a mounted folder or any that
pyarrow opens by its address.

Missing header fields are null. A record without a block has an empty payload. Header
values are one line: line breaks in them are written as %0D and %0A. Truncated files
and blocks that do not agree with their digest are errors. Columns of the frame that is
written and that no field is made of are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from tabwright.llm.common import saved
from tabwright.sources.workspace import fresh_path

#: Columns and the header fields they are read from.
FIELDS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
#: Fixed value: the profile of a record that another one's payload stands for.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a partition and of a written file, of a window, and of a batch handed on.
PARTITION_BYTES = 64 << 20
WINDOW = 1 << 20
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2_048
HEAD = 8 << 10
#: The date of pages that come without one.
NO_DATE = "1970-01-01T00:00:00Z"
_HEAD_END = b"\r\n\r\n"
_GZIP = b"\x1f\x8b"
_LISTED = re.compile(r"^job-([0-9a-f]{32})-")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def field_names(options: dict) -> dict[str, str]:
    """Columns and their header fields: the fixed ones and those of option ``headers``."""
    more = [h.strip() for h in options.get("headers", "").split(",") if h.strip()]
    return FIELDS | {h.lower().replace("-", "_"): h for h in more}


# ------------------------------------------------------------------------- predicates


def _both(test):
    return lambda value, wanted: None if value is None or wanted is None else test(value, wanted)


#: What a predicate on one column says of a header's value: true, false or unknown.
_OPERATORS = {
    EqualTo: _both(lambda a, b: a == b),
    EqualNullSafe: lambda a, b: a == b,
    GreaterThan: _both(lambda a, b: a > b),
    GreaterThanOrEqual: _both(lambda a, b: a >= b),
    LessThan: _both(lambda a, b: a < b),
    LessThanOrEqual: _both(lambda a, b: a <= b),
    StringStartsWith: _both(lambda a, b: a.startswith(b)),
    StringEndsWith: _both(lambda a, b: a.endswith(b)),
    StringContains: _both(lambda a, b: b in a),
    IsNull: lambda a, _: a is None,
    IsNotNull: lambda a, _: a is not None,
}
#: Texts are ordered by their bytes, as Spark orders them.
_ORDERED = (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


def decides(test: Filter, columns: Sequence[str]) -> bool:
    """Whether headers alone decide the predicate."""
    if isinstance(test, Not):
        return decides(test.child, columns)
    known = isinstance(test, In) or type(test) in _OPERATORS
    return known and len(test.attribute) == 1 and test.attribute[0] in columns


def holds(test: Filter, head: dict) -> bool | None:
    if isinstance(test, Not):
        inner = holds(test.child, head)
        return None if inner is None else not inner
    value = head[test.attribute[0]]
    if isinstance(test, In):
        if value is None:
            return None
        return value in test.value or (None if None in test.value else False)
    wanted = getattr(test, "value", None)
    if isinstance(test, _ORDERED) and isinstance(value, str) and isinstance(wanted, str):
        value, wanted = value.encode(), wanted.encode()
    return _OPERATORS[type(test)](value, wanted)


# ---------------------------------------------------------------------------- records


class Window:
    """Parts of a file, read a window at a time."""

    def __init__(self, file, chunk: int = WINDOW):
        self.file, self.chunk, self.begin, self.data = file, chunk, 0, b""
        self.size = file.size()

    def at(self, offset: int, size: int) -> bytes:
        """``size`` bytes from ``offset`` on; fewer at the end of the file."""
        size = min(size, self.size - offset)
        if not self.begin <= offset <= offset + size <= self.begin + len(self.data):
            self.file.seek(offset)
            self.begin, self.data = offset, self.file.read(max(size, self.chunk))
        return self.data[offset - self.begin :][:size] if size > 0 else b""


class Member:
    """One record's bytes: as they are, or in a gzip member of its own."""

    def __init__(self, window: Window, offset: int):
        self.window, self.offset, self.read, self.out = window, offset, offset, b""
        start = window.at(offset, 24)
        self.inflater = zlib.decompressobj(31) if start[:2] == _GZIP else None
        self.length = None
        if self.inflater and start[12:16] == b"sl\x08\x00" and len(start) == 24 and start[3] & 4:
            self.length = struct.unpack("<I", start[16:20])[0]

    def head(self, size: int) -> bytes:
        """At least ``size`` bytes of the record, fewer if there are no more."""
        if self.inflater is None:
            return self.window.at(self.offset, size)
        while len(self.out) < size and not self.inflater.eof:
            self.out += self._inflated(size - len(self.out))
        return self.out

    def _inflated(self, limit: int) -> bytes:
        left = self.inflater.unconsumed_tail
        if not left:
            taken = self.read - self.offset  # as much again, so that heads cost little
            left = self.window.at(self.read, min(max(HEAD, taken), WINDOW))
            self.read += len(left)
            if not left:
                raise EOFError("an archive ends inside a record")
        return self.inflater.decompress(left, max(limit, 1))

    def after(self, record_bytes: int) -> int:
        """Where the next record begins; what was not read is not kept."""
        if self.inflater is None:
            end = self.offset + record_bytes
            if end > self.window.size:
                raise EOFError("an archive ends inside a record")
            while self.window.at(end, 2) == b"\r\n":
                end += 2
            return end
        if self.length:
            end = self.offset + self.length
            if end > self.window.size:
                raise EOFError("an archive ends inside a record")
            return end
        while not self.inflater.eof:
            self._inflated(WINDOW)
        return self.read - len(self.inflater.unused_data)


def _fields(text: bytes) -> dict[str, str]:
    """Header lines after the first; a line that begins with a gap goes on with the one
    before it, and of a repeated field the first counts."""
    lines: list[str] = []
    for line in text.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


def _up_to(member: Member, begin: int, limit: int | None) -> tuple[bytes, int]:
    """(the headers that begin there, where they end); no end before ``limit``: all."""
    size = HEAD
    while True:
        text = member.head(begin + size)[begin:limit]
        end = text.find(_HEAD_END)
        if end >= 0:
            return text[:end], begin + end + len(_HEAD_END)
        if limit is not None and begin + len(text) >= limit:
            return text, limit
        if len(text) < size:
            raise EOFError("an archive ends inside a record's headers")
        size *= 2


def records(
    window: Window, columns: dict[str, str], tests: Sequence[Filter], payload: bool
) -> Iterator[dict]:
    """The records of a file for which all tests hold."""
    offset = 0
    while offset < window.size:
        member = Member(window, offset)
        if not member.head(5).startswith(b"WARC/"):
            raise ValueError(f"no record begins at byte {offset}")
        text, begin = _up_to(member, 0, None)
        fields = _fields(text)
        size = int(fields.get("content-length", "0"))
        row = {c: fields.get(h.lower()) for c, h in columns.items()}
        row |= {"block_bytes": size, "offset": offset}
        if all(holds(t, row) for t in tests):
            http = (row["content_type"] or "").startswith("application/http")
            end, body, length = begin + size, begin, None
            if http:
                head, body = _up_to(member, begin, end)
                length = _fields(head).get("content-length")
            stored = row["record_type"] != "revisit"
            row["payload_bytes"] = end - body if stored or not length else int(length)
            row["payload"] = member.head(end)[body:end] if payload and stored else None
            if row["payload"] is not None and len(row["payload"]) != end - body:
                raise EOFError("an archive ends inside a record")
            yield row
        offset = member.after(begin + size)


def _agrees(row: dict) -> bool:
    kind, _, wanted = (row["payload_digest"] or "").partition(":")
    if row["payload"] is None or kind.lower() != "sha1":
        return True
    return base64.b32encode(hashlib.sha1(row["payload"]).digest()).decode() == wanted.upper()


# ----------------------------------------------------------------------------- source


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcSource(DataSource):
    """``spark.read.format("warc")`` with the options path, headers (further fields to
    make columns of, as "X-One,X-Two"), payload, verify and partition_bytes; written
    with path, headers and compression ("gzip" or "none")."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        texts = [f"{c} string" for c in field_names(self.options)]
        return ", ".join(
            [*texts, "block_bytes long", "payload_bytes long", "payload binary", "archive string", "offset long"]
        )

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are appended to, never written over")
        return WarcWriter(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.columns = field_names(options)
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "true").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        known = [*self.columns, "block_bytes"]
        for test in filters:
            if decides(test, known):
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[Files]:
        store, root = _opened(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        committed = set()
        for info in found:
            if info.base_name.startswith("_committed-"):
                with store.open_input_file(info.path) as file:
                    committed |= {name for name, _ in json.loads(file.read())}
        archives = [
            (info.path, info.size)
            for info in sorted(found, key=lambda i: i.path)
            if info.base_name.endswith((".warc", ".warc.gz"))
            and (info.base_name in committed or not _LISTED.match(info.base_name))
        ]
        plan, held = [], 0
        for path, size in archives:
            if not plan or held + size > self.partition_bytes:
                plan.append(Files([]))
                held = 0
            plan[-1].paths.append(path)
            held += size
        return plan or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        names = [*self.columns, "block_bytes", "payload_bytes", "payload", "archive", "offset"]
        kinds = [
            *(pa.string() for _ in self.columns),
            pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(),
        ]
        schema = pa.schema(list(zip(names, kinds)))
        rows, held = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as file:
                for row in records(Window(file), self.columns, self.tests, self.payload):
                    if self.verify and not _agrees(row):
                        raise ValueError(f"{path}, byte {row['offset']}: not its digest")
                    rows.append(row | {"archive": path})
                    held += len(row["payload"] or b"")
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def record(fields: Sequence[tuple[str, str | None]], block: bytes) -> bytes:
    """A record: its header fields that have a value, its block, and what ends it."""
    lines = ["WARC/1.1"]
    for name, value in (*fields, ("Content-Length", str(len(block)))):
        if value is not None:
            lines.append(f"{name}: " + value.replace("\r", "%0D").replace("\n", "%0A"))
    return "\r\n".join(lines).encode() + _HEAD_END + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that says its own length."""
    squeezed = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = squeezed.compress(data) + squeezed.flush()
    lengths = struct.pack("<II", 24 + len(body) + 8, len(data) & 0xFFFFFFFF)
    head = _GZIP + b"\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl\x08\x00" + lengths
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    """Rows of (record_type, payload, payload_bytes, ...) to records: those of FIELDS,
    and of option ``headers``, that are columns of the frame become header fields;
    ``payload_sha1`` is the digest as bytes. A response's or revisit's block has HTTP
    headers before the payload; a revisit stores none."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.columns = field_names(options)
        self.packed = options.get("compression", "gzip") == "gzip"
        self.file_bytes = int(options.get("file_bytes", PARTITION_BYTES))
        self.job = uuid.uuid4().hex

    def _record(self, row: dict) -> bytes:
        fields = {c: row.get(c) for c in self.columns}
        kind, payload = fields["record_type"] or "resource", row.get("payload") or b""
        digest = row.get("payload_sha1")
        if digest is not None:
            fields["payload_digest"] = "sha1:" + base64.b32encode(digest).decode()
        block = payload
        extra: list[tuple[str, str | None]] = []
        if kind in ("response", "revisit"):
            stored = kind == "response"
            length = len(payload) if stored else row["payload_bytes"]
            shown = fields["content_type"] or "application/octet-stream"
            block = f"HTTP/1.1 200 OK\r\nContent-Type: {shown}\r\nContent-Length: {length}\r\n\r\n".encode()
            block += payload if stored else b""
            fields["content_type"] = "application/http; msgtype=response"
            extra = [] if stored else [("WARC-Profile", SAME_PAYLOAD)]
        fields |= {"record_type": kind, "date": fields["date"] or NO_DATE}
        fields["record_id"] = fields["record_id"] or f"<urn:uuid:{uuid.uuid4()}>"
        named = [(self.columns[c], v) for c, v in fields.items()]
        return record([*named, *extra], block)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        stream, held = None, 0
        try:
            for batch in iterator:
                for at in range(batch.num_rows):  # one record's payload at a time
                    (row,) = batch.slice(at, 1).to_pylist()
                    data = self._record(row)
                    data = member(data) if self.packed else data
                    if stream is None or held + len(data) > self.file_bytes:
                        if stream is not None:
                            stream.close()
                        name = f"job-{self.job}-{uuid.uuid4().hex}.warc" + ".gz" * self.packed
                        stream, held = store.open_output_stream(f"{root}/{name}", compression=None), 0
                        files.append((name, 0))
                    stream.write(data)
                    held += len(data)
                    files[-1] = (files[-1][0], held)
        finally:
            if stream is not None:
                stream.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        with store.open_output_stream(f"{root}/_committed-{self.job}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.path)
        for name, _ in (f for m in messages if m for f in m.files):
            store.delete_file(f"{root}/{name}")


def read_archives(spark: SparkSession, path: str, headers: Sequence[str] = (), payload: bool = True) -> DataFrame:
    """The records of all archives at ``path``. Predicates on their headers are pushed
    to the reader, which Spark does only with the setting made here."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").option("headers", ",".join(headers))
    return reader.option("payload", str(payload).lower()).load(path)


def write_archives(rows: DataFrame, path: str, headers: Sequence[str] = (), compression: str = "gzip") -> None:
    rows.sparkSession.dataSource.register(WarcSource)
    writer = rows.write.format("warc").mode("append").option("headers", ",".join(headers))
    writer.option("compression", compression).save(path)


# ------------------------------------------------------------------------------ pages

#: Header fields in which a page's number and that of the page it repeats are kept.
PAGE, REPEATED = "X-Page-Id", "X-Refers-To-Page-Id"
#: A payload with more than this share of the rows joins by broadcast, so that its rows
#: stay where they are; there are fewer than 1 / HOT such payloads.
HOT = 1 / 256
#: Equal rows of a page that one task writes at a time.
CHUNK = 1_024


def _record_id(page: Column, url: Column, content: Column, copy: Column) -> Column:
    known = F.to_json(F.struct(page.alias("p"), url.alias("u"), content.alias("c"), copy.alias("n")))
    digits = F.substring(F.sha2(known, 256), 1, 32)
    return F.concat(
        F.lit("<urn:uuid:"),
        F.regexp_replace(digits, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"),
        F.lit(">"),
    )


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The records of (page_id, url, html): of the pages of one payload, the one with
    the largest page_id (then url) is the response, the others are revisits of it; equal
    rows are one response and revisits. Payloads below ``min_bytes`` are all responses.
    Null html is an empty payload. Only a page's numbers and digests are joined; a
    payload moves once, to be written."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns(
        {
            "content": F.unhex(F.sha2("payload", 256)),
            "payload_sha1": F.unhex(F.sha1("payload")),
            "payload_bytes": F.octet_length("payload").cast("long"),
        }
    )
    place = F.struct("page_id", "url")
    large = rows.where(F.col("payload_bytes") >= min_bytes)
    same = ["content", "payload_sha1", "payload_bytes"]
    narrow = saved(
        large.groupBy(*same, "page_id", "url").agg(F.count(F.lit(1)).alias("n")), "page_digests"
    )
    heads = narrow.groupBy("content").agg(F.max(place).alias("head"), F.sum("n").alias("rows"))
    heads = saved(heads.where("rows > 1"), "page_heads")
    total = narrow.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("rows") > F.lit(total * HOT)
    hot, others = heads.where(is_hot), heads.where(~is_hot)
    apart = F.broadcast(hot.select("content"))
    repeated = (
        narrow.join(F.broadcast(hot), "content")
        .unionByName(narrow.join(apart, "content", "left_anti").join(others, "content"))
        .withColumn("extra", F.col("n") - place.eqNullSafe(F.col("head")).cast("long"))
        .where("extra > 0")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), ((F.col("extra") - 1) / CHUNK).cast("int"))))
        .repartition("content", "page_id", "url", "chunk")
    )
    last = F.least(F.col("extra"), (F.col("chunk") + 1) * CHUNK)
    revisits = repeated.withColumn(
        "copy", F.explode(F.sequence((F.col("chunk") * CHUNK + 1).cast("long"), last.cast("long")))
    ).select(
        *same, "page_id", "url", "copy", "head", F.lit(None).cast("binary").alias("payload"),
        F.lit("revisit").alias("record_type"),
    )
    firsts = large.groupBy("content").agg(
        F.max(place).alias("p"), *(F.first(c).alias(c) for c in ("payload", *same[1:]))
    )
    small = rows.where(F.col("payload_bytes") < min_bytes).withColumn("copy", F.expr("uuid()"))
    response = [F.lit(None).cast(revisits.schema["head"].dataType).alias("head"), "payload", F.lit("response").alias("record_type")]
    responses = firsts.select(*same, "p.page_id", "p.url", F.lit("0").alias("copy"), *response)
    if min_bytes > 0:
        responses = responses.unionByName(small.select(*same, "page_id", "url", "copy", *response))
    revisits = revisits.withColumn("copy", F.col("copy").cast("string"))
    head = F.col("head")
    original = _record_id(head["page_id"], head["url"], F.col("content"), F.lit("0"))
    return responses.unionByName(revisits).select(
        _record_id(F.col("page_id"), F.col("url"), F.col("content"), F.col("copy")).alias("record_id"),
        "record_type",
        F.col("url").alias("target_uri"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        "payload",
        "payload_bytes",
        "payload_sha1",
        F.when(head.isNotNull(), original).alias("refers_to"),
        F.col("page_id").cast("string").alias("x_page_id"),
        head["page_id"].cast("string").alias("x_refers_to_page_id"),
    )


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read these back."""
    path = fresh_path(pages.sparkSession, "archives")
    write_archives(page_records(pages, min_bytes), path, (PAGE, REPEATED))
    return read_archives(pages.sparkSession, path, (PAGE, REPEATED))


def digest_rows(read: DataFrame) -> DataFrame:
    return read.where(F.col("record_type").isin("response", "revisit")).select(
        F.col("x_page_id").cast("long").alias("page_id"),
        "payload_bytes",
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type",
        F.col("x_refers_to_page_id").cast("long").alias("refers_to"),
    )
