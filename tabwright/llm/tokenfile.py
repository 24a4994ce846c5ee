"""Token ids in Simple-8b words, written as blocks and read back.

A 64-bit word is a 4-bit selector and 60 bits that hold as many ids of one width as
the selector says; runs of 120 or 240 zeros have selectors of their own, and the
escape selector announces a whole 64-bit id in the next word, so that any unsigned
64-bit id can be stored. A block holds whole documents: their ids and lengths, the
words of all their ids as one stream, and for every 256th word the number of ids
before it, so that a reader can decode all words of a selector at once, or only those
of one document.

A file is a Parquet table with one row per block, in ascending order of documents;
Spark's writer commits it, so lost executors leave no halves and any store will do.

Null and empty texts have the end id only. Rows without a document id come first.
Rows of equal id keep the order of their text's hash, then their text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.llm.tokens import words
from tabwright.sources.workspace import fresh_path

#: Ids per word and bits per id of each selector; 0 and 1 are runs of zeros.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
#: A word of the last selector with this payload is followed by a whole 64-bit id.
ESCAPE = (1 << 60) - 1
STRIDE = 256
#: Ids that are cut into words at a time.
WINDOW = 1 << 17
#: A block is closed at the end of the document that brings it to so many ids.
BLOCK_IDS = 1 << 16
BLOCK = (
    "part int, before long, n_ids long, doc_ids array<long>, named array<boolean>, "
    "lengths array<long>, "
    "offsets array<long>, words binary"
)


def _selectors(values: np.ndarray) -> np.ndarray:
    """For each position the selector that takes most ids from there on. Largest
    values of longer and longer stretches come from those of shorter ones; ids past
    the end count as zero, but runs of zeros are taken only in full."""
    n = len(values)
    best = np.full(n, 15, np.int8)
    if n and values.max() < 1 << 32:
        values = values.astype(np.uint32)
    stretch, length = values, 1
    for s in range(14, -1, -1):
        count, width = COUNTS[s], WIDTHS[s]
        while length < count:
            step = min(length, count - length)
            ahead = np.zeros_like(stretch)
            ahead[: max(n - step, 0)] = stretch[step:]
            stretch, length = np.maximum(stretch, ahead), length + step
        fits = stretch >> values.dtype.type(width) == 0 if width < 32 else stretch < 1 << width
        if s < 2:
            fits[max(n - count + 1, 0) :] = False
        if not fits.any() and s > 1:
            break
        np.copyto(best, s, where=fits)
    return best


def _starts(step: np.ndarray) -> np.ndarray:
    """The ids at which words begin, if one that begins at i has step[i] ids: every 32nd
    word one behind the other, those between from it by 16, 8, 4, 2 and 1 words."""
    found, i = [np.zeros(0, np.int64)], 0
    while i < len(step):
        own = step[i : i + WINDOW].astype(np.int64)
        size = len(own)
        jumps = [np.append(np.minimum(np.arange(size) + own, size), size)]
        for _ in range(5):
            jumps.append(jumps[-1][jumps[-1]])
        at = [0]
        while (following := int(jumps[-1][at[-1]])) < size:
            at.append(following)
        at = np.array(at)
        for jump in jumps[-2::-1]:
            at = np.column_stack([at, jump[at]]).ravel()
        at = at[at < size]
        found.append(i + at)
        i += int(at[-1] + own[at[-1]])
    return np.concatenate(found)


def encode(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Little-endian words of unsigned 64-bit ids, and the ids before every 256th."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return b"", np.zeros(0, np.int64)
    best = _selectors(values)
    starts = _starts(np.array(COUNTS, np.uint8)[best])
    chosen = best[starts]
    whole = (chosen == 15) & (values[starts] >= np.uint64(ESCAPE))
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(whole)[:-1]])
    out = np.zeros(len(starts) + int(whole.sum()), np.uint64)
    padded = np.concatenate([values, np.zeros(max(COUNTS), np.uint64)])
    for s in range(16):
        rows = np.flatnonzero(chosen == s)
        if not len(rows):
            continue
        word = np.full(len(rows), s << 60, np.uint64)
        if s > 1:
            at = starts[rows]
            for lane in range(COUNTS[s]):
                value = padded[at + lane]
                if s == 15:
                    value = np.minimum(value, np.uint64(ESCAPE))
                word |= value << np.uint64(lane * WIDTHS[s])
        out[place[rows]] = word
    out[place[whole] + 1] = values[starts[whole]]
    before = np.full(len(out), -1, np.int64)
    before[place] = starts
    before[before < 0] = starts[whole] + 1
    return out.astype("<u8").tobytes(), before[::STRIDE]


def decode(data: bytes, n: int) -> np.ndarray:
    """The first ``n`` ids of the words, all words of a selector at once."""
    stream = np.frombuffer(data, "<u8").astype(np.uint64)
    escape = np.uint64((15 << 60) | ESCAPE)
    whole = np.zeros(len(stream), bool)  # words that are ids
    if (stream == escape).any():
        i = 0
        marks = (stream == escape).tolist()
        while i < len(marks):
            if marks[i]:
                whole[i + 1] = True
                i += 1
            i += 1
    escapes = np.flatnonzero(whole) - 1
    selectors = (stream >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[selectors]
    counts[escapes] = 0
    counts[whole] = 1
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in range(2, 16):
        rows = np.flatnonzero((selectors == s) & ~whole & (counts > 0))
        if not len(rows):
            continue
        at, words_of_it = starts[rows], stream[rows]
        mask = np.uint64((1 << WIDTHS[s]) - 1)
        for lane in range(COUNTS[s]):
            out[at + lane] = (words_of_it >> np.uint64(lane * WIDTHS[s])) & mask
    out[starts[whole]] = stream[whole]
    return out[:n]


def _blocks(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoded = words(path, False).texts
        end = np.array([end_id], "<u4").tobytes()
        part, before, names, named, ids = TaskContext.get().partitionId(), 0, [], [], []

        def close() -> pd.DataFrame:
            stream = np.frombuffer(b"".join(ids), "<u4")
            coded, offsets = encode(stream)
            lengths = [len(x) // 4 for x in ids]
            row = (part, before, len(stream), names, named, lengths, offsets, coded)
            return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCK.split(", ")])

        size = 0
        for batch in batches:
            texts = encoded(batch["text"])
            for doc_id, has_id, text in zip(batch["doc_id"], batch["named"], texts):
                names.append(doc_id)
                named.append(has_id)
                ids.append(text + end)
                size += len(ids[-1]) // 4
                if size >= block_ids:
                    yield close()
                    before, size, names, named, ids = before + size, 0, [], [], []
        if names:
            yield close()

    return run


def with_flag(doc_id: str) -> list[Column]:
    """The id without nulls, and whether there is one: a long column with nulls would
    be handed to Python as doubles, which cannot tell large ids apart."""
    column = F.col(doc_id).cast("long")
    return [F.coalesce(column, F.lit(0)).alias("doc_id"), column.isNotNull().alias("named")]


def with_nulls(doc_ids, named) -> pd.arrays.IntegerArray:
    """Whole ids of pandas, null where there was none."""
    values = np.array(doc_ids, np.int64)
    return pd.arrays.IntegerArray(values, ~np.array(named, bool))


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 2,
    partitions: int | None = None,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encode (doc_id, text) and write the blocks in ascending order of doc_id. The
    hash in the range key cuts even rows of one id; the tokenizer runs behind the
    exchange, so once per row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")
    )
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "doc_id", "h")
    ordered = ranged.sortWithinPartitions("doc_id", "h", "text").select(*with_flag("doc_id"), "text")
    ordered.mapInPandas(_blocks(tokenizer_path, end_id, block_ids), BLOCK).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document: ids as packed little-endian
    32-bit numbers, start as the number of ids before it in the whole table. A block
    knows the ids before it in its part; the totals of the parts, one row per
    partition of the writing, are added up and broadcast, so no block is moved."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("earlier"))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                lengths = np.asarray(row.lengths, np.int64)
                ids = decode(row.words, row.n_ids).astype("<u4")
                ends = np.cumsum(lengths)
                yield pd.DataFrame(
                    {
                        "doc_id": with_nulls(row.doc_ids, row.named),
                        "start": row.earlier + row.before + ends - lengths,
                        "n_tokens": lengths,
                        "ids": [ids[e - n : e].tobytes() for e, n in zip(ends, lengths)],
                    }
                )

    return blocks.join(F.broadcast(parts), "part").mapInPandas(
        documents, "doc_id long, start long, n_tokens long, ids binary"
    )


def written_and_read(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path)
    return read_tokens(docs.sparkSession, path)


def digest_rows(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
