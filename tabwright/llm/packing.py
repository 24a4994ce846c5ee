"""Vector bin packing of documents into training sequences.

A sequence has room for so many tokens, segments and loss-bearing tokens. Each task
packs the documents of its partition, a window at a time: of all waiting pieces that
fit, the one whose needs have the largest dot product with the room left comes next,
so that a piece large where room is large goes in and no limit is used up before the
others. When nothing fits whole, the piece of the largest product is cut to the room
left. Rows that wait are bounded by the window; the sequence that is open at its end
is carried on to the next window, so each task leaves one short sequence.

Null and empty texts have the end id only. Every id of every input row lies in one
piece. Repeated ids of documents stay apart as rows; ``start`` and ``doc_tokens`` are
those of their own text. A document longer than a window of tokens is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.tokenfile import with_flag, with_nulls
from tabwright.llm.tokens import words

LENGTH = 2_048
SEGMENTS = 256
#: Pieces that wait in a task at once.
WINDOW = 2_048
#: Characters whose words are encoded together; the waiting rows take memory, too.
CHARS = 1 << 20
PIECE = (
    "doc_id long, start long, length long, doc_tokens long, loss_tokens long, "
    "sequence_id long, offset long, ids binary"
)


class Packer:
    """Sequences of one task. Pieces are (tokens, loss tokens); each is one segment."""

    def __init__(self, limits: tuple[int, int, int], first_id: int):
        self.limits = np.array(limits, np.float64)
        self.sequence = first_id
        self.room = self.limits.copy()
        self.placed: list[tuple] = []

    def _next(self) -> None:
        self.sequence += 1
        self.room = self.limits.copy()

    def place(self, items: list[tuple]) -> list[tuple]:
        """Put all items (place, start, ids, loss, doc_tokens) into sequences; gives
        (item, first id taken, ids taken, sequence, offset) for every piece."""
        out = []
        if not items:
            return out
        needs = np.array([(len(i[2]), 1, int(i[3].sum())) for i in items], np.float64)
        taken = np.zeros(len(items), np.int64)
        waiting = np.ones(len(items), bool)
        places, left = np.arange(len(items)), len(items)
        while left:
            if 2 * left < len(places):  # go on with the rows that wait
                places, needs, waiting = places[waiting], needs[waiting], waiting[waiting]
            if self.room.min() < 1 and (self.room[0] < 1 or self.room[1] < 1):
                self._next()
            share = (needs / self.limits) @ (self.room / self.limits)
            fits = waiting & (needs <= self.room).all(axis=1)
            some = bool(fits.any())
            at = int(np.argmax(np.where(fits if some else waiting, share, -1.0)))
            k = int(places[at])
            doc, first, ids, loss, _ = items[k]
            begin = int(taken[k])
            size = len(ids) - begin
            if not some:  # the longest beginning that every limit allows
                losses = np.cumsum(loss[begin:])
                allowed = int(np.searchsorted(losses, self.room[2], side="right"))
                size = min(size, int(self.room[0]), allowed)
            if size == 0:
                self._next()
                continue
            used = int(loss[begin : begin + size].sum())
            offset = int(self.limits[0] - self.room[0])
            out.append((k, begin, size, used, self.sequence, offset))
            self.room -= (size, 1, used)
            taken[k] += size
            needs[at] -= (size, 0, used)
            waiting[at] = taken[k] < len(ids)
            left -= not waiting[at]
        return out


def _pack(path: str, lower: bool, end_id: int, limits: tuple[int, int, int], window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoded = words(path, lower).texts
        end = np.array([end_id], "<u4").tobytes()
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for at in range(0, len(batch), window):
                part = batch.iloc[at : at + window]
                items = []
                texts = zip(encoded(part["text"], CHARS), part["loss"])
                for place, (text, bearing) in enumerate(texts):
                    ids = np.frombuffer(text + end, "<u4")
                    loss = np.broadcast_to(np.int64(bearing), len(ids))
                    items.append((place, 0, ids, loss, len(ids)))
                doc_ids, named = part["doc_id"].to_numpy(), part["named"].to_numpy()
                rows = [
                    (
                        items[k][0],
                        begin,
                        size,
                        items[k][4],
                        used,
                        sequence,
                        offset,
                        items[k][2][begin : begin + size].tobytes(),
                    )
                    for k, begin, size, used, sequence, offset in packer.place(items)
                ]
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE.split(", ")])
                places = frame["doc_id"].to_numpy(np.int64)
                frame["doc_id"] = with_nulls(doc_ids[places], named[places])
                yield frame

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    lower: bool = True,
    end_id: int = 1,
    length: int = LENGTH,
    segments: int = SEGMENTS,
    loss_tokens: int = LENGTH,
    loss_column: str | None = None,
    window: int = WINDOW,
) -> DataFrame:
    """One row per piece, with its ids as packed little-endian 32-bit numbers, its
    sequence and its offset there. ``loss_column``: false for rows whose tokens bear no
    loss (null counts as true); without it all do. No shuffle: the partitions are the
    caller's, and a sequence's id holds its partition's number."""
    bearing = F.coalesce(F.col(loss_column), F.lit(True)) if loss_column else F.lit(True)
    rows = docs.select(*with_flag("doc_id"), "text", bearing.alias("loss"))
    limits = (length, segments, loss_tokens)
    return rows.mapInPandas(_pack(tokenizer_path, lower, end_id, limits, window), PIECE)


def digest_rows(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
