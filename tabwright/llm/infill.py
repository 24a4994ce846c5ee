"""Fill-in-middle examples by displacement scatter.

A text is cut into prefix, middle and suffix at unit ends; a unit is a word with the gap
before it, or the gap that ends the text. All bytes of a block of texts are worked on
at once: one scan finds the unit ends, hence the cuts; a difference array holds at each
segment's first byte by how much the shift to its place in the output changes; its
running sum is every byte's shift, and one scatter writes all outputs. Restoring scans
an output for its marks, and the same running sum gathers each byte back.

The form is drawn from a hash of the document's id: plain (the text as it is), psm
(prefix, suffix, middle) or spm (suffix, prefix, middle). A text that holds a mark, and
an empty one, stays plain, so an output's marks are those written here and the text can
be rebuilt from output and form alone.

Null text is empty text. A null id is drawn from like an empty one. Rows of equal id are
cut by the same draws, each in its own text. Texts are worked on whole; a block holds
``BLOCK_BYTES``, or one longer text. Columns in ``keep`` come back in a struct of their
own, so no name can clash; others are not looked at. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 42
#: Shares, in percent, of texts that are cut, and of these of the form spm.
CUT, SUFFIX_FIRST = 50, 80
#: The marks before each segment.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
PLAIN, PSM, SPM = range(3)
FORMS = ("plain", "psm", "spm")
BLOCK_BYTES = 4 << 20
_WIDTH = 3
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[0x20, *range(0x09, 0x0E)]] = True


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of the id's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [
        F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"_h{i + 1}")
        for i in range(4)
    ]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, start of each text and the end of the last) of strings without nulls."""
    whole = texts.cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset :][: len(whole) + 1]
    if not len(whole) or whole.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(whole) + 1, np.int64)
    data = np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _texts_of(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers).cast(pa.string())


def _marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each mark begins, and its letter; marks across two texts are none."""
    if len(data) < _WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    letters = data[1:-1]
    known = (letters == ord("P")) | (letters == ord("S")) | (letters == ord("M"))
    at = np.flatnonzero((data[:-2] == ord("<")) & known & (data[2:] == ord(">")))
    inside = at + _WIDTH <= offsets[np.searchsorted(offsets, at, side="right")]
    return at[inside], data[at[inside] + 1]


def _shifts(starts: np.ndarray, shifts: np.ndarray, size: int) -> np.ndarray:
    """Every byte's shift, from the segments' starts (ascending; empty segments share
    theirs with the next) and shifts: a difference array and its running sum."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, np.diff(shifts, prepend=0))
    return np.cumsum(change[:-1])


def _cuts(data, offsets, h1, h2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the bytes at which its prefix and its middle end."""
    gap = _IS_GAP[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~gap[:-1] & gap[1:]
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    places = np.flatnonzero(ends)
    before = np.searchsorted(places, offsets)  # units that end before each text
    units = np.diff(before)
    a, b = h1 % (units + 1), h2 % (units + 1)

    def cut(taken: np.ndarray) -> np.ndarray:
        last = np.minimum(before[:-1] + taken - 1, max(len(places) - 1, 0))
        past = places[last] + 1 if len(places) else np.zeros(len(taken), np.int64)
        return np.where(taken > 0, past, offsets[:-1])

    return units, cut(np.minimum(a, b)), cut(np.maximum(a, b))


def _segments(offsets: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray):
    """(output offsets, starts in the texts, shifts, place of each mark): three segments
    for each text, in the order prefix, middle, suffix; plain ones have no marks."""
    start, end = offsets[:-1], offsets[1:]
    marked = np.where(form == PLAIN, 0, _WIDTH)
    out = np.concatenate([[0], np.cumsum(end - start + 3 * marked)])
    begin = out[:-1]
    prefix, middle, suffix = first - start, second - first, end - second
    psm, spm = form == PSM, form == SPM
    p = begin + np.where(spm, suffix + 2 * marked, marked)
    s = begin + np.where(spm, marked, np.where(psm, prefix + 2 * marked, prefix + middle))
    m = begin + np.where(form == PLAIN, prefix, prefix + suffix + 3 * marked)
    starts = np.stack([start, first, second], axis=1)
    shifts = np.stack([p, m, s], axis=1) - starts
    return out, starts.ravel(), shifts.ravel(), {"prefix": p, "middle": m, "suffix": s}


def cut_block(texts: pa.Array, h: Sequence[np.ndarray]) -> dict[str, pa.Array]:
    """One block of texts without nulls to its columns of results."""
    data, offsets = _bytes_of(texts)
    units, first, second = _cuts(data, offsets, h[0], h[1])
    at, _ = _marks(data, offsets)
    holds_mark = np.bincount(np.searchsorted(offsets, at, side="right") - 1, minlength=len(texts))
    plain = (np.diff(offsets) == 0) | (holds_mark > 0) | (h[2] % 100 >= CUT)
    form = np.where(plain, PLAIN, np.where(h[3] % 100 < SUFFIX_FIRST, SPM, PSM))
    out, starts, shifts, places = _segments(offsets, first, second, form)
    output = np.empty(out[-1], np.uint8)
    output[np.arange(len(data)) + _shifts(starts, shifts, len(data))] = data
    for name, mark in MARKS.items():
        for i, byte in enumerate(mark):
            output[places[name][~plain] - _WIDTH + i] = byte
    letters = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])  # code points before
    return {
        "n": pa.array(units, pa.int64()),
        "form": pa.array(FORMS, pa.string()).take(pa.array(form)),
        "prefix_chars": pa.array(letters[first] - letters[offsets[:-1]], pa.int64(), mask=plain),
        "middle_chars": pa.array(letters[second] - letters[first], pa.int64(), mask=plain),
        "output": _texts_of(output, out),
    }


def restore_block(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts of a block of outputs: each byte is gathered from where it was put."""
    data, offsets = _bytes_of(outputs)
    form = np.array([FORMS.index(f) for f in forms.to_pylist()], np.int64)
    cut = form != PLAIN
    at, letter = _marks(data, offsets)
    owner = np.searchsorted(offsets, at, side="right") - 1
    at, letter, owner = at[cut[owner]], letter[cut[owner]], owner[cut[owner]]
    place = {}
    for name, mark in MARKS.items():
        found = letter == mark[1]
        if not np.array_equal(owner[found], np.flatnonzero(cut)):
            raise ValueError(f"an output needs exactly one {mark.decode()}")
        place[name] = offsets[:-1].copy()
        place[name][cut] = at[found] + _WIDTH
    end = offsets[1:]
    after_first = np.where(form == SPM, place["prefix"], place["suffix"]) - _WIDTH
    prefix = np.where(form == SPM, place["middle"] - _WIDTH, after_first) - place["prefix"]
    suffix = np.where(form == SPM, after_first, place["middle"] - _WIDTH) - place["suffix"]
    middle = end - place["middle"]
    prefix, suffix = np.where(cut, prefix, end - offsets[:-1]), np.where(cut, suffix, 0)
    middle = np.where(cut, middle, 0)
    out = np.concatenate([[0], np.cumsum(prefix + middle + suffix)])
    begin = out[:-1]
    starts = np.stack([begin, begin + prefix, begin + prefix + middle], axis=1)
    sources = np.stack([place["prefix"], place["middle"], place["suffix"]], axis=1)
    shifts = _shifts(starts.ravel(), (sources - starts).ravel(), int(out[-1]))
    return _texts_of(data[np.arange(out[-1]) + shifts], out)


def _in_blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a block's texts have about ``BLOCK_BYTES``."""
    for batch in batches:
        lengths = np.diff(_bytes_of(batch.column(text))[1])
        block = np.cumsum(lengths) // BLOCK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(lengths)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _kept(df: DataFrame, keep: Sequence[str]) -> list[Column]:
    return [F.struct(*(F.col(c) for c in keep)).alias("kept")] if keep else []


def _field(df: DataFrame) -> list[T.StructField]:
    return [df.schema["kept"]] if "kept" in df.columns else []


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """(kept, n, form, prefix_chars, middle_chars, output) of every document of
    (doc_id, text): its units, its form, the code points of prefix and middle (null if
    plain), and the example. ``keep`` names the columns of the struct ``kept``."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("_text")
    rows = docs.select(*_kept(docs, keep), text, *draws(F.col("doc_id"), seed))
    fields = [
        *_field(rows),
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
    names = [f.name for f in fields]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _in_blocks(batches, "_text"):
            h = [block.column(f"_h{i}").to_numpy() for i in (1, 2, 3, 4)]
            made = cut_block(block.column("_text"), h)
            columns = [block.column("kept")] if keep else []
            yield pa.RecordBatch.from_arrays([*columns, *made.values()], names=names)

    return rows.mapInArrow(cut, T.StructType(fields))


def restored(examples: DataFrame) -> DataFrame:
    """The frame of (output, form, ...) with ``restored``, the text of each example."""
    schema = T.StructType(
        [*(f for f in examples.schema if f.name != "restored"), T.StructField("restored", T.StringType())]
    )
    names = schema.fieldNames()

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _in_blocks(batches, "output"):
            texts = restore_block(block.column("output"), block.column("form"))
            columns = [block.column(c) for c in names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, texts], names=names)

    return examples.mapInArrow(rebuild, schema)


def digest_rows(examples: DataFrame) -> DataFrame:
    """Hashes of the outputs and of the texts rebuilt from them."""
    return restored(examples).select(
        F.col("kept.doc_id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )
