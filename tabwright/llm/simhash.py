"""Near-duplicates by 64-bit SimHash fingerprints and covering bit masks.

Masks come from a code: every bit gets a nonzero vector of ``radius + 1`` bits, and
every nonzero vector v makes one table whose mask keeps the bits with odd inner
product with v. Fewer than ``radius + 1`` differing bits leave some v orthogonal to
all their vectors, so two fingerprints within the radius agree under that mask: no
pair is ever missed, whatever the data.

Null or empty text: no shingle, fingerprint zero, linked like any other. Fewer words
than a shingle: one shingle of all words. Rows of one fingerprint are one node, so
copies are never compared. Null ids count as rows; they never are a component's
smallest id unless it has no other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.llm.common import saved
from tabwright.llm.links import components

BITS = 64
#: Buckets up to this size are compared in one go; larger ones are cut by more masks.
BUCKET = 512
LEVELS = 8
#: Texts that a worker takes to their shingles at once.
SLICE = 512
#: Texts whose shingles are counted to tell common ones, and how many of these are kept.
ORDER_DOCS, ORDER_SHINGLES = 4_096, 65_536
#: Bits of a text's sketch for each of its different shingles.
SKETCH_BITS = 4
#: Members of a bucket that are held against all of it: first, then (times eight a round).
FIRST_ROOTS, SECOND_ROOTS = 16, 4


def covering_masks(radius: int, level: int) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits; another level is another code."""
    dims = radius + 1
    drawn = np.random.default_rng(1_000 * radius + level).permutation(np.arange(1, 2**dims))
    vectors = np.resize(drawn, BITS)
    return [
        sum(1 << i for i in range(BITS) if int(vectors[i] & v).bit_count() & 1)
        for v in range(1, 2**dims)
    ]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def words_of(text: str | None) -> list[bytes]:
    """Bytes are lower-cased and split, which for UTF-8 touches ASCII letters and gaps
    only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fingerprint(text: str | None, width: int) -> int:
    """The majority of the shingles' hash bits, as an unsigned number; each occurrence
    counts."""
    words = words_of(text)
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), 42)
    shifted = [words[i:] for i in range(width)]
    hashes = np.fromiter(
        (digest(b" ".join(s), 42) for s in zip(*shifted)), np.uint64, len(words) - width + 1
    )
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65_536):
        block = hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def shingles(text: str | None, width: int) -> np.ndarray:
    """The different hashes of a text's shingles, as signed numbers."""
    words = words_of(text)
    found = [words[i:] for i in range(min(width, max(len(words), 1)))]
    hashes = {xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*found)}
    return np.sort(np.fromiter(hashes, np.uint64, len(hashes)).view(np.int64))


def sketch(hashes: np.ndarray) -> bytes:
    """One bit for each slot that holds an odd number of a set's hashes. The slots are a
    power of two, so a larger sketch folds to that of fewer slots."""
    slots = max(64, 1 << (SKETCH_BITS * len(hashes) - 1).bit_length())
    at = (hashes.view(np.uint64) & np.uint64(slots - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=slots) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def apart(one: bytes, other: bytes) -> int:
    """The slots odd in one of two sketches only: never more than the hashes that only one
    of their sets has, as those in both cancel out."""
    small, large = sorted((np.frombuffer(s, np.uint8) for s in (one, other)), key=len)
    folded = np.bitwise_xor.reduce(large.reshape(-1, len(small)))
    return int(np.bitwise_count(folded ^ small).sum())


def _slices(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """So few texts at a time that a worker's arrays of their shingles stay small."""
    for texts in batches:
        for at in range(0, len(texts), SLICE):
            yield texts.iloc[at : at + SLICE]


def _shingled(width: int):
    @F.pandas_udf("fp long, s array<long>")
    def shingled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in _slices(batches):
            fps = np.array([whole_text(t) for t in texts], np.int64)
            yield pd.DataFrame({"fp": fps, "s": [shingles(t, width) for t in texts]})

    return shingled


def _sketched(width: int):
    @F.pandas_udf("fp long, n int, sketch binary")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in _slices(batches):
            sets = [shingles(t, width) for t in texts]
            yield pd.DataFrame(
                {
                    "fp": np.array([whole_text(t) for t in texts], np.int64),
                    "n": np.array([len(s) for s in sets], np.int32),
                    "sketch": [sketch(s) for s in sets],
                }
            )

    return sketched


def with_fingerprint(df: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """The frame with ``fp``, the fingerprint as a signed long."""

    @F.pandas_udf(T.LongType())
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in _slices(batches):
            yield pd.Series(
                np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            )

    return df.withColumn("fp", simhash(F.col(text)))


def _local_trees(radius: int):
    """Batches of buckets to the edges of a spanning tree of each connected part; every
    edge is a pair within the radius. The trees start where the bucket's own seed says,
    not alike in all buckets."""

    def tree(values: np.ndarray) -> Iterator[tuple[int, int]]:
        values = np.sort(values)
        bits = values.view(np.uint64)
        order = np.random.default_rng(int(np.bitwise_xor.reduce(bits))).permutation(len(values))
        values, bits = values[order], bits[order]
        unseen = np.ones(len(values), bool)
        for root in range(len(values)):
            stack = [root] if unseen[root] else []
            unseen[root] = False
            while stack:
                i = stack.pop()
                near = unseen & (np.bitwise_count(bits ^ bits[i]) <= radius)
                for j in np.flatnonzero(near).tolist():
                    yield int(values[i]), int(values[j])
                    stack.append(j)
                unseen[near] = False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["fps"].map(len)
            two = batch["fps"][sizes == 2]
            out: list[tuple[int, int]] = []
            if len(two):
                pairs = np.stack(two.to_list()).astype(np.int64)
                close = np.bitwise_count((pairs[:, 0] ^ pairs[:, 1]).view(np.uint64)) <= radius
                out += map(tuple, pairs[close].tolist())
            for values in batch["fps"][sizes > 2]:
                values = np.asarray(values, np.int64)
                out += tree(values)
            edges = np.array(out, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"u": edges[:, 0], "v": edges[:, 1]})

    return run


def links(fps: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints (distinct ``fp``) linked by
    chains of at most ``radius`` differing bits.

    A bucket above ``bucket`` is not compared but cut by the masks of the next level:
    pairs in it that belong together still meet under one of them. Each level covers
    about half of the bits left, so the buckets of the last are tiny. Only buckets of
    two and more leave the count; each gives a tree per part, never all its pairs.
    """
    spark = fps.sparkSession
    current = fps.select("fp", F.lit(0).cast("long").alias("bucket"))
    found = spark.createDataFrame([], "u long, v long")
    for level in range(LEVELS):
        masks = F.array(*(F.lit(_signed(m)) for m in covering_masks(radius, level)))
        keys = F.transform(
            masks, lambda m: F.xxhash64(F.col("bucket"), m, F.col("fp").bitwiseAND(m))
        )
        spread = current.select("fp", F.explode(keys).alias("bucket"))
        counts = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = saved(spread.join(counts, "bucket"), "buckets")
        last = level == LEVELS - 1
        small = sized if last else sized.where(F.col("n") <= bucket)
        grouped = small.groupBy("bucket").agg(F.collect_list("fp").alias("fps"))
        edges = grouped.select("fps").mapInPandas(_local_trees(radius), "u long, v long")
        found = found.unionByName(edges)
        current = sized.where(F.col("n") > bucket).select("fp", "bucket")
        if last or current.isEmpty():
            break
    return found


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 3,
    radius: int = 3,
) -> DataFrame:
    """One row per document: (doc_id, fp, component_id), component_id being the
    smallest id among all documents linked to it, itself included."""
    marked, nodes = _nodes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width)
    return _named(marked, nodes, links(nodes.select("fp"), radius))


def _nodes(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every document, and (fp, first_id) of every fingerprint."""
    marked = saved(with_fingerprint(docs, width=width).select("doc_id", "fp"), "fingerprints")
    return marked, saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")


def _named(marked: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    roots = components(edges)
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        nodes["fp"], "first_id", F.coalesce("root", nodes["fp"]).alias("root")
    )
    placed = saved(placed, "placed")
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def _rarest_first(
    hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float
) -> np.ndarray:
    """So many of a set's hashes, in one order for all sets, that two sets of this
    similarity have one of them in common. Hashes in ``common`` (sorted) come last."""
    count = np.zeros(len(hashes), np.int64)
    if len(common) and len(hashes):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        count = np.where(common[at] == hashes, counts[at], 0)
    length = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1 if len(hashes) else 0
    return hashes[np.lexsort((hashes, count))][:length]


def _common(docs: DataFrame, nodes: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about ``ORDER_DOCS`` different texts have, and in how many.
    They only order the shingles: another sample gives other buckets, not other links."""

    shingled = _shingled(width)
    drawn = docs.select("text", F.xxhash64("text").alias("h"))
    drawn = drawn.where(F.pmod("h", F.lit(1 << 30)) * F.lit(nodes) < F.lit(ORDER_DOCS << 30))
    each = drawn.dropDuplicates(["h"]).select(F.explode(shingled("text")["s"]).alias("s"))
    counted = each.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    rows = counted.orderBy(F.desc("n"), "s").limit(ORDER_SHINGLES).collect()
    rows.sort()
    return np.array([r["s"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)


def _buckets(docs: DataFrame, nodes: int, width: int, similarity: float) -> DataFrame:
    """(key, fp, n, pos): texts that share the shingle ``key`` among their rarest, their
    numbers of shingles and its place in their order. Any two texts of this similarity
    meet in the bucket of the first shingle that they share."""
    common, counts = _common(docs, nodes, width)

    @F.pandas_udf("fp long, n int, keys array<long>")
    def rarest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in _slices(batches):
            sets = [shingles(t, width) for t in texts]
            yield pd.DataFrame(
                {
                    "fp": np.array([whole_text(t) for t in texts], np.int64),
                    "n": np.array([len(s) for s in sets], np.int32),
                    "keys": [_rarest_first(s, common, counts, similarity) for s in sets],
                }
            )

    each = docs.select(rarest("text").alias("r")).select("r.*").dropDuplicates(["fp"])
    spread = each.select("fp", "n", F.posexplode("keys").alias("pos", "key"))
    shared = Window.partitionBy("key")
    met = spread.withColumn("lo", F.min("fp").over(shared)).withColumn("hi", F.max("fp").over(shared))
    return met.where("lo != hi").select("key", "fp", "n", "pos")


def _open_pairs(roots: int, similarity: float):
    """Batches of buckets to pairs of different components: the ``roots`` members of the
    most links with every other that may be similar by its length and the shingle's place."""

    def pairs(fp, n, pos, root, degree) -> Iterator[np.ndarray]:
        order = np.lexsort((fp, -degree))
        fp, n, pos, root = fp[order], n[order], pos[order], root[order]
        left = n - pos  # shingles from the shared one on
        for i in range(min(roots, len(fp) - 1)):
            most = np.minimum(left[i], left[i + 1 :])
            may = most * (1 + similarity) >= similarity * (n[i] + n[i + 1 :]) - 1e-6
            others = fp[i + 1 :][may & (root[i + 1 :] != root[i])]
            if len(others):
                yield np.stack([np.maximum(others, fp[i]), np.minimum(others, fp[i])], axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for row in batch.itertuples(index=False):
                for block in pairs(*(np.asarray(x, np.int64) for x in row)):
                    out.append(block)
                    held += len(block)
                    if held > 100_000:
                        yield pd.DataFrame(np.concatenate(out), columns=["u", "v"])
                        out, held = [], 0
            if out:
                yield pd.DataFrame(np.concatenate(out), columns=["u", "v"])

    return run


def _row() -> Column:
    """Tells rows apart, so that a text is fetched once however many copies it has."""
    return F.xxhash64("doc_id", "text").alias("row")


def _sketches(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(fp, row, n, sketch) of the wanted texts: one row that has the text, its number of
    different shingles and their sketch, some 1/16 of the shingles in size. The function
    bears no copy of itself in a filter, which the join would else put below it: two in a
    row take twice the time and twice the Python workers."""
    sketched = _sketched(width).asNondeterministic()
    marks = docs.select(_row(), sketched("text").alias("m")).select("row", "m.*")
    each = marks.groupBy("fp").agg(
        F.min("row").alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    return each.join(wanted, "fp", "left_semi")


def _may_be(similarity: float):
    """Whether two texts may be this similar by their numbers of shingles and sketches."""

    @F.pandas_udf("boolean")
    def may_be(n: pd.Series, one: pd.Series, other: pd.Series) -> pd.Series:
        differing = np.array([apart(a, b) for a, b in zip(one, other)], np.float64)
        return pd.Series(differing * (1 + similarity) <= n * (1 - similarity) + 1e-6)

    return may_be


def _similar(
    pairs: DataFrame, sketches: DataFrame, docs: DataFrame, width: int, similarity: float
) -> DataFrame:
    """The pairs (u, v) whose whole shingle sets are this similar. Sketches rule out most
    of the others; only the texts of what they leave are fetched, and held against each
    other by their sets."""
    mark = F.struct("row", "n", "sketch")
    met = pairs.join(sketches.select(F.col("fp").alias("u"), mark.alias("a")), "u").join(
        sketches.select(F.col("fp").alias("v"), mark.alias("b")), "v"
    )
    may_be = _may_be(similarity)(F.col("a.n") + F.col("b.n"), "a.sketch", "b.sketch")
    left = met.where(may_be).select("u", "v", F.array("a.row", "b.row").alias("rows"))
    left = saved(left, "near_pairs")
    rows = saved(left.select(F.explode("rows").alias("row")).distinct(), "near_rows")
    texts = docs.select("text", _row()).join(rows, "row", "left_semi")
    sets = texts.select(_shingled(width)("text").alias("m")).select("m.fp", "m.s")
    sets = saved(sets.dropDuplicates(["fp"]), "shingles")
    both = (
        left.join(sets.select(F.col("fp").alias("u"), F.col("s").alias("a")), "u")
        .join(sets.select(F.col("fp").alias("v"), F.col("s").alias("b")), "v")
        .withColumn("common", F.size(F.array_intersect("a", "b")))
    )
    union = F.size("a") + F.size("b") - F.col("common")
    return both.where(F.col("common") >= similarity * union).select("u", "v")


def _marked(docs: DataFrame, width: int) -> DataFrame:
    """(whole, fp) of each text, from one function: two in a row would take two Python
    workers for a task, which the executor keeps."""

    @F.pandas_udf("whole long, fp long")
    def marks(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in _slices(batches):
            fps = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            whole = np.array([whole_text(t) for t in texts], np.int64)
            yield pd.DataFrame({"whole": whole, "fp": fps})

    return docs.select(marks("text").alias("m")).select("m.whole", "m.fp")


def fingerprint_pairs(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """Pairs (u, v) of different texts, by ``whole_text``, that connect exactly what
    fingerprints within the radius link: each text with the first of its fingerprint, and
    the first ones of linked fingerprints."""
    marked = saved(_marked(docs, width).distinct(), "fingerprints")
    nodes = saved(marked.groupBy("fp").agg(F.min("whole").alias("first")), "nodes")
    same = marked.join(nodes, "fp").select(F.col("whole").alias("a"), F.col("first").alias("b"))
    linked = (
        links(nodes.select("fp"), radius)
        .join(nodes.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u")
        .join(nodes.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    )
    both = same.unionByName(linked.select("a", "b")).where("a != b")
    return both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _similar_links(docs: DataFrame, nodes: int, width: int, similarity: float) -> DataFrame:
    """Links (u, v) between texts, by ``fp``, that connect exactly what all pairs of this
    similarity connect. First the pairs that SimHash links, each held against the whole
    shingle sets; what these join is not compared again. Then, for what fingerprints alone
    would miss, rounds: some members of each bucket are held against the others
    of it that are in another component so far; those with the most links, as the
    original of many copies has after the first round, come first, and more each round
    until every pair of a bucket is in one component or has been checked."""
    members = saved(_buckets(docs, nodes, width, similarity), "buckets")
    wanted = members.select("fp").distinct()

    sketches = saved(_sketches(docs, wanted, width), "sketches")
    checked = saved(fingerprint_pairs(docs), "fingerprint_pairs")
    found = saved(_similar(checked, sketches, docs, width, similarity), "links")
    parts = saved(components(found), "parts")
    roots, turn = FIRST_ROOTS, 0
    while True:
        ends = found.select(F.explode(F.array("u", "v")).alias("node"))
        degrees = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        known = parts.join(degrees, "node").withColumnRenamed("node", "fp")
        root, degree = F.coalesce("root", "fp"), F.coalesce("degree", F.lit(0))
        member = F.struct("fp", "n", "pos", root.alias("root"), degree.alias("degree"))
        placed = members.join(known, "fp", "left").select("key", member.alias("m"))
        grouped = placed.groupBy("key").agg(
            F.collect_list("m").alias("m"), F.min("m.root").alias("lo"), F.max("m.root").alias("hi")
        )
        still = grouped.where("lo != hi").select("m.fp", "m.n", "m.pos", "m.root", "m.degree")
        still = saved(still, "open_buckets")
        largest = still.agg(F.max(F.size("fp"))).first()[0]
        if largest is None:
            break
        pairs = still.mapInPandas(_open_pairs(roots, similarity), "u long, v long").distinct()
        pairs = saved(pairs.join(checked, ["u", "v"], "left_anti"), "pairs")
        linked = saved(_similar(pairs, sketches, docs, width, similarity), "links")
        found, checked = found.unionByName(linked), checked.unionByName(pairs)
        if roots >= largest:
            break
        parts = saved(components(found), "parts")
        roots, turn = SECOND_ROOTS * 8**turn, turn + 1
    return found


def whole_text(text: str | None) -> int:
    """A hash of all words in order, as a signed number: only texts of the same words in
    the same order are one node."""
    digest = xxhash.xxh64_intdigest(b" ".join(words_of(text)), 42)
    return _signed(digest)


def _whole(text: str) -> Column:
    @F.pandas_udf("long")
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([whole_text(t) for t in texts], dtype="int64")

    return whole(text)


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, fp, component_id): documents joined by chains whose links share
    ``similarity`` of their different shingles of ``width`` words.

    Texts of the same words in the same order are copies. Others are held against each
    other by their whole shingle sets: first those that SimHash links, then those that
    share one of their rarest shingles, as all texts this similar do, and are not in one
    component already: no link is missed."""
    marked = saved(docs.select("doc_id", _whole("text").alias("fp")), "contents")
    nodes = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    return _named(marked, nodes, _similar_links(docs, nodes.count(), width, similarity))


def distinct_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Exactly one row of each component of ``similar_documents``: that of the smallest
    id, one without an id only if no other is there. Rows are told apart by all their
    columns, so ids may be null or repeated; of rows equal in all columns any is taken."""
    row = F.md5(F.to_json(F.struct(*docs.columns)).cast("binary")).alias("_row_key")
    marked = saved(docs.select("doc_id", _whole("text").alias("fp"), row), "contents")
    nodes = saved(marked.groupBy("fp").agg(F.lit(0).alias("one")), "nodes")
    roots = components(_similar_links(docs, nodes.count(), width, similarity))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "_row_key")
    placed = marked.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    first = placed.groupBy(F.coalesce("root", "fp")).agg(F.min(place).alias("r"))
    chosen = saved(first.select("r._row_key"), "chosen")
    rows = docs.select("*", row).join(chosen, "_row_key", "left_semi")
    return rows.dropDuplicates(["_row_key"]).select(*docs.columns)


def digest_rows(found: DataFrame) -> DataFrame:
    """The published columns: the fingerprint as 16 hexadecimal digits."""
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
