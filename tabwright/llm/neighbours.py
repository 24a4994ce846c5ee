"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is then put into the leaf that it
reaches by going to the nearest centre at each node. A query goes through the tree
best bin first: a priority queue of branches by their centre's distance gives leaves in
the order in which they promise most. How many leaves are visited is calibrated: the
number is widened until the exact neighbours of a bounded set of queries are found to
the target share. The visits come in two rounds: the first leaves of each query give a
distance that its last neighbour cannot exceed, and the others give only rows within it.
The vectors of a leaf and the queries that visit it meet in blocks of bounded size, so a
leaf that holds a third of all vectors is many small tasks.

Vectors that are null, empty, all zero, or hold a null or a number that isn't finite
take no part, nor do those of another length than most of the sample. Rows without id
take no part. Queries of equal id and vector are one query, those of equal id and other
vectors are queries of their own; a query does not find rows of its id. Of other rows of
equal id it finds the nearest. Equal distances go to the smaller id. Other columns are
not looked at. No rows give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import saved

SAMPLE = 16_384
BRANCHES = 12
#: Sample vectors at which a node is not cut further.
LEAF = 96
CALIBRATION = 128
TARGET_RECALL = 0.97
#: Vectors of a leaf, and queries, that meet in one task.
BLOCK = 2_048
QUERY_BLOCK = 1_024
#: Leaves of the first round of visits.
FIRST = 4
#: Pairs of a query and a vector that are held at a time.
PAIRS = 1 << 17
SEED = 17
FOUND = "query_id long, query_key long, vec_id long, score double"


@dataclass
class Node:
    centres: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)
    leaf: int = -1


@dataclass
class Tree:
    root: Node
    leaves: int
    width: int

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        out = np.empty(len(vectors), np.int32)
        stack = [(self.root, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            if node.leaf >= 0:
                out[rows] = node.leaf
            elif len(rows):
                nearest = squared(vectors[rows], node.centres).argmin(axis=1)
                stack += [(c, rows[nearest == i]) for i, c in enumerate(node.children)]
        return out

    def best_bins(self, vector: np.ndarray) -> Iterator[int]:
        """Leaves, most promising first."""
        queue: list[tuple[float, int, Node]] = [(0.0, 0, self.root)]
        pushed = 0
        while queue:
            _, _, node = heapq.heappop(queue)
            if node.leaf >= 0:
                yield node.leaf
                continue
            for distance, child in zip(squared(vector[None], node.centres)[0], node.children):
                pushed += 1
                heapq.heappush(queue, (float(distance), pushed, child))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(
        (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :], 0.0
    )


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of row pairs without cancellation."""
    difference = a - b
    return (difference * difference).sum(axis=1)


def fit_tree(sample: np.ndarray) -> Tree:
    """Cut by k-means until a node has few vectors or they are all equal."""
    rng = np.random.default_rng(SEED)
    leaves = 0

    def grow(rows: np.ndarray) -> Node:
        nonlocal leaves
        distinct = np.unique(rows, axis=0)
        if len(rows) <= LEAF or len(distinct) == 1:
            leaves += 1
            return Node(leaf=leaves - 1)
        k = min(BRANCHES, len(distinct), -(-len(rows) // LEAF))
        centres = distinct[rng.choice(len(distinct), k, replace=False)]
        for _ in range(12):
            nearest = squared(rows, centres).argmin(axis=1)
            centres = np.stack(
                [
                    rows[nearest == i].mean(axis=0) if (nearest == i).any() else centres[i]
                    for i in range(k)
                ]
            )
        nearest = squared(rows, centres).argmin(axis=1)
        used = np.unique(nearest)
        if len(used) == 1:
            leaves += 1
            return Node(leaf=leaves - 1)
        return Node(centres[used], [grow(rows[nearest == i]) for i in used])

    root = grow(sample) if len(sample) else Node(leaf=0)
    return Tree(root, max(leaves, 1), sample.shape[1] if len(sample) else 0)


def usable(vector: str) -> Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


def _nearest(found: pd.DataFrame, count: int) -> pd.DataFrame:
    """The ``count`` nearest ids of each query, equal distances by id, each id once."""
    found = found.sort_values(["query_id", "query_key", "score", "vec_id"], kind="stable")
    found = found.drop_duplicates(["query_id", "query_key", "vec_id"])
    return found.groupby(["query_id", "query_key"], sort=False).head(count)


def _top(query_ids, keys, queries, bounds, ids, vectors, count: int) -> pd.DataFrame:
    """The ``count`` nearest ids of a block for each query, by exact distance then id, as
    far as they lie within the query's bound. The fast product picks the pairs that
    rounding could make one of them; of ids that repeat, the nearest row counts."""
    last = count - 1 + len(ids) - len(np.unique(ids))
    out = []
    step = max(1, PAIRS // max(len(ids), 1))
    for start in range(0, len(queries), step):
        part = slice(start, start + step)
        rough = squared(queries[part], vectors)
        size = (vectors * vectors).sum(axis=1).max(initial=0.0)
        size += (queries[part] * queries[part]).sum(axis=1).max(initial=0.0)
        rough[ids[None, :] == query_ids[part, None]] = np.inf
        limit = bounds[part] ** 2
        if len(ids) > last:
            limit = np.minimum(limit, np.partition(rough, last, axis=1)[:, last])
        limit = limit + 1e-9 * (1 + size) + 1e-9 * limit
        query, row = np.nonzero((rough <= limit[:, None]) & np.isfinite(rough))
        query += start
        score = np.sqrt(exact(vectors[row], queries[query]))
        near = score <= bounds[query] * (1 + 1e-12)
        query, row, score = query[near], row[near], score[near]
        found = {"query_id": query_ids[query], "query_key": keys[query]}
        out.append(_nearest(pd.DataFrame(found | {"vec_id": ids[row], "score": score}), count))
    empty = {c.split()[0]: [] for c in FOUND.split(", ")}
    return pd.concat(out) if out else pd.DataFrame(empty)


def ranked(found: DataFrame, count: int) -> DataFrame:
    """(query_id, query_key, rank, vec_id, score): the nearest of each query over all
    blocks. Rows meet by query once, and are sorted, not collected."""
    query = ["query_id", "query_key"]
    met = found.repartition(*query).groupBy(*query, "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy(*query).orderBy("score", "vec_id"))
    placed = met.withColumn("rank", place).where(F.col("rank") <= count)
    return placed.select(*query, "rank", "vec_id", "score")


def calibrated(vectors: DataFrame, tree: Tree, queries: pd.DataFrame, count: int) -> int:
    """Leaves to visit until the target share of the exact neighbours of ``queries``
    (bounded) is found. All rows are compared with them, a batch at a time."""
    queries = queries.drop_duplicates("vec_id")
    if not len(queries):
        return 1
    ids, points = queries["vec_id"].to_numpy(), _stack(queries["vector"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        bounds = np.full(len(ids), np.inf)
        for batch in batches:
            if len(batch):
                own = batch["vec_id"].to_numpy()
                top = _top(ids, ids, points, bounds, own, _stack(batch["vector"]), count)
                leaf = dict(zip(batch["vec_id"], batch["leaf"]))
                top = top.assign(leaf=[leaf[v] for v in top["vec_id"]])
                held = top if held is None else _nearest(pd.concat([held, top]), count)
        if held is not None:
            yield held

    found = vectors.mapInPandas(scan, FOUND + ", leaf int")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = found.withColumn("place", place).where(F.col("place") <= count)
    truth: dict[int, list[int]] = {}
    for r in best.select("query_id", "leaf").collect():
        truth.setdefault(r["query_id"], []).append(r["leaf"])
    places = []
    for query_id, point in zip(ids, points):
        order = {leaf: i for i, leaf in enumerate(tree.best_bins(point))}
        places += [order[leaf] for leaf in truth.get(query_id, [])]
    if not places:
        return 1
    places, visits = np.array(places), 1
    while visits < tree.leaves and (places < visits).mean() < TARGET_RECALL:
        visits += max(1, visits // 4)
    return min(visits, tree.leaves)


def search(
    vectors: DataFrame,
    is_query: Column,
    count: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    target_blocks: Sequence[int] = (BLOCK, QUERY_BLOCK),
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each row for which
    ``is_query`` (over ``vec_id``) holds, among all other rows."""
    block, query_block = target_blocks
    clean = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(vector).cast("array<double>").alias("vector"),
    ).where(F.col("vec_id").isNotNull() & usable("vector"))
    sample = (
        clean.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(SAMPLE).toPandas()
    )
    widths = sample["vector"].map(len)
    width = int(widths.mode().iloc[0]) if len(sample) else 0
    sample = sample[widths == width] if len(sample) else sample
    tree = fit_tree(_stack(sample["vector"]) if len(sample) else np.zeros((0, 0)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=tree.leaf_of(_stack(batch["vector"])))

    placed = saved(
        clean.where(F.size("vector") == width).mapInPandas(
            place, "vec_id long, vector array<double>, leaf int"
        ),
        "leaves",
    )
    visits = calibrated(placed, tree, sample.head(CALIBRATION), count)

    def visit(first: int, end: int):
        """Queries to the leaves that they visit, from one place of their order to another."""

        def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = ["query_id", "query_key", "point", "bound"]
            for batch in batches:
                orders = [
                    list(islice(tree.best_bins(np.asarray(p, np.float64)), first, end))
                    for p in batch["point"]
                ]
                yield batch[names].assign(leaf=orders).explode("leaf").dropna(subset="leaf")

        return leaves

    asking = "query_id long, query_key long, point array<double>, bound double, leaf int"

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")})
        query = [right[c].to_numpy() for c in ("query_id", "query_key")]
        points, bounds = _stack(right["point"]), right["bound"].to_numpy(np.float64)
        ids, vectors = left["vec_id"].to_numpy(), _stack(left["vector"])
        return _top(*query, points, bounds, ids, vectors, count)

    def visited(asked: DataFrame, first: int, end: int, name: str) -> DataFrame:
        """What the rows of the leaves at these places of each query's order give."""
        visiting = saved(asked.mapInPandas(visit(first, end), asking), f"{name}_visits")
        # A row per leaf of the tree, which is bounded by the sample: blocks on either side.
        blocks = F.ceil(F.count(F.lit(1)) / block).alias("blocks")
        query_blocks = F.ceil(F.count(F.lit(1)) / query_block).alias("query_blocks")
        sizes = placed.groupBy("leaf").agg(blocks).join(
            visiting.groupBy("leaf").agg(query_blocks), "leaf"
        )
        sizes = F.broadcast(saved(sizes, f"{name}_leaf_sizes"))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        rows = placed.join(sizes, "leaf").select(
            "leaf",
            F.pmod(F.xxhash64(F.lit(1), "vec_id"), "blocks").alias("b"),
            every("query_blocks").alias("q"),
            "vec_id",
            "vector",
        )
        visits_of_blocks = visiting.join(sizes, "leaf").select(
            "leaf",
            every("blocks").alias("b"),
            F.pmod(F.xxhash64(F.lit(2), "query_id"), "query_blocks").alias("q"),
            "query_id",
            "query_key",
            "point",
            "bound",
        )
        keys = ["leaf", "b", "q"]
        pairs = rows.groupBy(*keys).cogroup(visits_of_blocks.groupBy(*keys))
        return pairs.applyInPandas(meet, FOUND)

    queries = placed.where(is_query).select("vec_id", "vector").distinct().select(
        F.col("vec_id").alias("query_id"),
        F.xxhash64("vec_id", "vector").alias("query_key"),
        F.col("vector").alias("point"),
    )
    unbounded = queries.withColumn("bound", F.lit(float("inf")))
    first = saved(ranked(visited(unbounded, 0, min(FIRST, visits), "first"), count), "first")
    result = ["query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"]
    if visits <= FIRST:
        return first.select(*result)
    last = first.where(F.col("rank") == count).select(
        "query_id", "query_key", F.col("score").alias("found")
    )
    bounded = queries.join(last, ["query_id", "query_key"], "left").select(
        "*", F.coalesce("found", F.lit(float("inf"))).alias("bound")
    )
    more = visited(bounded, FIRST, visits, "more")
    together = first.select(*more.columns).unionByName(more)
    return ranked(together, count).select(*result)
