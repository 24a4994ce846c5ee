"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import saved


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")
    ).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); root is the smallest
    node that can be reached.

    Rounds of large-star and small-star: each node hands its neighbours to the
    smallest of them, until every component is one star. The number of edges never
    grows, smallest neighbours are aggregated before they are shuffled, and each
    round is a written table. Loops and nulls are ignored.
    """
    edges = saved(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(smallest, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        centre = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = (
            large.join(centre, "u")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        kept = centre.select("u", F.col("m").alias("v"))
        edges = saved(moved.unionByName(kept).distinct(), "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    own = roots.select(F.col("root").alias("node"), "root").distinct()
    return roots.unionByName(own)
