"""Splits, copies, and frames that are used more than once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import stable_bucket


def with_split(
    df: DataFrame, key: str, train_percent: int = 80, salt: str = "split:"
) -> DataFrame:
    """A split column that depends on the key alone: no shuffle, and the same answer
    on any number of partitions and after any task is run again."""
    in_train = stable_bucket(F.col(key), salt) < train_percent
    return df.withColumn("split", F.when(in_train, "train").otherwise("test"))


def parts(df: DataFrame, split: str = "split") -> tuple[DataFrame, DataFrame]:
    """(train, test) of a table with a split column."""
    return tuple(
        df.filter(F.col(split) == name).drop(split) for name in ("train", "test")
    )


def random_split(
    df: DataFrame, train_share: float = 0.8, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Spark's own random split. It depends on the partitioning of its input; cut the
    lineage first if that input may be recomputed in another order."""
    train, test = df.randomSplit([train_share, 1 - train_share], seed=seed)
    return train, test


def with_copies(df: DataFrame, n: int, name: str = "copy_id") -> DataFrame:
    """Every row n times, numbered 0 .. n-1: the product with an id table, made by
    each task on its own rows instead of by a join."""
    if n < 1:
        raise ValueError("a table is copied at least once")
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def replicate(df: DataFrame, n: int) -> DataFrame:
    return with_copies(df, n, "_copy").drop("_copy")


def laid_out(df: DataFrame, partitions: int | None) -> DataFrame:
    """The rows in ``partitions`` parts by a hash of all their columns and in its order
    inside each part: the same parts on any cluster and after any retry, which fits of
    trees and of steps need to come out the same. None leaves the frame as it is.
    Equal rows share a part; with a key among the columns there are none."""
    if partitions is None:
        return df
    place = F.xxhash64(*df.columns)
    return df.repartition(partitions, place).sortWithinPartitions(place)


@contextmanager
def held(*frames: DataFrame) -> Iterator[tuple[DataFrame, ...]]:
    """The frames computed once and kept while the block runs, then released, in the
    partitions that they have. Lost executors only cost their own blocks, which Spark
    computes again."""
    kept: list[DataFrame] = []
    try:
        for frame in frames:
            kept.append(_keep(frame))
        yield tuple(kept)
    finally:
        for frame in kept:
            frame.unpersist()


def _keep(frame: DataFrame) -> DataFrame:
    kept = frame.persist(StorageLevel.MEMORY_AND_DISK)
    kept.write.format("noop").mode("overwrite").save()
    return kept
