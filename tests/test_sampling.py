import pytest
from pyspark.sql import functions as F

from frame_rows import rows
from tabwright.operators import sampling as s


def test_split_is_complete_disjoint_and_stable(spark):
    ids = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    train, test = s.parts(s.with_split(ids, "k"))
    assert train.count() + test.count() == 5000
    assert train.join(test, "k", "left_semi").count() == 0
    assert 0.78 < train.count() / 5000 < 0.82
    again, _ = s.parts(s.with_split(ids.repartition(13), "k"))
    assert rows(again) == rows(train)


def test_salt_gives_another_split(spark):
    ids = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    one, _ = s.parts(s.with_split(ids, "k"))
    two, _ = s.parts(s.with_split(ids, "k", salt="other:"))
    assert rows(one) != rows(two)


def test_random_split_is_complete(spark):
    train, test = s.random_split(spark.range(1000))
    assert rows(train.union(test)) == [(i,) for i in sorted(range(1000), key=lambda i: repr((i,)))]


def test_replicate_multiplies_every_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "n int, t string")
    counts = rows(s.replicate(df, 4).groupBy("n", "t").count())
    assert counts == [(1, "a", 4), (2, "b", 8)]
    assert rows(s.replicate(df, 1)) == rows(df)
    with pytest.raises(ValueError):
        s.replicate(df, 0)


def test_replicate_needs_no_shuffle_and_no_join(spark):
    plan = s.replicate(spark.range(10), 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_layout_does_not_depend_on_the_input_partitions(spark):
    frame = spark.range(1000).selectExpr("id", "cast(id % 7 as string) as v")
    parts = [
        [[r["id"] for r in part] for part in s.laid_out(f, 6).rdd.glom().collect()]
        for f in (frame.repartition(3), frame.coalesce(1), frame.repartition(11, "v"))
    ]
    assert parts[0] == parts[1] == parts[2] and len(parts[0]) == 6
    assert sorted(x for p in parts[0] for x in p) == list(range(1000))
    assert s.laid_out(frame, None) is frame


def test_copies_are_numbered(spark):
    assert rows(s.with_copies(spark.range(1), 3)) == [(0, 0), (0, 1), (0, 2)]


def test_held_frames_keep_their_partitions_and_are_released(spark):
    frame = spark.range(100).coalesce(1)
    with s.held(frame) as (kept,):
        assert kept.rdd.getNumPartitions() == 1
        assert kept.storageLevel.useMemory and kept.storageLevel.useDisk
        assert kept.count() == 100
    assert not kept.storageLevel.useMemory
    assert not frame.storageLevel.useMemory


def test_held_releases_after_an_error(spark):
    with pytest.raises(RuntimeError):
        with s.held(spark.range(10)) as (kept,):
            raise RuntimeError
    assert not kept.storageLevel.useMemory
