import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from frame_rows import rows
from tabwright.operators import selection as s


def number(text, salt="exact:"):
    return int(hashlib.md5((salt + ("\0" if text is None else text)).encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("parts", [1, 7, 64])
@pytest.mark.parametrize("k", [0, 1, 799, 2500, 4999, 5000])
def test_exactly_the_rows_of_the_smallest_hashes(spark, parts, k):
    ids = spark.range(5000).select(F.col("id").cast("string").alias("k"), "id").repartition(parts)
    split = s.exact_split(ids, "k", k)
    assert split.columns == ["k", "id", "split"]
    wanted = sorted(map(str, range(5000)), key=number)[:k]
    assert sorted(r["k"] for r in split.where("split = 'train'").collect()) == sorted(wanted)
    assert split.count() == 5000


def test_share_is_cut_to_a_whole_number(spark):
    split = s.exact_split(spark.range(999).withColumnRenamed("id", "k"), "k")
    assert rows(split.groupBy("split").count()) == [("test", 200), ("train", 799)]


def test_kth_smallest(spark):
    values = [0, 5, 5, 5, 2**60 - 1, 2**59, 7, None]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    known = sorted(v for v in values if v is not None)
    for k in range(1, 8):
        cut = s.kth_smallest(df, "v", k)
        assert cut.value == known[k - 1]
        assert cut.below == sum(v < cut.value for v in known) and cut.below < k
    assert s.kth_smallest(df, "v", 3).equal == 3
    with pytest.raises(ValueError, match="7 rows"):
        s.kth_smallest(df, "v", 8)


HOT = [("hot", i % 3, None) for i in range(300)] + [("hot", 9, "x")] * 100
HOT += [(None, i, "null key") for i in range(40)] + [(str(i), i, "y") for i in range(100)]


@pytest.mark.parametrize("k", [1, 40, 77, 200, 333, 401, 480, 539])
def test_repeated_keys_equal_rows_and_null_keys(spark, k):
    df = spark.createDataFrame(HOT, "key string, split_ int, _row string")
    outcomes = []
    for parts in (1, 9):
        split = s.exact_split(df.repartition(parts), "key", k)
        found = rows(split)
        assert Counter(r[:3] for r in found) == Counter(HOT)
        assert sum(r[3] == "train" for r in found) == k
        outcomes.append(found)
    assert outcomes[0] == outcomes[1]
    train = [number(r[0]) for r in outcomes[0] if r[3] == "train"]
    test = [number(r[0]) for r in outcomes[0] if r[3] == "test"]
    assert max(train) <= min(test)


def test_sizes_that_cannot_be(spark):
    with pytest.raises(ValueError, match="6 training rows of 5"):
        s.exact_split(spark.range(5), "id", 6)
    assert s.exact_split(spark.range(0), "id").collect() == []


def test_the_split_of_different_keys_is_a_projection(spark):
    split = s.exact_split(spark.range(1000).withColumnRenamed("id", "k"), "k", 300)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
