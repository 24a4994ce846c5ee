import math

import pytest
from pyspark.sql import functions as F

from frame_rows import rows
from tabwright.functions.columns import (
    binary_label,
    int_via_double,
    safe_ratio,
    stable_bucket,
)
from tabwright.functions.spec import TableSpec
from tabwright.operators import clean, profile

SPEC = TableSpec("id", ("kind",), ("n",), ("x",), "y", "Yes", "No")
RAW = [
    ("1", " a ", "3", "1.5", "Yes"),
    ("2", "   ", "3", "1.5", "No"),  # blank category
    ("3", "\t", "3", "1.5", "No"),  # a tab is not a space and stays
    ("4", "a", "12x", "1.5", "No"),  # malformed whole number
    ("5", "a", "12.5", "1.5", "No"),  # a fraction is no whole number
    ("6", "a", "3", "NaN", "No"),  # not a number
    ("7", None, "3", "1.5", "No"),
    ("8", "b", "3", "-2", None),
    ("9", "b", " 4 ", " 7 ", "No"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(RAW, SPEC.text_schema())


def test_cleaning_keeps_complete_rows_only(raw):
    assert rows(clean.clean(raw, SPEC)) == [
        ("1", "a", 3, 1.5, "Yes"),
        ("3", "\t", 3, 1.5, "No"),
        ("9", "b", 4, 7.0, "No"),
    ]


def test_accounting_agrees_with_cleaning(raw):
    account = profile.cleaning_accounts(clean.to_typed(raw, SPEC), SPEC).first()
    assert tuple(account) == (len(RAW), 3, len(RAW) - 3)


def test_further_columns_count_only_when_asked_for(raw):
    wider = raw.withColumn("note", F.lit(" "))
    assert clean.clean(wider, SPEC).count() == 3
    assert clean.clean(wider, SPEC, subset=wider.columns).count() == 0


def test_empty_input(spark):
    empty = spark.createDataFrame([], SPEC.text_schema())
    assert clean.clean(empty, SPEC).count() == 0
    account = profile.cleaning_accounts(clean.to_typed(empty, SPEC), SPEC).first()
    assert tuple(account) == (0, 0, 0)


def test_null_counts(raw):
    counts = dict(rows(profile.null_counts(clean.to_typed(raw, SPEC))))
    assert counts == {"id": 0, "kind": 2, "n": 2, "x": 0, "y": 1}


def test_whole_numbers_through_double(spark):
    df = spark.createDataFrame([("3.0",), ("-2.9",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(int_via_double(F.col("t"))).collect()] == [
        3,
        -2,
        None,
        None,
    ]


def test_safe_ratio_and_label(spark):
    df = spark.createDataFrame([(1, 0, "Yes"), (1, 4, "No"), (0, 0, "?")], "a int, b int, c string")
    ratios = [r[0] for r in df.select(safe_ratio(F.col("a"), F.col("b"))).collect()]
    assert ratios == [0.0, 0.25, 0.0]
    labels = [r[0] for r in df.select(binary_label(F.col("c"), "Yes", "No")).collect()]
    assert labels == [1.0, 0.0, None]


def test_bucket_does_not_depend_on_partitions(spark):
    ids = spark.range(2000).withColumn("b", stable_bucket(F.col("id"), "s:"))
    assert rows(ids.repartition(7)) == rows(ids.coalesce(1))
    assert ids.agg(F.min("b"), F.max("b")).first() == (0, 99)


def test_resolve_columns_takes_the_first_match(spark):
    df = spark.createDataFrame([(1, 2)], "AUC int, auc_old int")
    assert rows(clean.resolve_columns(df, {"area": ["ROC_AUC", "AUC", "auc_old"]})) == [(1,)]
    with pytest.raises(KeyError, match="area"):
        clean.resolve_columns(df, {"area": ["nothing"]})


def test_display_names(spark):
    df = spark.createDataFrame([("a",), ("z",)], "m string")
    assert rows(clean.with_display_name(df, "m", {"a": "Alpha"})) == [("a", "Alpha"), ("z", "z")]
    assert rows(clean.with_display_name(df, "m", {})) == [("a", "a"), ("z", "z")]


def test_profile_helpers(raw):
    assert profile.row_count(raw).first()[0] == len(RAW)
    assert rows(profile.label_values(raw, "y")) == rows(raw.select("y").distinct())
    assert [r["id"] for r in profile.first_rows(raw, ["id"], 2).collect()] == ["1", "2"]
    assert rows(profile.schema_rows(raw))[0] == (0, "id", "string")


def test_split_percentages(spark):
    df = spark.createDataFrame([("train",)] * 2 + [("test",)], "split string")
    assert rows(profile.split_accounting(df)) == [("test", 1, 33.33), ("train", 2, 66.67)]
    assert not any(math.isnan(r[2]) for r in rows(profile.split_accounting(df)))
