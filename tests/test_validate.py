import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabwright.operators import validate as v


def report(df, *rules):
    return {r["rule"]: (r["ok"], r["observed"]) for r in v.validate(df, rules).collect()}


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(
        [(Vectors.dense(1, 2), 0.0), (Vectors.dense(3, 4), 0.0), (None, None)],
        ["features", "label"],
    )


def test_rules_from_one_pass(df):
    got = report(
        df,
        v.not_empty(),
        v.no_nulls("features"),
        v.no_nulls("label"),
        v.domain("label", (0.0, 1.0)),
        v.width_is("features", 2),
        v.row_count_is(3),
    )
    assert got == {
        "not_empty": (True, "3"),
        "no_nulls:features": (False, "1"),
        "no_nulls:label": (False, "1"),
        "domain:label": (True, "outside=0 absent=1"),
        "width:features": (True, "2-2"),
        "row_count": (True, "3"),
    }


def test_complete_domain_needs_both_classes(df):
    assert report(df, v.domain("label", (0.0, 1.0), complete=True)) == {
        "domain:label": (False, "outside=0 absent=1")
    }


def test_two_rules_on_one_column_do_not_mix(df):
    got = v.validate(
        df, [v.domain("label", (0.0, 1.0)), v.domain("label", (1.0,))]
    ).collect()
    assert [r["observed"] for r in got] == ["outside=0 absent=1", "outside=2 absent=1"]


def test_missing_column_is_reported_not_raised(df):
    got = report(df, v.columns_present("features", "gone"), v.no_nulls("gone"))
    assert got["columns_present"] == (False, "gone")
    assert got["no_nulls:gone"] == (False, "missing column")


def test_empty_table(df):
    none = df.limit(0)
    got = report(none, v.not_empty(), v.width_is("features", 2), v.no_nulls("label"))
    assert got["not_empty"] == (False, "0")
    assert got["width:features"][0] is False
    assert got["no_nulls:label"] == (True, "0")


def test_enforce_raises_on_errors_and_returns_warnings(df):
    warning = v.row_count_is(7043, severity="warn")
    assert v.enforce(v.validate(df, [warning])) == ["row_count: observed 3, expected 7043"]
    with pytest.raises(v.ValidationError, match="no_nulls:label"):
        v.enforce(v.validate(df, [warning, v.no_nulls("label")]))


def test_numeric_text_and_conditions(spark):
    df = spark.createDataFrame([("1.5",), ("",), ("x",), (None,)], "t string")
    got = report(df, v.numeric_text("t"), v.none_where("short", F.length("t") == 0))
    assert got == {"numeric:t": (False, "3"), "short": (False, "1")}
