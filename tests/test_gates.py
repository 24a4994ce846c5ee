import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from frame_rows import rows
from tabwright.operators import gates
from tabwright.operators import validate as v

FIRST = [(1, "x", 1, 2), (2, "y", 1, 2), (None, "x", 2, 2)]
MORE = [(3, "z", 2, 2), (9, None, 3, 3)]


def all_rules():
    return [
        v.columns_present("a", "gone"),
        v.not_empty(),
        v.no_nulls("a"),
        v.no_nulls("gone"),
        v.domain("label", ("x", "y", "z"), complete=True),
        v.domain("label", ("x", "y")),
        v.width_is("features", 2),
        v.row_count_is(4, severity="warn"),
        v.none_where("doubled_large", F.col("doubled") > 5),
    ]


def doubled():
    return {"doubled": F.col("a") * 2}


def write(spark, data, path, mode="append"):
    made = [(a, label, p, Vectors.dense([1.0] * width)) for a, label, p, width in data]
    df = spark.createDataFrame(made, ["a", "label", "p+ a", "features"])
    df.coalesce(1).write.mode(mode).partitionBy("p+ a").parquet(path)


def whole(spark, path):
    return rows(v.validate(spark.read.parquet(path).withColumns(doubled()), all_rules()))


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "ta ble"), str(tmp_path / "state")


def gate(spark, place, rules=None):
    return gates.gate_table(spark, *place, rules or all_rules(), doubled())


def test_an_append_is_checked_from_its_own_files(spark, place):
    write(spark, FIRST, place[0])
    first = gate(spark, place)
    assert (first.files, len(first.scanned)) == (2, 2)
    assert rows(first.report) == whole(spark, place[0])
    write(spark, MORE, place[0])
    second = gate(spark, place)
    assert (second.files, len(second.scanned)) == (4, 2)
    assert not set(first.scanned) & set(second.scanned)
    assert rows(second.report) == whole(spark, place[0])
    again = gate(spark, place)
    assert (again.files, again.scanned) == (4, ())
    assert rows(again.report) == whole(spark, place[0])
    observed = {r["rule"]: r["observed"] for r in again.report.collect()}
    assert observed["width:features"] == "2-3" and observed["not_empty"] == "5"


def test_only_new_files_are_read(spark, place, monkeypatch):
    write(spark, FIRST, place[0])
    gate(spark, place)
    write(spark, MORE, place[0])
    seen = []
    measure = gates.file_states

    def watched(scan, *rest):
        seen.extend(scan.inputFiles())
        return measure(scan, *rest)

    monkeypatch.setattr(gates, "file_states", watched)
    assert len(gate(spark, place).scanned) == len(seen) == 2
    gate(spark, place)
    assert len(seen) == 2


def test_rewritten_and_removed_files(spark, place):
    write(spark, FIRST + MORE, place[0])
    gate(spark, place)
    write(spark, [(7, "y", 1, 2)], place[0], "overwrite")
    after = gate(spark, place)
    assert (after.files, len(after.scanned)) == (1, 1)
    assert rows(after.report) == whole(spark, place[0])


def test_other_rules_do_not_use_what_was_kept(spark, place):
    write(spark, FIRST, place[0])
    gate(spark, place)
    rules = [v.no_nulls("label"), v.domain("label", ("x",))]
    other = gate(spark, place, rules)
    assert len(other.scanned) == 2
    assert rows(other.report) == rows(v.validate(spark.read.parquet(place[0]), rules))
    assert gate(spark, place).scanned == () == gate(spark, place, rules).scanned


def test_files_without_rows_and_rows_kept_twice(spark, place):
    made = spark.createDataFrame([(1, "x", Vectors.dense([1.0, 2.0]))], ["a", "label", "features"])
    made.limit(0).write.parquet(place[0])
    empty = gate(spark, place)
    assert empty.files == len(empty.scanned) == 1
    assert rows(empty.report) == whole(spark, place[0])
    assert gate(spark, place).scanned == ()
    made.write.mode("append").parquet(place[0])
    gate(spark, place)
    kept = spark.read.parquet(place[1]).collect()
    spark.createDataFrame(kept, gates.STATE).write.mode("append").parquet(place[1])
    twice = gate(spark, place)
    assert twice.scanned == () and rows(twice.report) == whole(spark, place[0])
