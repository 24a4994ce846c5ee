import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql.types import StringType, StructField, StructType

from frame_rows import rows
from tabwright.sources import sinks, tables
from tabwright.sources.workspace import fresh_path, shared_dir

TEXT = StructType([StructField(c, StringType()) for c in ("a", "b")])


def test_text_csv_keeps_outer_spaces(spark, tmp_path):
    df = spark.createDataFrame([("1", "  "), ("2", " x ")], TEXT)
    path = sinks.write_csv(df, str(tmp_path / "c"))
    assert rows(tables.read_csv_text(spark, path, TEXT)) == [("1", "  "), ("2", " x ")]


def test_header_is_checked_against_the_schema(spark, tmp_path):
    path = sinks.write_csv(spark.createDataFrame([("1", "2")], TEXT), str(tmp_path / "c"))
    wrong = StructType([StructField("b", StringType()), StructField("a", StringType())])
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_csv_text(spark, path, wrong).collect()


def test_inferred_types(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, "t")], "i int, d double, s string")
    path = sinks.write_csv(df, str(tmp_path / "c"))
    assert dict(tables.read_csv_inferred(spark, path).dtypes) == {"i": "int", "d": "double", "s": "string"}


def test_missing_store_means_no_rows(spark, tmp_path):
    none = tables.read_stored(spark, str(tmp_path / "nothing"), "a int, b string")
    assert none.count() == 0 and none.dtypes == [("a", "int"), ("b", "string")]


def test_required_rows(spark):
    assert tables.require_rows(spark.range(1), "ids").count() == 1
    with pytest.raises(tables.EmptySource, match="ids"):
        tables.require_rows(spark.range(0), "ids")


def test_stored_csv_is_retyped(spark, tmp_path):
    df = spark.createDataFrame([("1.0", "0.5"), ("2", "")], "n string, v string")
    path = sinks.write_csv(df, str(tmp_path / "c"))
    assert rows(tables.read_stored_csv(spark, path, "n int, v double")) == [(1, 0.5), (2, None)]


def test_verified_sink_notices_lost_rows(spark, tmp_path):
    df = spark.createDataFrame([(Vectors.dense(1, 2), 1)], ["features", "part"])
    good = sinks.write_parquet_verified(df, str(tmp_path / "f"), partition_by=["part"])
    by_rule = {r["rule"]: r["ok"] for r in good.collect()}
    assert by_rule["rows"]
    short = sinks.write_parquet_verified(df, str(tmp_path / "g"), rows=2)
    assert not {r["rule"]: r["ok"] for r in short.collect()}["rows"]


def test_workspace_is_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == folder
    one, two = fresh_path(spark, "x"), fresh_path(spark, "x")
    assert one.startswith(folder) and one != two


def test_id_range(spark):
    assert rows(tables.id_range(spark, 3, "k")) == [(0,), (1,), (2,)]


def test_texts_of_all_kinds_come_back_from_csv(spark, tmp_path):
    texts = ["a\nb", "\r\n", "\\n", "\\", "\\\\n\n\\", 'say "x", "y"', '\\"', " , ", "", None, "#"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    path = sinks.write_csv(df, str(tmp_path / "c"))
    assert sum(len(p.read_text().splitlines()) - 1 for p in (tmp_path / "c").glob("part*")) == len(texts)
    assert rows(tables.read_stored_csv(spark, path, "n int, t string")) == rows(df)


def test_footers_answer_without_reading_data(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "id % 7 - 3.5 as x", "id % 2 as split").write.partitionBy(
        "split"
    ).parquet(path)
    found = sinks.footer_answers(spark, path, "id")
    assert tuple(found.first()) == (1000, 0, 999)
    plan = found._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*), MIN(id), MAX(id)]" in plan
    v1 = spark.conf.get("spark.sql.sources.useV1SourceList")
    assert "parquet" in v1  # the caller's session is as it was
    none = str(tmp_path / "none")
    spark.range(0).write.parquet(none)
    assert tuple(sinks.footer_answers(spark, none, "id").first()) == (None, None, None)
