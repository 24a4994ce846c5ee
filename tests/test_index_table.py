import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from frame_rows import rows
from tabwright.functions.spec import TableSpec
from tabwright.functions.vectors import set_cells, vector_size
from tabwright.operators import features as f
from tabwright.operators import index_table as t
from tabwright.operators.validate import ValidationError
from tabwright.plans.prepare import prepare, prepare_wide

SPEC = TableSpec("id", ("color", "user"), ("n",), ("x",), "y", "Yes", "No")


@pytest.fixture(scope="module")
def table(spark):
    """Two thirds of the rows share a color; users are nearly as many as rows."""
    ids = spark.range(3_000)
    color = F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7))
    user = F.when(F.col("id") % 10 > 0, F.concat(F.lit("u"), F.col("id") % 1_999))
    return ids.select(
        F.col("id").cast("string").alias("id"),
        color.alias("color"),
        user.alias("user"),
        (F.col("id") % 4).cast("int").alias("n"),
        (F.col("id") % 9 / 8.0).alias("x"),
        F.when(F.col("id") % 2 == 0, "Yes").otherwise("No").alias("y"),
    )


def encoded(df, train, path, **more):
    index = t.fit_index_table(train, SPEC, f"{path}/index")
    return index, t.write_features(df, index, f"{path}/features", **more)


def dense(df):
    cells = F.when(F.col("features").isNotNull(), vector_to_array("features"))
    return rows(df.select("id", cells.alias("v"), "label"))


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_equal_to_the_encoder_of_small_vocabularies(spark, table, tmp_path, broadcast):
    train = table.where("cast(id as int) % 5 > 0")
    pipeline = f.fit_encoder(train, SPEC)
    wanted = f.encode(table, pipeline, SPEC)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        index, found = encoded(table, train, tmp_path)
        assert dense(found) == dense(wanted)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert index.width == len(f.slots(pipeline, SPEC))
    assert rows(t.slot_rows(spark, index)) == sorted(f.slots(pipeline, SPEC), key=repr)
    assert t.load_index_table(spark, index.path, SPEC) == index


def test_unseen_null_and_repeated_rows(spark, tmp_path):
    schema = "id string, color string, user string, n int, x double, y string"
    train = spark.createDataFrame([("1", "red", "a", 1, 1.0, "Yes"), ("2", "red", "b", 1, 1.0, "No")], schema)
    data = [
        ("3", "red", "b", 0, 2.0, "Yes"), ("3", "red", "b", 0, 2.0, "Yes"),
        ("4", "blue", None, 7, 0.0, "?"), ("5", None, "zz", 0, 0.0, "No"),
        ("6", "red", "a", None, 1.0, "No"), (None, "red", "a", 1, 1.0, "No"),
    ]
    _, found = encoded(spark.createDataFrame(data, schema), train, tmp_path)
    expected = [
        ("3", [0.0, 2.0, 1.0, 0.0, 1.0], 1.0), ("3", [0.0, 2.0, 1.0, 0.0, 1.0], 1.0),
        ("4", [7.0, 0.0, 0.0, 0.0, 0.0], None), ("5", [0.0] * 5, 0.0),
        ("6", None, 0.0), (None, [1.0, 1.0, 1.0, 1.0, 0.0], 0.0),
    ]
    assert dense(found) == sorted(expected, key=repr)
    cells = rows(set_cells(found, "id", "features"))
    assert ("3", 1, 2.0) in cells and not [c for c in cells if c[0] in ("5", "6")]
    assert rows(found.select(vector_size("features"))) == [(5,)] * 5 + [(None,)]


def test_more_values_than_the_driver_would_hold_can_be_fitted(spark, table, tmp_path):
    with pytest.raises(f.VocabularyTooLarge):
        f.fit_encoder(table, SPEC, max_values=100)
    index, found = encoded(table, table, tmp_path, keep=["n"])
    assert found.columns == ["id", "features", "label", "n"]
    model = LogisticRegression(maxIter=2).fit(found)
    assert model.numFeatures == index.width == 2 + 8 + table.select("user").distinct().count() - 1


def test_prepare_wide_has_the_rows_of_prepare(spark, table, tmp_path):
    raw = table.select(*[F.col(c).cast("string").alias(c) for c in table.columns]).na.fill("none")
    narrow = prepare(raw, SPEC)
    wide = prepare_wide(raw, SPEC, f"{tmp_path}/i", f"{tmp_path}/f")
    assert wide.width == narrow.width
    for part in ("train", "test"):
        assert dense(wide.split(part)) == dense(narrow.split(part))
    folders = {p.name for p in (tmp_path / "f").iterdir() if p.is_dir()}
    assert folders == {"split=train", "split=test"}


def test_gates(spark, table, tmp_path, monkeypatch):
    raw = table.select(*[F.col(c).cast("string").alias(c) for c in table.columns]).na.fill("none")
    odd = raw.withColumn("y", F.when(F.col("id") == "5", "?").otherwise(F.col("y")))
    with pytest.raises(ValidationError, match="label"):
        prepare_wide(odd, SPEC, f"{tmp_path}/i", f"{tmp_path}/f")
    with pytest.raises(ValueError, match="no value to index in: \\['color'\\]"):
        nothing = table.withColumn("color", F.lit(None).cast("string"))
        t.fit_index_table(nothing, SPEC, f"{tmp_path}/j")
    monkeypatch.setattr(t, "MOST_SLOTS", 50)
    with pytest.raises(ValueError, match="50 at most"):
        t.load_index_table(spark, f"{tmp_path}/i", SPEC)


def test_rows_without_a_value_to_look_up_are_spread(spark, table, tmp_path):
    """Two thirds of the rows have the hot color and a tenth no user: with shuffles for
    all but the hot values, no task gets more than a few times its share."""
    index = t.fit_index_table(table, SPEC, f"{tmp_path}/index")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        spread = F.xxhash64(F.col("id"), F.lit("spread"))
        joined = t._with_index(table, index, "color", spread)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert sum(sizes) == 3_000 and max(sizes) < 3 * 3_000 / 8
