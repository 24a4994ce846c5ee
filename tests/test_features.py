import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from frame_rows import rows
from tabwright.functions.spec import TableSpec
from tabwright.functions.vectors import declared_width, flatten_vector, strip_metadata
from tabwright.operators import features as f

SPEC = TableSpec("id", ("color", "size"), (), ("x",), "y", "Yes", "No")
DATA = [
    ("1", "red", "S", 1.0, "Yes"),
    ("2", "red", "M", 2.0, "No"),
    ("3", "blue", "S", 3.0, "No"),
    ("4", "green", "S", 4.0, "No"),
    ("5", None, "M", 5.0, "?"),
]


@pytest.fixture(scope="module")
def table(spark):
    schema = "id string, color string, size string, x double, y string"
    return spark.createDataFrame(DATA, schema)


def test_index_is_by_falling_count_then_value(table):
    assert rows(f.category_index(table, ["color"])) == [
        ("color", "blue", 1, 1),
        ("color", "green", 1, 2),
        ("color", "red", 2, 0),
    ]


def test_ranking_in_ranges_equals_ranking_in_a_window(spark):
    many = spark.range(3000).select(
        F.concat(F.lit("v"), (F.col("id") % 700).cast("string")).alias("a"),
        # one value holds more than a third of all rows
        F.when(F.col("id") % 5 < 2, "hot")
        .otherwise((F.col("id") % 40).cast("string"))
        .alias("b"),
    )
    ranked = rows(f.category_index(many, ["a", "b"]))
    for name in ("a", "b"):
        counted = {r[0]: r[1] for r in many.groupBy(name).count().collect() if r[0] is not None}
        order = sorted(counted, key=lambda v: (-counted[v], str(v)))
        expected = sorted((str(v), counted[v], i) for i, v in enumerate(order))
        assert sorted(r[1:] for r in ranked if r[0] == name) == expected
    assert len(ranked) == 700 + many.select("b").distinct().count()


def test_width_is_numeric_columns_plus_distinct_values(table):
    encoder = f.fit_encoder(table, SPEC)
    encoded = f.encode(table, encoder, SPEC)
    assert declared_width(encoded) == 1 + 3 + 2 == len(f.slots(encoder, SPEC))
    assert [s[1:] for s in f.slots(encoder, SPEC)] == [
        ("x", None),
        ("color", "red"),
        ("color", "blue"),
        ("color", "green"),
        ("size", "S"),
        ("size", "M"),
    ]


def test_unseen_and_null_values_are_all_zero(table):
    encoder = f.fit_encoder(table.filter("color = 'red'"), SPEC)
    cells = flatten_vector(f.encode(table, encoder, SPEC), "id", "features")
    filled = rows(cells.filter("value <> 0"), "id", "slot")
    assert filled == [
        *(("1", 0), ("1", 1), ("1", 3)),
        *(("2", 0), ("2", 1), ("2", 2)),
        *(("3", 0), ("3", 3), ("4", 0), ("4", 3), ("5", 0), ("5", 2)),
    ]


def test_label_is_by_value_not_by_frequency(table):
    encoder = f.fit_encoder(table, SPEC)
    assert rows(f.encode(table, encoder, SPEC), "id", "label") == [
        ("1", 1.0),
        ("2", 0.0),
        ("3", 0.0),
        ("4", 0.0),
        ("5", None),
    ]


def test_table_without_label_can_be_encoded(table):
    encoder = f.fit_encoder(table, SPEC)
    assert f.encode(table.drop("y"), encoder, SPEC).columns == ["id", "features"]


def test_large_vocabulary_is_refused_not_cut(table):
    with pytest.raises(f.VocabularyTooLarge, match="color"):
        f.fit_encoder(table, SPEC, max_values=2)


def test_column_of_nulls_is_refused(table):
    with pytest.raises(ValueError, match="color"):
        f.fit_encoder(table.withColumn("color", F.lit(None).cast("string")), SPEC)


def test_join_form_of_the_index_equals_the_model_form(table):
    columns = ["color", "size"]
    train = table.filter("id <> '4'")
    model = PipelineModel(f.indexers(f.vocabulary(train, columns)))
    names = ["id", "color_index", "size_index"]
    joined = f.index_by_join(table, f.category_index(train, columns), columns)
    assert rows(joined, *names) == rows(model.transform(table), *names)


def test_strip_metadata(table):
    model = PipelineModel(f.indexers({"color": ["red", "blue"]}))
    marked = model.transform(table)
    assert marked.schema["color_index"].metadata
    plain = strip_metadata(marked, "color_index")
    assert plain.schema["color_index"].metadata == {}
    assert rows(plain) == rows(marked)
