"""Categories to indices to one-hot slots to feature vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.columns import binary_label
from tabwright.functions.spec import TableSpec
from tabwright.sources.workspace import reliable

MAX_VOCABULARY = 10_000


class VocabularyTooLarge(ValueError):
    """A column has more distinct values than the driver should hold; for such columns
    there is ``operators.index_table``."""


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (column, value), NULLs left out: one scan for all columns. Each task
    first adds up its own rows, so a value that holds a third of the table reaches
    the shuffle as one row per task."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    return (
        df.select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def vocabulary_sizes(counts: DataFrame) -> dict[str, int]:
    """Distinct values per column; one row per column comes to the driver."""
    sized = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))
    return {r["column_name"]: r["n"] for r in sized.collect()}


def category_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, rows, category_index): 0-based rank by falling row count,
    ties by value."""
    return rank_in_ranges(category_counts(df, columns))


def rank_in_ranges(counts: DataFrame) -> DataFrame:
    """Ranks without one task per column, for columns of any number of values: sort
    ranges, rank within a range, add the sizes of the ranges before it. The ranges are
    checkpointed first, as the two uses below must agree on where each of them ends."""
    ranged = reliable(
        counts.repartitionByRange("column_name", F.desc("rows"), "value").withColumn(
            "chunk", F.spark_partition_id()
        )
    )
    sizes = ranged.groupBy("column_name", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = (
        Window.partitionBy("column_name")
        .orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        "column_name",
        "chunk",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"),
    )
    inside = Window.partitionBy("column_name", "chunk").orderBy(F.desc("rows"), "value")
    return (
        ranged.withColumn("place", F.row_number().over(inside) - 1)
        .join(offsets, ["column_name", "chunk"])
        .select(
            "column_name",
            "value",
            "rows",
            (F.col("offset") + F.col("place")).cast("int").alias("category_index"),
        )
    )


def vocabulary(
    df: DataFrame, columns: Sequence[str], max_values: int = MAX_VOCABULARY
) -> dict[str, list[str]]:
    """Values per column in index order, on the driver, where the vector layout is
    made. One job, whose answer is bounded: with more values than the bound allows
    the fit is refused; nothing is cut off."""
    bound = max_values * len(columns)
    ordered: dict[str, list[str]] = {c: [] for c in columns}
    found = category_counts(df, columns).limit(bound + 1)
    for row in found.orderBy("column_name", F.desc("rows"), "value").collect():
        ordered[row["column_name"]].append(row["value"])
    large = [c for c, values in ordered.items() if len(values) > max_values]
    if large:
        raise VocabularyTooLarge(f"more than {max_values} distinct values: {large}")
    empty = [c for c, values in ordered.items() if not values]
    if empty:
        raise ValueError(f"no value to index in: {empty}")
    return ordered


def indexers(values: Mapping[str, Sequence[str]]) -> list[StringIndexerModel]:
    """Indexers for the given values; NULL and unseen values get the next index. One
    per column, as a single model of several columns would pad the shorter lists."""
    return [
        StringIndexerModel.from_labels(
            list(labels),
            inputCol=column,
            outputCol=f"{column}_index",
            handleInvalid="keep",
        )
        for column, labels in values.items()
    ]


def index_by_join(df: DataFrame, index: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Indices for vocabularies that do not belong on the driver: one left join per
    column, whose strategy Spark picks by size. Unseen and NULL get the next index."""
    sizes = index.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))

    def attach(left: DataFrame, name: str) -> DataFrame:
        own = index.filter(F.col("column_name") == name).select(
            F.col("value").alias(name), F.col("category_index").alias(f"{name}_index")
        )
        size = sizes.filter(F.col("column_name") == name).select("n").scalar()
        filled = F.coalesce(F.col(f"{name}_index"), size, F.lit(0)).cast("double")
        return left.join(own, name, "left").withColumn(f"{name}_index", filled)

    return reduce(attach, columns, df)


def fit_encoder(
    train: DataFrame, spec: TableSpec, max_values: int = MAX_VOCABULARY
) -> PipelineModel:
    """Fit on training rows only. Numeric columns come first in ``features``, then
    one slot per known value; an unseen value is a vector of zeros in its slots."""
    values = vocabulary(train, spec.categorical, max_values)
    encoded = [f"{c}_encoded" for c in spec.categorical]
    stages = [
        *indexers(values),
        OneHotEncoder(
            inputCols=[f"{c}_index" for c in spec.categorical], outputCols=encoded
        ),
        VectorAssembler(inputCols=[*spec.numeric, *encoded], outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(train)


def encode(
    df: DataFrame, encoder: PipelineModel, spec: TableSpec, keep: Sequence[str] = ()
) -> DataFrame:
    """key, features, label (if the table has one) and any further columns to keep."""
    columns = [F.col(spec.key), F.col("features")]
    if spec.label in df.columns:
        label = binary_label(F.col(spec.label), spec.positive, spec.negative)
        columns.append(label.alias("label"))
    return encoder.transform(df).select(*columns, *keep)


def slots(encoder: PipelineModel, spec: TableSpec) -> list[tuple[int, str, str | None]]:
    """What each vector slot stands for: (slot, column, value); no value if numeric."""
    named: list[tuple[str, str | None]] = [(c, None) for c in spec.numeric]
    for column, stage in zip(spec.categorical, encoder.stages):
        named += [(column, value) for value in stage.labels]
    return [(i, column, value) for i, (column, value) in enumerate(named)]


def slot_table(df: DataFrame, encoder: PipelineModel, spec: TableSpec) -> DataFrame:
    return df.sparkSession.createDataFrame(
        slots(encoder, spec), "slot int, column_name string, value string"
    )
