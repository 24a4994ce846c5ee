"""Encoding of columns with any number of values by a stored index table.

The fit writes (column_name, value, rows, category_index), ranked in sort ranges, one
folder per column; the driver learns how many values each column has and nothing else.
Encoding joins every column with its folder: Spark broadcasts a folder that is small by
its files' size and shuffles for the others. A value that holds a large share of the
training rows is looked up in a broadcast of such values, of which there can only be a
few, and its rows stay where they are; in the shuffle after that, rows without a value
to look up are dealt by a hash of their key. The slots that are set become the
sparse vector's own fields, so a row costs what it has, not how wide the table is.

The vectors are written to Parquet and read back as ML vectors. Slots are those of
``features.fit_encoder``: numeric columns, then each column's values by falling row count,
ties by value. NULL and unseen values set no slot. A row with a NULL number has a NULL
vector, which the gate before a fit reports. Rows are kept, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import binary_label
from tabwright.functions.spec import TableSpec
from tabwright.operators.features import category_counts, rank_in_ranges

#: A value with more than this share of the training rows is looked up by broadcast;
#: a column has fewer than 1 / HOT such values.
HOT = 1 / 256
#: Vectors are numbered by 32-bit integers.
MOST_SLOTS = (1 << 31) - 1
VALUES, COLUMNS = "values", "columns"
_INDEX = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("category_index", T.IntegerType()),
        T.StructField("column_name", T.StringType()),
    ]
)


@dataclass(frozen=True)
class IndexTable:
    """Where the index lies, the number of values of each column, and the rows that
    each column's values were counted in."""

    path: str
    spec: TableSpec
    sizes: dict[str, int]
    counted: dict[str, int]

    @property
    def first_slots(self) -> dict[str, int]:
        sizes = [self.sizes[c] for c in self.spec.categorical]
        starts = accumulate([len(self.spec.numeric), *sizes])
        return dict(zip(self.spec.categorical, starts))

    @property
    def width(self) -> int:
        return len(self.spec.numeric) + sum(self.sizes.values())

    def values(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_INDEX).parquet(f"{self.path}/{VALUES}")


def fit_index_table(train: DataFrame, spec: TableSpec, path: str) -> IndexTable:
    """Count, rank and write the values of all categorical columns from one scan."""
    ranked = rank_in_ranges(category_counts(train, spec.categorical))
    spark = train.sparkSession
    ranked.select(*_INDEX.names).write.partitionBy("column_name").parquet(f"{path}/{VALUES}")
    written = spark.read.schema(_INDEX).parquet(f"{path}/{VALUES}")
    found = written.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("size"), F.sum("rows").alias("rows")
    )
    found.coalesce(1).write.parquet(f"{path}/{COLUMNS}")
    return load_index_table(spark, path, spec)


def load_index_table(spark: SparkSession, path: str, spec: TableSpec) -> IndexTable:
    """A stored index, checked against the columns that are to be encoded by it."""
    found = {r["column_name"]: r for r in spark.read.parquet(f"{path}/{COLUMNS}").collect()}
    missing = [c for c in spec.categorical if c not in found]
    if missing:
        raise ValueError(f"no value to index in: {missing}")
    index = IndexTable(
        path,
        spec,
        {c: found[c]["size"] for c in spec.categorical},
        {c: found[c]["rows"] for c in spec.categorical},
    )
    if index.width > MOST_SLOTS:
        raise ValueError(f"{index.width} slots; a vector has {MOST_SLOTS} at most")
    return index


def _with_index(df: DataFrame, index: IndexTable, column: str, spread: Column) -> DataFrame:
    """The frame with ``_<column>_at``, the value's index or NULL."""
    spark = df.sparkSession
    own = index.values(spark).where(F.col("column_name") == column)
    hot = own.where(F.col("rows") > F.lit(index.counted[column] * HOT))
    text = F.col(column).cast("string")
    first = df.withColumn("_value", text).join(
        F.broadcast(hot.select(F.col("value").alias("_value"), F.col("category_index").alias("_hot"))),
        "_value",
        "left",
    )
    # NULLs would share one task: rows without a value to look up have a key of their own,
    # which no value has, as it begins with another letter.
    asked = F.when(F.col("_hot").isNull(), F.concat(F.lit("v"), F.col("_value")))
    dealt = F.concat(F.lit("n"), spread.cast("string"))
    rest = own.where(F.col("rows") <= F.lit(index.counted[column] * HOT)).select(
        F.concat(F.lit("v"), F.col("value")).alias("_asked"),
        F.col("category_index").alias("_cold"),
    )
    both = first.withColumn("_asked", F.coalesce(asked, dealt)).join(rest, "_asked", "left")
    return both.withColumn(f"_{column}_at", F.coalesce("_hot", "_cold")).drop(
        "_value", "_hot", "_asked", "_cold"
    )


def sparse_fields(index: IndexTable) -> Column:
    """The stored fields of the vector, from numeric columns and indices."""
    spec = index.spec

    def cell(slot: Column, value: Column) -> Column:
        return F.struct(slot.cast("int").alias("slot"), value.cast("double").alias("value"))

    numbers = [F.col(c).cast("double") for c in spec.numeric]
    cells = [cell(F.lit(i), number) for i, number in enumerate(numbers)]
    for column, start in index.first_slots.items():
        at = F.col(f"_{column}_at")
        cells.append(F.when(at.isNotNull(), cell(F.lit(start) + at, F.lit(1.0))))
    kept = F.filter(F.array(*cells), lambda c: c.isNotNull() & (c["value"] != 0))
    fields = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(index.width).cast("int").alias("size"),
        F.transform(kept, lambda c: c["slot"]).alias("indices"),
        F.transform(kept, lambda c: c["value"]).alias("values"),
    )
    if not numbers:
        return fields
    return F.when(F.array_position(F.transform(F.array(*numbers), F.isnull), True) == 0, fields)


def write_features(
    df: DataFrame,
    index: IndexTable,
    path: str,
    keep: Sequence[str] = (),
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Encode, write, and read back: key, features, label (if the table has one) and
    the columns to keep."""
    spec = index.spec
    needed = [spec.key, *spec.categorical, *spec.numeric, *keep]
    has_label = spec.label in df.columns
    rows = df.select(*dict.fromkeys([*needed, *([spec.label] if has_label else [])]))
    spread = F.xxhash64(F.col(spec.key), F.lit("spread"))
    for column in spec.categorical:
        rows = _with_index(rows, index, column, spread)
    label = binary_label(F.col(spec.label), spec.positive, spec.negative)
    rows.select(
        F.col(spec.key),
        sparse_fields(index).alias("features"),
        *([label.alias("label")] if has_label else []),
        *keep,
    ).write.partitionBy(*partition_by).parquet(path)
    return read_features(df.sparkSession, path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The stored table with its vectors as vectors."""
    stored = spark.read.parquet(path)
    fields = [
        T.StructField("features", VectorUDT()) if f.name == "features" else f
        for f in stored.schema
    ]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def slot_rows(spark: SparkSession, index: IndexTable) -> DataFrame:
    """What each slot stands for: (slot, column_name, value); no value if numeric. As
    long as the vectors are wide, so it stays a distributed table."""
    starts = F.create_map(*(F.lit(x) for pair in index.first_slots.items() for x in pair))
    named = index.values(spark).select(
        (starts[F.col("column_name")] + F.col("category_index")).alias("slot"),
        "column_name",
        "value",
    )
    numeric = spark.createDataFrame(
        [(i, c, None) for i, c in enumerate(index.spec.numeric)],
        "slot int, column_name string, value string",
    )
    return numeric.unionByName(named)
