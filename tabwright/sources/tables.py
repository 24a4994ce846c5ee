"""Table sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tabwright.functions.columns import with_line_breaks
from tabwright.functions.layouts import empty, retype, schema_of


class EmptySource(ValueError):
    """A source that must hold rows holds none."""


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and inferred types. Inference reads the whole input once
    more; give a schema to ``read_csv_text`` where the types are known."""
    return spark.read.csv(path, header=True, inferSchema=True)


def read_csv_text(
    spark: SparkSession, path: str, schema: StructType | None = None
) -> DataFrame:
    """CSV with a header, every column as text. With a schema there is no pass over
    the data, and the header is checked against it by name and order."""
    reader = spark.read.option("header", True).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False)
    return reader.csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The frame itself, or an error if it holds no row (looks at one row only)."""
    if df.isEmpty():
        raise EmptySource(f"{what} is empty")
    return df


def read_stored(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Parquet rows of a layout. A path that does not exist yet means no rows."""
    try:
        return spark.read.schema(schema_of(layout)).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, layout)


def read_stored_csv(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """CSV rows that ``write_csv`` wrote, read as text, with their line breaks, and
    re-typed by column name."""
    text = read_csv_text(spark, path)
    return retype(text.select(*(with_line_breaks(c) for c in text.columns)), layout)


def id_range(spark: SparkSession, n: int, name: str = "id") -> DataFrame:
    """0 .. n-1, made inside the tasks."""
    return spark.range(n).withColumnRenamed("id", name)
