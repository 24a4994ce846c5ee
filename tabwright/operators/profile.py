"""Counts and distributions that describe a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.columns import safe_ratio
from tabwright.functions.spec import TableSpec
from tabwright.operators.clean import incomplete


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def schema_rows(df: DataFrame) -> DataFrame:
    """The schema as rows (position, name, type)."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, data_type string"
    )


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in a stated order (a top-n per task, then one merge)."""
    return df.orderBy(*order).limit(n)


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows")).orderBy(label)


def label_values(df: DataFrame, label: str) -> DataFrame:
    return df.select(label).distinct().orderBy(label)


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULLs per column: one aggregation for all of them, then turned into rows."""
    columns = list(columns or df.columns)
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], columns, "column_name", "nulls")


def cleaning_accounts(typed: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows before cleaning, kept and removed, in one pass over the typed table."""
    dropped = F.count_if(incomplete(typed, spec.columns))
    return typed.agg(
        F.count(F.lit(1)).alias("original_rows"), dropped.alias("removed_rows")
    ).select(
        "original_rows",
        (F.col("original_rows") - F.col("removed_rows")).alias("clean_rows"),
        "removed_rows",
    )


def split_accounting(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows and percentage per split. The window runs over the few split names."""
    counts = df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy())
    return counts.withColumn(
        "percentage", F.round(safe_ratio(F.col("rows") * 100, total), 2)
    )
