"""Table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tabwright.functions.columns import one_line
from tabwright.functions.vectors import declared_width, vector_size


def write_parquet(
    df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()
) -> str:
    """Parquet; a column in ``partition_by`` lets later readers skip whole folders."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a header. Outer spaces are data and are kept; the default writer
    would cut them. Quotes are doubled. Line breaks in texts are written as \\n and \\r
    and backslashes as two, an empty text as \\e, so that a row is a line, the file can
    be split, and NULL is not empty text; ``read_stored_csv`` undoes that."""
    texts = {f.name: one_line(f.name) for f in df.schema if f.dataType == StringType()}
    (
        df.withColumns(texts).write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


#: Readers of the first generation cannot answer an aggregate from footers.
_FOOTER_SETTINGS = {
    "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def footer_answers(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """One row: ``rows``, and smallest and largest value of plain columns, answered from
    the Parquet files' footers: no page of data is read. Without any rows in the files
    all are NULL, the count too. The settings that this needs are those of a session of its own, next to the caller's on the same cluster."""
    own = spark.newSession()
    for name, value in _FOOTER_SETTINGS.items():
        own.conf.set(name, value)
    extremes = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return own.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), *extremes)


def write_parquet_verified(
    df: DataFrame,
    path: str,
    vector: str = "features",
    rows: int | None = None,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Write, read back, and report one row per check.

    Give ``rows`` where the count is known. Otherwise the plan behind ``df`` is run
    once more for a bare count, for which Spark drops the encoding; the width to
    expect is in the schema and costs no job. The rows that were written are counted
    from the files' footers; only the widths of the vectors are read.
    """
    expected_rows = df.count() if rows is None else rows
    width = declared_width(df, vector)
    write_parquet(df, path, partition_by=partition_by)
    back = df.sparkSession.read.parquet(path)
    types, types_back = dict(df.dtypes), dict(back.dtypes)
    written = footer_answers(df.sparkSession, path).first()["rows"] or 0
    after = back.agg(
        F.lit(written).cast("bigint").alias("n"),
        F.min(vector_size(vector)).alias("low"),
        F.max(vector_size(vector)).alias("high"),
    )

    def check(name, expected, observed):
        return F.struct(
            F.lit(name).alias("rule"),
            F.lit(expected).cast("bigint").alias("expected"),
            observed.cast("bigint").alias("observed"),
        )

    checks = F.array(
        check("rows", expected_rows, F.col("n")),
        check("smallest_vector", width, F.col("low")),
        check("largest_vector", width, F.col("high")),
        check("same_schema", 1, F.lit(int(types == types_back))),
    )
    return after.select(F.inline(checks)).withColumn(
        "ok", F.col("expected").eqNullSafe(F.col("observed"))
    )
