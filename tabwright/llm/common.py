"""What several operators of this package share: tables in the shared folder,
bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.sources.workspace import fresh_path

#: Words are what lies between these characters (tab to carriage return, space).
WORD_GAP = "[\\x20\\x09-\\x0D]+"
#: Bound of every sample that a model is fitted on.
FIT_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """The frame as a table in the shared folder: cut lineage that outlives lost
    executors and is computed once."""
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column | str) -> Column:
    """Rows that no label may be learnt from; a row without an id is one of them."""
    digest = F.crc32(F.col(doc_id) if isinstance(doc_id, str) else doc_id)
    return F.coalesce(digest % 5 == 0, F.lit(True))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: Column, bound: int = FIT_ROWS
) -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` labelled rows outside the held-out
    fifth, in the order of a seeded hash; one label per document (the larger of
    contradicting ones). Rows without id, label or text are left out, and of equal
    texts one row is taken. The ids are broadcast: there are ``bound`` of them."""
    chosen = (
        labels.select(F.col("doc_id"), label.cast("int").alias("label"))
        .where(
            F.col("doc_id").isNotNull()
            & F.col("label").isNotNull()
            & ~held_out(F.col("doc_id").cast("string"))
        )
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id")
        .limit(bound)
    )
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    joined = rows.join(F.broadcast(chosen), "doc_id")
    first = joined.groupBy("text").agg(F.min(F.struct("doc_id", "label")).alias("r"))
    return first.select("r.doc_id", "text", "r.label")
