"""Two-pass external shuffle into shards.

Pass one scatters the rows uniformly, by a seeded hash, into buckets that fit in
memory. Pass two takes each bucket, puts it in the order of the id so that a retry
sees the same rows, Fisher-Yates shuffles it (the array function of that name draws
from one seeded generator per task, bucket after bucket), and writes it.
Buckets one after the other are a random order of all rows; cut into equal runs, they
are the shards: the counts differ by one at most (law ``rows``), and a row's place in
its shard has no gaps.

The number of buckets comes from the measured bytes, so a bucket's size doesn't grow
with the table. Rows are scattered by the hash of all their columns, so many rows of one
id or without one are spread; null text has size 1. Rows equal in all columns share a
bucket and can change places without a trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabwright.llm.common import saved
from tabwright.sources.workspace import fresh_path

LAW = "rows"
SEED = 20
BUCKET_BYTES = 4 << 20
#: Added to the rows' columns when they are written.
PLACES = ("_shard", "_slot")


def size_of(text: Column | str) -> Column:
    """UTF-8 bytes, plus one."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 1


def write_shards(
    df: DataFrame,
    path: str,
    shards: int,
    key: str = "doc_id",
    size: Column | None = None,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
) -> None:
    """Write the rows with ``_shard`` (a folder) and ``_slot``."""
    size = F.lit(1) if size is None else size
    df = df.drop(*PLACES)
    # All columns, so that rows without a key or of one key are scattered like others.
    bucket_of = F.xxhash64(F.lit(seed), F.col(key), *df.columns)
    total, rows = df.agg(F.sum(size), F.count(F.lit(1))).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    bucket = F.pmod(bucket_of, F.lit(buckets)).alias("_bucket")
    counts = df.select(bucket).groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = saved(
        counts.select("_bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("_first")),
        "bucket_starts",
    )
    row = F.struct(F.col(key).alias("_key"), F.struct(*df.columns).alias("_row"))
    scattered = df.select(bucket, row.alias("_r")).repartition("_bucket")
    gathered = scattered.groupBy("_bucket").agg(F.sort_array(F.collect_list("_r")).alias("_rs"))
    ordered = gathered.join(starts, "_bucket").sortWithinPartitions("_bucket")
    placed = (
        ordered.select("_first", F.shuffle("_rs", seed).alias("_rs"))
        .select("_first", F.posexplode("_rs").alias("_i", "_r"))
        .withColumn("_rank", F.col("_first") + F.col("_i"))
    )
    small, longer = divmod(rows, shards)  # the first ``longer`` shards have one row more
    head = longer * (small + 1)
    early = F.col("_rank") < head
    inside = F.col("_rank") - head
    shard = F.when(early, F.floor(F.col("_rank") / (small + 1))).otherwise(
        longer + F.floor(inside / max(small, 1))
    )
    slot = F.when(early, F.col("_rank") % (small + 1)).otherwise(inside % max(small, 1))
    placed.select(
        *(F.col("_r._row")[c].alias(c) for c in df.columns),
        shard.cast("int").alias("_shard"),
        slot.cast("long").alias("_slot"),
    ).write.partitionBy("_shard").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that were written, with ``_shard`` and ``_slot``."""
    whole = T.StructType([*schema.fields, T.StructField("_slot", T.LongType())])
    return spark.read.schema(whole.add("_shard", T.IntegerType())).parquet(path)


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Write the documents to the shared folder and read the shards back."""
    docs = docs.drop(*PLACES)
    path = fresh_path(docs.sparkSession, "shards")
    write_shards(docs, path, shards, size=size_of("text"))
    return read_shards(docs.sparkSession, path, docs.schema)


def digest_rows(read: DataFrame) -> DataFrame:
    return read.select(
        "doc_id",
        size_of("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
