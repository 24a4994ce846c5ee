"""Splits of an exact size, by selection of the k-th smallest hash.

Each row has a 60-bit hash of its key and a 60-bit hash of all its columns. The k rows of
the smallest (key hash, row hash) are the training rows. Their last hash is found digit
by digit: one count per value of the leading digit says in which of its values the k-th
row lies, and only rows with that digit are counted again by the next. Counts are added
up in each task, so a pass moves at most ``2 ** DIGIT`` numbers, whatever the table's
size, and reads the key alone; no row is sorted or collected. What a row gets depends
on its own values, so partitions, retries and the order of rows do not matter.

A NULL key is hashed as an empty text with a mark of its own. Rows equal in all columns
cannot be told apart: if the cut goes through them, they are counted, and as many copies
as are needed go to either side.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, DIGIT = 60, 15
#: So few rows of one prefix are looked at directly instead of by the next digit.
FEW = 4_096
#: Column names of the working frame.
KEY_HASH, ROW_HASH = "_key_hash", "_row_hash"


@dataclass(frozen=True)
class Cut:
    """The k-th smallest value, the rows below it, and the rows that have it."""

    value: int
    below: int
    equal: int


def hash_60(text: Column, salt: str) -> Column:
    """A number of 60 bits from salt and text, the same in any engine that has MD5."""
    known = F.concat(F.lit(salt), F.coalesce(text, F.lit("\0")))
    return F.conv(F.substring(F.md5(known), 1, BITS // 4), 16, 10).cast("bigint")


def row_text(columns: Sequence[str]) -> Column:
    """All columns of a row as one text."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def kth_smallest(df: DataFrame, number: str, k: int) -> Cut:
    """The k-th smallest (from 1) of a column of whole numbers of ``BITS`` bits."""
    prefix, below, left = 0, 0, BITS
    values = df.select(F.col(number).alias("v")).where(F.col("v").isNotNull())
    while left:
        left -= DIGIT
        digit = F.shiftright("v", left)
        counts = values.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n"))
        for d, n in sorted((r["d"], r["n"]) for r in counts.collect()):
            if below + n >= k:
                prefix, equal = d, n
                break
            below += n
        else:
            raise ValueError(f"there are {below} rows, fewer than {k}")
        values = values.where(F.shiftright("v", left) == prefix)
        if equal <= FEW and left:
            found = sorted(r["v"] for r in values.collect())
            prefix, left = found[k - below - 1], 0
            below, equal = below + found.index(prefix), found.count(prefix)
    return Cut(prefix, below, equal)


def exact_split(
    df: DataFrame,
    key: str,
    train_rows: int | None = None,
    train_share: float = 0.8,
    salt: str = "exact:",
) -> DataFrame:
    """The frame with ``split``: exactly ``train_rows`` rows (or the share of all rows,
    cut to a whole number) are "train". Passes over the key find the cut; the result is
    a projection of ``df``, unless the cut goes through rows of one hash."""
    total = df.count()
    k = int(total * train_share) if train_rows is None else train_rows
    if not 0 <= k <= total:
        raise ValueError(f"{k} training rows of {total}")
    names = df.columns
    if k in (0, total):
        return df.withColumn("split", F.lit("train" if k else "test"))
    hashed = df.withColumn(KEY_HASH, hash_60(F.col(key).cast("string"), salt))
    cut = kth_smallest(hashed, KEY_HASH, k)
    first = F.col(KEY_HASH) <= cut.value
    if cut.below + cut.equal == k:
        return hashed.select(*names, F.when(first, "train").otherwise("test").alias("split"))
    tied = hashed.where(F.col(KEY_HASH) == cut.value).withColumn(
        ROW_HASH, hash_60(row_text(names), salt)
    )
    inner = kth_smallest(tied, ROW_HASH, k - cut.below)
    side = F.when(F.col(KEY_HASH) < cut.value, "train").when(F.col(KEY_HASH) > cut.value, "test")
    both = hashed.withColumn(
        ROW_HASH, F.when(F.col(KEY_HASH) == cut.value, hash_60(row_text(names), salt))
    )
    side = side.when(F.col(ROW_HASH) < inner.value, "train")
    side = side.when(F.col(ROW_HASH) > inner.value, "test")
    needed = k - cut.below - inner.below
    if needed == inner.equal:
        return both.select(*names, F.coalesce(side, F.lit("train")).alias("split"))
    apart = both.withColumn("split", side)
    same = (
        apart.where(F.col("split").isNull())
        .groupBy(ROW_HASH)
        .agg(F.first(F.struct(*names)).alias("_row"), F.count(F.lit(1)).alias("_n"))
    )
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("_copy")
    again = same.select("_row", copies).select(
        "_row.*", F.when(F.col("_copy") <= needed, "train").otherwise("test").alias("split")
    )
    rest = apart.where(F.col("split").isNotNull()).select(*names, "split")
    return rest.unionByName(again)
