"""Column expressions. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(name: str) -> Column:
    """Text without outer spaces; text of spaces only becomes NULL."""
    return F.nullif(F.trim(F.col(name)), F.lit("")).alias(name)


def int_via_double(column: Column, to: str = "bigint") -> Column:
    """Text such as '12.0' to a whole number, cut towards zero; NULL if malformed."""
    return column.try_cast("double").try_cast(to)


def stable_bucket(key: Column, salt: str = "", buckets: int = 100) -> Column:
    """A bucket in 0..buckets-1 that depends on the key alone, so neither the
    partitioning nor a recomputed task moves a row to another bucket."""
    digest = F.md5(F.concat(F.lit(salt), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0.0 where the denominator is 0 or the result NULL."""
    quotient = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce(quotient, F.lit(0.0))


def binary_label(column: Column, positive: str, negative: str) -> Column:
    """1.0 for the positive text, 0.0 for the negative text, NULL for any other,
    which the not-null gate of ``operators.validate`` then reports."""
    return F.when(column == positive, 1.0).when(column == negative, 0.0)


def result_text(prediction: Column, positive: str, negative: str) -> Column:
    return F.when(prediction == 1.0, positive).otherwise(negative)


def position_in(column: Column, values: Sequence) -> Column:
    """1-based place of the value in a short fixed list; 0 when it is not there."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), column)


def one_line(text: str) -> Column:
    """The text without line breaks: a backslash stands as two, breaks as \\n and \\r,
    an empty text as \\e, since a CSV reader takes nothing for NULL."""
    doubled = F.replace(F.col(text), F.lit("\\"), F.lit("\\\\"))
    fed = F.replace(doubled, F.lit("\n"), F.lit("\\n"))
    broken = F.replace(fed, F.lit("\r"), F.lit("\\r"))
    return F.when(F.col(text) == "", "\\e").otherwise(broken).alias(text)


def with_line_breaks(text: str) -> Column:
    """What ``one_line`` was given: the parts between doubled backslashes hold none
    but those of breaks."""

    def restored(part: Column) -> Column:
        fed = F.replace(part, F.lit("\\n"), F.lit("\n"))
        return F.replace(fed, F.lit("\\r"), F.lit("\r"))

    parts = F.split(F.col(text), r"\\\\", -1)
    joined = F.array_join(F.transform(parts, restored), "\\")
    return F.when(F.col(text) == "\\e", "").otherwise(joined).alias(text)
