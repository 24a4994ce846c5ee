"""Helpers for ML vector columns and the metadata they carry."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_metadata(df: DataFrame, *names: str) -> DataFrame:
    """The same columns as plain doubles, without the class list that an indexer
    left behind and that a classifier would otherwise believe."""
    plain = df.withColumns({n: F.col(n).cast("double") for n in names})
    for name in names:
        plain = plain.withMetadata(name, {})
    return plain


def declared_width(df: DataFrame, vector: str = "features") -> int | None:
    """Vector width from the schema, without a job; None if it is not declared."""
    return df.schema[vector].metadata.get("ml_attr", {}).get("num_attrs")


def vector_size(vector: str) -> Column:
    """The length of the vector, from its stored fields: a sparse vector is not made
    dense for it. NULL stays NULL."""
    stored = F.unwrap_udt(F.col(vector))
    length = F.coalesce(stored["size"], F.size(stored["values"]))
    return F.when(F.col(vector).isNotNull(), length)


def flatten_vector(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One row per (key, slot), none for a NULL vector: a narrow explode, no shuffle."""
    cells = F.when(F.col(vector).isNotNull(), vector_to_array(F.col(vector)))
    return df.select(F.col(key), F.posexplode(cells).alias("slot", "value"))


def set_cells(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One row per (key, slot) whose value is not zero, from the stored fields: a sparse
    vector of a million slots with three set gives three rows."""
    stored = F.unwrap_udt(F.col(vector))
    slots = F.coalesce(stored["indices"], F.sequence(F.lit(0), F.size(stored["values"]) - 1))
    cells = F.arrays_zip(slots.alias("slot"), stored["values"].alias("value"))
    some = F.when(F.size(stored["values"]) > 0, cells)
    return df.select(F.col(key), F.inline(some)).filter(F.col("value") != 0)
