"""Cleaning and projection of raw tables. Everything here is one narrow stage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

from tabwright.functions.columns import blank_to_null
from tabwright.functions.spec import TableSpec


def trim_blanks(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Trim text columns (all by default) in one projection; blank becomes NULL."""
    text = {f.name for f in df.schema if isinstance(f.dataType, StringType)}
    chosen = text if columns is None else text & set(columns)
    return df.select(
        *[blank_to_null(c) if c in chosen else F.col(c) for c in df.columns]
    )


def cast_numeric(
    df: DataFrame, integers: Sequence[str] = (), doubles: Sequence[str] = ()
) -> DataFrame:
    """Typed columns; malformed text becomes NULL instead of failing the job."""
    types = {**{c: "int" for c in integers}, **{c: "double" for c in doubles}}
    return df.select(
        *[F.col(c).try_cast(types[c]).alias(c) if c in types else c for c in df.columns]
    )


def incomplete(df: DataFrame, columns: Sequence[str]) -> Column:
    """True where any of the columns is NULL, or NaN where the type allows it."""
    floating = {
        f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))
    }
    tests = [
        F.col(c).isNull() | F.isnan(c) if c in floating else F.col(c).isNull()
        for c in columns
    ]
    return reduce(Column.__or__, tests)


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(subset) if subset else None)


def to_typed(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """Trimmed and typed, before incomplete rows are dropped."""
    return cast_numeric(trim_blanks(raw), spec.integers, spec.doubles)


def clean(
    raw: DataFrame, spec: TableSpec, subset: Sequence[str] | None = None
) -> DataFrame:
    """Trim, type and drop incomplete rows, judged by the declared columns. Pass
    ``raw.columns`` as subset to let further columns take part as well."""
    return drop_incomplete(to_typed(raw, spec), subset or spec.columns)


def resolve_columns(
    df: DataFrame, wanted: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Rename to the wanted names: the first candidate that exists is taken."""
    found = {}
    for name, candidates in wanted.items():
        match = next((c for c in candidates if c in df.columns), None)
        if match is None:
            raise KeyError(
                f"no column for {name}: tried {list(candidates)}, have {df.columns}"
            )
        found[name] = match
    return df.select(*[F.col(old).alias(new) for new, old in found.items()])


def with_display_name(
    df: DataFrame, column: str, names: Mapping[str, str], output: str = "display_name"
) -> DataFrame:
    """Look names up in a literal map; an unknown name stays as it is."""
    if not names:
        return df.withColumn(output, F.col(column))
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    shown = F.coalesce(F.try_element_at(pairs, F.col(column)), F.col(column))
    return df.withColumn(output, shown)
