"""Which column of a table plays which part."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StringType, StructField, StructType


@dataclass(frozen=True)
class TableSpec:
    key: str
    categorical: tuple[str, ...]
    integers: tuple[str, ...]
    doubles: tuple[str, ...]
    label: str
    positive: str
    negative: str

    @property
    def numeric(self) -> tuple[str, ...]:
        return self.integers + self.doubles

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.key, *self.categorical, *self.numeric, self.label)

    def text_schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in self.columns])
