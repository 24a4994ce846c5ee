"""Raw table to checked feature tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.spec import TableSpec
from tabwright.operators.clean import clean
from tabwright.operators.features import MAX_VOCABULARY, encode, fit_encoder, slots
from tabwright.operators.index_table import IndexTable, fit_index_table, write_features
from tabwright.operators.sampling import with_split
from tabwright.operators.validate import (
    columns_present,
    domain,
    enforce,
    no_nulls,
    not_empty,
    validate,
    width_is,
)
from tabwright.sources.models import save_model
from tabwright.sources.sinks import write_parquet_verified


@dataclass(frozen=True)
class Prepared:
    """Clean rows with their split, and the encoder fitted on the training rows."""

    rows: DataFrame
    encoder: PipelineModel
    spec: TableSpec

    @property
    def width(self) -> int:
        return len(slots(self.encoder, self.spec))

    @property
    def features(self) -> DataFrame:
        """All rows encoded, with their split."""
        return encode(self.rows, self.encoder, self.spec, keep=["split"])

    def split(self, name: str) -> DataFrame:
        """One part encoded. Rows are chosen first: a filter behind the encoder would
        stay there, and the rows of the other part would be encoded in vain."""
        chosen = self.rows.filter(F.col("split") == name)
        return encode(chosen, self.encoder, self.spec)


def prepare(
    raw: DataFrame,
    spec: TableSpec,
    train_percent: int = 80,
    max_vocabulary: int = MAX_VOCABULARY,
    partitions: int | None = None,
) -> Prepared:
    """Clean, split by key, and fit the encoder on the training rows. The only job is
    the count of categories; the rest stays lazy. ``partitions`` spreads the rows
    evenly first, for input in a few files that cannot be split."""
    enforce(validate(raw.limit(0), [columns_present(*spec.columns)]))
    if partitions:
        raw = raw.repartition(partitions)
    rows = with_split(clean(raw, spec), spec.key, train_percent)
    train = rows.filter(F.col("split") == "train")
    return Prepared(rows, fit_encoder(train, spec, max_vocabulary), spec)


@dataclass(frozen=True)
class WidePrepared:
    """Stored features, and the index table that they were encoded by."""

    features: DataFrame
    encoder: IndexTable
    spec: TableSpec

    @property
    def width(self) -> int:
        return self.encoder.width

    def split(self, name: str) -> DataFrame:
        """One part; it lies in a folder of its own."""
        return self.features.filter(F.col("split") == name).drop("split")


def prepare_wide(
    raw: DataFrame,
    spec: TableSpec,
    index_path: str,
    features_path: str,
    train_percent: int = 80,
) -> WidePrepared:
    """As ``prepare`` and ``store``, for columns of any number of values: the index of the
    training rows and the features are written tables, and the features are gated."""
    enforce(validate(raw.limit(0), [columns_present(*spec.columns)]))
    rows = with_split(clean(raw, spec), spec.key, train_percent)
    index = fit_index_table(rows.filter(F.col("split") == "train"), spec, index_path)
    features = write_features(rows, index, features_path, ["split"], ["split"])
    enforce(validate(features, feature_rules(index.width, complete=False)))
    return WidePrepared(features, index, spec)


def feature_rules(width: int, complete: bool) -> list:
    """The gates before a sink (label a subset of 0 and 1) or a fit (both occur)."""
    return [
        columns_present("features", "label"),
        not_empty(),
        no_nulls("features"),
        no_nulls("label"),
        domain("label", (0.0, 1.0), complete),
        width_is("features", width),
    ]


def store(prepared: Prepared, table_path: str, encoder_path: str) -> DataFrame:
    """Write the feature table, one folder per split, and the encoder; gate what was
    written. The checks read Parquet instead of cleaning the raw input once more."""
    report = write_parquet_verified(
        prepared.features, table_path, partition_by=["split"]
    )
    save_model(prepared.encoder, encoder_path)
    stored = prepared.features.sparkSession.read.parquet(table_path)
    enforce(validate(stored, feature_rules(prepared.width, complete=False)))
    return report
