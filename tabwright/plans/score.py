"""Stored model and feature table to a flat table of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabwright.operators.evaluate import flat_scores, prediction_summary, prediction_totals
from tabwright.operators.models import score
from tabwright.operators.validate import (
    columns_present,
    enforce,
    no_nulls,
    not_empty,
    validate,
)
from tabwright.sources.models import load_model
from tabwright.sources.sinks import write_csv, write_parquet
from tabwright.sources.tables import read_parquet


def score_table(
    spark: SparkSession,
    model_name: str,
    model_path: str,
    table_path: str,
    output_path: str,
    keep: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Score every row of a stored feature table once, and give back the flat table,
    the count per result and the totals, all from what was written: Parquet in
    ``output_path``/rows, exported as CSV to ``output_path``/csv."""
    model = load_model(model_name, model_path)
    rows = read_parquet(spark, table_path)
    enforce(
        validate(rows, [columns_present("features"), not_empty(), no_nulls("features")])
    )
    flat = flat_scores(score(rows, model), keep=keep)
    stored = read_parquet(spark, write_parquet(flat, f"{output_path}/rows"))
    write_csv(stored, f"{output_path}/csv")
    return stored, prediction_summary(stored), prediction_totals(stored)
