"""Feature table to fitted, stored and compared models."""

from __future__ import annotations

from collections.abc import Sequence
from time import perf_counter

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.layouts import METRIC_COLUMNS, conform
from tabwright.operators.evaluate import COUNTS, in_model_order, metric_rows
from tabwright.operators.models import (
    MODEL_NAMES,
    estimator,
    require_binary,
    score,
    score_all,
)
from tabwright.operators.sampling import held, laid_out
from tabwright.operators.trials import throughput
from tabwright.operators.validate import enforce, validate
from tabwright.plans.prepare import feature_rules
from tabwright.sources.models import save_model
from tabwright.sources.workspace import shared_dir


def timed(action):
    """(result, seconds) on a clock that never runs backwards."""
    start = perf_counter()
    result = action()
    return result, perf_counter() - start


def force(df: DataFrame) -> None:
    """Compute every column of every row and keep nothing. A count would let the
    optimizer drop the very columns that are to be timed."""
    df.write.format("noop").mode("overwrite").save()


def needed(*frames: DataFrame, partitions: int | None = None) -> tuple[DataFrame, ...]:
    """What a fit reads, laid out in ``partitions`` parts while the key is still there;
    keys and other columns are not worth holding in memory."""
    return tuple(laid_out(f, partitions).select("features", "label") for f in frames)


class UnknownClass(ValueError):
    """Rows whose label or prediction is not 0 or 1."""


def compare(
    train: DataFrame,
    test: DataFrame,
    width: int,
    names: Sequence[str] = MODEL_NAMES,
    model_dir: str | None = None,
    partitions: int | None = None,
    table_path: str | None = None,
) -> tuple[dict[str, Model], DataFrame]:
    """Fit the models on one held training table, time them, store them, and compare
    them on the test table. The comparison holds one row per model; all models are
    scored and evaluated in a single pass over the test rows. Both tables are gated
    first. ``table_path`` is where the comparison is written, as CSV with a header in
    model order (one row per model). With ``partitions`` fits do not depend on the cluster (``laid_out``)."""
    models: dict[str, Model] = {}
    times = []
    shared_dir(train.sparkSession)  # boosting cuts its lineage there
    with held(*needed(train, test, partitions=partitions)) as (fit_rows, test_rows):
        enforce(validate(fit_rows, feature_rules(width, complete=True)))
        enforce(validate(test_rows, feature_rules(width, complete=False)))
        for name in names:
            model, fit_seconds = timed(lambda: estimator(name).fit(fit_rows))
            require_binary(model)
            _, predict_seconds = timed(lambda: force(score(test_rows, model)))
            times.append((name, fit_seconds, predict_seconds))
            models[name] = model
            if model_dir:
                save_model(model, f"{model_dir}/{name}")
        counted = fit_rows.count()
        quality = metric_rows(score_all(test_rows, models, ["label"]), ["Model"])
        rows = quality.collect()  # one row per model
    strange = [r["Model"] for r in rows if r["rows"] != sum(r[c] for c in COUNTS)]
    if strange:
        raise UnknownClass(f"rows outside the classes 0 and 1: {strange}")

    spark = train.sparkSession
    timing = spark.createDataFrame(
        times, "Model string, Training_Time_Seconds double, Prediction_Time_Seconds double"
    )
    table = spark.createDataFrame(rows, quality.schema).join(timing, "Model")
    ordered = in_model_order(
        as_metric_table(table.withColumn("Training_Rows", F.lit(counted)), width), names
    )
    if table_path:
        ordered.coalesce(1).write.mode("overwrite").option("header", True).csv(table_path)
    return models, ordered


def as_metric_table(quality: DataFrame, width: int) -> DataFrame:
    """Bring metric rows with Training_Rows and times into the published layout."""
    return conform(
        quality.withColumns(
            {
                "Testing_Rows": F.col("rows"),
                "Dataset_Rows": F.col("Training_Rows") + F.col("rows"),
                "Feature_Count": F.lit(width),
                "Training_Time_Seconds": F.round("Training_Time_Seconds", 6),
                "Prediction_Time_Seconds": F.round("Prediction_Time_Seconds", 6),
                "Prediction_Throughput_Rows_Per_Second": throughput(
                    F.col("rows"), F.col("Prediction_Time_Seconds")
                ),
            }
        ),
        METRIC_COLUMNS,
    )
