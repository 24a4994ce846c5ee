"""The data series behind the figures of a comparison and of a sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.columns import position_in

# The measures that the figures show.
BASELINE_MEASURES = (
    "Accuracy",
    "F1_Churn",
    "ROC_AUC",
    "Training_Time_Seconds",
    "Prediction_Time_Seconds",
)
SCALING_MEASURES = (
    "Mean_Training_Time_Seconds",
    "Mean_Prediction_Time_Seconds",
    "Mean_Training_Throughput_Rows_Per_Second",
    "Mean_Prediction_Throughput_Rows_Per_Second",
)


def metric_long(
    metrics: DataFrame,
    models: Sequence[str],
    measures: Sequence[str] = BASELINE_MEASURES,
) -> DataFrame:
    """(Model, model_order, measure, value) for the expected models."""
    place = position_in(F.col("Model"), models)
    return (
        metrics.withColumn("model_order", place)
        .filter(F.col("model_order") > 0)
        .unpivot(["Model", "model_order"], list(measures), "measure", "value")
    )


def scaling_series(
    summary: DataFrame, measures: Sequence[str] = SCALING_MEASURES
) -> DataFrame:
    """(Model, Scale_Factor, Synthetic_Total_Rows, measure, value)."""
    return summary.unpivot(
        ["Model", "Scale_Factor", "Synthetic_Total_Rows"],
        list(measures),
        "measure",
        "value",
    )


def error_bars(summary: DataFrame) -> DataFrame:
    """Mean and mean -/+ one standard deviation of both times."""
    rows = [
        F.struct(
            F.lit(part).alias("part"),
            F.col(f"Mean_{part}_Time_Seconds").alias("mean"),
            F.col(f"Std_{part}_Time_Seconds").alias("spread"),
        )
        for part in ("Training", "Prediction")
    ]
    return summary.select(
        "Model", "Scale_Factor", "Synthetic_Total_Rows", F.inline(F.array(*rows))
    ).select(
        "Model",
        "Scale_Factor",
        "Synthetic_Total_Rows",
        "part",
        F.round("mean", 6).alias("mean"),
        F.round(F.col("mean") - F.col("spread"), 6).alias("low"),
        F.round(F.col("mean") + F.col("spread"), 6).alias("high"),
    )


def largest_scale(summary: DataFrame) -> DataFrame:
    """The summary row of the largest scale of each model."""
    return summary.groupBy("Model").agg(
        F.max_by(F.struct(*summary.columns), "Scale_Factor").alias("_row")
    ).select("_row.*")


def relative_cost(summary: DataFrame, reference: str) -> DataFrame:
    """Mean fit time at the largest scale in relation to a reference model. The
    window runs over one row per model."""
    fit = F.col("Mean_Training_Time_Seconds")
    own = F.max(F.when(F.col("Model") == reference, fit))
    base = own.over(Window.partitionBy("Scale_Factor"))
    return largest_scale(summary).select(
        "Scale_Factor",
        "Model",
        fit.alias("fit_seconds"),
        F.round(F.try_divide(fit, base), 2).alias("relative_fit_time"),
    )


def by_model(summary: DataFrame, models: Sequence[str]) -> DataFrame:
    """Rows of the expected models, together per model and by rising scale."""
    place = position_in(F.col("Model"), models)
    return summary.filter(place > 0).orderBy(place, "Scale_Factor")
