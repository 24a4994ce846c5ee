"""Tables of timed trials: the grid of work, what is still to do, and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import position_in, safe_ratio
from tabwright.functions.layouts import QUALITY_COLUMNS, SUMMARY_COLUMNS, conform, names_of
from tabwright.operators.validate import no_nulls, none_where, not_empty

TRIAL_KEY = ("Scale_Factor", "Model", "Trial")
GROUP_KEY = ("Scale_Factor", "Model")
SIZES = (
    "Base_Dataset_Rows",
    "Synthetic_Total_Rows",
    "Training_Rows",
    "Testing_Rows",
    "Feature_Count",
)


def work_grid(models: DataFrame, scales: Sequence[int], trials: int) -> DataFrame:
    """(Scale_Factor, Model, Trial) for every model. Scales and trials are short
    lists of the caller, so each model row is multiplied in place, without a join."""
    return (
        models.select("Model")
        .withColumn("Scale_Factor", F.explode(F.array(*[F.lit(s) for s in scales])))
        .withColumn("Trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
        .select(*TRIAL_KEY)
    )


def missing_work(
    grid: DataFrame, done: DataFrame, key: Sequence[str] = TRIAL_KEY
) -> DataFrame:
    """Grid rows that have no finished trial."""
    return grid.join(done.select(*key).distinct(), list(key), "left_anti")


def repeated_work(done: DataFrame, key: Sequence[str] = TRIAL_KEY) -> DataFrame:
    """Trials that the table holds more than once, with their number of rows."""
    return done.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


class NoModels(ValueError):
    """A table that holds none of the expected models."""


def require_models(table: DataFrame, expected: Sequence[str]) -> DataFrame:
    """The rows of the expected models; an error if there is none."""
    chosen = table.filter(F.col("Model").isin(*expected))
    if chosen.isEmpty():
        raise NoModels(f"none of the expected models is present: {list(expected)}")
    return chosen


def missing_models(expected: DataFrame, found: DataFrame) -> DataFrame:
    return expected.join(found.select("Model").distinct(), "Model", "left_anti")


def throughput(rows: Column, seconds: Column) -> Column:
    """Rows per second, 2 decimals; 0.0 when no time has passed."""
    return F.round(safe_ratio(rows, seconds), 2)


def with_throughput(trials: DataFrame) -> DataFrame:
    return trials.withColumns(
        {
            f"{part}_Throughput_Rows_Per_Second": throughput(
                F.col(rows), F.col(f"{part}_Time_Seconds")
            )
            for part, rows in (
                ("Training", "Training_Rows"),
                ("Prediction", "Testing_Rows"),
            )
        }
    )


def metrics_in_first_trial(trials: DataFrame) -> DataFrame:
    """Quality columns stay in trial 1 and are NULL in all others."""
    return trials.withColumns(
        {
            c: F.when(F.col("Trial") == 1, F.col(c))
            for c in names_of(QUALITY_COLUMNS)
        }
    )


def trial_rules() -> list:
    """Gates of a trial table: quality in every first trial, times that can be read."""
    first = F.col("Trial") == 1
    return [
        not_empty(),
        none_where("first_trial_without_quality", first & F.col("Accuracy").isNull()),
        no_nulls("Training_Time_Seconds"),
        no_nulls("Prediction_Time_Seconds"),
    ]


def _in_trial(number: int, column: str) -> Column:
    return F.max(F.when(F.col("Trial") == number, F.col(column)))


def trials_to_columns(
    trials: DataFrame, column: str, prefix: str, count: int = 3
) -> DataFrame:
    """One column per trial: a conditional aggregate, so no pass to find the values."""
    return trials.groupBy(*GROUP_KEY).agg(
        *[_in_trial(i, column).alias(f"{prefix}_{i}") for i in range(1, count + 1)]
    )


def summarise(trials: DataFrame, count: int = 3) -> DataFrame:
    """The summary row of each (scale, model): sizes and quality of trial 1, the time
    of each trial, means and sample standard deviations. One grouping."""
    runs = range(1, count + 1)
    first = [
        _in_trial(1, c).alias(c) for c in (*SIZES, *names_of(QUALITY_COLUMNS))
    ]
    times = [
        expression
        for part in ("Training", "Prediction")
        for expression in (
            *[
                _in_trial(i, f"{part}_Time_Seconds").alias(f"{part}_Time_Run_{i}")
                for i in runs
            ],
            *_mean_and_spread(f"{part}_Time_Seconds", 6),
            *_mean_and_spread(f"{part}_Throughput_Rows_Per_Second", 2),
        )
    ]
    grouped = trials.groupBy(*GROUP_KEY).agg(
        F.count(F.lit(1)).alias("Trials"), *first, *times
    )
    extra = [
        f"{part}_Time_Run_{i}"
        for part in ("Training", "Prediction")
        for i in runs
        if i > 3
    ]
    if not extra:
        return conform(grouped, SUMMARY_COLUMNS)
    return grouped.select(*names_of(SUMMARY_COLUMNS), *extra)


def _mean_and_spread(column: str, digits: int) -> list[Column]:
    spread = F.coalesce(F.stddev_samp(column), F.lit(0.0))
    return [
        F.round(F.avg(column), digits).alias(f"Mean_{column}"),
        F.round(spread, digits).alias(f"Std_{column}"),
    ]


def in_sweep_order(
    trials: DataFrame, scales: Sequence[int], models: Sequence[str]
) -> DataFrame:
    """By the caller's order of scales, then of models, then by trial."""
    order = [
        position_in(F.col("Scale_Factor"), scales),
        position_in(F.col("Model"), models),
    ]
    if "Trial" in trials.columns:
        order.append(F.col("Trial"))
    return trials.orderBy(*order)


def scale_check(summary: DataFrame, expected: Sequence[int]) -> DataFrame:
    """Per model: which expected scales are there, in order, how many rows there are
    and how many of them have an unexpected scale. The list holds expected scales
    only, so it cannot grow with the data; the counts show the rest."""
    known = F.col("Scale_Factor").isin(*expected)
    found = F.array_sort(F.collect_set(F.when(known, F.col("Scale_Factor"))))
    return (
        summary.groupBy("Model")
        .agg(
            F.concat_ws(",", found.cast("array<string>")).alias("scales"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(~known).alias("unexpected_rows"),
        )
        .withColumn(
            "ok",
            (F.col("scales") == ",".join(str(s) for s in sorted(expected)))
            & (F.col("rows") == len(expected)),
        )
    )
