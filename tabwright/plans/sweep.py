"""Fit and predict over a grid of scales, models and trials, resumable."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import nullcontext

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.layouts import RUN_STORE_COLUMNS, TRIAL_COLUMNS, conform, empty
from tabwright.operators.evaluate import metric_rows
from tabwright.operators.models import (
    MODEL_NAMES,
    estimator,
    require_binary,
    score,
    score_all,
)
from tabwright.operators.sampling import held, laid_out, replicate
from tabwright.operators.trials import (
    in_sweep_order,
    missing_work,
    repeated_work,
    summarise,
    trial_rules,
    with_throughput,
    work_grid,
)
from tabwright.operators.validate import enforce, validate
from tabwright.plans.prepare import feature_rules
from tabwright.plans.train import force, needed, timed
from tabwright.sources.sinks import write_csv
from tabwright.sources.tables import read_stored
from tabwright.sources.workspace import shared_dir

# The published grid.
SCALES = (1, 5, 10, 20, 50, 100)
TRIALS = 3


class SweepIncomplete(RuntimeError):
    """Trials of the grid are missing from the store, or are there more than once."""


def pending(
    done: DataFrame, scales: Sequence[int], models: Sequence[str], trials: int
) -> DataFrame:
    """Grid rows that are not done yet."""
    names = done.sparkSession.createDataFrame([(m,) for m in models], "Model string")
    return missing_work(work_grid(names, scales, trials), done)


def input_mark(*frames: DataFrame) -> str:
    """What tells one input from another: per frame the number of rows and a sum of
    their hashes, which no order or partitioning changes."""
    summed = F.sum(F.xxhash64("features", "label").cast("decimal(38,0)"))
    marks = [f.agg(F.count(F.lit(1)).alias("n"), summed.alias("h")).first() for f in frames]
    return ";".join(f"{m['n']}:{m['h'] or 0}" for m in marks)


def run_sweep(
    train: DataFrame,
    test: DataFrame,
    width: int,
    store: str,
    scales: Sequence[int] = SCALES,
    models: Sequence[str] = MODEL_NAMES,
    trials: int = TRIALS,
    warm_up: bool = True,
    run_id: str = "",
    partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(trials, summary) in the order of the grid.

    Each finished trial is appended to ``store`` as its own committed Parquet write,
    so a run that dies goes on with what is missing, and scales without missing work
    are not built again. The summary is always derived from the stored trials of this
    ``run_id`` and this input; a store may hold others beside them.

    Both tables are gated before anything is fitted. With ``partitions`` the base is
    laid out in so many parts, and at each scale in so many times the scale.
    """
    spark = train.sparkSession
    enforce(validate(train, feature_rules(width, complete=True)))
    enforce(validate(test, feature_rules(width, complete=True)))
    empty(spark, RUN_STORE_COLUMNS).write.mode("append").parquet(store)
    run = (run_id, input_mark(train, test))

    def done() -> DataFrame:
        of_run = (F.col("Run_Id") == run[0]) & (F.col("Input") == run[1])
        return read_stored(spark, store, RUN_STORE_COLUMNS).filter(of_run)

    todo = pending(done(), scales, models, trials).collect()  # at most the grid
    if todo:
        shared_dir(spark)  # boosting cuts its lineage there
        with held(*needed(train, test, partitions=partitions)) as (base_train, base_test):
            counts = (base_train.count(), base_test.count())
            base_rows = sum(counts)
            if warm_up:
                for name in sorted({r["Model"] for r in todo}):
                    force(score(base_test, estimator(name).fit(base_train)))
            for scale in scales:
                work = [r for r in todo if r["Scale_Factor"] == scale]
                if not work:
                    continue
                work.sort(key=lambda r: (list(models).index(r["Model"]), r["Trial"]))
                with _copies((base_train, base_test), scale, partitions) as grown:
                    fit_rows, test_rows = grown
                    sizes = (base_rows, fit_rows.count(), test_rows.count())
                    for row in work:
                        _run_trial(row, fit_rows, test_rows, sizes, width, store, run)
    missing = pending(done(), scales, models, trials).count()
    if missing:
        raise SweepIncomplete(f"{missing} trials are missing; the store is kept")
    stored = done().filter(
        F.col("Scale_Factor").isin(*scales)
        & F.col("Model").isin(*models)
        & (F.col("Trial") <= trials)
    )
    if repeated := repeated_work(stored).count():
        raise SweepIncomplete(f"{repeated} trials are stored more than once")
    enforce(validate(stored, trial_rules()))
    ordered = in_sweep_order(stored, scales, models)
    return (
        conform(ordered, TRIAL_COLUMNS),
        in_sweep_order(summarise(stored, trials), scales, models),
    )


def publish(trials: DataFrame, summary: DataFrame, folder: str) -> None:
    """The two final tables as CSV, one file each: they have one row per trial and per
    (scale, model). The store is not needed after that, and a new run takes its own."""
    write_csv(trials.coalesce(1), f"{folder}/scalability_trials")
    write_csv(summary.coalesce(1), f"{folder}/scalability_repeated_results")


def _copies(base: Sequence[DataFrame], scale: int, partitions: int | None):
    """The frames ``scale`` times and held; the frames themselves at scale 1. Room is
    made before the copies, so that single rows are shuffled."""
    if scale == 1:
        return nullcontext(tuple(base))
    room = partitions and partitions * scale
    return held(*[replicate(laid_out(f, room), scale) for f in base])


def _run_trial(row, fit_rows, test_rows, sizes, width: int, store: str, run=("", "")) -> None:
    """Fit, predict, and append the trial row; quality is measured in trial 1 only."""
    name, spark = row["Model"], fit_rows.sparkSession
    base_rows, training_rows, testing_rows = sizes
    model, fit_seconds = timed(lambda: estimator(name).fit(fit_rows))
    require_binary(model)
    _, predict_seconds = timed(lambda: force(score(test_rows, model)))
    trial = spark.range(1).select(
        F.lit(row["Scale_Factor"]).alias("Scale_Factor"),
        F.lit(name).alias("Model"),
        F.lit(row["Trial"]).alias("Trial"),
        F.lit(base_rows).alias("Base_Dataset_Rows"),
        F.lit(training_rows + testing_rows).alias("Synthetic_Total_Rows"),
        F.lit(training_rows).alias("Training_Rows"),
        F.lit(testing_rows).alias("Testing_Rows"),
        F.lit(width).alias("Feature_Count"),
        F.lit(fit_seconds).alias("Training_Time_Seconds"),
        F.lit(predict_seconds).alias("Prediction_Time_Seconds"),
        F.lit(run[0]).alias("Run_Id"),
        F.lit(run[1]).alias("Input"),
    )
    if row["Trial"] == 1:
        scored = score_all(test_rows, {name: model}, ["label"])
        trial = trial.join(metric_rows(scored, ["Model"]), "Model")
    times = ("Training_Time_Seconds", "Prediction_Time_Seconds")
    exact = with_throughput(trial)
    rounded = exact.withColumns({c: F.round(c, 6) for c in times})
    rows = conform(rounded, RUN_STORE_COLUMNS)
    rows.coalesce(1).write.mode("append").parquet(store)
