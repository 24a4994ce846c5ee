"""Registered queries: trial tables, their summaries and report series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.evaluation import model_metrics
from casebook.fixtures import (
    EVENT_MODELS,
    RULE_NAMES,
    SCALES,
    table,
    trials,
    trials_all,
)
from tabwright.functions.layouts import (
    QUALITY_COLUMNS,
    TRIAL_COLUMNS,
    conform,
    names_of,
)
from tabwright.operators import moments, report
from tabwright.operators import trials as ops
from tabwright.operators.validate import validate
from tabwright.sources.sinks import write_parquet
from tabwright.sources.workspace import fresh_path

MEASURES = ("Accuracy", "F1_Churn", "ROC_AUC")


def _models(spark, sf) -> DataFrame:
    events = table(spark, sf, "events")
    return events.select(F.col("event_type").alias("Model")).distinct()


def _summary(spark, sf) -> DataFrame:
    return ops.summarise(trials(spark, sf))


def trial_summary_folded(spark, sf) -> DataFrame:
    """The same summary, from states of single trials that arrive out of order and are
    written in between."""
    rows = trials(spark, sf)
    state = moments.state_of(rows.filter("Trial = 3"))
    for arrived in (1, 2):
        state = moments.merged(state, moments.state_of(rows.filter(F.col("Trial") == arrived)))
        path = write_parquet(state, fresh_path(spark, "state"))
        state = spark.read.schema(state.schema).parquet(path)
    return moments.summary_of(state)


def trial_table(spark, sf) -> DataFrame:
    """Without its feature count, which comes back as a typed NULL. It is shown as a
    double, as frames of other engines hold NULLs among whole numbers differently."""
    table = conform(trials(spark, sf).drop("Feature_Count"), TRIAL_COLUMNS)
    return table.withColumn("Feature_Count", F.col("Feature_Count").cast("double"))


def trial_gates(spark, sf) -> DataFrame:
    """The gates on the trials, after trial 1 of one model has lost its quality."""
    lost = (F.col("Model") == "view") & (F.col("Scale_Factor") == 5)
    rows = trials(spark, sf).withColumn(
        "Accuracy", F.when(~lost, F.col("Accuracy"))
    )
    return validate(rows, ops.trial_rules())


def sweep_grid(spark, sf) -> DataFrame:
    return ops.work_grid(_models(spark, sf), SCALES, 3)


def grid_missing(spark, sf) -> DataFrame:
    """Trials 3 at scale 20 are taken away and must be found again."""
    lost = (F.col("Trial") == 3) & (F.col("Scale_Factor") == 20)
    done = trials_all(spark, sf).filter(~lost)
    return ops.missing_work(sweep_grid(spark, sf), done)


def models_missing(spark, sf) -> DataFrame:
    """Event types that never occur at a value above 400."""
    expected = _models(spark, sf)
    events = table(spark, sf, "events").filter(F.col("value") > 400)
    return ops.missing_models(expected, events.select(F.col("event_type").alias("Model")))


def trial_throughput(spark, sf) -> DataFrame:
    return ops.with_throughput(trials(spark, sf)).select(
        *ops.TRIAL_KEY,
        "Training_Throughput_Rows_Per_Second",
        "Prediction_Throughput_Rows_Per_Second",
    )


def trial_one_metrics(spark, sf) -> DataFrame:
    marked = ops.metrics_in_first_trial(trials_all(spark, sf))
    return marked.select(
        *ops.TRIAL_KEY, *[F.col(c).cast("double") for c in names_of(QUALITY_COLUMNS)]
    )


def trial_pivot(spark, sf) -> DataFrame:
    return ops.trials_to_columns(
        trials(spark, sf), "Training_Time_Seconds", "Training_Time_Run"
    )


def ordered_trials(spark, sf) -> DataFrame:
    ordered = ops.in_sweep_order(trials(spark, sf), SCALES, EVENT_MODELS)
    return ordered.select(*ops.TRIAL_KEY, "Training_Time_Seconds")


def scale_lists(spark, sf) -> DataFrame:
    return ops.scale_check(_summary(spark, sf), SCALES)


def metric_long(spark, sf) -> DataFrame:
    return report.metric_long(model_metrics(spark, sf), RULE_NAMES, MEASURES)


def scaling_series(spark, sf) -> DataFrame:
    return report.scaling_series(_summary(spark, sf))


def error_bar_series(spark, sf) -> DataFrame:
    return report.error_bars(_summary(spark, sf))


def largest_scale(spark, sf) -> DataFrame:
    return report.largest_scale(_summary(spark, sf))


def relative_cost(spark, sf) -> DataFrame:
    return report.relative_cost(_summary(spark, sf), "click")


def summary_by_model(spark, sf) -> DataFrame:
    rows = report.by_model(_summary(spark, sf), EVENT_MODELS)
    return rows.select("Model", "Scale_Factor", "Mean_Training_Time_Seconds")


_KEY = ", ".join(ops.TRIAL_KEY)
_GRID = f"""(select s.s as Scale_Factor, m.Model, cast(t.range + 1 as integer) as Trial
             from (select distinct event_type as Model from events) m
             cross join (select unnest({list(SCALES)}) s) s cross join range(3) t)"""

CASES = {
    "trial_table": (
        trial_table,
        f"""select {', '.join(c for c in names_of(TRIAL_COLUMNS) if c != 'Feature_Count')},
                   cast(null as double) as Feature_Count from trials""",
    ),
    "trial_gates": (
        trial_gates,
        """
with t as (select count(*) n,
                  count(*) filter (where Trial=1 and (Accuracy is null or
                                   (Model='view' and Scale_Factor=5))) bare,
                  count(*) filter (where Training_Time_Seconds is null) no_fit,
                  count(*) filter (where Prediction_Time_Seconds is null) no_predict
           from trials)
select 'not_empty' as rule, 'error' as severity, n > 0 as ok,
       cast(n as varchar) as observed, '>0' as expected from t
union all select 'first_trial_without_quality', 'error', bare = 0,
                 cast(bare as varchar), '0' from t
union all select 'no_nulls:Training_Time_Seconds', 'error', no_fit = 0,
                 cast(no_fit as varchar), '0' from t
union all select 'no_nulls:Prediction_Time_Seconds', 'error', no_predict = 0,
                 cast(no_predict as varchar), '0' from t""",
    ),
    "sweep_grid": (sweep_grid, f"select * from {_GRID} g"),
    "grid_missing": (
        grid_missing,
        f"""select * from {_GRID} g where ({_KEY}) not in
            (select ({_KEY}) from trials_all where not (Trial=3 and Scale_Factor=20))""",
    ),
    "models_missing": (
        models_missing,
        """select distinct event_type as Model from events
           where event_type not in (select event_type from events where value > 400)""",
    ),
    "trial_throughput": (
        trial_throughput,
        f"""select {_KEY}, Training_Throughput_Rows_Per_Second,
                   Prediction_Throughput_Rows_Per_Second from trials""",
    ),
    "trial_one_metrics": (
        trial_one_metrics,
        f"select {_KEY}, "
        + ", ".join(f"cast({c} as double) as {c}" for c in names_of(QUALITY_COLUMNS))
        + " from trials",
    ),
    "trial_pivot": (
        trial_pivot,
        """select Scale_Factor, Model, "1" as Training_Time_Run_1,
                  "2" as Training_Time_Run_2, "3" as Training_Time_Run_3
           from (pivot (select Scale_Factor, Model, Trial, Training_Time_Seconds from trials)
                 on Trial in (1, 2, 3) using first(Training_Time_Seconds)) p""",
    ),
    "trial_summary": (_summary, "select * from summary"),
    "trial_summary_folded": (trial_summary_folded, "select * from summary"),
    "ordered_trials": (
        ordered_trials,
        f"select {_KEY}, Training_Time_Seconds from trials",
    ),
    "scale_lists": (
        scale_lists,
        """select Model, string_agg(cast(Scale_Factor as varchar), ',' order by Scale_Factor)
                    as scales, count(*) as rows, cast(0 as bigint) as unexpected_rows,
                  count(*) = 6 as ok
           from summary group by Model""",
    ),
    "metric_long": (
        metric_long,
        " union all ".join(
            f"""select Model, cast(list_position({list(RULE_NAMES)}, Model) as bigint) as model_order,
                       '{m}' as measure, {m} as value from model_metrics"""
            for m in MEASURES
        ),
    ),
    "scaling_series": (
        scaling_series,
        " union all ".join(
            f"""select Model, Scale_Factor, Synthetic_Total_Rows, '{m}' as measure,
                       {m} as value from summary"""
            for m in report.SCALING_MEASURES
        ),
    ),
    "error_bar_series": (
        error_bar_series,
        " union all ".join(
            f"""select Model, Scale_Factor, Synthetic_Total_Rows, '{p}' as part,
                       round(Mean_{p}_Time_Seconds, 6) as mean,
                       round(Mean_{p}_Time_Seconds - Std_{p}_Time_Seconds, 6) as low,
                       round(Mean_{p}_Time_Seconds + Std_{p}_Time_Seconds, 6) as high
                from summary"""
            for p in ("Training", "Prediction")
        ),
    ),
    "largest_scale": (
        largest_scale,
        """select * from summary s where Scale_Factor =
             (select max(Scale_Factor) from summary t where t.Model = s.Model)""",
    ),
    "relative_cost": (
        relative_cost,
        """select Scale_Factor, Model, Mean_Training_Time_Seconds as fit_seconds,
                  round(Mean_Training_Time_Seconds /
                        (select Mean_Training_Time_Seconds from summary
                         where Model='click' and Scale_Factor=100), 2) as relative_fit_time
           from summary where Scale_Factor=100""",
    ),
    "summary_by_model": (
        summary_by_model,
        "select Model, Scale_Factor, Mean_Training_Time_Seconds from summary",
    ),
}
