import pytest
from pyspark.sql import functions as F

from frame_rows import rows
from tabwright.functions.layouts import (
    SUMMARY_COLUMNS,
    TRIAL_COLUMNS,
    TRIAL_STORE_COLUMNS,
    conform,
    names_of,
    retype,
)
from tabwright.operators import report
from tabwright.operators import trials as t

# Published fit and predict times and throughputs of one model at 1x, and their summary.
FIT = (5.183742, 5.225739, 4.130814)
PREDICT = (0.516315, 0.238859, 0.229099)


@pytest.fixture(scope="module")
def published(spark):
    data = [
        (1, "Logistic_Regression", i + 1, 7032, 7032, 5690, 1342, 45, FIT[i], PREDICT[i])
        for i in range(3)
    ]
    df = spark.createDataFrame(data, ", ".join(TRIAL_COLUMNS.split(", ")[:10]))
    first = F.col("Trial") == 1
    return t.with_throughput(conform(df, TRIAL_STORE_COLUMNS)).withColumns(
        {"Accuracy": F.when(first, 0.821908), "True_Positives": F.when(first, F.lit(214).cast("bigint"))}
    )


def test_layout_widths():
    assert [len(names_of(x)) for x in (TRIAL_COLUMNS, TRIAL_STORE_COLUMNS, SUMMARY_COLUMNS)] == [12, 22, 32]


def test_published_throughput(published):
    got = rows(published, "Trial", "Training_Throughput_Rows_Per_Second")
    assert got == [(1, 1097.66), (2, 1088.84), (3, 1377.45)]


def test_published_summary(published):
    # The published throughputs come from times that were not yet rounded.
    exact = F.array(*[F.lit(x) for x in (2599.19, 5618.38, 5857.72)])[F.col("Trial") - 1]
    summary = t.summarise(
        published.withColumn("Prediction_Throughput_Rows_Per_Second", exact)
    )
    assert summary.columns == names_of(SUMMARY_COLUMNS)
    row = summary.first()
    assert (row["Mean_Training_Time_Seconds"], row["Std_Training_Time_Seconds"]) == (4.846765, 0.620387)
    assert (row["Mean_Prediction_Time_Seconds"], row["Std_Prediction_Time_Seconds"]) == (0.328091, 0.16308)
    assert row["Mean_Training_Throughput_Rows_Per_Second"] == 1187.98
    assert row["Std_Training_Throughput_Rows_Per_Second"] == 164.14
    assert row["Mean_Prediction_Throughput_Rows_Per_Second"] == 4691.76
    assert row["Std_Prediction_Throughput_Rows_Per_Second"] == 1816.17
    assert tuple(row[f"Training_Time_Run_{i}"] for i in (1, 2, 3)) == FIT
    assert (row["Trials"], row["Accuracy"], row["True_Positives"]) == (3, 0.821908, 214)


def test_one_trial_has_no_spread(published):
    row = t.summarise(published.filter("Trial = 1"), 1).first()
    assert row["Std_Training_Time_Seconds"] == 0.0
    assert row["Training_Time_Run_2"] is None


def test_more_trials_than_the_layout_holds(published):
    fourth = published.filter("Trial = 3").withColumn("Trial", F.lit(4))
    summary = t.summarise(published.unionByName(fourth), 4)
    assert summary.first()["Training_Time_Run_4"] == FIT[2]


def test_zero_seconds(spark):
    df = spark.createDataFrame([(10, 0.0), (10, 4.0)], "n int, s double")
    got = [r[0] for r in df.select(t.throughput(F.col("n"), F.col("s"))).collect()]
    assert got == [0.0, 2.5]


def test_metrics_only_in_trial_one(published):
    filled = published.withColumn("Accuracy", F.lit(0.5))
    got = rows(t.metrics_in_first_trial(filled), "Trial", "Accuracy")
    assert got == [(1, 0.5), (2, None), (3, None)]


def test_grid_and_missing_work(spark, published):
    models = spark.createDataFrame([("Logistic_Regression",), ("Decision_Tree",)], "Model string")
    grid = t.work_grid(models, (1, 5), 3)
    assert grid.count() == 12
    missing = t.missing_work(grid, published.filter("Trial <> 2"))
    assert missing.count() == 10
    assert (1, "Logistic_Regression", 2) in rows(missing)
    assert rows(t.missing_models(models, published)) == [("Decision_Tree",)]


def test_order_follows_the_lists(spark):
    df = spark.createDataFrame(
        [(100, "a", 1), (5, "a", 1), (5, "b", 2), (5, "b", 1)],
        "Scale_Factor int, Model string, Trial int",
    )
    got = [tuple(r) for r in t.in_sweep_order(df, (5, 100), ("b", "a")).collect()]
    assert got == [(5, "b", 1), (5, "b", 2), (5, "a", 1), (100, "a", 1)]


def test_scale_check(spark):
    df = spark.createDataFrame(
        [(1, "a"), (5, "a"), (1, "b"), (7, "b"), (5, "c"), (5, "c")], "Scale_Factor int, Model string"
    )
    assert rows(t.scale_check(df, (1, 5))) == [
        ("a", "1,5", 2, 0, True),
        ("b", "1", 2, 1, False),
        ("c", "5", 2, 0, False),
    ]


def test_retype_text_rows(spark):
    text = spark.createDataFrame(
        [("1.0", "m", "3", "", "0.5"), ("x", "m", None, "7", "")],
        "Scale_Factor string, Model string, Trials string, n string, v string",
    )
    got = rows(retype(text, "Scale_Factor int, Model string, Trials bigint, n bigint, v double"))
    assert got == [(1, "m", 3, None, 0.5), (None, "m", None, 7, None)]


def test_report_series(spark):
    data = [
        (1, "lr", 10, 2.0, 0.5, 1.0, 0.1, 5.0, 6.0),
        (9, "lr", 90, 4.0, 0.5, 1.0, 0.1, 5.0, 6.0),
        (9, "dt", 90, 8.0, 0.5, 1.0, 0.1, 5.0, 6.0),
    ]
    summary = spark.createDataFrame(
        data,
        "Scale_Factor int, Model string, Synthetic_Total_Rows bigint, "
        "Mean_Training_Time_Seconds double, Std_Training_Time_Seconds double, "
        "Mean_Prediction_Time_Seconds double, Std_Prediction_Time_Seconds double, "
        "Mean_Training_Throughput_Rows_Per_Second double, "
        "Mean_Prediction_Throughput_Rows_Per_Second double",
    )
    assert report.scaling_series(summary).count() == 12
    bars = report.error_bars(summary).filter("part = 'Training'")
    assert rows(bars, "Model", "Scale_Factor", "low", "high") == [
        ("dt", 9, 7.5, 8.5),
        ("lr", 1, 1.5, 2.5),
        ("lr", 9, 3.5, 4.5),
    ]
    assert rows(report.largest_scale(summary), "Model", "Scale_Factor") == [("dt", 9), ("lr", 9)]
    assert rows(report.relative_cost(summary, "lr"), "Model", "relative_fit_time") == [
        ("dt", 2.0),
        ("lr", 1.0),
    ]
    ordered = [r["Model"] for r in report.by_model(summary, ["lr", "dt"]).collect()]
    assert ordered == ["lr", "lr", "dt"]


def test_metric_long(spark):
    df = spark.createDataFrame([("a", 0.5, 0.6), ("z", 0.1, 0.1)], "Model string, p double, q double")
    assert rows(report.metric_long(df, ["a", "b"], ["p", "q"])) == [("a", 1, "p", 0.5), ("a", 1, "q", 0.6)]


def test_models_are_required(spark):
    table = spark.createDataFrame([("Decision_Tree", 1), ("Other", 2)], "Model string, n int")
    assert rows(t.require_models(table, ["Decision_Tree"])) == [("Decision_Tree", 1)]
    with pytest.raises(t.NoModels):
        t.require_models(table, ["Random_Forest"])
