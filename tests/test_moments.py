import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from frame_rows import rows
from tabwright.functions.layouts import TRIAL_STORE_COLUMNS, conform
from tabwright.operators import moments as m
from tabwright.operators import trials as t


def table(spark, seconds, models=("a",)):
    data = [(1, k, i + 1, 10, 8, 2, s, s) for k in models for i, s in enumerate(seconds)]
    names = (
        "Scale_Factor int, Model string, Trial int, Synthetic_Total_Rows long, Training_Rows long, "
        "Testing_Rows long, Training_Time_Seconds double, Prediction_Time_Seconds double"
    )
    return conform(t.with_throughput(spark.createDataFrame(data, names)), TRIAL_STORE_COLUMNS)


def parts(trials, *groups):
    return [m.state_of(trials.where(F.col("Trial").isin(*g))) for g in groups]


def test_any_order_and_grouping_of_merges(spark):
    trials = table(spark, [4.5, 1.25, 9.0], ("a", "b")).cache()
    wanted = rows(t.summarise(trials))
    assert rows(m.summary_of(m.state_of(trials))) == wanted
    for order in itertools.permutations([1, 2, 3]):
        a, b, c = parts(trials, *([i] for i in order))
        assert rows(m.summary_of(m.merged(m.merged(a, b), c))) == wanted
    a, b = parts(trials, [1, 3], [2])
    assert rows(m.summary_of(m.merged(b, a))) == wanted
    trials.unpersist()


@pytest.mark.parametrize("shift", [1e9, -3e8, 0.0])
def test_large_means_and_small_spreads(spark, shift):
    seconds = [shift + x for x in (0.0, 1.0, 0.25, 0.75, 2.0)]
    states = parts(table(spark, seconds), *([i] for i in range(1, 6)))
    state = m.merged(m.merged(*states[:2]), m.merged(*states[2:])).first()
    assert state["Trials"] == state["Training_Time_Seconds_n"] == 5
    assert state["Training_Time_Seconds_mean"] == pytest.approx(np.mean(seconds), rel=1e-15)
    squares = 4 * np.var([x - shift for x in seconds], ddof=1)
    assert state["Training_Time_Seconds_squares"] == pytest.approx(squares, rel=1e-6)


def test_groups_that_arrive_alone_and_missing_times(spark):
    one, two = table(spark, [3.0], ("a",)), table(spark, [None, 5.0], ("b",))
    summary = {r["Model"]: r for r in m.summary_of(m.merged(m.state_of(one), m.state_of(two))).collect()}
    assert summary["a"]["Std_Training_Time_Seconds"] == 0.0
    assert summary["b"]["Trials"] == 2 and summary["b"]["Mean_Training_Time_Seconds"] == 5.0
    assert rows(m.summary_of(m.merged(m.state_of(one.limit(0)), m.state_of(two)))) == rows(t.summarise(two))
    nothing = m.merged(m.state_of(one.limit(0)))
    assert nothing.collect() == []
