"""Summaries of trials that are folded as trials arrive.

A state has a row per (scale, model): the number of trials, what the summary takes from
single trials, and of each averaged column the count, the mean and the sum of squared
deviations from it. States merge in any order and grouping, so a new trial costs a fold
of two small tables, not another pass over all trials. Means are merged as differences
from one of the means that are merged: values of a billion that differ by one lose nothing.

A trial must be folded in once. NULL values count for nothing; a group without any value
has a NULL mean, as in the summary from all trials.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.layouts import QUALITY_COLUMNS, SUMMARY_COLUMNS, conform, names_of
from tabwright.operators.trials import GROUP_KEY, SIZES

#: Averaged columns and the digits that the summary keeps of them.
MEASURES = {
    f"{part}_{what}": digits
    for part in ("Training", "Prediction")
    for what, digits in (("Time_Seconds", 6), ("Throughput_Rows_Per_Second", 2))
}
_FIRST = (*SIZES, *names_of(QUALITY_COLUMNS))


def _runs(count: int) -> list[tuple[str, str, int]]:
    return [
        (f"{part}_Time_Run_{i}", f"{part}_Time_Seconds", i)
        for part in ("Training", "Prediction")
        for i in range(1, count + 1)
    ]


def state_of(trials: DataFrame, count: int = 3) -> DataFrame:
    """The state of these trials: one grouping, partial sums in each task."""
    first = [F.max(F.when(F.col("Trial") == 1, F.col(c))).alias(c) for c in _FIRST]
    runs = [F.max(F.when(F.col("Trial") == i, F.col(c))).alias(n) for n, c, i in _runs(count)]
    sums = [
        expression
        for c in MEASURES
        for expression in (
            F.count(c).alias(f"{c}_n"),
            F.avg(c).alias(f"{c}_mean"),
            (F.var_pop(c) * F.count(c)).alias(f"{c}_squares"),
        )
    ]
    return trials.groupBy(*GROUP_KEY).agg(F.count(F.lit(1)).alias("Trials"), *first, *runs, *sums)


def merged(*states: DataFrame) -> DataFrame:
    """One state for all the trials of the given ones."""
    rows = reduce(DataFrame.unionByName, states)
    group = Window.partitionBy(*GROUP_KEY)
    for c in MEASURES:
        near = F.min(f"{c}_mean").over(group)
        rows = rows.withColumn(f"{c}_near", near).withColumn(
            f"{c}_apart", F.col(f"{c}_mean") - F.col(f"{c}_near")
        )
    kept = [c for c in states[0].columns if c not in GROUP_KEY and c != "Trials"]
    sums = []
    for c in MEASURES:
        n, apart = F.col(f"{c}_n"), F.col(f"{c}_apart")
        shift = F.try_divide(F.sum(n * apart), F.sum(n))
        between = F.sum(n * apart * apart) - F.sum(n * apart) * shift
        kept = [k for k in kept if k not in (f"{c}_n", f"{c}_mean", f"{c}_squares")]
        sums += [
            F.sum(n).alias(f"{c}_n"),
            (F.min(f"{c}_near") + shift).alias(f"{c}_mean"),
            (F.sum(f"{c}_squares") + F.greatest(between, F.lit(0.0))).alias(f"{c}_squares"),
        ]
    single = [F.max(c).alias(c) for c in kept]
    out = rows.groupBy(*GROUP_KEY).agg(F.sum("Trials").alias("Trials"), *single, *sums)
    return out.select(*states[0].columns)


def summary_of(state: DataFrame) -> DataFrame:
    """The summary row of each (scale, model), as from all trials at once."""
    out = state
    for c, digits in MEASURES.items():
        spread = F.sqrt(F.try_divide(F.col(f"{c}_squares"), F.col(f"{c}_n") - 1))
        out = out.withColumns(
            {
                f"Mean_{c}": F.round(f"{c}_mean", digits),
                f"Std_{c}": F.round(F.coalesce(spread, F.lit(0.0)), digits),
            }
        )
    extra = [
        c
        for c in state.columns
        if "_Time_Run_" in c and int(c.rsplit("_", 1)[1]) > 3
    ]
    if not extra:
        return conform(out, SUMMARY_COLUMNS)
    return out.select(*names_of(SUMMARY_COLUMNS), *extra)
