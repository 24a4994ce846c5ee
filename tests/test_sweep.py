import pytest
from pyspark.sql import functions as F

from casebook.fixtures import ACCOUNTS, accounts_raw
from frame_rows import rows
from tabwright.functions.layouts import (
    SUMMARY_COLUMNS,
    TRIAL_COLUMNS,
    TRIAL_STORE_COLUMNS,
    names_of,
)
from tabwright.operators.sampling import held
from tabwright.plans import sweep
from tabwright.plans.prepare import prepare
from tabwright.sources.tables import read_stored, read_stored_csv

MODELS = ("Decision_Tree", "Logistic_Regression")


@pytest.fixture(scope="module")
def frames(spark):
    prepared = prepare(accounts_raw(spark, "/root/testdata/sf0.001"), ACCOUNTS)
    with held(prepared.split("train"), prepared.split("test")) as kept:
        yield kept


def test_a_sweep_that_dies_goes_on_where_it_stopped(spark, frames, tmp_path, monkeypatch):
    store = str(tmp_path / "trials")
    run, done = sweep._run_trial, []

    def fail_at_the_third(row, *rest):
        if len(done) == 2:
            raise RuntimeError("lost")
        done.append((row["Scale_Factor"], row["Model"], row["Trial"]))
        return run(row, *rest)

    monkeypatch.setattr(sweep, "_run_trial", fail_at_the_third)
    args = (*frames, 21, store, (1, 2), MODELS, 2)
    with pytest.raises(RuntimeError, match="lost"):
        sweep.run_sweep(*args, warm_up=False)
    kept = rows(read_stored(spark, store, TRIAL_STORE_COLUMNS))
    assert len(kept) == 2

    again = []
    monkeypatch.setattr(
        sweep,
        "_run_trial",
        lambda row, *rest: (
            again.append((row["Scale_Factor"], row["Model"], row["Trial"])),
            run(row, *rest),
        ),
    )
    trials, summary = sweep.run_sweep(*args, warm_up=False)
    assert len(again) == 6 and not set(again) & set(done)
    everything = rows(read_stored(spark, store, TRIAL_STORE_COLUMNS))
    assert set(kept) < set(everything) and len(everything) == 8

    assert trials.columns == names_of(TRIAL_COLUMNS)
    assert summary.columns == names_of(SUMMARY_COLUMNS)
    assert [(r["Scale_Factor"], r["Model"], r["Trial"]) for r in trials.collect()] == [
        (s, m, t) for s in (1, 2) for m in MODELS for t in (1, 2)
    ]
    assert summary.filter(F.col("Accuracy").isNull()).count() == 0
    assert {(r["Scale_Factor"], r["Trials"]) for r in summary.collect()} == {(1, 2), (2, 2)}

    monkeypatch.setattr(sweep, "_run_trial", None)  # nothing is left to run
    sweep.run_sweep(*args)


def test_sizes_grow_with_the_scale(spark, frames, tmp_path):
    base = tuple(f.count() for f in frames)
    trials, summary = sweep.run_sweep(
        *frames, 21, str(tmp_path / "t"), (3,), ("Decision_Tree",), 1, warm_up=True
    )
    row = trials.first()
    assert (row["Training_Rows"], row["Testing_Rows"]) == (3 * base[0], 3 * base[1])
    assert row["Base_Dataset_Rows"] == sum(base)
    assert summary.first()["Std_Training_Time_Seconds"] == 0.0
    sweep.publish(trials, summary, str(tmp_path / "final"))
    for name, layout, table in (
        ("scalability_trials", TRIAL_COLUMNS, trials),
        ("scalability_repeated_results", SUMMARY_COLUMNS, summary),
    ):
        back = read_stored_csv(spark, str(tmp_path / "final" / name), layout)
        assert rows(back) == rows(table)


def test_incomplete_store_is_an_error(frames, tmp_path, monkeypatch):
    monkeypatch.setattr(sweep, "_run_trial", lambda *a: None)
    with pytest.raises(sweep.SweepIncomplete, match="1 trials"):
        sweep.run_sweep(
            *frames, 21, str(tmp_path / "t"), (1,), ("Decision_Tree",), 1, warm_up=False
        )


def test_labels_are_gated_before_a_sweep(spark, frames, tmp_path):
    train, test = frames
    args = (21, str(tmp_path / "t"), (1,), MODELS[:1], 1)
    third = test.withColumn("label", F.when(F.rand(3) < 0.1, 2.0).otherwise(F.col("label")))
    missing = test.withColumn("label", F.when(F.col("label") == 0, 0.0))
    for bad in (third, missing, test.limit(0)):
        with pytest.raises(ValueError):
            sweep.run_sweep(train, bad, *args)


def test_a_store_keeps_runs_and_inputs_apart(spark, frames, tmp_path):
    train, test = frames
    store = str(tmp_path / "t")
    args = (21, store, (1,), MODELS[:1], 1)
    _, first = sweep.run_sweep(train, test, *args, warm_up=False)
    half = train.filter(F.col("label").isNotNull() & (F.rand(1) < 0.5))
    half = spark.createDataFrame(half.collect(), half.schema)
    _, second = sweep.run_sweep(half, test, *args, warm_up=False)
    sweep.run_sweep(train, test, *args, warm_up=False, run_id="next")
    assert first.first()["Training_Rows"] == train.count()
    assert second.first()["Training_Rows"] == half.count()
    assert first.first()["Trials"] == 1 == second.first()["Trials"]
    stored = spark.read.parquet(store)
    assert stored.count() == 3
    stored.limit(1).write.mode("append").parquet(store)
    with pytest.raises(sweep.SweepIncomplete, match="more than once"):
        for run_id in ("", "next"):
            sweep.run_sweep(train, test, *args, warm_up=False, run_id=run_id)
            sweep.run_sweep(half, test, *args, warm_up=False, run_id=run_id)
