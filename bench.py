"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local cores. The 5x copies
of the sf0.1 accounts are about as many rows as the largest published workload.
"""

from __future__ import annotations

import json
import os
import sys
from pathlib import Path
from time import perf_counter

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.ml.evaluation import (  # noqa: E402
    BinaryClassificationEvaluator,
    MulticlassClassificationEvaluator,
)
from pyspark.sql import SparkSession  # noqa: E402

from casebook import evaluation, sweeps, tables  # noqa: E402
from casebook.fixtures import ACCOUNTS, accounts_raw  # noqa: E402
from tabwright.operators.evaluate import metric_rows  # noqa: E402
from tabwright.operators.models import (  # noqa: E402
    MODEL_NAMES,
    estimator,
    score,
    score_all,
)
from tabwright.operators.sampling import held, replicate  # noqa: E402
from tabwright.plans.prepare import prepare  # noqa: E402
from tabwright.plans.train import force  # noqa: E402
from tabwright.sources.sinks import write_parquet  # noqa: E402
from tabwright.sources.workspace import fresh_path  # noqa: E402

SCALES = (1, 5)
SHORT = {
    "Logistic_Regression": "lr",
    "Decision_Tree": "dt",
    "Random_Forest": "rf",
    "Gradient_Boosted_Tree": "gbt",
}


def many_passes(scored) -> float:
    """Seconds for the same numbers from evaluators and filtered counts, per model."""
    start = perf_counter()
    scored = scored.drop("probability")  # the evaluators would take it for a vector
    for name in MODEL_NAMES:
        one = scored.filter(scored.Model == name)
        BinaryClassificationEvaluator(rawPredictionCol="raw_score").evaluate(one)
        for metric in ("accuracy", "f1"):
            MulticlassClassificationEvaluator(metricName=metric).evaluate(one)
        for y, p in ((0, 0), (0, 1), (1, 0), (1, 1)):
            one.filter((one.label == y) & (one.prediction == p)).count()
    return perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    rows: dict[str, int] = {}
    elsewhere: dict[str, float] = {}

    def measure(name, action):
        start = perf_counter()
        result = action()
        seconds[name] = round(perf_counter() - start, 4)
        return result

    force(accounts_raw(spark, sf_dir))  # JVM and scan warm-up, not measured
    plain = {
        "clean_accounting": tables.clean_accounting,
        "validate_report": tables.validate_report,
        "category_index": tables.category_counts,
        "hash_split": tables.hash_split,
        "metric_table": evaluation.metric_table,
        "roc_auc": evaluation.roc_auc,
        "trial_summary": sweeps.CASES["trial_summary"][0],
        "grid_missing": sweeps.grid_missing,
    }
    for name, run in plain.items():
        measure(name, lambda: force(run(spark, sf_dir)))

    raw = accounts_raw(spark, sf_dir)
    prepared = measure("prepare_fit", lambda: prepare(raw, ACCOUNTS, partitions=cores))
    path = fresh_path(spark, "features")
    measure(
        "prepare_write",
        lambda: write_parquet(prepared.features, path, partition_by=["split"]),
    )
    stored = spark.read.parquet(path)
    parts = [stored.filter(stored.split == s).drop("split") for s in ("train", "test")]
    with held(*parts) as (base_train, base_test):
        for name in MODEL_NAMES:  # each algorithm once, not measured
            force(score(base_test, estimator(name).fit(base_train)))
        for scale in SCALES:
            copies = (replicate(base_train, scale), replicate(base_test, scale))
            with held(*copies) as (train, test):
                rows[f"train_{scale}x"] = train.count()
                rows[f"test_{scale}x"] = test.count()
                fitted = {}
                for name in MODEL_NAMES:
                    tag = f"{SHORT[name]}_{scale}x"
                    fitted[name] = measure(
                        f"fit_{tag}", lambda: estimator(name).fit(train)
                    )
                    measure(f"predict_{tag}", lambda: force(score(test, fitted[name])))
                scored = score_all(test, fitted, ["label"])
                measure(
                    f"evaluate_all_{scale}x",
                    lambda: force(metric_rows(scored, ["Model"])),
                )
                if scale == SCALES[-1]:
                    with held(scored) as (rows_scored,):
                        elsewhere["evaluate_all_many_passes"] = many_passes(rows_scored)
                        start = perf_counter()
                        force(metric_rows(rows_scored, ["Model"]))
                        elsewhere["evaluate_all_one_pass"] = perf_counter() - start
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "rows": rows,
                "on_held_scores": {k: round(v, 4) for k, v in elsewhere.items()},
                "cores": cores,
                "spark": spark.version,
                "partitions": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
