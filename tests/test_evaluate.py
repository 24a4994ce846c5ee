import numpy as np
import pytest
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    MulticlassClassificationEvaluator,
)
from pyspark.sql import functions as F

from frame_rows import rows
from tabwright.operators import evaluate as e

# Published confusion counts (TN, FP, FN, TP) and the ratios published with them:
# accuracy, precision, recall, F1, weighted F1.
PUBLISHED = {
    "Logistic_Regression": ((889, 91, 148, 214), (0.821908, 0.701639, 0.59116, 0.641679, 0.816814)),
    "Decision_Tree": ((908, 72, 203, 159), (0.795082, 0.688312, 0.439227, 0.536256, 0.778867)),
    "Random_Forest": ((913, 67, 186, 176), (0.811475, 0.72428, 0.486188, 0.581818, 0.79833)),
    "Gradient_Boosted_Tree": ((880, 100, 165, 197), (0.802534, 0.6633, 0.544199, 0.597876, 0.795964)),
}
RATIOS = ("Accuracy", "Precision_Churn", "Recall_Churn", "F1_Churn", "Weighted_F1")


def expand(spark):
    """One row per scored case behind the published counts."""
    cells = [
        (model, y, p, n)
        for model, (counts, _) in PUBLISHED.items()
        for (y, p), n in zip([(0, 0), (0, 1), (1, 0), (1, 1)], counts)
    ]
    df = spark.createDataFrame(cells, "Model string, label int, prediction int, n int")
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))


def test_published_ratios_from_published_counts(spark):
    counts = e.confusion(expand(spark), ["Model"])
    for row in e.with_metrics(counts).collect():
        expected_counts, expected = PUBLISHED[row["Model"]]
        assert tuple(row[c] for c in e.COUNTS) == expected_counts
        assert tuple(round(row[c], 6) for c in RATIOS) == expected
        assert row["rows"] == sum(expected_counts)


def test_metric_rows_agree_with_the_parts(spark):
    df = expand(spark).withColumn("raw_score", F.col("prediction") * 2.0 + F.col("copy") % 3)
    one_pass = e.metric_rows(df, ["Model"])
    parts = e.with_metrics(e.confusion(df, ["Model"])).join(e.roc_auc(df, ["Model"]), "Model")
    names = ["Model", *e.COUNTS, *RATIOS, "ROC_AUC"]
    rounded = [F.round(c, 6).alias(c) if c in (*RATIOS, "ROC_AUC") else c for c in names]
    assert rows(one_pass, *names) == rows(parts.select(*rounded))


def brute_auc(labels, scores):
    positives, negatives = scores[labels == 1], scores[labels == 0]
    wins = (positives[:, None] > negatives[None, :]).sum()
    ties = (positives[:, None] == negatives[None, :]).sum()
    return (wins + ties / 2) / (len(positives) * len(negatives))


@pytest.fixture(params=["true", "false"])
def ranges(spark, request):
    """With AQE small ranges are merged; without it there really are many."""
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_auc_equals_brute_force_with_ties_and_a_hot_score(spark, ranges):
    random = np.random.default_rng(7)
    labels = random.integers(0, 2, 900)
    scores = np.round(random.normal(labels, 1.0), 1)
    scores[random.random(900) < 0.4] = 0.5  # one score holds more than a third
    groups = random.integers(0, 2, 900)
    data = list(zip(groups.tolist(), labels.tolist(), scores.tolist()))
    df = spark.createDataFrame(data, "g int, label int, raw_score double")
    for group, area in rows(e.roc_auc(df, ["g"])):
        mine = groups == group
        assert area == pytest.approx(brute_auc(labels[mine], scores[mine]), abs=1e-12)
    assert e.roc_auc(df).first()[0] == pytest.approx(brute_auc(labels, scores), abs=1e-12)


def test_auc_and_ratios_equal_the_evaluators(spark):
    df = spark.range(4000).select(
        (F.hash("id") % 3 == 0).cast("double").alias("label"),
        (F.abs(F.hash("id", F.lit(1))) % 997 / 997.0).alias("raw_score"),
    )
    df = df.withColumn("prediction", (F.col("raw_score") > 0.6).cast("double"))
    ours = e.metric_rows(df).first()
    area = BinaryClassificationEvaluator(rawPredictionCol="raw_score", numBins=0)
    assert ours["ROC_AUC"] == pytest.approx(area.evaluate(df), abs=1e-6)
    for name, metric in (("Accuracy", "accuracy"), ("Weighted_F1", "f1")):
        evaluator = MulticlassClassificationEvaluator(metricName=metric)
        assert ours[name] == pytest.approx(evaluator.evaluate(df), abs=1e-6)


def test_one_class_only(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2)], "label int, prediction int, raw_score double")
    row = e.metric_rows(df).first()
    assert row["ROC_AUC"] is None
    assert (row["Accuracy"], row["Precision_Churn"], row["Recall_Churn"], row["F1_Churn"]) == (1, 0, 0, 0)
    assert row["Weighted_F1"] == 1.0


def test_no_rows(spark):
    df = spark.createDataFrame([], "label int, prediction int, raw_score double")
    assert tuple(e.confusion(df).first()) == (0, 0, 0, 0, 0)
    assert e.with_metrics(e.confusion(df)).first()["F1_Churn"] == 0.0
    assert e.metric_rows(df, ["label"]).count() == 0


def test_further_sums_come_with_the_metrics(spark):
    df = spark.createDataFrame(
        [(0, 0, 0.1, 5), (1, 1, 0.2, 6), (1, 0, 0.3, 7)],
        "label int, prediction int, raw_score double, v int",
    )
    assert e.metric_rows(df, sums={"total": F.col("v")}).first()["total"] == 18


def test_best_model_first_in_order_wins_a_tie(spark):
    df = spark.createDataFrame(
        [("b", 0.9, 0.1), ("a", 0.9, 0.3), ("c", 0.2, 0.2)], "Model string, m double, n double"
    )
    assert rows(e.best_models(df, ["b", "a", "c"], ["m", "n"])) == [("m", "b", 0.9), ("n", "a", 0.3)]
    assert rows(e.best_models(df, ["a", "b", "c"], ["m"])) == [("m", "a", 0.9)]


def test_model_order(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "Model string")
    assert [r[0] for r in e.in_model_order(df, ["c", "a", "b"]).collect()] == ["c", "a", "b"]


def test_flat_scores_with_and_without_label(spark):
    df = spark.createDataFrame(
        [("k", 1, 1, 0.2, 0.8), ("l", 0, 0, 0.7, 0.3)],
        "id string, label int, prediction int, no double, yes double",
    )
    flat = e.flat_columns(df, "no", "yes", keep=["id"])
    assert rows(flat) == [("k", 1.0, 1.0, "Churn", 0.2, 0.8), ("l", 0.0, 0.0, "No Churn", 0.7, 0.3)]
    bare = e.flat_columns(df.drop("label"), "no", "yes")
    assert "actual_label" not in bare.columns
    assert tuple(e.prediction_totals(bare).first()) == (2, 1, 1, 50.0)
    assert tuple(e.prediction_totals(bare.limit(0)).first()) == (0, 0, 0, 0.0)
    assert rows(e.prediction_summary(bare)) == [("Churn", 1), ("No Churn", 1)]


def test_scores_move_twice_whatever_the_rows(spark, tmp_path):
    path = str(tmp_path / "scores")
    spark.range(20_000).selectExpr(
        "int(id % 3 = 0) label", "double(id % 7919) raw_score", "id % 2 Model", "id % 2 prediction"
    ).write.parquet(path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # its plan is final at once
    try:
        plans = {
            n: e.metric_rows(spark.read.parquet(path), ["Model"][:n])
            ._jdf.queryExecution()
            .executedPlan()
            .toString()
            for n in (0, 1)
        }
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for plan in plans.values():
        moved = [x for x in plan.splitlines() if " Exchange " in x and "Reused" not in x]
        assert sum("raw_score" in x for x in moved) == 1
        assert sum("_range" in x for x in moved) == 1
        assert sum("SinglePartition" in x or "hashpartitioning" in x for x in moved) == len(moved)
        assert "ReusedExchange" in plan


def test_ranges_agree_with_one_window_for_odd_scores(spark):
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1.5, 1e300]
    data = [(i % 5 % 2, odd[i % 8] if i % 5 > 1 else 0.25, i % 3) for i in range(4_000)]
    df = spark.createDataFrame(data, "label int, raw_score double, Model int")
    found = dict(map(tuple, e.roc_auc(df, ["Model"]).collect()))

    def place(score):
        return (0, 0) if score is None else (2, 0) if score != score else (1, score)

    for model in range(3):
        own = [(place(s), y) for y, s, m in data if m == model]
        good, bad = ([p for p, y in own if y == label] for label in (1, 0))
        won = sum((a > b) + 0.5 * (a == b) for a in good for b in bad)
        assert found[model] == pytest.approx(won / len(good) / len(bad), abs=1e-12)
