import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from casebook.fixtures import ACCOUNTS, accounts_raw
from frame_rows import rows
from tabwright.operators import evaluate, features, models
from tabwright.operators.sampling import held
from tabwright.plans.prepare import feature_rules, prepare, store
from tabwright.plans.score import score_table
from tabwright.plans.train import compare
from tabwright.operators.validate import ValidationError, enforce, validate
from tabwright.sources.models import load_model, load_pipeline, save_model

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def prepared(spark):
    return prepare(accounts_raw(spark, SF), ACCOUNTS)


@pytest.fixture(scope="module")
def frames(prepared):
    with held(prepared.split("train"), prepared.split("test")) as kept:
        yield kept


@pytest.fixture(scope="module")
def tree(frames):
    return models.estimator("Decision_Tree").fit(frames[0])


@pytest.fixture(scope="module")
def regression(frames):
    return models.estimator("Logistic_Regression").fit(frames[0])


def test_settings(spark):
    rf = models.estimator("Random_Forest")
    assert (rf.getNumTrees(), rf.getMaxDepth(), rf.getSeed()) == (50, 8, 42)
    assert models.estimator("Gradient_Boosted_Tree").getMaxIter() == 30
    assert models.estimator("Logistic_Regression").getMaxIter() == 50
    assert models.estimator("Decision_Tree", maxDepth=2).getMaxDepth() == 2
    with pytest.raises(ValueError, match="Nearest"):
        models.estimator("Nearest_Neighbour")


def test_loading_an_unknown_model_is_an_error():
    with pytest.raises(ValueError, match="Nearest"):
        load_model("Nearest_Neighbour", "/nowhere")


def test_one_plain_tree_of_a_forest_is_the_tree(frames, tree):
    forest = models.estimator(
        "Random_Forest", numTrees=1, maxDepth=5, featureSubsetStrategy="all", bootstrap=False
    ).fit(frames[0])
    both = models.score_all(frames[1], {"tree": tree, "forest": forest}, ["account_id"])
    spread = both.groupBy("account_id").agg(
        (F.max("probability") - F.min("probability")).alias("d")
    )
    assert spread.agg(F.max("d")).first()[0] < 1e-9


def test_loss_of_boosting_does_not_rise(frames):
    boosted = models.estimator("Gradient_Boosted_Tree", maxIter=6).fit(frames[0])
    losses = np.array(boosted.evaluateEachIteration(frames[0]))
    assert (np.diff(losses) <= 1e-9).all()


def test_regression_gives_back_the_base_rate(frames, regression):
    scored = models.score(frames[0], regression)
    p, y = scored.agg(F.avg(vector_to_array("probability")[1]), F.avg("label")).first()
    assert p == pytest.approx(y, abs=1e-3)


def test_long_form_equals_single_scoring(frames, tree, regression):
    both = models.score_all(
        frames[1], {"Decision_Tree": tree, "Logistic_Regression": regression}, ["account_id"]
    )
    alone = models.score(frames[1], tree).select(
        "account_id", "prediction", vector_to_array("probability")[1]
    )
    mine = both.filter("Model = 'Decision_Tree'").select("account_id", "prediction", "probability")
    assert rows(mine) == rows(alone)
    assert both.count() == 2 * frames[1].count()


def test_copies_change_no_ratio(frames, tree):
    from tabwright.operators.sampling import replicate

    scored = models.score_all(frames[1], {"t": tree}, ["label"])
    one = evaluate.metric_rows(scored).first()
    five = evaluate.metric_rows(replicate(scored, 5)).first()
    for c in evaluate.COUNTS:
        assert five[c] == 5 * one[c]
    for c in ("Accuracy", "F1_Churn", "Weighted_F1", "ROC_AUC"):
        assert five[c] == pytest.approx(one[c], abs=1e-6)


def test_stored_chain_scores_raw_rows_alike(spark, prepared, frames, regression, tmp_path):
    save_model(prepared.encoder, str(tmp_path / "encoder"))
    save_model(regression, str(tmp_path / "model"))
    encoder = load_pipeline(str(tmp_path / "encoder"))
    model = load_model("Logistic_Regression", str(tmp_path / "model"))
    from casebook.fixtures import accounts_split

    test = accounts_split(spark, SF).filter("split = 'test'")
    again = models.score(features.encode(test, encoder, ACCOUNTS), model)
    first = models.score(frames[1], regression)
    columns = ("account_id", vector_to_array("probability")[1])
    assert rows(again.select(*columns)) == rows(first.select(*columns))


def test_store_train_and_score(spark, prepared, tmp_path):
    table, encoder = str(tmp_path / "features"), str(tmp_path / "encoder")
    report = store(prepared, table, encoder)
    assert all(r["ok"] for r in report.collect())
    stored = spark.read.parquet(table)
    train, test = (stored.filter(F.col("split") == s) for s in ("train", "test"))
    fitted, comparison = compare(
        train,
        test,
        prepared.width,
        ["Decision_Tree"],
        str(tmp_path / "models"),
        table_path=str(tmp_path / "metrics"),
    )
    written = spark.read.option("header", True).csv(str(tmp_path / "metrics"))
    assert written.columns == comparison.columns and written.count() == 1
    row = comparison.first()
    assert row["Dataset_Rows"] == stored.count() == row["Training_Rows"] + row["Testing_Rows"]
    assert row["Feature_Count"] == 21 and len(comparison.columns) == 18
    assert row["Prediction_Throughput_Rows_Per_Second"] > 0
    flat, summary, totals = score_table(
        spark,
        "Decision_Tree",
        str(tmp_path / "models" / "Decision_Tree"),
        table,
        str(tmp_path / "scores"),
        keep=("account_id",),
    )
    assert flat.count() == stored.count() == totals.first()["total_rows"]
    assert sum(r["rows"] for r in summary.collect()) == stored.count()
    expected = models.score(stored, fitted["Decision_Tree"]).select("account_id", "prediction")
    assert rows(flat, "account_id", "predicted_label") == rows(expected)


def test_stored_split_is_read_without_the_other_part(spark, prepared, tmp_path):
    store(prepared, str(tmp_path / "f"), str(tmp_path / "e"))
    plan = spark.read.parquet(str(tmp_path / "f")).filter("split = 'test'")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in text


def test_gates_before_a_fit(spark, prepared):
    one_class = prepared.features.filter("label = 0")
    enforce(validate(one_class, feature_rules(21, complete=False)))
    with pytest.raises(ValidationError, match="domain:label"):
        enforce(validate(one_class, feature_rules(21, complete=True)))
    with pytest.raises(ValidationError, match="width"):
        enforce(validate(one_class, feature_rules(45, complete=False)))


def test_unknown_label_text_is_an_error(spark):
    raw = accounts_raw(spark, SF).withColumn(
        "churn", F.when(F.col("account_id") == "7", "Maybe").otherwise(F.col("churn"))
    )
    odd = prepare(raw, ACCOUNTS)
    with pytest.raises(ValidationError, match="no_nulls:label"):
        enforce(validate(odd.features, feature_rules(odd.width, complete=True)))


def test_missing_input_column(spark):
    with pytest.raises(ValidationError, match="tenure"):
        prepare(accounts_raw(spark, SF).drop("tenure"), ACCOUNTS)


def test_three_classes_are_refused(frames):
    odd = frames[0].withColumn("label", F.floor(F.rand(1) * 3).cast("double"))
    model = models.estimator("Decision_Tree", maxDepth=1).fit(odd)
    with pytest.raises(ValueError, match="3 classes"):
        models.require_binary(model)


def test_model_facts(frames, tree):
    got = rows(models.model_facts(frames[0], {"Decision_Tree": tree}))
    assert got == [("Decision_Tree", "classes", 2), ("Decision_Tree", "features", 21)]
