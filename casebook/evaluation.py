"""Registered queries: evaluation of scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.fixtures import (
    RULE_NAMES,
    SQL_COUNTS,
    SQL_METRICS,
    scored,
    scored_models,
    sql_auc,
)
from tabwright.operators import evaluate
from tabwright.plans.train import as_metric_table


def _flat(spark, sf, with_label: bool) -> DataFrame:
    rows = scored(spark, sf)
    share = F.round(F.col("score") / 200.0, 6)
    rows = rows.withColumns(
        {"yes": share, "no": F.round(1 - F.col("score") / 200.0, 6)}
    )
    if not with_label:
        rows = rows.drop("label")
    return evaluate.flat_columns(rows, "no", "yes", keep=["account_id"])


def scored_output(spark, sf) -> DataFrame:
    return _flat(spark, sf, with_label=True)


def scored_output_nolabel(spark, sf) -> DataFrame:
    return _flat(spark, sf, with_label=False)


def confusion_matrix(spark, sf) -> DataFrame:
    return evaluate.confusion(scored_models(spark, sf), ["Model"])


def accuracy(spark, sf) -> DataFrame:
    counts = evaluate.confusion(scored_models(spark, sf), ["Model"])
    return evaluate.with_metrics(counts).select(
        "Model", F.round("Accuracy", 6).alias("Accuracy")
    )


def metrics_of_all_rows(spark, sf) -> DataFrame:
    """Labels that are NULL or a third class: such rows are never right."""
    strange = F.when(F.col("score") % 7 == 0, None).when(F.col("score") % 7 == 1, 2)
    label = F.when(F.col("score") % 7 > 1, F.col("label")).otherwise(strange)
    rows = scored_models(spark, sf).withColumn("label", label)
    counts = evaluate.confusion(rows, ["Model"])
    return evaluate.with_metrics(counts).select(
        "Model",
        "rows",
        evaluate.other_rows(),
        F.round("Accuracy", 6).alias("Accuracy"),
    )


def precision_recall_f1(spark, sf) -> DataFrame:
    counts = evaluate.confusion(scored_models(spark, sf), ["Model"])
    names = ("Precision_Churn", "Recall_Churn", "F1_Churn")
    return evaluate.with_metrics(counts).select(
        "Model", *[F.round(c, 6).alias(c) for c in names]
    )


def weighted_f1(spark, sf) -> DataFrame:
    counts = evaluate.confusion(scored_models(spark, sf), ["Model"])
    return evaluate.with_metrics(counts).select(
        "Model", F.round("Weighted_F1", 6).alias("Weighted_F1")
    )


def roc_auc(spark, sf) -> DataFrame:
    area = evaluate.roc_auc(scored(spark, sf), score="score")
    return area.select(F.round("ROC_AUC", 9).alias("ROC_AUC"))


def roc_auc_odd_scores(spark, sf) -> DataFrame:
    """Scores of which 40 % are one value, and some are NULL (lowest) or NaN (highest)."""
    points = F.col("score")
    odd = (
        F.when(points % 5 < 2, 95.0)
        .when(points % 11 == 0, None)
        .when(points % 13 == 0, float("nan"))
        .otherwise(points.cast("double"))
    )
    rows = scored_models(spark, sf).withColumn("odd", odd)
    area = evaluate.roc_auc(rows, ["Model"], score="odd")
    return area.select("Model", F.round("ROC_AUC", 9).alias("ROC_AUC"))


def model_metrics(spark, sf) -> DataFrame:
    return evaluate.metric_rows(scored_models(spark, sf), ["Model"], score="score")


def metric_table(spark, sf) -> DataFrame:
    """The published layout. Rows to learn from do not exist for a rule, and times
    are no part of an answer that can be compared."""
    rows = model_metrics(spark, sf).withColumns(
        {
            "Training_Rows": F.lit(0).cast("bigint"),
            "Training_Time_Seconds": F.lit(None).cast("double"),
            "Prediction_Time_Seconds": F.lit(None).cast("double"),
        }
    )
    table = evaluate.in_model_order(as_metric_table(rows, 21), RULE_NAMES)
    return table.drop("Training_Time_Seconds", "Prediction_Time_Seconds")


def best_model(spark, sf) -> DataFrame:
    return evaluate.best_models(
        model_metrics(spark, sf), RULE_NAMES, ("Accuracy", "ROC_AUC", "F1_Churn")
    )


def prediction_summary(spark, sf) -> DataFrame:
    return evaluate.prediction_summary(scored_output(spark, sf))


def prediction_totals(spark, sf) -> DataFrame:
    return evaluate.prediction_totals(scored_output(spark, sf))


_FLAT = """account_id, cast(prediction as double) predicted_label,
           case when prediction=1 then 'Churn' else 'No Churn' end prediction_result,
           round(1 - score/200.0, 6) probability_no_churn,
           round(score/200.0, 6) probability_churn"""
_ODD = """(select *, case when score % 5 < 2 then 95.0::double
                        when score % 11 = 0 then -1e300::double
                        when score % 13 = 0 then 'nan'::double
                        else score::double end as odd from scored_models)"""
_COUNTED = f"""(select Model, count(*) n, {SQL_COUNTS}
               from scored_models group by Model) c"""

CASES = {
    "scored_output": (
        scored_output,
        f"select cast(label as double) actual_label, {_FLAT} from scored",
    ),
    "scored_output_nolabel": (scored_output_nolabel, f"select {_FLAT} from scored"),
    "confusion_matrix": (
        confusion_matrix,
        f"select Model, count(*) as rows, {SQL_COUNTS} from scored_models group by Model",
    ),
    "accuracy": (
        accuracy,
        """select Model, round(avg(case when label=prediction then 1.0 else 0.0 end), 6)
                  as Accuracy from scored_models group by Model""",
    ),
    "metrics_of_all_rows": (
        metrics_of_all_rows,
        """select Model, count(*) as rows,
                  count(*) filter (where score % 7 < 2) as other_rows,
                  round(avg(case when score % 7 > 1 and label=prediction
                                 then 1.0 else 0.0 end), 6) as Accuracy
           from scored_models group by Model""",
    ),
    "precision_recall_f1": (
        precision_recall_f1,
        f"""select Model, Precision_Churn, Recall_Churn, F1_Churn
            from (select Model, {SQL_METRICS} from {_COUNTED}) m""",
    ),
    "weighted_f1": (
        weighted_f1,
        f"select Model, Weighted_F1 from (select Model, {SQL_METRICS} from {_COUNTED}) m",
    ),
    "roc_auc": (
        roc_auc,
        f"select round(auc, 9) as ROC_AUC from ({sql_auc('scored', '', 'score')}) a",
    ),
    "roc_auc_odd_scores": (
        roc_auc_odd_scores,
        f"select Model, round(auc, 9) as ROC_AUC from ({sql_auc(_ODD, 'Model', 'odd')}) a",
    ),
    "model_metrics": (model_metrics, "select * from model_metrics"),
    "metric_table": (
        metric_table,
        """select Model, rows as Dataset_Rows, cast(0 as bigint) as Training_Rows,
                  rows as Testing_Rows, 21 as Feature_Count, Accuracy, Precision_Churn,
                  Recall_Churn, F1_Churn, Weighted_F1, ROC_AUC, True_Negatives,
                  False_Positives, False_Negatives, True_Positives,
                  0.0::double as Prediction_Throughput_Rows_Per_Second
           from model_metrics""",
    ),
    "best_model": (
        best_model,
        " union all ".join(
            f"""select * from (select '{m}' as measure, Model, {m} as value
                from model_metrics
                order by {m} desc, list_position({list(RULE_NAMES)}, Model) limit 1)"""
            for m in ("Accuracy", "ROC_AUC", "F1_Churn")
        ),
    ),
    "prediction_summary": (
        prediction_summary,
        """select case when prediction=1 then 'Churn' else 'No Churn' end prediction_result,
                  count(*) as rows from scored group by 1""",
    ),
    "prediction_totals": (
        prediction_totals,
        """select count(*) as total_rows,
                  count(*) filter (where prediction=0) as predicted_no_churn,
                  count(*) filter (where prediction=1) as predicted_churn,
                  round(count(*) filter (where prediction=1) * 100.0 / count(*), 2)
                    as churn_percentage
           from scored""",
    ),
}
