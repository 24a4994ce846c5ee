"""Quality of predictions, for any number of models at a time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.columns import position_in, result_text, safe_ratio

COUNTS = ("True_Negatives", "False_Positives", "False_Negatives", "True_Positives")

#: The published ratios, in their order.
RATIOS = (
    "Accuracy",
    "Precision_Churn",
    "Recall_Churn",
    "F1_Churn",
    "Weighted_F1",
    "ROC_AUC",
)


def _cell_counts(label: str, prediction: str) -> list[Column]:
    cells = [(0, 0), (0, 1), (1, 0), (1, 1)]
    return [
        F.count_if((F.col(label) == y) & (F.col(prediction) == p)).alias(name)
        for name, (y, p) in zip(COUNTS, cells)
    ]


def confusion(
    df: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """The four counts per group, in one pass with partial sums in each task."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), *_cell_counts(label, prediction)
    )


def with_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class, and weighted F1, from
    the four counts. Accuracy and the shares of weighted F1 are of all ``rows`` where
    the counts have them: a row outside the four cells is never right. A ratio whose
    denominator is 0 is 0.0."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    total = F.col("rows") if "rows" in counts.columns else tn + fp + fn + tp
    precision, recall = F.col("Precision_Churn"), F.col("Recall_Churn")
    negative_f1 = safe_ratio(2 * tn, 2 * tn + fp + fn)
    return (
        counts.withColumns(
            {
                "Accuracy": safe_ratio(tn + tp, total),
                "Precision_Churn": safe_ratio(tp, tp + fp),
                "Recall_Churn": safe_ratio(tp, tp + fn),
            }
        )
        .withColumn("F1_Churn", safe_ratio(2 * precision * recall, precision + recall))
        .withColumn(
            "Weighted_F1",
            safe_ratio(
                (tn + fp) * negative_f1 + (fn + tp) * F.col("F1_Churn"), total
            ),
        )
    )


def other_rows() -> Column:
    """Rows in none of the four cells: label or prediction is NULL or not 0 or 1."""
    return (F.col("rows") - sum(F.col(c) for c in COUNTS)).alias("other_rows")


def roc_auc(
    df: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    score: str = "raw_score",
) -> DataFrame:
    """Exact area under the ROC curve per group; NULL if a class is absent."""
    is_label = [F.count_if(F.col(label) == y).alias(n) for y, n in ((1, "_p"), (0, "_n"))]
    per_score = df.groupBy(*by, score).agg(*is_label)
    return _from_scores(per_score, by, score, []).select(*by, "ROC_AUC")


def metric_rows(
    df: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    prediction: str = "prediction",
    score: str = "raw_score",
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Counts, ratios and exact ROC-AUC per group from a single pass over the rows.
    ``sums`` names further columns to add up per group on the way."""
    sums = dict(sums or {})
    per_score = df.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("_p"),
        F.count_if(F.col(label) == 0).alias("_n"),
        F.count(F.lit(1)).alias("rows"),
        *_cell_counts(label, prediction),
        *[F.sum(c).alias(name) for name, c in sums.items()],
    )
    totals = _from_scores(per_score, by, score, ["rows", *COUNTS, *sums])
    return with_metrics(totals).select(
        *by,
        "rows",
        *sums,
        *[F.round(c, 6).alias(c) for c in RATIOS],
        *COUNTS,
    )


def _score_cuts(per_score: DataFrame, score: str, used: Sequence[str]) -> Column:
    """About as many scores as there are shuffle partitions, at even steps of all
    distinct scores: a quantile sketch that tasks fill from their part and merge. The
    condition names every column that the other use of ``per_score`` reads, so that
    both read one shuffle instead of two that differ in their columns."""
    count = int(per_score.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / count for i in range(1, count)] or [0.5]
    sketch = F.percentile_approx(score, steps, max(10_000, 50 * count))
    shared = F.max(F.xxhash64(*used)).isNotNull()
    return per_score.agg(F.when(shared, sketch).alias("cuts")).scalar()


def _from_scores(
    per_score: DataFrame, by: Sequence[str], score: str, sums: Sequence[str]
) -> DataFrame:
    """Area from positives and negatives per distinct score.

    A positive beats every negative with a lower score and half of those with its
    own. The distinct scores are cut into ranges of scores, each range is cumulated
    by its own task, and what a range adds to the area needs only two sums of the
    ranges below it. Where the cuts lie comes from a sketch of the scores, so a range
    is an expression: rows move once by score and once by range, and what moves after
    that is one row per range. A NULL score is below all others, NaN above them.
    """
    by = list(by)
    cuts = _score_cuts(per_score, score, [*by, "_p", "_n", *sums])
    below_score = F.filter("_cuts", lambda cut: cut < F.col(score))
    ranged = per_score.withColumn("_cuts", cuts).withColumn(
        "_range", F.coalesce(F.size(below_score), F.lit(0))
    )
    below = (
        Window.partitionBy(*by, "_range")
        .orderBy(score)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    lower = F.coalesce(F.sum("_n").over(below), F.lit(0)).cast("double")
    ranges = (
        ranged.withColumn("_won", F.col("_p") * (lower + F.col("_n") / 2))
        .groupBy(*by, "_range")
        .agg(*[F.sum(c).alias(c) for c in ("_won", "_p", "_n", *sums)])
    )
    earlier = (
        Window.partitionBy(*by)
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offset = F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("double")
    won = F.sum("_won")
    pairs = F.sum("_p").cast("double") * F.sum("_n")
    return (
        ranges.withColumn("_won", F.col("_won") + F.col("_p") * offset)
        .groupBy(*by)
        .agg(
            F.try_divide(won, pairs).alias("ROC_AUC"),
            *[F.sum(c).alias(c) for c in sums],
        )
    )


def best_models(
    metrics: DataFrame, models: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """(measure, Model, value): the best model of each measure; the earlier one in
    the list wins a tie."""
    place = position_in(F.col("Model"), models)
    ranked = metrics.filter(place > 0)
    best = ranked.agg(
        *[
            F.max_by(
                F.struct("Model", F.col(m).alias("value")), F.struct(F.col(m), -place)
            ).alias(m)
            for m in measures
        ]
    )
    rows = [
        F.struct(
            F.lit(m).alias("measure"),
            F.col(m)["Model"].alias("Model"),
            F.col(m)["value"].alias("value"),
        )
        for m in measures
    ]
    return best.select(F.inline(F.array(*rows)))


def in_model_order(df: DataFrame, models: Sequence[str], *then: str) -> DataFrame:
    return df.orderBy(position_in(F.col("Model"), models), *then)


def flat_scores(
    scored: DataFrame,
    positive: str = "Churn",
    negative: str = "No Churn",
    label: str = "label",
    keep: Sequence[str] = (),
) -> DataFrame:
    """The flat scored table. ``actual_label`` is there only if the input has a label;
    ``keep`` carries the key, so that a score can be joined to its row again."""
    probability = vector_to_array("probability")
    pair = scored.withColumns({"_no": probability[0], "_yes": probability[1]})
    return flat_columns(pair, "_no", "_yes", positive, negative, label, keep)


def flat_columns(
    df: DataFrame,
    no: str,
    yes: str,
    positive: str = "Churn",
    negative: str = "No Churn",
    label: str = "label",
    keep: Sequence[str] = (),
) -> DataFrame:
    actual = [F.col(label).cast("double").alias("actual_label")]
    return df.select(
        *keep,
        *(actual if label in df.columns else []),
        F.col("prediction").cast("double").alias("predicted_label"),
        result_text(F.col("prediction"), positive, negative).alias("prediction_result"),
        F.col(no).alias("probability_no_churn"),
        F.col(yes).alias("probability_churn"),
    )


def prediction_summary(flat: DataFrame) -> DataFrame:
    return (
        flat.groupBy("prediction_result")
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy("prediction_result")
    )


def prediction_totals(flat: DataFrame) -> DataFrame:
    """Total, predicted negatives and positives and their share, in one pass."""
    return flat.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("predicted_label") == 0).alias("predicted_no_churn"),
        F.count_if(F.col("predicted_label") == 1).alias("predicted_churn"),
    ).withColumn(
        "churn_percentage",
        F.round(safe_ratio(F.col("predicted_churn") * 100, F.col("total_rows")), 2),
    )
