"""Layouts of the result tables, and how a frame is brought into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StructType,
)

from tabwright.functions.columns import int_via_double

# Column names and their order in the published result tables.
METRIC_COLUMNS = (
    "Model string, Dataset_Rows bigint, Training_Rows bigint, Testing_Rows bigint, "
    "Feature_Count int, Accuracy double, Precision_Churn double, Recall_Churn double, "
    "F1_Churn double, Weighted_F1 double, ROC_AUC double, True_Negatives bigint, "
    "False_Positives bigint, False_Negatives bigint, True_Positives bigint, "
    "Training_Time_Seconds double, Prediction_Time_Seconds double, "
    "Prediction_Throughput_Rows_Per_Second double"
)
TRIAL_COLUMNS = (
    "Scale_Factor int, Model string, Trial int, Base_Dataset_Rows bigint, "
    "Synthetic_Total_Rows bigint, Training_Rows bigint, Testing_Rows bigint, "
    "Feature_Count int, Training_Time_Seconds double, Prediction_Time_Seconds double, "
    "Training_Throughput_Rows_Per_Second double, "
    "Prediction_Throughput_Rows_Per_Second double"
)
QUALITY_COLUMNS = (
    "Accuracy double, Precision_Churn double, Recall_Churn double, F1_Churn double, "
    "Weighted_F1 double, ROC_AUC double, True_Negatives bigint, "
    "False_Positives bigint, False_Negatives bigint, True_Positives bigint"
)
TRIAL_STORE_COLUMNS = TRIAL_COLUMNS + ", " + QUALITY_COLUMNS
#: A store may hold several runs: each row names its run and the input it was made from.
RUN_STORE_COLUMNS = TRIAL_STORE_COLUMNS + ", Run_Id string, Input string"
SUMMARY_COLUMNS = (
    "Scale_Factor int, Model string, Trials bigint, Base_Dataset_Rows bigint, "
    "Synthetic_Total_Rows bigint, Training_Rows bigint, Testing_Rows bigint, "
    "Feature_Count int, " + QUALITY_COLUMNS + ", "
    "Training_Time_Run_1 double, Training_Time_Run_2 double, "
    "Training_Time_Run_3 double, Mean_Training_Time_Seconds double, "
    "Std_Training_Time_Seconds double, Prediction_Time_Run_1 double, "
    "Prediction_Time_Run_2 double, Prediction_Time_Run_3 double, "
    "Mean_Prediction_Time_Seconds double, Std_Prediction_Time_Seconds double, "
    "Mean_Training_Throughput_Rows_Per_Second double, "
    "Std_Training_Throughput_Rows_Per_Second double, "
    "Mean_Prediction_Throughput_Rows_Per_Second double, "
    "Std_Prediction_Throughput_Rows_Per_Second double"
)


def schema_of(layout: str) -> StructType:
    return StructType.fromDDL(layout)


def names_of(layout: str) -> list[str]:
    return [column.split()[0] for column in layout.split(",")]


def conform(df: DataFrame, layout: str) -> DataFrame:
    """The columns of the layout in its order; a missing one becomes a typed NULL."""
    present = set(df.columns)

    def column(field) -> Column:
        source = F.col(field.name) if field.name in present else F.lit(None)
        return source.cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema_of(layout).fields])


def retype(df: DataFrame, layout: str) -> DataFrame:
    """Text columns to the types of the layout. Whole numbers may be written as
    '3.0'; malformed or empty text becomes NULL for the numeric gate to report."""

    def column(field) -> Column:
        text = F.col(field.name)
        if isinstance(field.dataType, (IntegerType, LongType)):
            text = int_via_double(text, field.dataType.simpleString())
        elif isinstance(field.dataType, DoubleType):
            text = text.try_cast("double")
        return text.alias(field.name)

    return df.select(*[column(f) for f in schema_of(layout).fields])


def empty(spark: SparkSession, layout: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(layout))
