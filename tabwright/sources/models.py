"""Stored models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    GBTClassificationModel,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)

# The names under which the four models are stored.
LOADERS = {
    "Logistic_Regression": LogisticRegressionModel,
    "Decision_Tree": DecisionTreeClassificationModel,
    "Random_Forest": RandomForestClassificationModel,
    "Gradient_Boosted_Tree": GBTClassificationModel,
}


def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(name: str, path: str):
    if name not in LOADERS:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(LOADERS)}")
    return LOADERS[name].load(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
