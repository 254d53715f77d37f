"""Churn: clean the subscribers, encode them, explain and predict churn."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tidemark.operators import churn, features, models, sampling
from tidemark.plans.value import Scored
from tidemark.session import materialize

ID = "customerID"
LABEL = "Churn"


def clean_subscribers(subscribers: DataFrame) -> DataFrame:
    """Total charges as a number, taken from the monthly charges where they are missing."""
    parsed = features.parse_numeric(subscribers, "TotalCharges")
    return features.fill_from(parsed, "TotalCharges", "MonthlyCharges")


def model_table(
    cleaned: DataFrame,
    centers: Mapping[str, Sequence[float]] | None = None,
    drop_first: bool = False,
) -> DataFrame:
    """Grouped and encoded subscribers with model-safe column names; ``cleaned`` should be stored."""
    grouped = materialize(churn.numeric_groups(cleaned, centers=centers), "grouped")
    return features.sanitize_columns(features.encode_categoricals(grouped, ID, drop_first=drop_first))


def feature_columns(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c not in (ID, LABEL, "is_train")]


def explain_churn(table: DataFrame) -> DataFrame:
    """Logistic regression summary, with all levels of the categories as the original analysis has them."""
    return models.logistic_summary(table, LABEL, feature_columns(table))


def predict_churn(table: DataFrame, test_share: float = 0.05, seed: int = 56, rounds: int = 100) -> Scored:
    """Churn probability of every subscriber."""
    split = materialize(sampling.train_test_split(table, ID, test_share, seed), "churn-split")
    model = models.train_binary(split.where("is_train"), LABEL, feature_columns(split), rounds)
    return Scored(model, models.score(split, model), LABEL)
