"""Customer lifetime value: observe, wait, cluster the outcome, predict it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.operators import evaluation, features, ltv, models, sampling, segments
from tidemark.operators.boosting import BoostedTrees
from tidemark.session import materialize

# What must not become a feature, because it is the id or tells the outcome.
NOT_FEATURES = ("CustomerID", "LTVCluster", "m6_Revenue", "is_train")


@dataclass(frozen=True)
class Scored:
    """A model together with the scored customers (``is_train`` says whom it has seen)."""

    model: BoostedTrees
    customers: DataFrame
    label: str

    def accuracy(self) -> DataFrame:
        return evaluation.accuracy(self.customers, self.label, by="is_train")

    def report(self) -> DataFrame:
        """Precision, recall and F1 on the customers the model has not seen."""
        return evaluation.classification_report(self.customers.where("not is_train"), self.label)

    def importance(self) -> DataFrame:
        return models.feature_importance(self.customers, self.model)


def ltv_table(
    tx: DataFrame,
    features_window: tuple[str, str],
    outcome_window: tuple[str, str],
    centers: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """RFM scores of the first window next to the revenue of the second."""
    observed, outcome = ltv.observation_windows(tx, features_window, outcome_window)
    return ltv.ltv_table(segments.rfm_scores(observed, centers), ltv.future_revenue(outcome))


def predict_ltv_cluster(clustered: DataFrame, test_share: float = 0.1, seed: int = 42) -> Scored:
    """Predicts the value cluster of every customer from the RFM features."""
    table = materialize(clustered, "ltv-clusters")
    split = sampling.train_test_split(features.one_hot(table), "CustomerID", test_share, seed)
    split = materialize(split, "ltv-split")
    used = [c for c in split.columns if c not in NOT_FEATURES]
    model = models.train_multiclass(split.where("is_train"), "LTVCluster", used)
    names = [f"proba_{i}" for i in range(ltv.LTV_K)]
    return Scored(model, models.score_classes(split, model, names), "LTVCluster")
