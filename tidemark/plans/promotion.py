"""Promotion response and uplift targeting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidemark.operators import campaign, features, models, sampling, segments
from tidemark.operators.campaign import CLASS_PROBABILITIES
from tidemark.plans.value import Scored
from tidemark.session import materialize

# Number of history clusters, columns that tell the class.
HISTORY_K = 5
TELLS_CLASS = ("offer", "campaign_group", "conversion")


def predict_response(
    responses: DataFrame, id_col: str, test_share: float = 0.2, seed: int = 56, rounds: int = 100
) -> Scored:
    """Conversion probability of every customer; the offer is a feature.  Pass stored responses."""
    split = materialize(sampling.train_test_split(responses, id_col, test_share, seed), "response-split")
    encoded = features.one_hot(split, features.fit_categories(split))
    used = [c for c in encoded.columns if c not in (id_col, "conversion", "is_train")]
    model = models.train_binary(
        encoded.where("is_train"), "conversion", used, rounds, models.RESPONSE_DEPTH, models.RESPONSE_STEP
    )
    return Scored(model, models.score(encoded, model), "conversion")


def predict_uplift(
    responses: DataFrame,
    id_col: str,
    test_share: float = 0.2,
    seed: int = 56,
    centers: Sequence[float] | None = None,
) -> Scored:
    """Class probabilities and uplift score of every customer.  Pass stored responses."""
    labelled = campaign.target_class(campaign.campaign_group(responses))
    clustered = segments.ordered_kmeans(
        labelled, "history", HISTORY_K, "history_cluster", centers=centers
    ).drop(*TELLS_CLASS)
    split = materialize(sampling.train_test_split(clustered, id_col, test_share, seed), "uplift-split")
    encoded = features.one_hot(split, features.fit_categories(split))
    used = [c for c in encoded.columns if c not in (id_col, "target_class", "is_train")]
    model = models.train_multiclass(
        encoded.where("is_train"), "target_class", used, depth=models.RESPONSE_DEPTH, step=models.RESPONSE_STEP
    )
    scored = campaign.uplift_score(models.score_classes(encoded, model, CLASS_PROBABILITIES))
    return Scored(model, scored, "target_class")


def scored_responses(responses: DataFrame, scored: DataFrame, id_col: str) -> DataFrame:
    """Responses with their scores, stored: input of any number of reports."""
    both = responses.join(scored.select(id_col, "is_train", "uplift_score"), id_col)
    return materialize(both, "scored-responses")


def targeting_report(both: DataFrame, id_col: str, report: str) -> DataFrame:
    """One report on stored scored responses; nothing else is computed.

    ``benchmark`` and ``mean_score`` cover everybody; ``high`` and ``low`` the uplift of the
    discount among customers with high and low scores, ``unseen_…`` on unseen customers.
    """
    if report == "benchmark":
        return campaign.campaign_uplift(both.where(f"offer <> '{campaign.BOGO}'"))
    if report == "mean_score":
        return campaign.mean_score_by_offer(both)
    side = report.removeprefix("unseen_")
    share = {"high": 0.75, "low": 0.5}[side]
    if report == side:
        return campaign.quantile_targeting(both, share, side)
    return campaign.heldout_targeting(both, both.where("not is_train"), id_col, share, side)


REPORTS = ("benchmark", "mean_score", "high", "low", "unseen_high", "unseen_low")


def targeting_reports(responses: DataFrame, scored: DataFrame, id_col: str) -> dict[str, DataFrame]:
    """All reports; each quantile is computed at once."""
    both = scored_responses(responses, scored, id_col)
    return {report: targeting_report(both, id_col, report) for report in REPORTS}
