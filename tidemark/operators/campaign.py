"""Promotion campaigns: conversion by group, uplift over the control group, uplift targeting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import over_groups, with_one_row
from tidemark.operators.churn import rate_by_category
from tidemark.operators.quantiles import exact_quantiles

# Offer names, average order value, class numbers.
CONTROL = "No Offer"
DISCOUNT = "Discount"
BOGO = "Buy One Get One"
ORDER_VALUE = 25.0
CONTROL_NON_RESPONDER, CONTROL_RESPONDER, TREATED_NON_RESPONDER, TREATED_RESPONDER = 0, 1, 2, 3
CLASS_PROBABILITIES = ("proba_CN", "proba_CR", "proba_TN", "proba_TR")


def _rates(df: DataFrame, targets: Sequence[str], control: str, offer: str) -> DataFrame:
    """Size and mean of each target per offer, with the control group's means alongside."""
    means = [F.avg(F.col(t).cast("double")).alias(f"rate_{t}") for t in targets]
    by_offer = df.dropna(subset=[offer]).groupBy(offer).agg(F.count(F.lit(1)).alias("customers"), *means)
    # One row per offer from here on.
    all_offers = over_groups([])
    base = {
        f"base_{t}": F.max(F.when(F.col(offer) == control, F.col(f"rate_{t}"))).over(all_offers) for t in targets
    }
    return by_offer.withColumns(base).withColumn("population", F.sum("customers").over(all_offers))


def campaign_uplift(
    df: DataFrame,
    target: str = "conversion",
    control: str = CONTROL,
    order_value: float = ORDER_VALUE,
    offer: str = "offer",
) -> DataFrame:
    """Conversion, order and revenue uplift of each offer over the control group.

    An offer nobody received has no row; without control rows the uplift is null.
    """
    uplift = F.col(f"rate_{target}") - F.col(f"base_{target}")
    orders = uplift * F.col("customers")
    return (
        _rates(df, [target], control, offer)
        .where(F.col(offer) != control)
        .select(
            offer,
            "customers",
            uplift.alias("conversion_uplift"),
            orders.alias("order_uplift"),
            (orders * order_value).alias("revenue_uplift"),
            F.try_divide(orders * order_value, F.col("customers")).alias("revenue_per_target"),
        )
    )


def offer_from_dummies(df: DataFrame, prefix: str = "offer_") -> DataFrame:
    """Turns one-hot offer columns back into one ``offer`` column."""
    dummies = [c for c in df.columns if c.startswith(prefix)]
    names = [F.when(F.col(f"`{c}`") == 1, c[len(prefix) :]) for c in dummies]
    return df.withColumn("offer", F.coalesce(*names)).drop(*dummies)


def scored_uptick(
    scored: DataFrame,
    targets: Sequence[str] = ("conversion", "proba"),
    control: str = CONTROL,
    order_value: float = ORDER_VALUE,
    offer: str = "offer",
) -> DataFrame:
    """:func:`campaign_uplift` for several targets (real and predicted) in one pass."""
    return _uptick(scored, targets, control, order_value, offer, "customers")


def population_uptick(
    scored: DataFrame,
    targets: Sequence[str] = ("conversion", "proba"),
    control: str = CONTROL,
    order_value: float = ORDER_VALUE,
    offer: str = "offer",
) -> DataFrame:
    """The variant that multiplies by *all* scored customers instead of the offer's own."""
    return _uptick(scored, targets, control, order_value, offer, "population")


def _uptick(scored, targets, control, order_value, offer, size) -> DataFrame:
    per_target = [
        F.struct(
            F.lit(t).alias("target"),
            (F.col(f"rate_{t}") - F.col(f"base_{t}")).alias("conversion_uplift"),
        )
        for t in targets
    ]
    rows = (
        _rates(scored, targets, control, offer)
        .where(F.col(offer) != control)
        .select(offer, F.col(size).alias("customers"), F.explode(F.array(*per_target)).alias("t"))
    )
    orders = F.col("t.conversion_uplift") * F.col("customers")
    return rows.select(
        offer,
        "t.target",
        "customers",
        "t.conversion_uplift",
        orders.alias("order_uplift"),
        (orders * order_value).alias("revenue_uplift"),
    )


def conversion_by(df: DataFrame, key: str, target: str = "conversion") -> DataFrame:
    """Mean conversion and rows per value of one column, in value order."""
    return rate_by_category(df, key, target).orderBy(key)


def overall_conversion(df: DataFrame, target: str = "conversion") -> DataFrame:
    return df.agg(F.avg(F.col(target).cast("double")).alias("mean"), F.count(target).alias("count"))


def conversion_by_keys(
    df: DataFrame, keys: Sequence[str] = ("used_discount", "used_bogo", "offer"), target: str = "conversion"
) -> DataFrame:
    """Mean conversion per combination of keys that occurs."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.avg(F.col(target).cast("double")).alias("mean"))


def cluster_profile(
    df: DataFrame, cluster: str = "history_cluster", value: str = "history", target: str = "conversion"
) -> DataFrame:
    """Spread of the clustered value, and size and mean of the target, per cluster."""
    number = F.col(value).cast("double")
    return df.dropna(subset=[cluster]).groupBy(cluster).agg(
        F.avg(number).alias(f"{value}_mean"),
        F.min(number).alias(f"{value}_min"),
        F.max(number).alias(f"{value}_max"),
        F.count(target).alias(f"{target}_count"),
        F.avg(F.col(target).cast("double")).alias(f"{target}_mean"),
    )


def calibration_by_group(
    scored: DataFrame, by: str = "offer", actual: str = "conversion", predicted: str = "proba"
) -> DataFrame:
    """Mean actual and mean predicted per group, plus one ``(all)`` row."""
    means = scored.rollup(by).agg(
        F.grouping(by).alias("_all"),
        F.avg(F.col(actual).cast("double")).alias("actual"),
        F.avg(F.col(predicted).cast("double")).alias("predicted"),
        F.count(F.lit(1)).alias("rows"),
    )
    named = F.when(F.col("_all") == 1, F.lit("(all)")).otherwise(F.col(by))
    return means.where((F.col("_all") == 1) | F.col(by).isNotNull()).select(
        named.alias(by), "actual", "predicted", "rows"
    )


def campaign_group(df: DataFrame, control: str = CONTROL) -> DataFrame:
    """Treatment unless the offer is the control; a missing offer is not the control."""
    is_control = F.coalesce(F.col("offer") == control, F.lit(False))
    return df.withColumn("campaign_group", F.when(is_control, "control").otherwise("treatment"))


def target_class(df: DataFrame) -> DataFrame:
    """The four responder classes; needs ``campaign_group``."""
    control = F.col("campaign_group") == "control"
    responded = F.col("conversion") > 0
    return df.withColumn(
        "target_class",
        F.when(control & responded, CONTROL_RESPONDER)
        .when(~control & responded, TREATED_RESPONDER)
        .when(~control & (F.col("conversion") == 0), TREATED_NON_RESPONDER)
        .otherwise(CONTROL_NON_RESPONDER),
    )


def uplift_score(scored: DataFrame, names: Sequence[str] = CLASS_PROBABILITIES) -> DataFrame:
    """Probability of the two classes worth an offer minus that of the other two."""
    cn, cr, tn, tr = (F.col(n) for n in names)
    return scored.withColumn("uplift_score", cn + tr - tn - cr)


def attach_scores(df: DataFrame, scored: DataFrame, id_col: str, columns: Sequence[str] = ("uplift_score",)) -> DataFrame:
    """Brings scores back to the full table by id."""
    return df.join(scored.select(id_col, *columns), id_col, "left")


def mean_score_by_offer(scored: DataFrame, score: str = "uplift_score", offer: str = "offer") -> DataFrame:
    return (
        scored.dropna(subset=[offer])
        .groupBy(offer)
        .agg(F.avg(score).alias(score))
    )


def quantile_target(
    scored: DataFrame, q: float, side: str, score: str = "uplift_score", exclude: str | None = BOGO, offer: str = "offer"
) -> DataFrame:
    """Customers strictly above (``high``) or below (``low``) a score quantile.

    The quantile is that of *all* scored customers; the excluded offer leaves afterwards.
    """
    if side not in ("high", "low"):
        raise ValueError("side must be 'high' or 'low'")
    cut = exact_quantiles(scored, score, {"cut": q}).scalar()
    chosen = scored.where(F.col(score) > cut if side == "high" else F.col(score) < cut)
    return chosen if exclude is None else chosen.where(F.col(offer) != exclude)


def quantile_targeting(scored: DataFrame, q: float, side: str, exclude: str | None = BOGO, **options) -> DataFrame:
    """Uplift of the offer among the targeted customers, with the size of the target group."""
    target = quantile_target(scored, q, side, exclude=exclude)
    uplift = campaign_uplift(target, **options)
    return with_one_row(uplift, target.agg(F.count(F.lit(1)).alias("group_size")))


def heldout_targeting(scored: DataFrame, test_ids: DataFrame, id_col: str, q: float, side: str, **options) -> DataFrame:
    """:func:`quantile_targeting` on held-out customers only, with their own quantile."""
    return quantile_targeting(scored.join(test_ids.select(id_col), id_col, "left_semi"), q, side, **options)
