"""Customer lifetime value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.money import money_sum
from tidemark.operators.quantiles import trim_upper
from tidemark.operators.revenue import known_customers
from tidemark.operators.segments import kmeans_1d, ordered_kmeans

# The quantile above which customers are outliers, the number of segments.
OUTLIER_QUANTILE = 0.99
LTV_K = 3


def in_window(tx: DataFrame, start: str, stop: str, ts: str = "InvoiceDate") -> DataFrame:
    """Lines in ``[start, stop)``.  The predicate is on the raw column, so files can be skipped."""
    kind = tx.schema[ts].dataType.simpleString()
    return tx.where((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.lit(stop).cast(kind)))


def observation_windows(
    tx: DataFrame, features: tuple[str, str], outcome: tuple[str, str]
) -> tuple[DataFrame, DataFrame]:
    """The lines features are computed from, and the later lines the outcome is computed from."""
    return in_window(tx, *features), in_window(tx, *outcome)


def future_revenue(tx: DataFrame, output: str = "m6_Revenue") -> DataFrame:
    """Revenue per customer in the outcome window; without cost data this is the lifetime value."""
    revenue = money_sum(F.col("UnitPrice") * F.col("Quantity"))
    return known_customers(tx).groupBy("CustomerID").agg(revenue.alias(output))


def ltv_table(rfm: DataFrame, future: DataFrame) -> DataFrame:
    """RFM rows with their future revenue; customers without one, and any other gap, get 0."""
    return rfm.join(future, "CustomerID", "left").fillna(0)


def ltv_clusters(
    table: DataFrame,
    col: str = "m6_Revenue",
    k: int = LTV_K,
    centers: Sequence[float] | None = None,
    q: float = OUTLIER_QUANTILE,
) -> DataFrame:
    """Outliers removed, then clusters of the outcome in ascending order of value."""
    trimmed = trim_upper(table, col, q)
    if centers is not None:
        # Known centres in ascending order need no ranking pass.
        return kmeans_1d(trimmed, col, k, "LTVCluster", centers=sorted(centers))
    return ordered_kmeans(trimmed, col, k, "LTVCluster")
