"""Churn rates and churn features of subscribers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.segments import label_clusters, ordered_kmeans

# The columns compared one by one, the grouped numeric columns.
OTHER_CATEGORIES = (
    "Partner",
    "PhoneService",
    "MultipleLines",
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "StreamingTV",
    "StreamingMovies",
    "PaperlessBilling",
)
GROUPED_COLUMNS = {
    "tenure": "TenureCluster",
    "MonthlyCharges": "MonthlyChargesCluster",
    "TotalCharges": "TotalChargesCluster",
}


def churn_flag(df: DataFrame, col: str = "Churn") -> DataFrame:
    """Yes/No to 1/0; anything else stays unknown (null)."""
    return df.withColumn(col, F.when(F.col(col) == "Yes", 1).when(F.col(col) == "No", 0))


def rate_by_category(df: DataFrame, category: str, label: str = "Churn") -> DataFrame:
    """Mean label and number of labelled rows per category."""
    return (
        df.dropna(subset=[category])
        .groupBy(category)
        .agg(F.avg(F.col(label).cast("double")).alias("mean"), F.count(label).alias("count"))
    )


def rate_by_categories(df: DataFrame, cols: Sequence[str] = OTHER_CATEGORIES, label: str = "Churn") -> DataFrame:
    """:func:`rate_by_category` for many columns in a single scan."""
    texts = df.select(F.col(label).alias("_label"), *[F.col(c).cast("string").alias(c) for c in cols])
    return (
        texts.unpivot("_label", list(cols), "feature", "value")
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.avg(F.col("_label").cast("double")).alias("mean"), F.count("_label").alias("count"))
    )


def rate_by_numeric(df: DataFrame, col: str, label: str = "Churn", bins: str | None = None) -> DataFrame:
    """Mean label per exact value, or per value cut to a whole number with ``bins='int'``."""
    if bins not in (None, "int"):
        raise ValueError("bins must be None or 'int'")
    name = col if bins is None else f"{col}Bin"
    value = F.col(col) if bins is None else F.col(col).cast("bigint")
    return (
        df.dropna(subset=[col])
        .groupBy(value.alias(name))
        .agg(F.avg(F.col(label).cast("double")).alias("mean"))
    )


def rate_by_parsed(df: DataFrame, col: str, label: str = "Churn") -> DataFrame:
    """:func:`rate_by_numeric` on a text column: rows with a null anywhere, or with text that
    is not a number, are left out, the rest is cut to whole numbers."""
    parsed = df.withColumn("_parsed", F.col(col).try_cast("double")).dropna()
    return rate_by_numeric(parsed.drop(col).withColumnRenamed("_parsed", col), col, label, "int")


def numeric_groups(
    df: DataFrame,
    columns: Mapping[str, str] = GROUPED_COLUMNS,
    k: int = 3,
    order_by: str | None = "tenure",
    centers: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """A Low/Mid/High group per numeric column.

    The clusters of *every* column are ranked by their mean tenure by default, as the
    original analysis does; ``order_by=None`` ranks each by its own column.
    """
    for col, name in columns.items():
        fixed = centers.get(col) if centers else None
        df = label_clusters(ordered_kmeans(df, col, k, name, order_by, True, fixed), name)
    return df
