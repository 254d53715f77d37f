"""Clusters, RFM scores and segment reports."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tidemark.functions.frames import with_one_row
from tidemark.functions.money import money_sum
from tidemark.operators.intervals import best_centers, best_errors
from tidemark.operators.revenue import known_customers
from tidemark.session import materialize

# Cluster names, segment names and the score above which each starts.
CLUSTER_NAMES = {0: "Low", 1: "Mid", 2: "High"}
SEGMENT_ABOVE = {"Mid-Value": 2, "High-Value": 4}
LOWEST_SEGMENT = "Low-Value"

# Number of clusters per RFM measure, and the measures whose best customers
# have the *smallest* value.
RFM_K = 4
RFM_DESCENDING = ("Recency",)
RFM_MEASURES = ("Recency", "Frequency", "Revenue")

# Fixed value: the usual stopping rule of k-means, as a share of the variance.
TOLERANCE = 1e-4

POINTS_PER_TASK = 100_000
STARTS = 3


def rfm_measures(tx: DataFrame) -> DataFrame:
    """Recency in whole days, number of lines and revenue per customer, in one aggregate.

    Recency runs to the latest purchase of *any* customer and counts full 24-hour days.
    """
    per_customer = known_customers(tx).groupBy("CustomerID").agg(
        F.max("InvoiceDate").alias("_last"),
        F.count("InvoiceDate").alias("Frequency"),
        money_sum(F.col("UnitPrice") * F.col("Quantity")).alias("Revenue"),
    )
    return _recency(per_customer).select("CustomerID", "Recency", "Frequency", "Revenue")


def _recency(per_customer: DataFrame) -> DataFrame:
    """Days from each customer's last purchase to the last one of all.

    The maximum comes from the customers, who are written once, not from the lines again.
    """
    per_customer = materialize(per_customer, "last-purchases")
    latest = with_one_row(per_customer, per_customer.agg(F.max("_last").alias("_latest")))
    days = F.timestamp_diff("DAY", F.col("_last"), F.col("_latest"))
    return latest.withColumn("Recency", days)


def recency(tx: DataFrame) -> DataFrame:
    tx = known_customers(tx)
    per_customer = tx.groupBy("CustomerID").agg(F.max("InvoiceDate").alias("_last"))
    return _recency(per_customer).select("CustomerID", "Recency")


def frequency(tx: DataFrame) -> DataFrame:
    """Lines per customer (not invoices)."""
    return known_customers(tx).groupBy("CustomerID").agg(F.count("InvoiceDate").alias("Frequency"))


def monetary(tx: DataFrame) -> DataFrame:
    revenue = money_sum(F.col("UnitPrice") * F.col("Quantity"))
    return known_customers(tx).groupBy("CustomerID").agg(revenue.alias("Revenue"))


@contextmanager
def _weighted_points(df: DataFrame, cols: Sequence[str]) -> Iterator[tuple[DataFrame, float]]:
    """Distinct points with their multiplicity, and their mean variance.

    The same clustering from far fewer rows.  Points are laid out by their values, in as many
    partitions as their number deserves, so a seed gives the same fit whatever the partitions
    of ``df``; they are cached while the fits run.
    """
    points = df.dropna(subset=list(cols)).groupBy(*cols).agg(F.count(F.lit(1)).cast("double").alias("_weight"))
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    laid = None
    try:
        n = points.count()
        ordered = points.repartition(1 + n // POINTS_PER_TASK, *cols).sortWithinPartitions(*cols)
        laid = VectorAssembler(inputCols=list(cols), outputCol="_features").transform(ordered)
        laid = laid.persist(StorageLevel.MEMORY_AND_DISK)
        weight = F.col("_weight")
        means = laid.agg(*[F.try_divide(F.sum(F.col(c) * weight), F.sum(weight)) for c in cols]).first()
        spread = [F.sum(F.pow(F.col(c) - F.lit(float(m or 0.0)), 2) * weight) for c, m in zip(cols, means)]
        squares = laid.agg(F.sum(weight), *spread).first()
        yield laid, sum(v or 0.0 for v in squares[1:]) / (squares[0] or 1.0) / len(cols)
    finally:
        points.unpersist()
        if laid is not None:
            laid.unpersist()


def _best_fit(points: DataFrame, k: int, seed: int, max_iter: int, variance: float) -> KMeansModel:
    """The fit with the lowest cost of ``STARTS`` starts, the first one on a tie."""
    # Stop when all centres together move less than TOLERANCE of the variance, whatever
    # the unit of the column.
    step = max(TOLERANCE * variance / k, 0.0) ** 0.5
    fits = [
        KMeans(k=k, seed=seed + i, maxIter=max_iter, tol=step, featuresCol="_features", weightCol="_weight").fit(points)
        for i in range(STARTS)
    ]
    return min(fits, key=lambda fit: fit.summary.trainingCost)


def kmeans_centers(df: DataFrame, col: str, k: int) -> list[float]:
    """The centres of the best k clusters of one column, in ascending order; exact, so there is no seed."""
    return best_centers(df, col, k)


def assign_to_centers(df: DataFrame, col: str, centers: Sequence[float], label: str) -> DataFrame:
    """Labels each row with the position of the nearest centre; the first one wins a tie."""
    if not centers:
        return df.withColumn(label, F.lit(None).cast("int"))
    distance = [F.abs(F.col(col).cast("double") - F.lit(float(c))) for c in centers]
    nearest = F.least(*distance) if len(distance) > 1 else distance[0]
    choice = reduce(
        lambda chain, i: chain.when(distance[i] == nearest, i),
        range(1, len(centers)),
        F.when(distance[0] == nearest, 0),
    )
    return df.withColumn(label, choice)


def kmeans_1d(df: DataFrame, col: str, k: int, label: str, centers: Sequence[float] | None = None) -> DataFrame:
    """One-column k-means; with ``centers`` given nothing is fitted."""
    if centers is None:
        centers = kmeans_centers(df, col, k)
    return assign_to_centers(df, col, centers, label)


def order_cluster(df: DataFrame, cluster: str, target: str, ascending: bool = True) -> DataFrame:
    """Renumbers clusters 0 … k-1 by their mean ``target``; equal means keep the old order.

    The k cluster means travel as one scalar array, so the customers are not shuffled.
    """
    means = (
        df.dropna(subset=[cluster])
        .groupBy(cluster)
        .agg(F.avg(F.col(target).cast("double")).alias("_mean"))
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct((F.col("_mean") if ascending else -F.col("_mean")).alias("m"), F.col(cluster).alias("c"))
                )
            ).alias("_ranked")
        )
    )
    ranked = with_one_row(df, means)
    rank = F.array_position(F.transform("_ranked", lambda s: s["c"]), F.col(cluster)) - 1
    return ranked.select(*[rank.cast("int").alias(c) if c == cluster else F.col(c) for c in df.columns])


def ordered_kmeans(
    df: DataFrame,
    col: str,
    k: int,
    label: str,
    order_by: str | None = None,
    ascending: bool = True,
    centers: Sequence[float] | None = None,
) -> DataFrame:
    """k-means on ``col`` with labels ranked by the mean of ``order_by`` (default: ``col`` itself).

    Reads ``df`` two or three times; pass a stored frame rather than a long computation.
    """
    if centers is None and order_by in (None, col):
        # In one dimension clusters are intervals: ranking the centres ranks the means.
        centers = kmeans_centers(df, col, k)
        return assign_to_centers(df, col, centers if ascending else centers[::-1], label)
    return order_cluster(kmeans_1d(df, col, k, label, centers), label, order_by or col, ascending)


def rfm_scores(tx: DataFrame, centers: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """RFM measures, their ordered clusters, the overall score (0–9) and the value segment."""
    scored = rfm_measures(tx)
    if centers is None:
        # Three fits and the scoring read the measures, the lines are read once.
        scored = materialize(scored, "rfm-measures")
        centers = {c: kmeans_centers(scored, c, RFM_K) for c in RFM_MEASURES}
    for col in RFM_MEASURES:
        # In one dimension clusters are intervals: ranking the centres ranks the means.
        ranked = sorted(centers[col], reverse=col in RFM_DESCENDING)
        scored = assign_to_centers(scored, col, ranked, f"{col}Cluster")
    total = reduce(lambda a, b: a + b, [F.col(f"{c}Cluster") for c in RFM_MEASURES])
    return scored.withColumn("OverallScore", total).withColumn("Segment", value_segment("OverallScore"))


def value_segment(score: str) -> Column:
    """Segment name of an overall score."""
    names = sorted(SEGMENT_ABOVE.items(), key=lambda item: -item[1])
    chain = reduce(
        lambda c, item: c.when(F.col(score) > item[1], item[0]),
        names[1:],
        F.when(F.col(score) > names[0][1], names[0][0]),
    )
    return chain.otherwise(LOWEST_SEGMENT)


def elbow(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(1, 10), seed: int = 0) -> DataFrame:
    """Within-cluster squared error for each k, fitted on the named columns only.

    One column gives the least error there is, for all k from one table; ``seed`` counts for
    several columns, whose clusters are searched for.
    """
    spark = df.sparkSession
    if len(cols) == 1:
        errors = best_errors(df, cols[0], max(ks))
        return spark.createDataFrame([(int(k), errors[k - 1]) for k in ks], "k int, inertia double")
    with _weighted_points(df, cols) as (points, variance):
        # One centre is the mean: its error needs a single aggregate, no fit.
        w = F.col("_weight")
        mean_of = {c: F.sum(F.col(c) * w) / F.sum(w) for c in cols}
        centre = points.agg(*[m.alias(c) for c, m in mean_of.items()]).first()
        rows = []
        for k in ks:
            if k == 1:
                square = reduce(lambda a, b: a + b, [F.pow(F.col(c) - F.lit(float(centre[c])), 2) for c in cols])
                rows.append((1, float(points.agg(F.sum(square * w)).first()[0])))
            else:
                rows.append((int(k), float(_best_fit(points, k, seed, 1000, variance).summary.trainingCost)))
    return spark.createDataFrame(rows, "k int, inertia double")


def label_clusters(
    df: DataFrame, cluster: str, names: Mapping[int, str] = CLUSTER_NAMES, output: str | None = None
) -> DataFrame:
    """Replaces cluster numbers by names; numbers without a name become their own text."""
    number = F.col(cluster)
    items = list(names.items())
    chain = reduce(lambda c, kv: c.when(number == kv[0], kv[1]), items[1:], F.when(number == items[0][0], items[0][1]))
    return df.withColumn(output or cluster, chain.otherwise(number.cast("string")))


def segment_profile(
    df: DataFrame, by: str, cols: Sequence[str], sort_by: str | None = None
) -> DataFrame:
    """Mean of several columns per segment, optionally sorted by one of them."""
    profile = df.dropna(subset=[by]).groupBy(by).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])
    return profile.orderBy(sort_by) if sort_by else profile


def segment_points(
    df: DataFrame, x: str, y: str, below: Mapping[str, float] | None = None, segment: str = "Segment"
) -> DataFrame:
    """(segment, x, y) of all rows strictly below the given caps: the data of a scatter plot."""
    for col, cap in (below or {}).items():
        df = df.where(F.col(col) < cap)
    return df.select(segment, x, y)
