"""Retention, churn and cohorts.

All functions start from the distinct (customer, period) pairs, one shuffle after a
map-side distinct.  Per-customer windows then see at most one row per period.  What
leaves the customer level is a table of period pairs, a few thousand rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import over_groups, round_half_even
from tidemark.functions.periods import code_to_index, index_to_code
from tidemark.operators.revenue import MONTH, known_customers
from tidemark.session import materialize


def activity(tx: DataFrame) -> DataFrame:
    """Distinct (customer, period): active means any line in the period, whatever its amount."""
    return known_customers(tx, ["CustomerID", MONTH]).select("CustomerID", MONTH).distinct()


def activity_matrix(tx: DataFrame, periods: Sequence[int], prefix: str = "m_") -> DataFrame:
    """0/1 per customer and listed period; the list is given so the columns are known up front."""
    flags = [F.max((F.col(MONTH) == p).cast("int")).alias(f"{prefix}{p}") for p in periods]
    return known_customers(tx, ["CustomerID", MONTH]).groupBy("CustomerID").agg(*flags)


def period_list(active: DataFrame, period: str = MONTH) -> list[int]:
    """The periods that occur, for matrices with a column per period; as many as the calendar has."""
    return [r[0] for r in active.select(period).where(F.col(period).isNotNull()).distinct().orderBy(period).collect()]


def present_periods(active: DataFrame) -> DataFrame:
    """The periods that occur, numbered 0, 1, 2 … without gaps."""
    number = F.row_number().over(over_groups([], [MONTH])) - 1
    return active.select(MONTH).distinct().withColumn("idx", number)


def _numbered(active: DataFrame, calendar: bool, grain: str) -> DataFrame:
    """Active pairs with a period number: by calendar, or by rank among present periods."""
    if calendar:
        return active.withColumn("idx", code_to_index(MONTH, grain))
    # One row per period that has data, so broadcasting it is safe at any number of customers.
    return active.join(F.broadcast(present_periods(active)), MONTH)


def monthly_retention(
    tx: DataFrame,
    skip_first: bool = True,
    denominator: str = "current",
    calendar: bool = False,
    grain: str = "month",
) -> DataFrame:
    """Customers active in a period and in the one before.

    By default "before" is the previous period *with data*, the first period of the data
    is left out altogether, and the rate divides by the current period's customers; with
    ``denominator='previous'`` it divides by the previous period's customers.
    """
    if denominator not in ("current", "previous"):
        raise ValueError("denominator must be 'current' or 'previous'")
    last_seen = F.lag(MONTH).over(Window.partitionBy("CustomerID").orderBy(MONTH))
    pairs = (
        activity(tx)
        .withColumn("LastSeen", last_seen)
        .groupBy(MONTH, "LastSeen")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # From here on there are at most periods x periods rows.
    before = Window.partitionBy(F.lit(1)).orderBy(MONTH).rangeBetween(Window.unboundedPreceding, -1)
    periods = (
        pairs.withColumn("PreviousPeriod", F.max(MONTH).over(before))
        .groupBy(MONTH, "PreviousPeriod")
        .agg(
            F.sum("n").alias("TotalUserCount"),
            F.sum(F.when(F.col("LastSeen") == F.col("PreviousPeriod"), F.col("n")).otherwise(0)).alias("Retained"),
        )
    )
    in_order = over_groups([], [MONTH])
    adjacent = F.lit(True)
    if calendar:
        adjacent = code_to_index("PreviousPeriod", grain) == code_to_index(MONTH, grain) - 1
    retained = F.when(adjacent, F.col("Retained")).otherwise(0).cast("bigint")
    previous = F.when(adjacent, F.lag("TotalUserCount").over(in_order))
    base = F.col("TotalUserCount") if denominator == "current" else previous
    return (
        periods.withColumns(
            {
                "Position": F.row_number().over(in_order),
                "RetainedUserCount": retained,
                "RetentionRate": F.try_divide(retained.cast("double"), base),
            }
        )
        .where(F.col("Position") >= (3 if skip_first else 2))
        .select(MONTH, "TotalUserCount", "RetainedUserCount", "RetentionRate")
    )


def churn_rate(tx: DataFrame, **options) -> DataFrame:
    """One minus the retention rate; takes the options of :func:`monthly_retention`."""
    return monthly_retention(tx, **options).withColumn("ChurnRate", 1 - F.col("RetentionRate"))


def streak_cohort(
    tx: DataFrame, skip_first: bool = True, calendar: bool = False, grain: str = "month"
) -> DataFrame:
    """Share of a period's customers active in *every* period since, in long form.

    ``Offset`` 0 is the start period itself (share 1).  Each customer's periods fall into
    unbroken runs; somebody at ``r`` periods before the end of a run survives offsets
    0 … r, so one count per (start, r) and a running total from the far end is enough.
    The (customer, period) pairs are stored once, so the lines are read once.
    """
    active = materialize(activity(tx), "activity")
    numbered = _numbered(active, calendar, grain)
    by_customer = Window.partitionBy("CustomerID").orderBy("idx")
    run = numbered.withColumn("run", F.col("idx") - F.row_number().over(by_customer))
    left = F.max("idx").over(Window.partitionBy("CustomerID", "run")) - F.col("idx")
    ends = run.withColumn("left", left).groupBy("idx", MONTH, "left").agg(F.count(F.lit(1)).alias("n"))

    # Period level.  Between two observed run ends the number of survivors is constant;
    # behind the last one it is zero up to the end of the data.
    of_start = Window.partitionBy("idx")
    everything = over_groups([])
    ends = ends.withColumns(
        {
            "alive": F.sum("n").over(of_start.orderBy(F.desc("left"))),
            "TotalUserCount": F.sum("n").over(of_start),
            "since": F.coalesce(F.lag("left").over(of_start.orderBy("left")) + 1, F.lit(0)),
            "longest": F.max("left").over(of_start),
            "first": F.min("idx").over(everything),
            "last": F.max("idx").over(everything) - F.col("idx"),
        }
    )
    if skip_first:
        ends = ends.where(F.col("idx") > F.col("first"))
    # The longest run also stands for the offsets behind it.
    stop = F.when(F.col("left") == F.col("longest"), F.col("last")).otherwise(F.col("left"))
    table = ends.withColumn("Offset", F.explode(F.sequence(F.col("since"), stop)))
    survivors = F.when(F.col("Offset") <= F.col("left"), F.col("alive")).otherwise(0)
    table = table.withColumns({"survivors": survivors, "later": F.col("idx") + F.col("Offset")})
    if calendar:
        named = table.withColumn("Period", index_to_code("later", grain))
    else:
        later = present_periods(active).select(F.col("idx").alias("later"), F.col(MONTH).alias("Period"))
        named = table.join(F.broadcast(later), "later")
    share = round_half_even(F.col("survivors") / F.col("TotalUserCount"), 2)
    return named.select(
        F.col(MONTH).alias("StartPeriod"), "Period", "Offset", "TotalUserCount", share.alias("RetentionRate")
    )


def streak_matrix(cohort: DataFrame, periods: Sequence[int]) -> DataFrame:
    """:func:`streak_cohort` as a triangle, one column per listed period."""
    return (
        cohort.groupBy("StartPeriod", "TotalUserCount")
        .pivot("Period", list(periods))
        .agg(F.first("RetentionRate"))
    )


def nth_month_retention(cohort: DataFrame, n: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """The n-th diagonal of the cohort triangle as a column ``n_month_retention``.

    Starts too close to the end of the data for a diagonal have null there; the last
    start has none at all and is left out.
    """
    wanted = [
        F.max(F.when(F.col("Offset") == i, F.col("RetentionRate"))).alias(f"{i}_month_retention") for i in n
    ]
    return cohort.where(F.col("Offset").isin(list(n))).groupBy("StartPeriod").agg(*wanted)


def first_purchase_cohort(tx: DataFrame, grain: str = "month") -> DataFrame:
    """Customers by period of first purchase: the share active k periods later, streak or not."""
    idx = code_to_index(MONTH, grain)
    first = F.min("idx").over(Window.partitionBy("CustomerID"))
    aged = activity(tx).withColumn("idx", idx).withColumn("first", first)
    counts = aged.groupBy("first", (F.col("idx") - F.col("first")).cast("bigint").alias("Offset")).agg(
        F.count(F.lit(1)).alias("ActiveCustomers")
    )
    size = F.max(F.when(F.col("Offset") == 0, F.col("ActiveCustomers"))).over(Window.partitionBy("first"))
    return counts.select(
        index_to_code("first", grain).alias("CohortPeriod"),
        "Offset",
        "ActiveCustomers",
        size.alias("CohortSize"),
        (F.col("ActiveCustomers") / size).alias("ActiveShare"),
    )
