"""New and existing customers, activation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import join_per_key
from tidemark.functions.money import exact_sum
from tidemark.functions.periods import period_code
from tidemark.operators.revenue import MONTH, known_customers
from tidemark.session import materialize

# Labels of the two customer types.
NEW, EXISTING = "New", "Existing"


def first_purchase(tx: DataFrame, grain: str = "month") -> DataFrame:
    """First purchase of each customer."""
    first = known_customers(tx).groupBy("CustomerID").agg(F.min("InvoiceDate").alias("MinPurchaseDate"))
    return first.withColumn("MinPurchaseYearMonth", period_code("MinPurchaseDate", grain))


def label_user_type(tx: DataFrame, grain: str = "month") -> DataFrame:
    """Every line with its customer's first purchase and New/Existing.

    This keeps the lines, so it has to bring them together with their customer; hot
    customers are spread.  The reports below never need it, they work on
    :func:`customer_periods`.
    """
    lines = known_customers(tx)
    first = lines.groupBy("CustomerID").agg(
        F.min("InvoiceDate").alias("MinPurchaseDate"), F.count(F.lit(1)).alias("_lines")
    )
    first = materialize(first.withColumn("MinPurchaseYearMonth", period_code("MinPurchaseDate", grain)), "first-purchase")
    labelled = join_per_key(lines, first, ["CustomerID"], "_lines")
    is_later = F.col(MONTH) > F.col("MinPurchaseYearMonth")
    return labelled.withColumn("UserType", F.when(is_later, EXISTING).otherwise(NEW))


def customer_periods(tx: DataFrame) -> DataFrame:
    """Lines, revenue and user type per (customer, month).

    The aggregate shrinks a customer to at most one row per month before anything is
    partitioned by customer, so a customer with a third of all lines is no larger than
    any other.  All measures are sums, so months can be added up again exactly.
    """
    has_revenue = "Revenue" in tx.columns
    revenue = exact_sum("Revenue") if has_revenue else F.lit(None).cast("decimal(28,4)")
    per_month = known_customers(tx).groupBy("CustomerID", MONTH).agg(
        F.count(F.lit(1)).alias("Lines"), revenue.alias("Revenue")
    )
    first = F.min(MONTH).over(Window.partitionBy("CustomerID"))
    return per_month.withColumn("UserType", F.when(F.col(MONTH) > first, EXISTING).otherwise(NEW))


def user_type_counts(tx: DataFrame) -> DataFrame:
    """Number of lines per user type."""
    return customer_periods(tx).groupBy("UserType").agg(F.sum("Lines").alias("count"))


def revenue_by_user_type(tx: DataFrame, exclude: Sequence[int] = ()) -> DataFrame:
    """Revenue per month and user type without the (partial) months in ``exclude``."""
    report = customer_periods(tx)
    if exclude:
        report = report.where(~F.col(MONTH).isin(list(exclude)))
    return report.groupBy(MONTH, "UserType").agg(F.sum("Revenue").cast("double").alias("Revenue"))


def user_type_customers(tx: DataFrame) -> DataFrame:
    """Customers per month and user type, one row per month."""
    # One row per (customer, month) already: counting rows counts distinct customers.
    return customer_periods(tx).groupBy(MONTH).agg(
        F.count_if(F.col("UserType") == NEW).alias("NewCustomers"),
        F.count_if(F.col("UserType") == EXISTING).alias("ExistingCustomers"),
    )


def new_customer_ratio(tx: DataFrame, over: str = "existing") -> DataFrame:
    """New customers divided by existing (default) or by all; months lacking either side drop out."""
    if over not in ("existing", "total"):
        raise ValueError("over must be 'existing' or 'total'")
    counts = user_type_customers(tx).where((F.col("NewCustomers") > 0) & (F.col("ExistingCustomers") > 0))
    base = F.col("ExistingCustomers")
    if over == "total":
        base = base + F.col("NewCustomers")
    return counts.select(MONTH, (F.col("NewCustomers") / base).alias("NewCustomerRatio"))


def activation_rate(signups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of sign-ups that made their first purchase in the sign-up period.

    A period (or period and channel) in which nobody did has a null rate, not zero.
    """
    activated = F.count_if(F.col("MinPurchasePeriod") == F.col("SignupPeriod"))
    keys = ["SignupPeriod", *by]
    return (
        signups.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.nullif(activated, F.lit(0)).alias("Activated"), F.count("CustomerID").alias("SignedUp"))
        .select(*keys, F.try_divide(F.col("Activated").cast("double"), F.col("SignedUp")).alias("ActivationRate"))
    )


def activation_rate_by_channel(
    signups: DataFrame, after: int | None = None, before: int | None = None, channel: str | None = None
) -> DataFrame:
    """Activation per sign-up period and channel, for periods strictly inside ``(after, before)``."""
    if after is not None:
        signups = signups.where(F.col("SignupPeriod") > after)
    if before is not None:
        signups = signups.where(F.col("SignupPeriod") < before)
    if channel is not None:
        signups = signups.where(F.col("AcqChannel") == channel)
    return activation_rate(signups, ["AcqChannel"])
