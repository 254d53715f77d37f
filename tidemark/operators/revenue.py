"""Monthly business metrics on invoice lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import growth
from tidemark.functions.money import exact_sum, money_avg, money_sum
from tidemark.functions.periods import period_code

MONTH = "InvoiceYearMonth"


def with_revenue(tx: DataFrame, grain: str = "month") -> DataFrame:
    """Adds the period code and the revenue of each line."""
    return tx.withColumns(
        {MONTH: period_code("InvoiceDate", grain), "Revenue": F.col("UnitPrice") * F.col("Quantity")}
    )


def for_country(tx: DataFrame, country: str | None) -> DataFrame:
    return tx if country is None else tx.where(F.col("Country") == country)


def between_periods(
    df: DataFrame, after: int | None = None, before: int | None = None, period: str = MONTH
) -> DataFrame:
    """Keeps periods strictly inside ``(after, before)``; reports use it to cut partial months."""
    if after is not None:
        df = df.where(F.col(period) > after)
    if before is not None:
        df = df.where(F.col(period) < before)
    return df


def monthly_revenue(tx: DataFrame) -> DataFrame:
    """Revenue per month and its growth against the previous month that has data."""
    monthly = tx.groupBy(MONTH).agg(money_sum("Revenue").alias("Revenue"))
    return monthly.withColumn("MonthlyGrowth", growth("Revenue", MONTH))


def top_countries(tx: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` countries with the most revenue, amounts cut to whole units."""
    exact = tx.groupBy("Country").agg(exact_sum("Revenue").alias("total"))
    best = exact.where(F.col("Country").isNotNull()).orderBy(F.desc("total"), "Country").limit(n)
    return best.select("Country", F.col("total").cast("bigint").alias("Revenue"))


def monthly_active_customers(tx: DataFrame, country: str | None = None) -> DataFrame:
    """Distinct customers per month and the change against the previous present month."""
    # Two steps in the plan: pairs are made distinct where they are read, then counted.
    monthly = for_country(tx, country).groupBy(MONTH).agg(F.count_distinct("CustomerID").alias("ActiveCustomers"))
    return monthly.withColumn("pct_change", growth("ActiveCustomers", MONTH))


def monthly_quantity(tx: DataFrame, country: str | None = None) -> DataFrame:
    """Units sold per month (reported as "orders" in the original analysis)."""
    monthly = for_country(tx, country).groupBy(MONTH).agg(F.sum(F.col("Quantity").cast("double")).alias("Quantity"))
    return monthly.withColumn("pct_change", growth("Quantity", MONTH))


def monthly_invoices(tx: DataFrame, country: str | None = None) -> DataFrame:
    """Distinct invoices per month: what "number of orders" means literally."""
    monthly = for_country(tx, country).groupBy(MONTH).agg(F.count_distinct("InvoiceNo").alias("Invoices"))
    return monthly.withColumn("pct_change", growth("Invoices", MONTH))


def monthly_average_revenue(tx: DataFrame, country: str | None = None, per: str = "line") -> DataFrame:
    """Mean revenue per invoice line (default) or per invoice."""
    tx = for_country(tx, country)
    if per == "line":
        value = money_avg("Revenue")
    elif per == "invoice":
        value = F.try_divide(money_sum("Revenue"), F.count_distinct("InvoiceNo").cast("double"))
    else:
        raise ValueError("per must be 'line' or 'invoice'")
    return tx.groupBy(MONTH).agg(value.alias("AverageRevenue"))


def known_customers(tx: DataFrame, keys: Sequence[str] = ("CustomerID",)) -> DataFrame:
    """Drops lines without a customer, which no customer-level figure may count."""
    return tx.dropna(subset=list(keys))
