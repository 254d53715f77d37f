"""Business metrics of a shop, one frame per report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators import lifecycle, retention, revenue
from tidemark.session import materialize


def growth_reports(tx: DataFrame, country: str | None = None, last_month: int | None = None) -> dict[str, DataFrame]:
    """Revenue, activity, new customers, retention and cohorts.

    ``last_month`` cuts the partial month at the end from the growth and retention reports.
    """
    tx = revenue.with_revenue(tx)
    local = revenue.for_country(tx, country)
    cohort = retention.streak_cohort(local)

    def complete(report: DataFrame) -> DataFrame:
        return revenue.between_periods(report, before=last_month)

    return {
        "monthly_revenue": complete(revenue.monthly_revenue(tx)),
        "top_countries": revenue.top_countries(tx),
        "active_customers": complete(revenue.monthly_active_customers(local)),
        "quantity": complete(revenue.monthly_quantity(local)),
        "average_revenue": complete(revenue.monthly_average_revenue(local)),
        "revenue_by_user_type": complete(lifecycle.revenue_by_user_type(local)),
        "new_customer_ratio": complete(lifecycle.new_customer_ratio(local)),
        "retention": complete(retention.churn_rate(local)),
        "cohort": cohort,
        "nth_month_retention": retention.nth_month_retention(cohort),
    }


def stored_activity(tx: DataFrame) -> DataFrame:
    """(customer, month) pairs written once: input enough for all retention and cohort reports."""
    return materialize(retention.activity(revenue.with_revenue(tx)), "activity")
