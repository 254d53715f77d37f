"""Monthly metrics, customer types, activation, retention and cohorts on small fixtures."""

import datetime as dt
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import lifecycle, retention, revenue

SCHEMA = "CustomerID long, InvoiceDate timestamp_ntz, Quantity double, UnitPrice double, Country string, InvoiceNo string"


def line(customer, day, quantity=1.0, price=1.0, country="X", invoice="a"):
    return (customer, dt.datetime.fromisoformat(day), quantity, price, country, invoice)


@pytest.fixture
def tx(rows):
    return lambda *lines: revenue.with_revenue(rows(list(lines), SCHEMA))


def month_gap():
    return [line(c, f"{m}-05") for c, m in [(1, "2010-11"), (1, "2010-12"), (1, "2011-02"), (2, "2010-12"), (2, "2011-02")]]


def test_growth_uses_the_previous_present_month(tx, table):
    report = revenue.monthly_revenue(tx(*month_gap()))
    assert table(report) == [(201011, 1.0, None), (201012, 2.0, 1.0), (201102, 2.0, 0.0)]


def test_growth_after_a_month_without_revenue_is_unknown(tx, table):
    report = revenue.monthly_revenue(tx(line(1, "2011-01-01", price=0.0), line(1, "2011-02-01")))
    assert table(report) == [(201101, 0.0, None), (201102, 1.0, None)]


def test_three_digit_prices_are_summed_exactly(tx):
    report = revenue.monthly_revenue(tx(*[line(1, "2011-01-01", price=0.001) for _ in range(10)]))
    assert report.first()["Revenue"] == 0.01


def test_lines_without_customer_count_in_totals_only(tx, table):
    data = tx(line(None, "2011-01-01", 5.0), line(1, "2011-01-02", 2.0))
    assert table(revenue.monthly_quantity(data), "Quantity") == [(7.0,)]
    assert table(revenue.monthly_average_revenue(data), "AverageRevenue") == [(3.5,)]
    assert table(revenue.monthly_active_customers(data), "ActiveCustomers") == [(1,)]
    assert table(lifecycle.revenue_by_user_type(data), "Revenue") == [(2.0,)]
    assert lifecycle.first_purchase(data).count() == 1
    assert lifecycle.label_user_type(data).count() == 1


def test_top_countries_cuts_amounts_and_breaks_ties_by_name(tx, table):
    data = tx(
        line(1, "2011-01-01", price=2.9, country="B"),
        line(1, "2011-01-01", price=2.9, country="A"),
        line(1, "2011-01-01", price=-1.9, country="C"),
    )
    assert [tuple(r) for r in revenue.top_countries(data, 2).collect()] == [("A", 2), ("B", 2)]
    assert revenue.top_countries(data, 3).collect()[2]["Revenue"] == -1


def test_average_per_invoice_differs_from_average_per_line(tx):
    data = tx(line(1, "2011-01-01", invoice="a"), line(1, "2011-01-01", 3.0, invoice="a"), line(1, "2011-01-02", 2.0, invoice="b"))
    assert revenue.monthly_average_revenue(data).first()["AverageRevenue"] == 2.0
    assert revenue.monthly_average_revenue(data, per="invoice").first()["AverageRevenue"] == 3.0
    assert revenue.monthly_invoices(data).first()["Invoices"] == 2


def test_ratio_needs_both_sides(tx, table):
    # January: only new. February: both. March: only existing.
    data = tx(line(1, "2011-01-01"), line(1, "2011-02-01"), line(2, "2011-02-01"), line(2, "2011-03-01"))
    assert table(lifecycle.new_customer_ratio(data)) == [(201102, 1.0)]
    assert table(lifecycle.new_customer_ratio(data, over="total")) == [(201102, 0.5)]
    assert table(lifecycle.user_type_customers(data)) == [(201101, 1, 0), (201102, 1, 1), (201103, 0, 1)]


def test_counts_by_type_equal_the_labelled_lines(tx, table):
    data = tx(line(1, "2011-01-01"), line(1, "2011-01-20"), line(1, "2011-02-01"), line(2, "2011-02-01"))
    labelled = lifecycle.label_user_type(data).groupBy("UserType").count()
    assert table(labelled) == table(lifecycle.user_type_counts(data)) == [("Existing", 1), ("New", 3)]


def test_activation(rows, table):
    data = rows(
        [(1, 201101, 201101, "a"), (2, 201102, 201101, "a"), (3, None, 201101, "b"), (4, 201103, 201102, "b")],
        "CustomerID long, MinPurchasePeriod int, SignupPeriod int, AcqChannel string",
    )
    assert table(lifecycle.activation_rate(data)) == [(201101, 1 / 3), (201102, None)]
    by_channel = lifecycle.activation_rate_by_channel(data, after=201100, before=201102)
    assert table(by_channel) == [(201101, "a", 0.5), (201101, "b", None)]


def test_negative_revenue_is_activity(tx, table):
    data = tx(line(1, "2011-01-01", -5.0), line(1, "2011-01-02", 1.0))
    assert table(retention.activity(data)) == [(1, 201101)]


def test_activity_matrix(tx, table):
    matrix = retention.activity_matrix(tx(*month_gap()), [201011, 201012, 201102])
    assert table(matrix) == [(1, 1, 1, 1), (2, 0, 1, 1)]


def test_retention_skips_the_first_month_and_bridges_gaps(tx, table):
    data = tx(*month_gap())
    assert table(retention.monthly_retention(data)) == [(201102, 2, 2, 1.0)]
    everything = retention.monthly_retention(data, skip_first=False)
    assert table(everything) == [(201012, 2, 1, 0.5), (201102, 2, 2, 1.0)]
    previous = retention.monthly_retention(data, skip_first=False, denominator="previous")
    assert table(previous, "InvoiceYearMonth", "RetentionRate") == [(201012, 1.0), (201102, 1.0)]
    calendar = retention.monthly_retention(data, calendar=True)
    assert table(calendar) == [(201102, 2, 0, 0.0)]
    assert retention.churn_rate(data).first()["ChurnRate"] == 0.0


def streaks():
    active = {1: (1, 2, 3), 2: (1, 3), 3: (2, 3), 4: (3,)}
    return [line(c, f"2011-0{m}-01") for c, months in active.items() for m in months]


def test_streak_cohort_is_not_the_first_purchase_cohort(tx, table):
    cohort = retention.streak_cohort(tx(*streaks()))
    assert table(cohort, "StartPeriod", "Period", "Offset", "TotalUserCount", "RetentionRate") == [
        (201102, 201102, 0, 2, 1.0),
        (201102, 201103, 1, 2, 1.0),
        (201103, 201103, 0, 4, 1.0),
    ]
    with_first = retention.streak_cohort(tx(*streaks()), skip_first=False)
    january = with_first.where("StartPeriod = 201101").select("Offset", "RetentionRate")
    assert table(january) == [(0, 1.0), (1, 0.5), (2, 0.5)]
    first = retention.first_purchase_cohort(tx(*streaks())).where("CohortPeriod = 201101")
    assert table(first, "Offset", "ActiveShare") == [(0, 1.0), (1, 0.5), (2, 1.0)]


def test_streak_offsets_nobody_ends_on_are_filled(tx, table):
    # Everybody who survives survives to the end: no run ends at offsets 0 and 1.
    data = tx(*[line(1, f"2011-0{m}-01") for m in (1, 2, 3)])
    cohort = retention.streak_cohort(data, skip_first=False).where("StartPeriod = 201101")
    assert table(cohort, "Offset", "RetentionRate") == [(0, 1.0), (1, 1.0), (2, 1.0)]


def test_nth_month_crosses_the_year_end(tx, table):
    data = tx(*[line(1, d) for d in ("2010-11-01", "2010-12-01", "2011-01-01")])
    nth = retention.nth_month_retention(retention.streak_cohort(data, skip_first=False), (1, 2))
    assert table(nth) == [(201011, 1.0, 1.0), (201012, 1.0, None)]


def test_streak_matrix(tx, table):
    matrix = retention.streak_matrix(retention.streak_cohort(tx(*streaks())), [201102, 201103])
    assert table(matrix) == [(201102, 2, 1.0, 1.0), (201103, 4, None, 1.0)]


def definition_of_streaks(active, periods):
    """Straight from the definition: active in every period from the start on."""
    result = {}
    for i, start in enumerate(periods):
        base = [c for c, months in active.items() if start in months]
        for j in range(i, len(periods)):
            alive = [c for c in base if set(periods[i : j + 1]) <= active[c]]
            result[start, periods[j]] = float(np.round(len(alive) / len(base), 2))
    return result


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(1, 8), st.integers(1, 9)), min_size=3, max_size=40))
def test_streaks_and_retention_equal_their_definitions(spark, pairs):
    data = spark.createDataFrame(sorted((c, 201100 + m) for c, m in pairs), "CustomerID long, InvoiceYearMonth int")
    active = defaultdict(set)
    for c, m in pairs:
        active[c].add(201100 + m)
    periods = sorted({201100 + m for _, m in pairs})
    got = {(r.StartPeriod, r.Period): r.RetentionRate for r in retention.streak_cohort(data, skip_first=False).collect()}
    assert got == definition_of_streaks(active, periods)
    rates = {
        r.InvoiceYearMonth: (r.TotalUserCount, r.RetainedUserCount)
        for r in retention.monthly_retention(data, skip_first=False).collect()
    }
    want = {
        now: (sum(now in a for a in active.values()), sum(now in a and before in a for a in active.values()))
        for before, now in zip(periods, periods[1:])
    }
    assert rates == want


@pytest.mark.parametrize("grain", ["year", "quarter", "month", "day"])
def test_period_index_has_no_gaps_and_an_inverse(spark, grain):
    from tidemark.functions.periods import code_to_index, index_to_code, period_code

    days = spark.sql("select explode(sequence(date'2009-12-25', date'2012-01-05', interval 1 day)) as d")
    coded = days.withColumn("code", period_code("d", grain)).withColumn("i", code_to_index("code", grain))
    back = coded.where(index_to_code("i", grain) != F.col("code"))
    assert back.count() == 0
    distinct = coded.agg(F.count_distinct("i"), F.max("i") - F.min("i") + 1).first()
    assert distinct[0] == distinct[1]
