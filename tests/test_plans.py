import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_unit
from tidemark.operators import retention, revenue
from tidemark.plans import business, sales


def shop(spark):
    start = dt.datetime(2010, 11, 15)
    lines = [
        (c, start + dt.timedelta(days=31 * m), 1.0 + c % 3, 2.0, "UK" if c % 4 else "FR")
        for c in range(12)
        for m in range(6)
        if (c + m) % 3
    ]
    return spark.createDataFrame(lines, "CustomerID long, InvoiceDate timestamp_ntz, Quantity double, UnitPrice double, Country string")


def test_growth_reports(spark):
    reports = business.growth_reports(shop(spark), "UK", last_month=201104)
    for name, report in reports.items():
        assert report.count() > 0, name
    assert reports["retention"].where("RetentionRate + ChurnRate <> 1").count() == 0
    assert reports["monthly_revenue"].where("InvoiceYearMonth >= 201104").count() == 0
    cohort = reports["cohort"].collect()
    shares = {(r.StartPeriod, r.Offset): r.RetentionRate for r in cohort}
    assert all(shares[s, o] >= shares[s, o + 1] for s, o in shares if (s, o + 1) in shares)


def test_reports_from_stored_activity(spark, table):
    tx = shop(spark)
    direct = retention.monthly_retention(revenue.with_revenue(tx))
    assert table(retention.monthly_retention(business.stored_activity(tx))) == table(direct)


def test_forecast_follows_a_seasonal_pattern(spark):
    """Sales that repeat every year are predicted from the change a year before."""
    days = spark.sql("select explode(sequence(date'2010-01-01', date'2014-12-01', interval 1 month)) as date")
    level = 1000 + 10 * F.month("date") * F.month("date") + F.when(F.month("date") % 2 == 0, 50).otherwise(0)
    stores = days.withColumn("store", F.explode(F.array(F.lit(1), F.lit(2))))
    data = stores.withColumn("sales", level.cast("double") * F.col("store") + hash_unit(F.col("date").cast("string"), "n"))
    for series in ((), ("store",)):
        report = sales.forecast_report(data, series).where("pred_value is not null").collect()
        assert len(report) == (12 if series else 6)
        for r in report:
            assert r.pred_value == pytest.approx(r.sales, rel=0.02)
