"""Sums that do not depend on the order of the rows."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.money import exact_sum, money_sum
from tidemark.operators import forecast, revenue


def test_small_amounts_with_enough_digits(spark):
    df = spark.range(1000).select(F.lit(0.00004).alias("x"))
    assert df.agg(money_sum("x", digits=6).alias("s")).first()["s"] == pytest.approx(0.04)


def test_large_amounts_and_refunds(rows):
    df = rows([(1e15,), (2.5e15,), (-1e15,), (0.25,), (None,)], "x double")
    assert float(df.agg(exact_sum("x").alias("s")).first()["s"]) == 2.5e15 + 0.25
    refunds = rows([(-0.5,), (-12345.6789,), (0.1,), (0.2,)], "x double")
    assert refunds.agg(money_sum("x").alias("s")).first()["s"] == -12345.8789


def test_quantities_and_sales_are_not_rounded(rows):
    tx = rows([(201101, "UK", 0.00002, 1.0)] * 5, "InvoiceYearMonth int, Country string, Quantity double, UnitPrice double")
    assert revenue.monthly_quantity(tx).first()["Quantity"] == pytest.approx(0.0001)
    sales = rows([("2011-01-05", 0.00002), ("2011-01-09", 0.00002)], "date string, sales double")
    found = forecast.resample_month(sales.withColumn("date", F.to_date("date"))).first()
    assert found["sales"] == pytest.approx(0.00004)
