"""Business metrics: M01 – M19."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import A, T, check, rounded
from tidemark.operators import lifecycle, retention, revenue
from tidemark.operators.revenue import MONTH
from tidemark.session import materialize, scratch_path
from tidemark.sources import csv
from tidemark.sources.star import signups, transactions

# The country of the country-level reports, and a month list for reports that cut partial months.
FOCUS = "NATION_2"
PARTIAL_MONTHS = (199501, 200108)
YEARS = list(range(1995, 2002))

CUSTOMER_MONTH = ("CustomerID", MONTH)


@check(
    "m01_read_transactions",
    f"WITH {T} SELECT CAST(InvoiceNo AS VARCHAR) AS InvoiceNo, CustomerID, Quantity, UnitPrice, InvoiceDate, Country FROM t",
)
def m01(spark, sf_dir):
    """Writes the lines in the retail file format, then reads that file."""
    lines = transactions(
        spark, sf_dir, ["InvoiceNo", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"]
    ).select(
        F.col("InvoiceNo").cast("string").alias("InvoiceNo"),
        F.lit("item").alias("StockCode"),
        F.lit("café").alias("Description"),
        "Quantity",
        "InvoiceDate",
        "UnitPrice",
        "CustomerID",
        "Country",
    )
    path = scratch_path(spark, "retail-csv")
    lines.write.options(
        header="true", timestampNTZFormat=csv.INVOICE_TIME_FORMAT, encoding=csv.INVOICE_ENCODING
    ).csv(path)
    return csv.read_transactions(spark, path).select(
        "InvoiceNo", "CustomerID", "Quantity", "UnitPrice", "InvoiceDate", "Country"
    )


@check(
    "m02_with_revenue",
    f"""WITH {T} SELECT InvoiceNo, LineNo, CustomerID, Quantity, UnitPrice, InvoiceDate, Country,
        m AS InvoiceYearMonth, Revenue FROM t""",
)
def m02(spark, sf_dir):
    return transactions(spark, sf_dir)


@check(
    "m03_monthly_revenue",
    f"""WITH {T}, g AS (SELECT m AS InvoiceYearMonth, CAST(sum(rev) AS DOUBLE) AS Revenue FROM t GROUP BY m)
    SELECT InvoiceYearMonth, Revenue,
      round(Revenue / lag(Revenue) OVER (ORDER BY InvoiceYearMonth) - 1, 6) AS MonthlyGrowth FROM g""",
)
def m03(spark, sf_dir):
    tx = transactions(spark, sf_dir, [MONTH, "Revenue"])
    return rounded(revenue.monthly_revenue(tx), 6, "MonthlyGrowth")


@check(
    "m03_monthly_revenue_complete_months",
    f"""WITH {T}, g AS (SELECT m AS InvoiceYearMonth, CAST(sum(rev) AS DOUBLE) AS Revenue FROM t GROUP BY m),
    h AS (SELECT InvoiceYearMonth, Revenue,
      round(Revenue / lag(Revenue) OVER (ORDER BY InvoiceYearMonth) - 1, 6) AS MonthlyGrowth FROM g)
    SELECT * FROM h WHERE InvoiceYearMonth < 200108""",
)
def m03_complete(spark, sf_dir):
    tx = transactions(spark, sf_dir, [MONTH, "Revenue"])
    return rounded(revenue.between_periods(revenue.monthly_revenue(tx), before=200108), 6, "MonthlyGrowth")


@check(
    "m04_top_countries",
    f"""WITH {T}, g AS (SELECT Country, sum(rev) AS total FROM t WHERE Country IS NOT NULL GROUP BY Country)
    SELECT Country, CAST(trunc(total) AS BIGINT) AS Revenue FROM g ORDER BY total DESC, Country LIMIT 5""",
)
def m04(spark, sf_dir):
    return revenue.top_countries(transactions(spark, sf_dir, ["Country", "Revenue"]))


def _active_sql(where: str = "") -> str:
    return f"""WITH {T}, g AS (
      SELECT m AS InvoiceYearMonth, count(DISTINCT CustomerID) AS ActiveCustomers FROM t {where} GROUP BY m)
    SELECT InvoiceYearMonth, ActiveCustomers,
      round(ActiveCustomers / lag(ActiveCustomers) OVER (ORDER BY InvoiceYearMonth) - 1, 6) AS pct_change FROM g"""


@check("m05_monthly_active_customers", _active_sql())
def m05(spark, sf_dir):
    return rounded(revenue.monthly_active_customers(transactions(spark, sf_dir, CUSTOMER_MONTH)), 6, "pct_change")


@check("m05_monthly_active_customers_of_country", _active_sql(f"WHERE Country = '{FOCUS}'"))
def m05_country(spark, sf_dir):
    tx = transactions(spark, sf_dir, [*CUSTOMER_MONTH, "Country"])
    return rounded(revenue.monthly_active_customers(tx, FOCUS), 6, "pct_change")


def _quantity_sql(where: str = "") -> str:
    return f"""WITH {T}, g AS (SELECT m AS InvoiceYearMonth, CAST(sum(q) AS DOUBLE) AS Quantity FROM t {where} GROUP BY m)
    SELECT InvoiceYearMonth, Quantity,
      round(Quantity / lag(Quantity) OVER (ORDER BY InvoiceYearMonth) - 1, 6) AS pct_change FROM g"""


@check("m06_monthly_quantity", _quantity_sql())
def m06(spark, sf_dir):
    return rounded(revenue.monthly_quantity(transactions(spark, sf_dir, [MONTH, "Quantity"])), 6, "pct_change")


@check("m06_monthly_quantity_of_country", _quantity_sql(f"WHERE Country = '{FOCUS}'"))
def m06_country(spark, sf_dir):
    tx = transactions(spark, sf_dir, [MONTH, "Quantity", "Country"])
    return rounded(revenue.monthly_quantity(tx, FOCUS), 6, "pct_change")


@check(
    "m06_monthly_invoices",
    f"""WITH {T}, g AS (SELECT m AS InvoiceYearMonth, count(DISTINCT InvoiceNo) AS Invoices FROM t GROUP BY m)
    SELECT InvoiceYearMonth, Invoices,
      round(Invoices / lag(Invoices) OVER (ORDER BY InvoiceYearMonth) - 1, 6) AS pct_change FROM g""",
)
def m06_invoices(spark, sf_dir):
    return rounded(revenue.monthly_invoices(transactions(spark, sf_dir, [MONTH, "InvoiceNo"])), 6, "pct_change")


@check(
    "m07_monthly_average_revenue",
    f"""WITH {T} SELECT m AS InvoiceYearMonth, round(CAST(sum(rev) AS DOUBLE) / count(rev), 6) AS AverageRevenue
    FROM t GROUP BY m""",
)
def m07(spark, sf_dir):
    tx = transactions(spark, sf_dir, [MONTH, "Revenue"])
    return rounded(revenue.monthly_average_revenue(tx), 6, "AverageRevenue")


@check(
    "m07_monthly_average_revenue_per_invoice",
    f"""WITH {T} SELECT m AS InvoiceYearMonth,
      round(CAST(sum(rev) AS DOUBLE) / count(DISTINCT InvoiceNo), 6) AS AverageRevenue
    FROM t WHERE Country = '{FOCUS}' GROUP BY m""",
)
def m07_invoice(spark, sf_dir):
    tx = transactions(spark, sf_dir, [MONTH, "Revenue", "InvoiceNo", "Country"])
    return rounded(revenue.monthly_average_revenue(tx, FOCUS, per="invoice"), 6, "AverageRevenue")


FIRST = """first AS (SELECT CustomerID, min(InvoiceDate) AS d, min(m) AS fm FROM t WHERE CustomerID IS NOT NULL GROUP BY CustomerID),
lab AS (SELECT t.*, d, fm, CASE WHEN m > fm THEN 'Existing' ELSE 'New' END AS UserType FROM t JOIN first USING (CustomerID))"""


@check("m08_first_purchase", f"WITH {T}, {FIRST} SELECT CustomerID, d AS MinPurchaseDate, fm AS MinPurchaseYearMonth FROM first")
def m08(spark, sf_dir):
    return lifecycle.first_purchase(transactions(spark, sf_dir, ["CustomerID", "InvoiceDate"]))


@check(
    "m09_label_user_type",
    f"""WITH {T}, {FIRST} SELECT InvoiceNo, LineNo, CustomerID, m AS InvoiceYearMonth, d AS MinPurchaseDate,
      fm AS MinPurchaseYearMonth, UserType FROM lab""",
)
def m09(spark, sf_dir):
    tx = transactions(spark, sf_dir, ["InvoiceNo", "LineNo", "CustomerID", "InvoiceDate", MONTH])
    return lifecycle.label_user_type(tx).drop("InvoiceDate")


@check("m09_user_type_counts", f"WITH {T}, {FIRST} SELECT UserType, count(*) AS count FROM lab GROUP BY UserType")
def m09_counts(spark, sf_dir):
    return lifecycle.user_type_counts(transactions(spark, sf_dir, CUSTOMER_MONTH))


@check(
    "m10_revenue_by_user_type",
    f"""WITH {T}, {FIRST} SELECT m AS InvoiceYearMonth, UserType, CAST(sum(rev) AS DOUBLE) AS Revenue
    FROM lab WHERE m NOT IN {PARTIAL_MONTHS} GROUP BY ALL""",
)
def m10(spark, sf_dir):
    tx = transactions(spark, sf_dir, ["CustomerID", MONTH, "Revenue"])
    return lifecycle.revenue_by_user_type(tx, PARTIAL_MONTHS)


BOTH = """counts AS (SELECT m AS InvoiceYearMonth, count(DISTINCT CustomerID) FILTER (UserType = 'New') AS n,
  count(DISTINCT CustomerID) FILTER (UserType = 'Existing') AS e FROM lab GROUP BY m)"""


@check(
    "m11_new_customer_ratio",
    f"""WITH {T}, {FIRST}, {BOTH} SELECT InvoiceYearMonth, round(n / e, 6) AS NewCustomerRatio FROM counts
    WHERE n > 0 AND e > 0 AND InvoiceYearMonth > 199501 AND InvoiceYearMonth < 200108""",
)
def m11(spark, sf_dir):
    ratio = lifecycle.new_customer_ratio(transactions(spark, sf_dir, CUSTOMER_MONTH))
    return rounded(revenue.between_periods(ratio, 199501, 200108), 6, "NewCustomerRatio")


@check(
    "m11_new_customer_share",
    f"""WITH {T}, {FIRST}, {BOTH} SELECT InvoiceYearMonth, round(n / (n + e), 6) AS NewCustomerRatio FROM counts
    WHERE n > 0 AND e > 0""",
)
def m11_share(spark, sf_dir):
    ratio = lifecycle.new_customer_ratio(transactions(spark, sf_dir, CUSTOMER_MONTH), over="total")
    return rounded(ratio, 6, "NewCustomerRatio")


@check(
    "m11_user_type_customers",
    f"WITH {T}, {FIRST}, {BOTH} SELECT InvoiceYearMonth, n AS NewCustomers, e AS ExistingCustomers FROM counts",
)
def m11_customers(spark, sf_dir):
    return lifecycle.user_type_customers(transactions(spark, sf_dir, CUSTOMER_MONTH))


def _activation_sql(keys: str, where: str = "") -> str:
    return f"""WITH {A} SELECT {keys},
      round(nullif(count(*) FILTER (MinPurchasePeriod = SignupPeriod), 0) / count(*), 6) AS ActivationRate
    FROM signup {where} GROUP BY {keys}"""


@check("m12_activation_rate", _activation_sql("SignupPeriod"))
def m12(spark, sf_dir):
    return rounded(lifecycle.activation_rate(signups(spark, sf_dir)), 6, "ActivationRate")


@check(
    "m13_activation_rate_by_channel",
    _activation_sql("SignupPeriod, AcqChannel", "WHERE SignupPeriod > 20240101 AND SignupPeriod < 20240128"),
)
def m13(spark, sf_dir):
    by_channel = lifecycle.activation_rate_by_channel(signups(spark, sf_dir), 20240101, 20240128)
    return rounded(by_channel, 6, "ActivationRate")


@check("m14_activity", f"WITH {T} SELECT DISTINCT CustomerID, m AS InvoiceYearMonth FROM t WHERE CustomerID IS NOT NULL")
def m14(spark, sf_dir):
    return retention.activity(transactions(spark, sf_dir, CUSTOMER_MONTH))


@check(
    "m14_activity_matrix_by_year",
    f"""WITH {T} SELECT CustomerID, {", ".join(f"CAST(max(CAST(m // 100 = {y} AS INTEGER)) AS INTEGER) AS m_{y}" for y in YEARS)}
    FROM t WHERE CustomerID IS NOT NULL GROUP BY CustomerID""",
)
def m14_matrix(spark, sf_dir):
    tx = transactions(spark, sf_dir, ["CustomerID", "InvoiceDate"]).select("CustomerID", F.year("InvoiceDate").alias(MONTH))
    return retention.activity_matrix(tx, retention.period_list(tx))


def _retention_sql(period: str, outer: str) -> str:
    """Present periods in order, the first two without a report."""
    return f"""WITH {T}, act AS (SELECT DISTINCT CustomerID, {period} AS p FROM t WHERE CustomerID IS NOT NULL),
    per AS (SELECT p, row_number() OVER (ORDER BY p) AS i, n FROM (SELECT p, count(*) AS n FROM act GROUP BY p)),
    ret AS (SELECT c.p AS InvoiceYearMonth, c.i, c.n AS TotalUserCount, b.n AS PreviousCount,
      (SELECT count(*) FROM act x JOIN act y ON x.CustomerID = y.CustomerID WHERE x.p = c.p AND y.p = b.p) AS RetainedUserCount
      FROM per c JOIN per b ON b.i = c.i - 1)
    {outer}"""


@check(
    "m15_monthly_retention",
    _retention_sql("m", """SELECT InvoiceYearMonth, CAST(TotalUserCount AS BIGINT) AS TotalUserCount, RetainedUserCount,
      round(RetainedUserCount / TotalUserCount, 6) AS RetentionRate FROM ret WHERE i >= 3"""),
)
def m15(spark, sf_dir):
    return rounded(retention.monthly_retention(transactions(spark, sf_dir, CUSTOMER_MONTH)), 6, "RetentionRate")


def quarterly(spark, sf_dir):
    return transactions(spark, sf_dir, ["CustomerID", "InvoiceDate"]).select(
        "CustomerID", (F.year("InvoiceDate") * 10 + F.quarter("InvoiceDate")).alias(MONTH)
    )


@check(
    "m15_quarterly_retention_over_previous",
    _retention_sql("qtr", """SELECT InvoiceYearMonth, CAST(TotalUserCount AS BIGINT) AS TotalUserCount, RetainedUserCount,
      round(RetainedUserCount / PreviousCount, 6) AS RetentionRate FROM ret"""),
)
def m15_previous(spark, sf_dir):
    report = retention.monthly_retention(
        quarterly(spark, sf_dir), skip_first=False, denominator="previous", calendar=True, grain="quarter"
    )
    return rounded(report, 6, "RetentionRate")


@check(
    "m16_churn_rate",
    _retention_sql("m", """SELECT InvoiceYearMonth, CAST(TotalUserCount AS BIGINT) AS TotalUserCount, RetainedUserCount,
      round(RetainedUserCount / TotalUserCount, 6) AS RetentionRate,
      round(1 - RetainedUserCount / TotalUserCount, 6) AS ChurnRate FROM ret WHERE i >= 3"""),
)
def m16(spark, sf_dir):
    return rounded(retention.churn_rate(transactions(spark, sf_dir, CUSTOMER_MONTH)), 6, "RetentionRate", "ChurnRate")


def _streak_sql(period: str, outer: str) -> str:
    """Survivors by definition: still active in each of the periods since the start."""
    return f"""WITH RECURSIVE {T}, act AS (SELECT DISTINCT CustomerID, {period} AS p FROM t WHERE CustomerID IS NOT NULL),
    per AS (SELECT p, row_number() OVER (ORDER BY p) AS i FROM (SELECT DISTINCT p FROM act)),
    ai AS (SELECT CustomerID, i FROM act JOIN per USING (p)),
    alive AS (
      SELECT CustomerID, i AS s, CAST(0 AS BIGINT) AS o FROM ai
      UNION ALL
      SELECT a.CustomerID, a.s, a.o + 1 FROM alive a JOIN ai ON ai.CustomerID = a.CustomerID AND ai.i = a.s + a.o + 1
    ),
    cnt AS (SELECT s, o, count(*) AS n FROM alive GROUP BY s, o),
    coh AS (
      SELECT st.p AS StartPeriod, la.p AS Period, la.i - st.i AS "Offset",
        (SELECT count(*) FROM ai WHERE ai.i = st.i) AS TotalUserCount, coalesce(n, 0) AS n
      FROM per st JOIN per la ON la.i >= st.i LEFT JOIN cnt ON s = st.i AND o = la.i - st.i WHERE st.i > 1
    ),
    cohort AS (SELECT StartPeriod, Period, "Offset", TotalUserCount,
      round_even(n / TotalUserCount * 100, 0) / 100 AS RetentionRate FROM coh)
    {outer}"""


@check(
    "m17_streak_cohort",
    _streak_sql("m", """SELECT StartPeriod, Period, CAST("Offset" AS INTEGER) AS "Offset", TotalUserCount, RetentionRate FROM cohort"""),
)
def m17(spark, sf_dir):
    cohort = retention.streak_cohort(transactions(spark, sf_dir, CUSTOMER_MONTH))
    return cohort.withColumn("Offset", F.col("Offset").cast("int"))


QUARTERS = [10 * y + q for y in YEARS for q in range(1, 5)][1:-1]


@check(
    "m17_streak_matrix_by_quarter",
    _streak_sql("qtr", f"""SELECT StartPeriod, TotalUserCount,
      {", ".join(f'max(RetentionRate) FILTER (Period = {q}) AS "{q}"' for q in QUARTERS)}
    FROM cohort GROUP BY ALL"""),
)
def m17_matrix(spark, sf_dir):
    cohort = retention.streak_cohort(quarterly(spark, sf_dir), calendar=True, grain="quarter")
    cohort = materialize(cohort, "cohort")
    return retention.streak_matrix(cohort, retention.period_list(cohort, "Period"))


def _nth_sql(period: str) -> str:
    columns = ", ".join(f'max(RetentionRate) FILTER ("Offset" = {i}) AS "{i}_month_retention"' for i in range(1, 5))
    return _streak_sql(period, f'SELECT StartPeriod, {columns} FROM cohort WHERE "Offset" BETWEEN 1 AND 4 GROUP BY ALL')


@check("m18_nth_month_retention", _nth_sql("m"))
def m18(spark, sf_dir):
    return retention.nth_month_retention(retention.streak_cohort(transactions(spark, sf_dir, CUSTOMER_MONTH)))


@check("m18_nth_quarter_retention", _nth_sql("qtr"))
def m18_quarter(spark, sf_dir):
    return retention.nth_month_retention(retention.streak_cohort(quarterly(spark, sf_dir)))


@check(
    "m19_first_purchase_cohort",
    f"""WITH {T}, {FIRST}, act AS (SELECT DISTINCT CustomerID, m, fm FROM lab),
    c AS (SELECT fm, (m // 100 * 12 + m % 100) - (fm // 100 * 12 + fm % 100) AS o, count(*) AS n FROM act GROUP BY ALL),
    z AS (SELECT fm, count(DISTINCT CustomerID) AS size FROM act GROUP BY fm)
    SELECT fm AS CohortPeriod, CAST(o AS BIGINT) AS "Offset", n AS ActiveCustomers, size AS CohortSize,
      round(n / size, 6) AS ActiveShare FROM c JOIN z USING (fm)""",
)
def m19(spark, sf_dir):
    return rounded(retention.first_purchase_cohort(transactions(spark, sf_dir, CUSTOMER_MONTH)), 6, "ActiveShare")
