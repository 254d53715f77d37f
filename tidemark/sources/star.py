"""Maps the star-schema parquet tables to the inputs of the analyses.

Every function is lazy and reads only the columns it needs.  Lookups are left joins on
unique keys: they neither drop nor repeat lines, so a lookup whose columns are not asked
for can be left out without changing the rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_bucket
from tidemark.functions.money import exact_sum, money_sum
from tidemark.functions.periods import code_to_index, period_code
from tidemark.operators.revenue import with_revenue

TRANSACTION_COLUMNS = (
    "InvoiceNo",
    "LineNo",
    "CustomerID",
    "Quantity",
    "UnitPrice",
    "InvoiceDate",
    "Country",
    "InvoiceYearMonth",
    "Revenue",
)

YES_NO_COLUMNS = ("Partner", "PhoneService", "PaperlessBilling")
THREE_WAY_COLUMNS = (
    "MultipleLines",
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
)


# Fixed schemas: no file is opened before the query runs.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def transactions(
    spark: SparkSession, sf_dir: str, columns: Iterable[str] = TRANSACTION_COLUMNS
) -> DataFrame:
    """Invoice lines; ask only for the columns you use, each unused lookup join is skipped."""
    columns = list(columns)
    unknown = set(columns) - set(TRANSACTION_COLUMNS)
    if unknown:
        raise ValueError(f"unknown transaction columns: {sorted(unknown)}")
    wants = set(columns)

    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("InvoiceNo"),
        F.col("o_custkey").alias("CustomerID"),
        F.col("o_orderdate").alias("InvoiceDate"),
    )
    if "Country" in wants:
        # Joined on the order side: one lookup per order instead of one per line.
        nation = table(spark, sf_dir, "nation").select(
            F.col("n_nationkey"), F.col("n_name").alias("Country")
        )
        customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        orders = (
            orders.join(customer, orders.CustomerID == customer.c_custkey, "left")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .drop("c_custkey", "c_nationkey", "n_nationkey")
        )

    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("InvoiceNo"),
        F.col("l_linenumber").alias("LineNo"),
        F.col("l_partkey"),
        F.col("l_quantity").alias("Quantity"),
    )
    if wants & {"UnitPrice", "Revenue"}:
        part = table(spark, sf_dir, "part").select(
            "p_partkey", F.col("p_retailprice").alias("UnitPrice")
        )
        lines = lines.join(part, lines.l_partkey == part.p_partkey, "left").drop("p_partkey")
    joined = lines.drop("l_partkey").join(orders, "InvoiceNo")
    if "Revenue" in wants:
        joined = with_revenue(joined)
    elif "InvoiceYearMonth" in wants:
        joined = joined.withColumn("InvoiceYearMonth", period_code("InvoiceDate"))
    return joined.select(*columns)


def signups(spark: SparkSession, sf_dir: str, grain: str = "day") -> DataFrame:
    """One row per signed-up user: period of sign-up, period of first purchase, channel."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase"))
    is_signup = F.col("event_type") == "signup"
    channel_no = F.get_json_object("props", "$.k").cast("int") % 3
    first = events.groupBy(F.col("user_id").alias("CustomerID")).agg(
        F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("MinPurchaseDate"),
        F.min(F.when(is_signup, F.struct("ts", "event_id", channel_no.alias("n")))).alias("s"),
    )
    channel = F.when(F.col("s.n") == 0, "organic").when(F.col("s.n") == 1, "inorganic").otherwise("referral")
    return first.where(F.col("s").isNotNull()).select(
        "CustomerID",
        "MinPurchaseDate",
        period_code("MinPurchaseDate", grain).alias("MinPurchasePeriod"),
        period_code(F.col("s.ts"), grain).alias("SignupPeriod"),
        channel.alias("AcqChannel"),
    )


def subscribers(spark: SparkSession, sf_dir: str, churn_before: str = "2001-01-01") -> DataFrame:
    """One row per customer with an order history, in the raw (text) form of a subscriber file."""
    orders = table(spark, sf_dir, "orders")
    by_priority = orders.groupBy("o_custkey", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"),
        exact_sum("o_totalprice").alias("spent"),
        F.min("o_orderdate").alias("first"),
        F.max("o_orderdate").alias("last"),
    )
    # At most one row per priority and customer reaches this second step.
    history = by_priority.groupBy("o_custkey").agg(
        F.max(F.struct(F.col("n"), F.col("o_orderpriority"))).alias("mode"),
        F.sum("n").alias("n"),
        F.sum("spent").alias("spent"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region")
    customer = (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    )
    joined = customer.join(history, F.col("c_custkey") == F.col("o_custkey"))

    def yes_no(name: str):
        return F.when(hash_bucket("c_custkey", name, 2) == 0, "No").otherwise("Yes").alias(name)

    def three_way(name: str):
        b = hash_bucket("c_custkey", name, 3)
        return F.when(b == 0, "No").when(b == 1, "Yes").otherwise("No internet service").alias(name)

    first_month = code_to_index(period_code("first"))
    last_month = code_to_index(period_code("last"))
    blank = hash_bucket("c_custkey", "TotalCharges", 20) == 0
    return joined.select(
        F.col("c_custkey").cast("string").alias("customerID"),
        F.when(hash_bucket("c_custkey", "gender", 2) == 0, "Female").otherwise("Male").alias("gender"),
        hash_bucket("c_custkey", "SeniorCitizen", 2).alias("SeniorCitizen"),
        *[yes_no(c) for c in YES_NO_COLUMNS],
        *[three_way(c) for c in THREE_WAY_COLUMNS],
        F.col("r_name").alias("InternetService"),
        F.col("c_mktsegment").alias("Contract"),
        F.col("mode.o_orderpriority").alias("PaymentMethod"),
        (last_month - first_month).cast("int").alias("tenure"),
        (F.col("spent").cast("double") / F.col("n")).alias("MonthlyCharges"),
        F.when(blank, " ").otherwise(F.col("spent").cast("decimal(28,4)").cast("string")).alias("TotalCharges"),
        F.when(F.col("last") < F.lit(churn_before).cast("timestamp_ntz"), "Yes").otherwise("No").alias("Churn"),
    )


def daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"),
        F.col("l_suppkey").alias("store"),
        F.col("l_partkey").alias("item"),
        F.col("l_quantity").alias("sales"),
    )


def responses(spark: SparkSession, sf_dir: str, cutoff: str = "2001-05-01") -> DataFrame:
    """One campaign response per customer who ordered before the cutoff."""
    before = F.col("o_orderdate") < F.lit(cutoff).cast("timestamp_ntz")
    # Lines shrink to one row per order before they meet the orders.
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.max((F.col("l_discount") > 0.05).cast("int")).alias("discounted"),
            F.max((F.col("l_quantity") % 2 == 0).cast("int")).alias("paired"),
        )
    )
    orders = table(spark, sf_dir, "orders")
    per_customer = (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
        .groupBy(F.col("o_custkey").alias("customer_id"))
        .agg(
            F.max(F.when(before, F.col("o_orderdate"))).alias("last"),
            money_sum(F.when(before, F.col("o_totalprice"))).alias("history"),
            F.coalesce(F.max(F.when(before, F.col("discounted"))), F.lit(0)).alias("used_discount"),
            F.coalesce(F.max(F.when(before, F.col("paired"))), F.lit(0)).alias("used_bogo"),
            F.max((~before).cast("int")).alias("conversion"),
        )
        .where(F.col("last").isNotNull())
    )

    def pick(salt: str, *names: str):
        b = hash_bucket("customer_id", salt, len(names))
        choice = F.when(b == 0, names[0])
        for i, name in enumerate(names[1:], 1):
            choice = choice.when(b == i, name)
        return choice

    cutoff_month = code_to_index(period_code(F.lit(cutoff).cast("date")))
    return per_customer.select(
        "customer_id",
        (cutoff_month - code_to_index(period_code("last"))).cast("int").alias("recency"),
        "history",
        "used_discount",
        "used_bogo",
        pick("zip_code", "Suburban", "Urban", "Rural").alias("zip_code"),
        hash_bucket("customer_id", "is_referral", 2).alias("is_referral"),
        pick("channel", "Phone", "Web", "Multichannel").alias("channel"),
        pick("offer", "Discount", "Buy One Get One", "No Offer").alias("offer"),
        "conversion",
    )


def experiment(spark: SparkSession, sf_dir: str, groups: Iterable[str] = ("control", "test")) -> DataFrame:
    """Every customer with segment, experiment arm and purchase counts (0 without orders)."""
    groups = list(groups)
    since = F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")
    previous = (F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")) & ~since
    counts = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.count_if(since).alias("now"), F.count_if(previous).alias("prev"))
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    bucket = hash_bucket("c_custkey", "group", len(groups))
    arm = F.when(bucket == 0, groups[0])
    for i, name in enumerate(groups[1:], 1):
        arm = arm.when(bucket == i, name)
    return customer.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.when(F.col("c_acctbal") >= 4500, "high-value").otherwise("low-value").alias("segment"),
        arm.alias("group"),
        F.coalesce("now", F.lit(0)).cast("double").alias("purchase_count"),
        F.coalesce("prev", F.lit(0)).cast("bigint").alias("prev_purchase_count"),
    )
