"""CSV readers with fixed schemas (nothing is inferred, so nothing is read twice)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.churn import churn_flag

# The file formats the inputs come in.
INVOICE_TIME_FORMAT = "M/d/yyyy H:mm"
INVOICE_ENCODING = "ISO-8859-1"

TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.DoubleType()),
        T.StructField("InvoiceDate", T.TimestampNTZType()),
        T.StructField("UnitPrice", T.DoubleType()),
        T.StructField("CustomerID", T.StringType()),
        T.StructField("Country", T.StringType()),
    ]
)

SUBSCRIBER_SCHEMA = T.StructType(
    [T.StructField("customerID", T.StringType()), T.StructField("gender", T.StringType())]
    + [T.StructField("SeniorCitizen", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("Partner", "Dependents")]
    + [T.StructField("tenure", T.IntegerType())]
    + [
        T.StructField(c, T.StringType())
        for c in (
            "PhoneService",
            "MultipleLines",
            "InternetService",
            "OnlineSecurity",
            "OnlineBackup",
            "DeviceProtection",
            "TechSupport",
            "StreamingTV",
            "StreamingMovies",
            "Contract",
            "PaperlessBilling",
            "PaymentMethod",
        )
    ]
    + [
        T.StructField("MonthlyCharges", T.DoubleType()),
        T.StructField("TotalCharges", T.StringType()),
        T.StructField("Churn", T.StringType()),
    ]
)

SALES_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("store", T.LongType()),
        T.StructField("item", T.LongType()),
        T.StructField("sales", T.DoubleType()),
    ]
)

RESPONSE_SCHEMA = T.StructType(
    [
        T.StructField("recency", T.IntegerType()),
        T.StructField("history", T.DoubleType()),
        T.StructField("used_discount", T.IntegerType()),
        T.StructField("used_bogo", T.IntegerType()),
        T.StructField("zip_code", T.StringType()),
        T.StructField("is_referral", T.IntegerType()),
        T.StructField("channel", T.StringType()),
        T.StructField("offer", T.StringType()),
        T.StructField("conversion", T.IntegerType()),
    ]
)


def _read(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    # FAILFAST: a line that does not fit the schema must not turn into silent nulls.
    # The header is compared with the schema, so a reordered file is rejected too.
    return (
        spark.read.schema(schema)
        .options(header="true", mode="FAILFAST", enforceSchema="false", **options)
        .csv(path)
    )


def read_transactions(spark: SparkSession, path: str, schema: T.StructType = TRANSACTION_SCHEMA) -> DataFrame:
    """Retail lines; dates such as ``12/1/2010 8:26``; ids arrive as ``17850`` or ``17850.0``."""
    raw = _read(
        spark, path, schema, timestampNTZFormat=INVOICE_TIME_FORMAT, encoding=INVOICE_ENCODING
    )
    # By way of a decimal: a double would merge ids above 2^53.
    return raw.withColumn("CustomerID", F.col("CustomerID").cast("decimal(38,1)").cast("bigint"))


def read_subscribers(spark: SparkSession, path: str, schema: T.StructType = SUBSCRIBER_SCHEMA) -> DataFrame:
    """Subscriber table with ``Churn`` turned from Yes/No into 1/0."""
    # Blanks in TotalCharges are data here (see parse_numeric), so keep them.
    return churn_flag(_read(spark, path, schema, ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false"))


def read_daily_sales(spark: SparkSession, path: str, schema: T.StructType = SALES_SCHEMA) -> DataFrame:
    return _read(spark, path, schema, dateFormat="yyyy-MM-dd")


def read_responses(spark: SparkSession, path: str, schema: T.StructType = RESPONSE_SCHEMA) -> DataFrame:
    """Campaign responses; pass a schema with an id column in front when the file has one."""
    return _read(spark, path, schema)
