"""Segmentation and RFM: S01 – S11."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.registry import T, check, clusters_sql, nearest_sql, rounded
from tidemark.operators import quantiles, segments
from tidemark.session import materialize
from tidemark.sources.star import table, transactions

RFM_INPUT = ("CustomerID", "InvoiceDate", "Quantity", "UnitPrice")

# Centres given as parameters, so that everything after the fit can be checked exactly.
RECENCY_CENTERS = [20.0, 150.0, 400.0, 900.0]
FREQUENCY_CENTERS = [20.0, 35.0, 45.0, 60.0]
REVENUE_CENTERS = [600000.0, 1000000.0, 1400000.0, 2000000.0]
CENTERS = {"Recency": RECENCY_CENTERS, "Frequency": FREQUENCY_CENTERS, "Revenue": REVENUE_CENTERS}

MEASURES = """k AS (SELECT * FROM t WHERE CustomerID IS NOT NULL),
rfm0 AS (
  SELECT CustomerID, max(InvoiceDate) AS last, count(InvoiceDate) AS Frequency, CAST(sum(rev) AS DOUBLE) AS Revenue
  FROM k GROUP BY CustomerID
),
rfm AS (
  SELECT CustomerID,
    CAST(floor(epoch((SELECT max(InvoiceDate) FROM k) - last) / 86400) AS BIGINT) AS Recency, Frequency, Revenue
  FROM rfm0
)"""

SCORED = f"""{MEASURES},
c AS (
  SELECT *, {nearest_sql('Recency', RECENCY_CENTERS[::-1])} AS RecencyCluster,
    {nearest_sql('Frequency', FREQUENCY_CENTERS)} AS FrequencyCluster,
    {nearest_sql('Revenue', REVENUE_CENTERS)} AS RevenueCluster
  FROM rfm
),
scored AS (
  SELECT *, RecencyCluster + FrequencyCluster + RevenueCluster AS OverallScore,
    CASE WHEN RecencyCluster + FrequencyCluster + RevenueCluster > 4 THEN 'High-Value'
         WHEN RecencyCluster + FrequencyCluster + RevenueCluster > 2 THEN 'Mid-Value' ELSE 'Low-Value' END AS Segment
  FROM c
)"""


def stored_measures(spark, sf_dir):
    """RFM measures written once, for queries that read them several times."""
    return materialize(segments.rfm_measures(rfm_input(spark, sf_dir)), "rfm-measures")


def rfm_input(spark, sf_dir):
    return transactions(spark, sf_dir, RFM_INPUT)


def fixed_scores(spark, sf_dir):
    return segments.rfm_scores(rfm_input(spark, sf_dir), centers=CENTERS)


def balances(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")


@check("s01_recency", f"WITH {T}, {MEASURES} SELECT CustomerID, Recency FROM rfm")
def s01(spark, sf_dir):
    return segments.recency(transactions(spark, sf_dir, ["CustomerID", "InvoiceDate"]))


@check(
    "s01_recency_of_events",
    """SELECT user_id AS CustomerID,
      CAST(floor(epoch((SELECT max(ts) FROM events) - max(ts)) / 86400) AS BIGINT) AS Recency
    FROM events GROUP BY user_id""",
)
def s01_events(spark, sf_dir):
    """Events have times of day, so whole days and calendar days differ."""
    events = table(spark, sf_dir, "events")
    return segments.recency(events.select(F.col("user_id").alias("CustomerID"), F.col("ts").alias("InvoiceDate")))


@check("s02_frequency", f"WITH {T}, {MEASURES} SELECT CustomerID, Frequency FROM rfm")
def s02(spark, sf_dir):
    return segments.frequency(transactions(spark, sf_dir, ["CustomerID", "InvoiceDate"]))


@check("s03_monetary", f"WITH {T}, {MEASURES} SELECT CustomerID, Revenue FROM rfm")
def s03(spark, sf_dir):
    return segments.monetary(transactions(spark, sf_dir, ["CustomerID", "Quantity", "UnitPrice"]))


@check(
    "s04_kmeans_1d",
    f"""WITH {T}, {MEASURES}, {clusters_sql('f', 'rfm', 'Frequency', 4)}
    SELECT CustomerID, Frequency, c AS FrequencyCluster FROM rfm JOIN f_label ON v = Frequency""",
)
def s04(spark, sf_dir):
    """Fitted: the four clusters with the least squared error."""
    measured = stored_measures(spark, sf_dir).select("CustomerID", "Frequency")
    return segments.kmeans_1d(measured, "Frequency", 4, "FrequencyCluster")


@check(
    "s04_assign_to_centers",
    f"WITH {T}, {MEASURES} SELECT CustomerID, Frequency, {nearest_sql('Frequency', [35.0, 60.0, 20.0, 45.0])} AS FrequencyCluster FROM rfm",
)
def s04_assign(spark, sf_dir):
    measured = segments.frequency(rfm_input(spark, sf_dir))
    return segments.kmeans_1d(measured, "Frequency", 4, "FrequencyCluster", centers=[35.0, 60.0, 20.0, 45.0])


@check(
    "s05_order_cluster",
    f"""WITH {T}, {MEASURES},
    c AS (SELECT CustomerID, Frequency, Revenue, {nearest_sql('Frequency', [35.0, 60.0, 20.0, 45.0])} AS cl FROM rfm),
    o AS (SELECT cl, CAST(row_number() OVER (ORDER BY avg(Revenue) DESC, cl) - 1 AS INTEGER) AS FrequencyCluster FROM c GROUP BY cl)
    SELECT CustomerID, Frequency, Revenue, FrequencyCluster FROM c JOIN o USING (cl)""",
)
def s05(spark, sf_dir):
    measured = stored_measures(spark, sf_dir).drop("Recency")
    clustered = segments.assign_to_centers(measured, "Frequency", [35.0, 60.0, 20.0, 45.0], "FrequencyCluster")
    return segments.order_cluster(clustered, "FrequencyCluster", "Revenue", ascending=False)


@check(
    "s06_rfm_scores",
    f"""WITH {T}, {SCORED} SELECT CustomerID, Recency, Frequency, Revenue, RecencyCluster, FrequencyCluster,
      RevenueCluster, OverallScore, Segment FROM scored""",
)
def s06(spark, sf_dir):
    return fixed_scores(spark, sf_dir)


FITTED = f"""{MEASURES},
{", ".join(clusters_sql(f"x{c}", "rfm", c, 4) for c in segments.RFM_MEASURES)},
n AS (SELECT {", ".join(f"(SELECT count(DISTINCT c) FROM x{c}_label) AS {c}_n" for c in segments.RFM_MEASURES)}),
fitted AS (
  SELECT rfm.*, CAST(Recency_n - 1 - xRecency_label.c AS INTEGER) AS RecencyCluster, xFrequency_label.c AS FrequencyCluster,
    xRevenue_label.c AS RevenueCluster
  FROM rfm, n JOIN xRecency_label ON xRecency_label.v = Recency JOIN xFrequency_label ON xFrequency_label.v = Frequency
  JOIN xRevenue_label ON xRevenue_label.v = Revenue)"""


@check(
    "s06_rfm_scores_fitted",
    f"""WITH {T}, {FITTED}
    SELECT *, RecencyCluster + FrequencyCluster + RevenueCluster AS OverallScore,
      CASE WHEN RecencyCluster + FrequencyCluster + RevenueCluster > 4 THEN 'High-Value'
           WHEN RecencyCluster + FrequencyCluster + RevenueCluster > 2 THEN 'Mid-Value' ELSE 'Low-Value' END AS Segment
    FROM fitted""",
)
def s06_fitted(spark, sf_dir):
    return segments.rfm_scores(rfm_input(spark, sf_dir))


@check(
    "s07_elbow",
    f"""WITH {T}, {MEASURES}, {clusters_sql('f', 'rfm', 'Frequency', 9)}
    SELECT k, round(c, 4) AS inertia FROM f_cost""",
)
def s07(spark, sf_dir):
    """The least squared error of one to nine clusters."""
    return rounded(segments.elbow(segments.frequency(rfm_input(spark, sf_dir)), ["Frequency"]), 4, "inertia")


@check(
    "s08_segment_profile",
    f"""WITH {T}, {SCORED} SELECT Segment, round(avg(Recency), 4) AS Recency, round(avg(Frequency), 4) AS Frequency,
      round(avg(Revenue), 2) AS Revenue FROM scored GROUP BY Segment""",
)
def s08(spark, sf_dir):
    profile = segments.segment_profile(
        fixed_scores(spark, sf_dir), "Segment", ["Recency", "Frequency", "Revenue"], sort_by="Frequency"
    )
    return rounded(profile, {"Recency": 4, "Frequency": 4, "Revenue": 2})


def _describe_sql(source: str, col: str, by: str = "") -> str:
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {key}count({col}) AS count, round(avg({col}), 4) AS mean, round(stddev_samp({col}), 4) AS std,
      round(CAST(min({col}) AS DOUBLE), 4) AS min, round(quantile_cont({col}, 0.25), 4) AS p25,
      round(quantile_cont({col}, 0.5), 4) AS p50, round(quantile_cont({col}, 0.75), 4) AS p75,
      round(CAST(max({col}) AS DOUBLE), 4) AS max FROM {source} {group}"""


DESCRIBED = {c: 4 for c in ("mean", "std", "min", "p25", "p50", "p75", "max")}


@check("s09_describe", f"WITH {T} {_describe_sql('t', 'Quantity')}")
def s09(spark, sf_dir):
    quantities = materialize(transactions(spark, sf_dir, ["Quantity"]), "quantities")
    return rounded(quantiles.describe(quantities, "Quantity"), DESCRIBED)


@check("s09_describe_by", _describe_sql("customer", "c_acctbal", "c_mktsegment"))
def s09_by(spark, sf_dir):
    return rounded(quantiles.describe(balances(spark, sf_dir), "c_acctbal", ["c_mktsegment"]), DESCRIBED)


@check(
    "s10_label_clusters",
    f"""SELECT c_custkey, c_acctbal, CASE {nearest_sql('c_acctbal', [0.0, 4000.0, 9000.0])}
      WHEN 0 THEN 'Low' WHEN 1 THEN 'Mid' ELSE 'High' END AS BalanceCluster FROM customer""",
)
def s10(spark, sf_dir):
    customers = balances(spark, sf_dir).select("c_custkey", "c_acctbal")
    clustered = segments.assign_to_centers(customers, "c_acctbal", [0.0, 4000.0, 9000.0], "BalanceCluster")
    return segments.label_clusters(clustered, "BalanceCluster")


@check(
    "s11_segment_points",
    f"WITH {T}, {SCORED} SELECT Segment, Recency, Revenue FROM scored WHERE Revenue < 1500000 AND Frequency < 60",
)
def s11(spark, sf_dir):
    return segments.segment_points(
        fixed_scores(spark, sf_dir), "Recency", "Revenue", {"Revenue": 1500000, "Frequency": 60}
    )
