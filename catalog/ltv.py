"""Customer lifetime value: L01 – L12."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import T, bucket_sql, check, clusters_sql, nearest_sql, rounded
from catalog.segmentation import RFM_INPUT
from tidemark.functions.hashing import hash_bucket
from tidemark.operators import evaluation, features, ltv, quantiles, sampling, segments
from tidemark.plans import value
from tidemark.session import materialize
from tidemark.sources.star import table, transactions

FEATURE_WINDOW = ("2001-01-01", "2001-04-01")
OUTCOME_WINDOW = ("2001-04-01", "2001-08-01")
IN_FEATURES = "InvoiceDate >= TIMESTAMP '2001-01-01' AND InvoiceDate < TIMESTAMP '2001-04-01'"
IN_OUTCOME = "InvoiceDate >= TIMESTAMP '2001-04-01' AND InvoiceDate < TIMESTAMP '2001-08-01'"

# Centres given as parameters, so that everything after the fit can be checked exactly.
CENTERS = {
    "Recency": [5.0, 30.0, 50.0, 75.0],
    "Frequency": [2.0, 4.0, 7.0, 12.0],
    "Revenue": [30000.0, 100000.0, 180000.0, 320000.0],
}
LTV_CENTERS = [20000.0, 150000.0, 350000.0]

LTV = f"""f AS (SELECT * FROM t WHERE CustomerID IS NOT NULL AND {IN_FEATURES}),
o AS (SELECT CustomerID, CAST(sum(rev) AS DOUBLE) AS m6 FROM t WHERE CustomerID IS NOT NULL AND {IN_OUTCOME} GROUP BY CustomerID),
r0 AS (SELECT CustomerID, CAST(date_diff('day', max(InvoiceDate), (SELECT max(InvoiceDate) FROM f)) AS BIGINT) AS Recency,
        count(*) AS Frequency, CAST(sum(rev) AS DOUBLE) AS Revenue FROM f GROUP BY CustomerID),
r1 AS (SELECT *, {nearest_sql('Recency', CENTERS['Recency'][::-1])} AS RecencyCluster,
        {nearest_sql('Frequency', CENTERS['Frequency'])} AS FrequencyCluster,
        {nearest_sql('Revenue', CENTERS['Revenue'])} AS RevenueCluster FROM r0),
r2 AS (SELECT *, RecencyCluster + FrequencyCluster + RevenueCluster AS OverallScore FROM r1),
ltv AS (SELECT r2.*, CASE WHEN OverallScore > 4 THEN 'High-Value' WHEN OverallScore > 2 THEN 'Mid-Value' ELSE 'Low-Value' END AS Segment,
        coalesce(m6, 0) AS m6_Revenue FROM r2 LEFT JOIN o USING (CustomerID)),
trimmed AS (SELECT * FROM ltv WHERE m6_Revenue < (SELECT quantile_cont(m6_Revenue, 0.99) FROM ltv)),
clustered AS (SELECT *, {nearest_sql('m6_Revenue', LTV_CENTERS)} AS LTVCluster FROM trimmed)"""


def windows(spark, sf_dir):
    return ltv.observation_windows(transactions(spark, sf_dir, RFM_INPUT), FEATURE_WINDOW, OUTCOME_WINDOW)


def ltv_table(spark, sf_dir):
    tx = transactions(spark, sf_dir, RFM_INPUT)
    return value.ltv_table(tx, FEATURE_WINDOW, OUTCOME_WINDOW, centers=CENTERS)


def stored_table(spark, sf_dir):
    """The LTV table written once, for queries that read it several times."""
    return materialize(ltv_table(spark, sf_dir), "ltv-table")


def clustered(spark, sf_dir):
    return ltv.ltv_clusters(stored_table(spark, sf_dir), centers=LTV_CENTERS)


def stand_in_prediction(df, id_col, label, classes):
    """A fixed "model" that is right for most rows, so metrics of predictions can be checked exactly."""
    wrong = hash_bucket(id_col, "wrong", 4) == 0
    return df.withColumn("prediction", F.when(wrong, hash_bucket(id_col, "guess", classes)).otherwise(F.col(label)))


PREDICTED = f"""{LTV}, scored AS (SELECT *, CASE WHEN {bucket_sql('CustomerID', 'wrong', 4)} = 0
    THEN {bucket_sql('CustomerID', 'guess', 3)} ELSE LTVCluster END AS prediction FROM clustered)"""


@check("l01_feature_window", f"WITH {T} SELECT CustomerID, InvoiceDate, Quantity, UnitPrice FROM t WHERE {IN_FEATURES}")
def l01(spark, sf_dir):
    return windows(spark, sf_dir)[0]


@check("l01_outcome_window", f"WITH {T} SELECT CustomerID, InvoiceDate, Quantity, UnitPrice FROM t WHERE {IN_OUTCOME}")
def l01_outcome(spark, sf_dir):
    return windows(spark, sf_dir)[1]


@check("l02_future_revenue", f"WITH {T}, {LTV} SELECT CustomerID, m6 AS \"m6_Revenue\" FROM o")
def l02(spark, sf_dir):
    return ltv.future_revenue(windows(spark, sf_dir)[1])


COLUMNS = "CustomerID, Recency, Frequency, Revenue, RecencyCluster, FrequencyCluster, RevenueCluster, OverallScore, Segment, m6_Revenue"


@check("l03_ltv_table", f"WITH {T}, {LTV} SELECT {COLUMNS} FROM ltv")
def l03(spark, sf_dir):
    return ltv_table(spark, sf_dir)


@check("l04_trim_upper", f"WITH {T}, {LTV} SELECT {COLUMNS} FROM trimmed")
def l04(spark, sf_dir):
    return quantiles.trim_upper(stored_table(spark, sf_dir), "m6_Revenue", 0.99)


@check("l05_ltv_clusters", f"WITH {T}, {LTV} SELECT {COLUMNS}, LTVCluster FROM clustered")
def l05(spark, sf_dir):
    return clustered(spark, sf_dir)


@check(
    "l05_ltv_clusters_fitted",
    f"""WITH {T}, {LTV}, {clusters_sql('x', 'trimmed', 'm6_Revenue', 3)}
    SELECT CustomerID, m6_Revenue AS "m6_Revenue", c AS LTVCluster FROM trimmed JOIN x_label ON v = m6_Revenue""",
)
def l05_fitted(spark, sf_dir):
    return ltv.ltv_clusters(stored_table(spark, sf_dir)).select("CustomerID", "m6_Revenue", "LTVCluster")


@check(
    "l05_ltv_cluster_profile",
    f"""WITH {T}, {LTV} SELECT LTVCluster, count(*) AS count, round(avg(m6_Revenue), 2) AS mean,
      round(stddev_samp(m6_Revenue), 2) AS std, round(min(m6_Revenue), 2) AS min,
      round(quantile_cont(m6_Revenue, 0.25), 2) AS p25, round(quantile_cont(m6_Revenue, 0.5), 2) AS p50,
      round(quantile_cont(m6_Revenue, 0.75), 2) AS p75, round(max(m6_Revenue), 2) AS max
    FROM clustered GROUP BY LTVCluster""",
)
def l05_profile(spark, sf_dir):
    profile = quantiles.describe(clustered(spark, sf_dir), "m6_Revenue", ["LTVCluster"])
    return rounded(profile, 2, "mean", "std", "min", "p25", "p50", "p75", "max")


SEGMENT_DUMMIES = ", ".join(
    f"CAST(Segment = '{s}' AS INTEGER) AS \"Segment_{s}\"" for s in ("High-Value", "Low-Value", "Mid-Value")
)


@check("l06_one_hot", f"WITH {T}, {LTV} SELECT * EXCLUDE (Segment), {SEGMENT_DUMMIES} FROM clustered")
def l06(spark, sf_dir):
    return features.one_hot(clustered(spark, sf_dir))


@check(
    "l06_one_hot_sparse",
    """SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS place,
      CAST((SELECT count(DISTINCT c_name) FROM customer) AS INTEGER) AS width FROM customer""",
)
def l06_sparse(spark, sf_dir):
    """A column with a category per customer."""
    encoded, _ = features.encode_sparse(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_name"])
    # The vector's only index and its length, without writing its zeros out.
    seen = F.udf(lambda v: (int(v.indices[0]), v.size), "place int, width int")("c_name_vector").alias("s")
    return encoded.select("c_custkey", seen).select("c_custkey", "s.place", "s.width")


_NUMERIC = ["CustomerID", "Recency", "Frequency", "Revenue", "RecencyCluster", "FrequencyCluster", "RevenueCluster",
            "OverallScore", "LTVCluster", "Segment_High-Value", "Segment_Low-Value", "Segment_Mid-Value"]


@check(
    "l07_label_correlation",
    f"WITH {T}, {LTV}, h AS (SELECT *, {SEGMENT_DUMMIES} FROM clustered) "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr(\"{c}\", LTVCluster), 6) AS correlation FROM h" for c in _NUMERIC),
)
def l07(spark, sf_dir):
    encoded = features.one_hot(clustered(spark, sf_dir))
    return rounded(features.label_correlation(encoded, "LTVCluster", ["m6_Revenue"]), 6, "correlation")


@check(
    "l08_train_test_split",
    """WITH h AS (SELECT c_custkey, c_name, md5(c_custkey || '|42') AS d FROM customer),
    k AS (SELECT *, row_number() OVER (ORDER BY d, c_custkey) AS i, count(*) OVER () AS n FROM h)
    SELECT c_custkey, c_name, i > ceil(0.1::DOUBLE * n) AS is_train FROM k""",
)
def l08(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return sampling.train_test_split(customers, "c_custkey", 0.1, 42)


@check("l09_train_multiclass")
def l09(spark, sf_dir):
    """The whole way: RFM and LTV clusters are fitted, boosted trees learn from 90 % of the customers and score all."""
    table = value.ltv_table(transactions(spark, sf_dir, RFM_INPUT), FEATURE_WINDOW, OUTCOME_WINDOW)
    scored = value.predict_ltv_cluster(ltv.ltv_clusters(materialize(table, "ltv-table"))).customers
    return scored.select("CustomerID", "is_train", "LTVCluster", "prediction", "proba_0", "proba_1", "proba_2")


@check(
    "l10_accuracy",
    f"""WITH {T}, {PREDICTED} SELECT round(avg(CAST(prediction = LTVCluster AS INTEGER)), 6) AS accuracy,
      count(*) AS rows FROM scored""",
)
def l10(spark, sf_dir):
    scored = stand_in_prediction(clustered(spark, sf_dir), "CustomerID", "LTVCluster", 3)
    return rounded(evaluation.accuracy(scored, "LTVCluster"), 6, "accuracy")


@check(
    "l11_class_share",
    f"""WITH {T}, {LTV} SELECT LTVCluster, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share
    FROM clustered GROUP BY LTVCluster""",
)
def l11(spark, sf_dir):
    return rounded(evaluation.class_distribution(clustered(spark, sf_dir), "LTVCluster"), 6, "share")


def report_sql(ctes: str, label: str) -> str:
    return f"""WITH {ctes},
    pairs AS (SELECT {label} AS l, prediction AS p, count(*) AS n FROM scored GROUP BY ALL),
    cls AS (SELECT DISTINCT x FROM (SELECT l AS x FROM pairs UNION SELECT p FROM pairs)),
    raw AS (SELECT x, coalesce((SELECT sum(n) FROM pairs WHERE l = x), 0) AS support,
      coalesce((SELECT sum(n) FROM pairs WHERE p = x), 0) AS predicted,
      coalesce((SELECT sum(n) FROM pairs WHERE l = x AND p = x), 0) AS hit FROM cls),
    per AS (SELECT CAST(x AS VARCHAR) AS class, coalesce(hit / nullif(predicted, 0), 0) AS precision,
      coalesce(hit / nullif(support, 0), 0) AS recall,
      coalesce(2 * hit / nullif(predicted + support, 0), 0) AS f1, support, hit FROM raw),
    rep AS (
      SELECT class, precision, recall, f1, support FROM per
      UNION ALL SELECT 'accuracy', NULL, NULL, sum(hit) / sum(support), sum(support) FROM per
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), sum(support) FROM per)
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
      CAST(support AS BIGINT) AS support FROM rep"""


@check("l12_classification_report", report_sql(f"{T}, {PREDICTED}", "LTVCluster"))
def l12(spark, sf_dir):
    scored = stand_in_prediction(clustered(spark, sf_dir), "CustomerID", "LTVCluster", 3)
    return rounded(evaluation.classification_report(scored, "LTVCluster"), 6, "precision", "recall", "f1")


@check(
    "s08_mean_ltv_by_segment",
    f"WITH {T}, {LTV} SELECT Segment, round(avg(m6_Revenue), 2) AS \"m6_Revenue\" FROM ltv GROUP BY Segment",
)
def s08_ltv(spark, sf_dir):
    return rounded(segments.segment_profile(ltv_table(spark, sf_dir), "Segment", ["m6_Revenue"]), 2, "m6_Revenue")
