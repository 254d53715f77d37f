"""Churn: C01 – C15."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.ltv import report_sql, stand_in_prediction
from catalog.registry import S, bucket_sql, check, clusters_sql, nearest_sql, rounded
from tidemark.operators import churn, evaluation, features, models, quantiles
from tidemark.plans import churn as plan
from tidemark.session import materialize, scratch_path
from tidemark.sources import csv, star

ID = "customerID"
CATEGORIES = ("gender", "InternetService", "Contract", "TechSupport", "PaymentMethod")
CENTERS = {
    "tenure": [40.0, 58.0, 72.0],
    "MonthlyCharges": [200000.0, 250000.0, 300000.0],
    "TotalCharges": [1500000.0, 2500000.0, 3500000.0],
}
TEXTS = ["gender", "Partner", "PhoneService", "PaperlessBilling", "MultipleLines", "OnlineSecurity", "OnlineBackup",
         "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "InternetService", "Contract",
         "PaymentMethod"]

# Categories in the order the encoders must find them.
BINARY = {"gender": ("Female", "Male"), "Partner": ("No", "Yes"), "PhoneService": ("No", "Yes"), "PaperlessBilling": ("No", "Yes")}
THREE = ("No", "No internet service", "Yes")
MULTIPLE = {c: THREE for c in TEXTS[4:11]} | {
    "InternetService": ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"),
    "Contract": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
    "PaymentMethod": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
}

CLEAN = f"""{S},
clean AS (SELECT * REPLACE (coalesce(TRY_CAST(TotalCharges AS DOUBLE), MonthlyCharges) AS TotalCharges) FROM s)"""


def _group_sql(col: str, name: str, order_by: str) -> str:
    return f"""
{name}_c AS (SELECT customerID, {order_by} AS ob, {nearest_sql(col, CENTERS[col])} AS cl FROM clean),
{name}_o AS (SELECT cl, row_number() OVER (ORDER BY avg(ob), cl) - 1 AS i FROM {name}_c GROUP BY cl),
{name}_g AS (SELECT customerID, CASE i WHEN 0 THEN 'Low' WHEN 1 THEN 'Mid' ELSE 'High' END AS {name}
  FROM {name}_c JOIN {name}_o USING (cl))"""


GROUPS = ",".join(
    [
        _group_sql("tenure", "TenureCluster", "tenure"),
        _group_sql("MonthlyCharges", "MonthlyChargesCluster", "tenure"),
        _group_sql("TotalCharges", "TotalChargesCluster", "tenure"),
    ]
)
GROUPED = f"""{CLEAN},{GROUPS},
grouped AS (SELECT * FROM clean JOIN TenureCluster_g USING (customerID) JOIN MonthlyChargesCluster_g USING (customerID)
  JOIN TotalChargesCluster_g USING (customerID))"""


def subscribers(spark, sf_dir):
    return churn.churn_flag(star.subscribers(spark, sf_dir))


def cleaned(spark, sf_dir):
    return plan.clean_subscribers(subscribers(spark, sf_dir))


def stored(spark, sf_dir):
    """Cleaned subscribers written once, for queries that read them several times."""
    return materialize(cleaned(spark, sf_dir), "subscribers")


def grouped(spark, sf_dir):
    return churn.numeric_groups(stored(spark, sf_dir), centers=CENTERS)


def encoded(spark, sf_dir, drop_first=False):
    """Model input with fitted groups."""
    return plan.model_table(stored(spark, sf_dir), drop_first=drop_first)


def feature_names(drop_first=False):
    """Names of the model's columns, as the data and the fixed group names give them."""
    levels = MULTIPLE | {c: ("High", "Low", "Mid") for c in churn.GROUPED_COLUMNS.values()}
    dummies = [f"{c}_{v}" for c, values in levels.items() for v in values[1 if drop_first else 0 :]]
    for ch in " ()-":
        dummies = [d.replace(ch, "_") for d in dummies]
    return ["SeniorCitizen", *churn.GROUPED_COLUMNS, *BINARY, *dummies]


def _names_sql(names, facts: str) -> str:
    return "SELECT feature, " + facts + " FROM (VALUES " + ", ".join(f"('{n}')" for n in names) + ") AS v(feature)"


@check("c01_read_subscribers", f"WITH {S} SELECT * FROM s")
def c01(spark, sf_dir):
    """Writes the subscribers in the file format, then reads that file."""
    path = scratch_path(spark, "subscriber-csv")
    raw = star.subscribers(spark, sf_dir)
    raw.write.options(header="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    return csv.read_subscribers(spark, path, raw.schema)


@check(
    "c02_rate_by_category",
    f"WITH {S} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS value, round(avg(Churn), 6) AS mean, count(Churn) AS count FROM s GROUP BY {c}"
        for c in ("Contract",)
    ),
)
def c02(spark, sf_dir):
    rates = churn.rate_by_category(subscribers(spark, sf_dir), "Contract")
    return rounded(rates.select(F.lit("Contract").alias("feature"), F.col("Contract").alias("value"), "mean", "count"), 6, "mean")


def _rates_sql(cols) -> str:
    return f"WITH {S} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS value, round(avg(Churn), 6) AS mean, count(Churn) AS count FROM s GROUP BY {c}"
        for c in cols
    )


@check("c03_rate_by_categories", _rates_sql(CATEGORIES + churn.OTHER_CATEGORIES))
def c03(spark, sf_dir):
    cols = CATEGORIES + churn.OTHER_CATEGORIES
    return rounded(churn.rate_by_categories(subscribers(spark, sf_dir), cols), 6, "mean")


@check("c04_rate_by_tenure", f"WITH {S} SELECT tenure, round(avg(Churn), 6) AS mean FROM s GROUP BY tenure")
def c04(spark, sf_dir):
    return rounded(churn.rate_by_numeric(subscribers(spark, sf_dir), "tenure"), 6, "mean")


@check(
    "c04_rate_by_monthly_charges",
    f"""WITH {S} SELECT CAST(trunc(MonthlyCharges) AS BIGINT) AS "MonthlyChargesBin", round(avg(Churn), 6) AS mean
    FROM s GROUP BY 1""",
)
def c04_monthly(spark, sf_dir):
    return rounded(churn.rate_by_numeric(subscribers(spark, sf_dir), "MonthlyCharges", bins="int"), 6, "mean")


@check(
    "c04_rate_by_total_charges",
    f"""WITH {S} SELECT CAST(trunc(TRY_CAST(TotalCharges AS DOUBLE)) AS BIGINT) AS "TotalChargesBin", round(avg(Churn), 6) AS mean
    FROM s WHERE TRY_CAST(TotalCharges AS DOUBLE) IS NOT NULL GROUP BY 1""",
)
def c04_total(spark, sf_dir):
    return rounded(churn.rate_by_parsed(subscribers(spark, sf_dir), "TotalCharges"), 6, "mean")


@check(
    "c04_describe_monthly_charges",
    f"""WITH {S} SELECT count(*) AS count, round(avg(MonthlyCharges), 2) AS mean, round(stddev_samp(MonthlyCharges), 2) AS std,
      round(min(MonthlyCharges), 2) AS min, round(quantile_cont(MonthlyCharges, 0.25), 2) AS p25,
      round(quantile_cont(MonthlyCharges, 0.5), 2) AS p50, round(quantile_cont(MonthlyCharges, 0.75), 2) AS p75,
      round(max(MonthlyCharges), 2) AS max FROM s""",
)
def c04_describe(spark, sf_dir):
    described = quantiles.describe(stored(spark, sf_dir), "MonthlyCharges")
    return rounded(described, 2, "mean", "std", "min", "p25", "p50", "p75", "max")


@check("c05_parse_numeric", f"WITH {S} SELECT customerID, TRY_CAST(TotalCharges AS DOUBLE) AS TotalCharges FROM s")
def c05(spark, sf_dir):
    return features.parse_numeric(subscribers(spark, sf_dir), "TotalCharges").select(ID, "TotalCharges")


@check(
    "c06_missing_report",
    f"""WITH {S} SELECT customerID, tenure, MonthlyCharges, TRY_CAST(TotalCharges AS DOUBLE) AS TotalCharges FROM s
    WHERE TRY_CAST(TotalCharges AS DOUBLE) IS NULL""",
)
def c06(spark, sf_dir):
    parsed = features.parse_numeric(subscribers(spark, sf_dir), "TotalCharges")
    return features.missing_report(parsed, "TotalCharges", [ID, "tenure", "MonthlyCharges", "TotalCharges"])


@check(
    "c06_recheck_after_fill",
    f"""WITH {CLEAN} SELECT customerID, tenure, MonthlyCharges, TotalCharges FROM clean
    WHERE customerID IN (SELECT customerID FROM s WHERE TRY_CAST(TotalCharges AS DOUBLE) IS NULL)""",
)
def c06_recheck(spark, sf_dir):
    parsed = materialize(features.parse_numeric(subscribers(spark, sf_dir), "TotalCharges"), "parsed")
    missing = features.missing_report(parsed, "TotalCharges", [ID])
    filled = features.fill_from(parsed, "TotalCharges", "MonthlyCharges")
    return filled.select(ID, "tenure", "MonthlyCharges", "TotalCharges").join(missing, ID, "left_semi")


@check("c07_fill_from", f"WITH {CLEAN} SELECT customerID, MonthlyCharges, TotalCharges FROM clean")
def c07(spark, sf_dir):
    return cleaned(spark, sf_dir).select(ID, "MonthlyCharges", "TotalCharges")


@check(
    "c08_numeric_groups",
    f"""WITH {GROUPED} SELECT customerID, tenure, MonthlyCharges, TotalCharges, TenureCluster,
      MonthlyChargesCluster, TotalChargesCluster FROM grouped""",
)
def c08(spark, sf_dir):
    return grouped(spark, sf_dir).select(ID, *churn.GROUPED_COLUMNS, *churn.GROUPED_COLUMNS.values())


def _fitted_group_sql(col: str, name: str) -> str:
    return f"""{clusters_sql(f"x{col}", "clean", col, 3)},
{name}_c AS (SELECT customerID, tenure AS ob, c AS cl FROM clean JOIN x{col}_label ON v = {col}),
{name}_o AS (SELECT cl, row_number() OVER (ORDER BY avg(ob), cl) - 1 AS i FROM {name}_c GROUP BY cl),
{name}_g AS (SELECT customerID, CASE i WHEN 0 THEN 'Low' WHEN 1 THEN 'Mid' ELSE 'High' END AS {name}
  FROM {name}_c JOIN {name}_o USING (cl))"""


@check(
    "c08_numeric_groups_fitted",
    f"WITH {CLEAN}, {', '.join(_fitted_group_sql(c, n) for c, n in churn.GROUPED_COLUMNS.items())} "
    + f"SELECT customerID, {', '.join([*churn.GROUPED_COLUMNS, *churn.GROUPED_COLUMNS.values()])} FROM clean "
    + " ".join(f"JOIN {n}_g USING (customerID)" for n in churn.GROUPED_COLUMNS.values()),
)
def c08_fitted(spark, sf_dir):
    fitted = churn.numeric_groups(stored(spark, sf_dir))
    return fitted.select(ID, *churn.GROUPED_COLUMNS, *churn.GROUPED_COLUMNS.values())


@check(
    "c08_tenure_by_group",
    f"""WITH {GROUPED} SELECT TenureCluster, count(tenure) AS count, round(avg(tenure), 4) AS mean,
      round(stddev_samp(tenure), 4) AS std, CAST(min(tenure) AS DOUBLE) AS min, quantile_cont(tenure, 0.25) AS p25,
      quantile_cont(tenure, 0.5) AS p50, quantile_cont(tenure, 0.75) AS p75, CAST(max(tenure) AS DOUBLE) AS max
    FROM grouped GROUP BY TenureCluster""",
)
def c08_profile(spark, sf_dir):
    profiled = materialize(grouped(spark, sf_dir).select("tenure", "TenureCluster"), "tenure-groups")
    return rounded(quantiles.describe(profiled, "tenure", ["TenureCluster"]), 4, "mean", "std")


def _code_sql() -> str:
    codes = [f"CASE {c} WHEN '{a}' THEN 0 WHEN '{b}' THEN 1 END AS {c}" for c, (a, b) in BINARY.items()]
    dummies = [f"CAST({c} = '{v}' AS INTEGER) AS \"{c}_{v}\"" for c, values in MULTIPLE.items() for v in values]
    return ", ".join(["customerID", "SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges", "Churn", *codes, *dummies])


@check("c09_encode_categoricals", f"WITH {CLEAN} SELECT {_code_sql()} FROM clean")
def c09(spark, sf_dir):
    return features.encode_categoricals(stored(spark, sf_dir), ID)


def _clean_code_sql() -> str:
    sql = _code_sql()
    for c, values in MULTIPLE.items():
        for v in values:
            name = f"{c}_{v}"
            for ch in " ()-":
                name = name.replace(ch, "_")
            sql = sql.replace(f'"{c}_{v}"', f'"{name}"')
    return sql


@check("c10_sanitize_columns", f"WITH {CLEAN} SELECT {_clean_code_sql()} FROM clean")
def c10(spark, sf_dir):
    return features.sanitize_columns(features.encode_categoricals(stored(spark, sf_dir), ID))


@check("c11_logistic_summary")
def c11(spark, sf_dir):
    """On all levels of all categories."""
    return plan.explain_churn(materialize(encoded(spark, sf_dir), "encoded"))


@check("c12_odds_ratios")
def c12(spark, sf_dir):
    return models.odds_ratios(plan.explain_churn(materialize(encoded(spark, sf_dir), "encoded")))


def churn_model(spark, sf_dir):
    return plan.predict_churn(encoded(spark, sf_dir))


@check("c13_train_binary")
def c13(spark, sf_dir):
    """Accuracy on the training and the test customers, next to the share of the commoner answer."""
    model = churn_model(spark, sf_dir)
    share = F.greatest(F.avg("Churn"), 1 - F.avg("Churn")).alias("commoner")
    common = model.customers.groupBy(F.col("is_train").alias("side")).agg(share)
    return model.accuracy().join(common, F.col("is_train") == F.col("side")).select("is_train", "rows", "accuracy", "commoner")


@check("c13_fitted_report")
def c13_fitted(spark, sf_dir):
    """The model's own report on the customers it has not seen."""
    return churn_model(spark, sf_dir).report()


@check("c13_churn_report", report_sql(
    f"{S}, scored AS (SELECT *, CASE WHEN {bucket_sql('customerID', 'wrong', 4)} = 0 THEN {bucket_sql('customerID', 'guess', 2)} ELSE Churn END AS prediction FROM s)",
    "Churn",
))
def c13_report(spark, sf_dir):
    scored = stand_in_prediction(subscribers(spark, sf_dir), ID, "Churn", 2)
    return rounded(evaluation.classification_report(scored, "Churn"), 6, "precision", "recall", "f1")


@check("c14_feature_importance")
def c14(spark, sf_dir):
    """Splits per feature and their share of the gain."""
    return churn_model(spark, sf_dir).importance()


@check("c15_score")
def c15(spark, sf_dir):
    """Churn probability of every customer; ``is_train`` says who the model has seen."""
    return churn_model(spark, sf_dir).customers.select(ID, "is_train", "Churn", "prediction", "proba")
