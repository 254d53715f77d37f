"""Promotion response and uplift: U01 – U16."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import R, check, clusters_sql, nearest_sql, rounded, unit_sql
from tidemark.functions.hashing import hash_unit
from tidemark.operators import campaign, evaluation, experiment, features, sampling, segments
from tidemark.operators.campaign import BOGO, CLASS_PROBABILITIES
from tidemark.operators.churn import rate_by_categories
from tidemark.plans import promotion
from tidemark.session import materialize
from tidemark.sources.star import responses

ID = "customer_id"
HISTORY_CENTERS = [500000.0, 1500000.0, 2300000.0, 3000000.0, 4000000.0]
CATEGORIES = {
    "zip_code": ["Rural", "Suburban", "Urban"],
    "channel": ["Multichannel", "Phone", "Web"],
    "offer": ["Buy One Get One", "Discount", "No Offer"],
}

UPLIFT_DIGITS = {"conversion_uplift": 6, "order_uplift": 6, "revenue_uplift": 4, "revenue_per_target": 6}

# Stand-in scores: fixed pseudo-random numbers per customer, so that everything computed
# from a model's output can be checked exactly.
SCORED = f"""{R},
scored AS (SELECT *, {unit_sql('customer_id', 'proba')} AS proba FROM r),
four AS (SELECT *, {", ".join(f"{unit_sql('customer_id', p)} / 4.0::DOUBLE AS {p}" for p in CLASS_PROBABILITIES)} FROM r),
uplifted AS (SELECT *, proba_CN + proba_TR - proba_TN - proba_CR AS uplift_score FROM four)"""


def scored(spark, sf_dir):
    return responses(spark, sf_dir).withColumn("proba", hash_unit(ID, "proba"))


def stored(spark, sf_dir):
    """Responses written once, for queries that read them several times."""
    return materialize(responses(spark, sf_dir), "responses")


def stored_uplift(spark, sf_dir):
    return materialize(uplifted(spark, sf_dir).select(ID, "offer", "conversion", "uplift_score"), "uplift-scores")


def uplifted(spark, sf_dir):
    four = {p: hash_unit(ID, p) / F.lit(4.0) for p in CLASS_PROBABILITIES}
    return campaign.uplift_score(responses(spark, sf_dir).withColumns(four))


def _uplift_sql(ctes: str, source: str, extra: str = "") -> str:
    return f"""WITH {ctes},
    g AS (SELECT offer, count(*) AS customers, avg(conversion) AS rate FROM {source} GROUP BY offer),
    u AS (SELECT offer, customers, rate - (SELECT rate FROM g WHERE offer = 'No Offer') AS up FROM g WHERE offer <> 'No Offer')
    SELECT offer, customers, round(up, 6) AS conversion_uplift, round(up * customers, 6) AS order_uplift,
      round(up * customers * 25, 4) AS revenue_uplift, round(up * 25, 6) AS revenue_per_target {extra} FROM u"""


@check("u01_campaign_uplift", _uplift_sql(R, "r"))
def u01(spark, sf_dir):
    return rounded(campaign.campaign_uplift(responses(spark, sf_dir)), UPLIFT_DIGITS)


@check("u01_campaign_uplift_without_bogo", _uplift_sql(f"{R}, two AS (SELECT * FROM r WHERE offer <> '{BOGO}')", "two"))
def u01_benchmark(spark, sf_dir):
    two = responses(spark, sf_dir).where(F.col("offer") != BOGO)
    return rounded(campaign.campaign_uplift(two), UPLIFT_DIGITS)


def _uptick_sql(size: str) -> str:
    part = "SELECT offer, '{0}' AS target, {1} AS customers, r_{0} - (SELECT r_{0} FROM g WHERE offer = 'No Offer') AS up FROM g WHERE offer <> 'No Offer'"
    return f"""WITH {SCORED},
    g AS (SELECT offer, count(*) AS n, (SELECT count(*) FROM scored) AS total, avg(conversion) AS r_conversion,
      avg(proba) AS r_proba FROM scored GROUP BY offer),
    u AS ({part.format('conversion', size)} UNION ALL {part.format('proba', size)})
    SELECT offer, target, customers, round(up, 6) AS conversion_uplift, round(up * customers, 6) AS order_uplift,
      round(up * customers * 25, 4) AS revenue_uplift FROM u"""


UPTICK_DIGITS = {"conversion_uplift": 6, "order_uplift": 6, "revenue_uplift": 4}


@check("u02_scored_uptick", _uptick_sql("n"))
def u02(spark, sf_dir):
    """On one-hot offer columns, as model input has them."""
    encoded = features.one_hot(scored(spark, sf_dir), CATEGORIES)
    return rounded(campaign.scored_uptick(campaign.offer_from_dummies(encoded)), UPTICK_DIGITS)


@check("u03_population_uptick", _uptick_sql("total"))
def u03(spark, sf_dir):
    return rounded(campaign.population_uptick(scored(spark, sf_dir)), UPTICK_DIGITS)


KEYS = ("recency", "zip_code", "is_referral", "channel", "offer")


@check(
    "u04_conversion_by",
    f"WITH {R} "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS feature, CAST({k} AS VARCHAR) AS value, round(avg(conversion), 6) AS mean, count(conversion) AS count FROM r GROUP BY {k}"
        for k in KEYS
    ),
)
def u04(spark, sf_dir):
    return rounded(rate_by_categories(responses(spark, sf_dir), KEYS, "conversion"), 6, "mean")


@check(
    "u04_conversion_by_recency",
    f"WITH {R} SELECT recency, round(avg(conversion), 6) AS mean, count(conversion) AS count FROM r GROUP BY recency ORDER BY recency",
)
def u04_recency(spark, sf_dir):
    return rounded(campaign.conversion_by(responses(spark, sf_dir), "recency"), 6, "mean")


@check("u04_overall_conversion", f"WITH {R} SELECT round(avg(conversion), 6) AS mean, count(conversion) AS count FROM r")
def u04_overall(spark, sf_dir):
    return rounded(campaign.overall_conversion(responses(spark, sf_dir)), 6, "mean")


@check(
    "u05_conversion_by_keys",
    f"WITH {R} SELECT used_discount, used_bogo, offer, round(avg(conversion), 6) AS mean FROM r GROUP BY ALL",
)
def u05(spark, sf_dir):
    return rounded(campaign.conversion_by_keys(responses(spark, sf_dir)), 6, "mean")


def history_clusters(spark, sf_dir):
    return segments.ordered_kmeans(
        stored(spark, sf_dir), "history", 5, "history_cluster", centers=HISTORY_CENTERS[::-1]
    )


CLUSTERED = f"{R}, h AS (SELECT *, {nearest_sql('history', HISTORY_CENTERS)} AS cl FROM r)"
# Only clusters somebody belongs to get a number.
NUMBERED = f"""{CLUSTERED}, nb AS (SELECT cl, CAST(row_number() OVER (ORDER BY avg(history)) - 1 AS INTEGER) AS history_cluster
  FROM h GROUP BY cl), hc AS (SELECT h.* EXCLUDE (cl), history_cluster FROM h JOIN nb USING (cl))"""


@check("u06_history_clusters", f"WITH {NUMBERED} SELECT customer_id, history, history_cluster FROM hc")
def u06(spark, sf_dir):
    return history_clusters(spark, sf_dir).select(ID, "history", "history_cluster")


@check(
    "u06_history_clusters_fitted",
    f"""WITH {R}, {clusters_sql('x', 'r', 'history', 5)}
    SELECT customer_id, history, c AS history_cluster FROM r JOIN x_label ON v = history""",
)
def u06_fitted(spark, sf_dir):
    fitted = segments.ordered_kmeans(stored(spark, sf_dir), "history", 5, "history_cluster")
    return fitted.select(ID, "history", "history_cluster")


@check(
    "u04_conversion_by_history_cluster",
    f"""WITH {NUMBERED} SELECT history_cluster, round(avg(conversion), 6) AS mean, count(conversion) AS count
    FROM hc GROUP BY history_cluster""",
)
def u04_history(spark, sf_dir):
    return rounded(campaign.conversion_by(history_clusters(spark, sf_dir), "history_cluster"), 6, "mean")


@check(
    "u06_history_cluster_profile",
    f"""WITH {NUMBERED} SELECT history_cluster, round(avg(history), 2) AS history_mean, round(min(history), 2) AS history_min,
      round(max(history), 2) AS history_max, count(conversion) AS conversion_count, round(avg(conversion), 6) AS conversion_mean
    FROM hc GROUP BY history_cluster""",
)
def u06_profile(spark, sf_dir):
    profile = campaign.cluster_profile(history_clusters(spark, sf_dir))
    return rounded(profile, {"history_mean": 2, "history_min": 2, "history_max": 2, "conversion_mean": 6})


def response_model(spark, sf_dir):
    """The test customers with their fitted conversion probability."""
    scored = promotion.predict_response(stored(spark, sf_dir), ID).customers
    return materialize(campaign.offer_from_dummies(scored.where("not is_train")), "tested-responses")


@check("u07_train_response")
def u07(spark, sf_dir):
    """Conversion probability of the test customers."""
    return response_model(spark, sf_dir).select(ID, "offer", "conversion", "prediction", "proba")


@check("u02_scored_uptick_fitted")
def u02_fitted(spark, sf_dir):
    """On the fitted probabilities of the test customers."""
    return campaign.scored_uptick(response_model(spark, sf_dir))


@check("u03_population_uptick_fitted")
def u03_fitted(spark, sf_dir):
    return campaign.population_uptick(response_model(spark, sf_dir))


@check("u08_calibration_by_group_fitted")
def u08_fitted(spark, sf_dir):
    return campaign.calibration_by_group(response_model(spark, sf_dir))


@check(
    "u08_calibration_by_group",
    f"""WITH {SCORED}
    SELECT offer, round(avg(conversion), 6) AS actual, round(avg(proba), 6) AS predicted, count(*) AS rows FROM scored GROUP BY offer
    UNION ALL SELECT '(all)', round(avg(conversion), 6), round(avg(proba), 6), count(*) FROM scored""",
)
def u08(spark, sf_dir):
    return rounded(campaign.calibration_by_group(scored(spark, sf_dir)), 6, "actual", "predicted")


LABELLED = f"""{R},
cg AS (SELECT *, CASE WHEN offer = 'No Offer' THEN 'control' ELSE 'treatment' END AS campaign_group FROM r),
tc AS (SELECT *, CASE WHEN campaign_group = 'control' THEN CASE WHEN conversion > 0 THEN 1 ELSE 0 END
  ELSE CASE WHEN conversion > 0 THEN 3 ELSE 2 END END AS target_class FROM cg)"""


def labelled(spark, sf_dir):
    return campaign.target_class(campaign.campaign_group(responses(spark, sf_dir)))


@check("u09_campaign_group", f"WITH {LABELLED} SELECT customer_id, offer, campaign_group FROM cg")
def u09(spark, sf_dir):
    return campaign.campaign_group(responses(spark, sf_dir)).select(ID, "offer", "campaign_group")


@check("u10_target_class", f"WITH {LABELLED} SELECT customer_id, campaign_group, conversion, target_class FROM tc")
def u10(spark, sf_dir):
    return labelled(spark, sf_dir).select(ID, "campaign_group", "conversion", "target_class")


@check(
    "u11_class_distribution",
    f"""WITH {LABELLED} SELECT target_class, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share
    FROM tc GROUP BY target_class""",
)
def u11(spark, sf_dir):
    return rounded(evaluation.class_distribution(labelled(spark, sf_dir), "target_class"), 6, "share")


def uplift_scores(df):
    """Fitted: history clusters, then boosted trees for the four classes."""
    return promotion.predict_uplift(df, ID).customers


@check("u12_train_uplift")
def u12(spark, sf_dir):
    """Chances of the four classes for every customer."""
    scored = uplift_scores(stored(spark, sf_dir))
    return scored.select(ID, "is_train", "target_class", "prediction", *CLASS_PROBABILITIES)


@check("u13_uplift_score", f"WITH {SCORED} SELECT customer_id, round(uplift_score, 9) AS uplift_score FROM uplifted")
def u13(spark, sf_dir):
    return rounded(uplifted(spark, sf_dir).select(ID, "uplift_score"), 9, "uplift_score")


@check("u13_uplift_score_fitted")
def u13_fitted(spark, sf_dir):
    """Model scores joined back to the responses by customer."""
    df = stored(spark, sf_dir)
    scores = materialize(uplift_scores(df), "uplift-scores")
    chances = scores.select(ID, "is_train", *CLASS_PROBABILITIES)
    return campaign.attach_scores(df, scores, ID).join(chances, ID).select(
        ID, "offer", "conversion", "is_train", "uplift_score", *CLASS_PROBABILITIES
    )


@check("u14_mean_score_by_offer", f"WITH {SCORED} SELECT offer, round(avg(uplift_score), 6) AS uplift_score FROM uplifted GROUP BY offer")
def u14(spark, sf_dir):
    return rounded(campaign.mean_score_by_offer(uplifted(spark, sf_dir)), 6, "uplift_score")


def _target_sql(source: str, q: float, op: str) -> str:
    ctes = f"""{SCORED}, pool AS ({source}),
    grp AS (SELECT * FROM pool WHERE offer <> '{BOGO}' AND uplift_score {op} (SELECT quantile_cont(uplift_score, {q}) FROM pool))"""
    return _uplift_sql(ctes, "grp", ", (SELECT count(*) FROM grp) AS group_size")


EVERYBODY = "SELECT * FROM uplifted"
HELD_OUT = """SELECT * FROM uplifted WHERE customer_id IN (
  SELECT customer_id FROM (SELECT customer_id, row_number() OVER (ORDER BY md5(customer_id || '|56'), customer_id) AS i,
    count(*) OVER () AS n FROM uplifted) WHERE i <= ceil(0.2::DOUBLE * n))"""


@check("u15_high_uplift_targeting", _target_sql(EVERYBODY, 0.75, ">"))
def u15_high(spark, sf_dir):
    return rounded(campaign.quantile_targeting(stored_uplift(spark, sf_dir), 0.75, "high"), UPLIFT_DIGITS)


@check("u15_low_uplift_targeting", _target_sql(EVERYBODY, 0.5, "<"))
def u15_low(spark, sf_dir):
    return rounded(campaign.quantile_targeting(stored_uplift(spark, sf_dir), 0.5, "low"), UPLIFT_DIGITS)


def _heldout(spark, sf_dir, q, side):
    rows = stored_uplift(spark, sf_dir)
    test_ids = sampling.train_test_split(rows.select(ID), ID, 0.2, 56).where(~F.col("is_train"))
    return rounded(campaign.heldout_targeting(rows, test_ids, ID, q, side), UPLIFT_DIGITS)


@check("u16_heldout_high_targeting", _target_sql(HELD_OUT, 0.75, ">"))
def u16_high(spark, sf_dir):
    return _heldout(spark, sf_dir, 0.75, "high")


@check("u16_heldout_low_targeting", _target_sql(HELD_OUT, 0.5, "<"))
def u16_low(spark, sf_dir):
    return _heldout(spark, sf_dir, 0.5, "low")


@check(
    "u16_score_histogram",
    f"""WITH {SCORED} SELECT floor(uplift_score / 0.05::DOUBLE) * 0.05::DOUBLE AS bin_start, count(*) AS count,
      round(count(*) / (sum(count(*)) OVER () * 0.05::DOUBLE), 6) AS density FROM uplifted GROUP BY 1""",
)
def u16_histogram(spark, sf_dir):
    return rounded(experiment.histogram(uplifted(spark, sf_dir), "uplift_score", 0.05), 6, "density")


def _fitted_targeting(spark, sf_dir, report):
    df = stored(spark, sf_dir)
    both = promotion.scored_responses(df, uplift_scores(df), ID)
    return promotion.targeting_report(both, ID, report)


@check("u15_fitted_high_targeting")
def u15_fitted(spark, sf_dir):
    """The whole way: fitted scores of every customer, then the discount among the top quarter."""
    return _fitted_targeting(spark, sf_dir, "high")


@check("u16_fitted_unseen_high_targeting")
def u16_fitted(spark, sf_dir):
    return _fitted_targeting(spark, sf_dir, "unseen_high")
