import pytest
from pyspark.sql import functions as F

from tidemark.operators import campaign, churn, features

SCHEMA = "customer_id long, offer string, conversion int"


def make(*groups):
    """(offer, customers, converted) -> one row per customer."""
    out, i = [], 0
    for offer, n, yes in groups:
        for j in range(n):
            out.append((i, offer, int(j < yes)))
            i += 1
    return out


THREE = make(("No Offer", 10, 1), ("Discount", 20, 6), ("Buy One Get One", 5, 1))


def test_uplift_over_control(rows):
    got = {r.offer: r for r in campaign.campaign_uplift(rows(THREE, SCHEMA)).collect()}
    assert set(got) == {"Discount", "Buy One Get One"}
    d = got["Discount"]
    assert (d.customers, d.conversion_uplift, d.order_uplift) == (20, pytest.approx(0.2), pytest.approx(4.0))
    assert (d.revenue_uplift, d.revenue_per_target) == (pytest.approx(100.0), pytest.approx(5.0))


def test_missing_offer_and_missing_control(rows):
    two = rows(make(("No Offer", 4, 1), ("Discount", 4, 2)), SCHEMA)
    assert [r.offer for r in campaign.campaign_uplift(two).collect()] == ["Discount"]
    lonely = campaign.campaign_uplift(rows(make(("Discount", 4, 2)), SCHEMA)).first()
    assert lonely.conversion_uplift is None and lonely.customers == 4


def test_uptick_on_dummies_and_on_population(rows):
    scored = rows(THREE, SCHEMA).withColumn("proba", F.lit(0.5))
    encoded = features.one_hot(scored)
    got = {(r.offer, r.target): r for r in campaign.scored_uptick(campaign.offer_from_dummies(encoded)).collect()}
    assert got["Discount", "conversion"].order_uplift == pytest.approx(4.0)
    assert got["Discount", "proba"].order_uplift == 0.0
    whole = {(r.offer, r.target): r for r in campaign.population_uptick(scored).collect()}
    assert whole["Discount", "conversion"].order_uplift == pytest.approx(0.2 * 35)


def test_calibration_has_an_overall_row_and_no_null_group(rows):
    scored = rows(THREE + [(99, None, 1)], SCHEMA).withColumn("proba", F.lit(0.5))
    got = {r.offer: r for r in campaign.calibration_by_group(scored).collect()}
    assert set(got) == {"No Offer", "Discount", "Buy One Get One", "(all)"}
    assert got["(all)"].rows == 36 and got["(all)"].actual == pytest.approx(9 / 36)


def test_classes(rows, table):
    data = rows([(1, "No Offer", 0), (2, "No Offer", 1), (3, "Discount", 0), (4, "Discount", 1), (5, None, 1)], SCHEMA)
    labelled = campaign.target_class(campaign.campaign_group(data))
    assert table(labelled, "customer_id", "target_class") == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 3)]


def test_quantile_is_taken_before_the_offer_is_excluded(rows):
    scores = [(i, "Buy One Get One" if i >= 6 else ("Discount" if i % 2 else "No Offer"), 1, float(i)) for i in range(9)]
    scored = rows(scores, SCHEMA + ", uplift_score double")
    # Median over all nine is 4; the remaining offers have scores 0 … 5.
    assert {r.customer_id for r in campaign.quantile_target(scored, 0.5, "high").collect()} == {5}
    assert {r.customer_id for r in campaign.quantile_target(scored, 0.5, "low").collect()} == {0, 1, 2, 3}
    report = campaign.quantile_targeting(scored, 0.5, "low").first()
    assert (report.group_size, report.customers, report.conversion_uplift) == (4, 2, 0.0)
    ids = rows([(0,), (1,), (2,)], "customer_id long")
    held = campaign.heldout_targeting(scored, ids, "customer_id", 0.5, "low").collect()
    assert held == [] or held[0].group_size == 1


def test_rates(rows, table):
    data = rows([("a", "x", 1), ("a", "y", 0), ("b", "x", None), (None, "x", 1)], "k string, j string, Churn int")
    assert table(churn.rate_by_category(data, "k")) == [("a", 0.5, 2), ("b", None, 0)]
    assert table(churn.rate_by_categories(data, ["k", "j"])) == [
        ("j", "x", 1.0, 2),
        ("j", "y", 0.0, 1),
        ("k", "a", 0.5, 2),
        ("k", "b", None, 0),
    ]


def test_numeric_rates_cut_towards_zero(rows, table):
    data = rows([(1.9, 1), (1.1, 0), (-0.5, 1), (None, 1)], "x double, Churn int")
    assert table(churn.rate_by_numeric(data, "x", bins="int")) == [(0, 1.0), (1, 0.5)]
    texts = rows([("1.9", 1, 1), (" ", 1, 1), ("1.2", None, 0), ("1.5", 3, 0)], "t string, other int, Churn int")
    assert table(churn.rate_by_parsed(texts, "t")) == [(1, 0.5)]


def test_groups_are_ranked_by_tenure_unless_told_otherwise(rows, table):
    # High charges come with short tenure.
    data = rows([(1, 10.0), (2, 10.0), (50, 5.0), (60, 5.0), (90, 1.0)], "tenure int, charge double")
    fixed = {"charge": [1.0, 5.0, 10.0]}
    by_tenure = churn.numeric_groups(data, {"charge": "g"}, centers=fixed)
    assert table(by_tenure, "tenure", "g") == [(1, "Low"), (2, "Low"), (50, "Mid"), (60, "Mid"), (90, "High")]
    by_self = churn.numeric_groups(data, {"charge": "g"}, order_by=None, centers=fixed)
    assert table(by_self, "tenure", "g") == [(1, "High"), (2, "High"), (50, "Mid"), (60, "Mid"), (90, "Low")]
