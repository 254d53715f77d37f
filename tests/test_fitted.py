"""Queries with fitted models: right sums of what the model says, and a model that has learnt.

A model that answers the same for everybody fails every test here.
"""

import math
from collections import Counter

import numpy as np
import pytest

from tidemark.functions.tails import t_power

# Fixed value: what an order is worth in the campaign.
ORDER_VALUE = 25
CLASSES = ("proba_CN", "proba_CR", "proba_TN", "proba_TR")


def log_loss(rows, label, chances):
    return -np.mean([math.log(max(chances(r)[int(r[label])], 1e-15)) for r in rows])


def learnt(rows, label, chances, least=0.9):
    """The log loss of the rows is clearly below that of the shares of the classes."""
    counts = Counter(r[label] for r in rows)
    constant = -sum(n / len(rows) * math.log(n / len(rows)) for n in counts.values())
    assert log_loss(rows, label, chances) < least * constant


def binary(r):
    return [1 - r["proba"], r["proba"]]


def test_churn_scores(collected):
    rows = collected("c15_score")
    assert all(r["prediction"] == float(r["proba"] > 0.5) for r in rows)
    learnt([r for r in rows if r["is_train"]], "Churn", binary)
    held = [r for r in rows if not r["is_train"]]
    assert len(held) == math.ceil(0.05 * len(rows))


def test_churn_accuracy_and_report(collected):
    scores = collected("c15_score")
    for row in collected("c13_train_binary"):
        own = [r for r in scores if r["is_train"] == row["is_train"]]
        ones = np.mean([r["Churn"] for r in own])
        assert row["rows"] == len(own)
        assert row["accuracy"] == pytest.approx(np.mean([r["prediction"] == r["Churn"] for r in own]))
        assert row["commoner"] == pytest.approx(max(ones, 1 - ones))
        if row["is_train"]:
            assert row["accuracy"] > row["commoner"] + 0.1
    held = [r for r in scores if not r["is_train"]]
    by_class = {r["class"]: r for r in collected("c13_fitted_report")}
    for c in (0, 1):
        hits = sum(r["Churn"] == c == r["prediction"] for r in held)
        support, said = sum(r["Churn"] == c for r in held), sum(r["prediction"] == c for r in held)
        if str(c) in by_class and support and said:
            found = by_class[str(c)]
            assert found["support"] == support
            assert found["precision"] == pytest.approx(hits / said) and found["recall"] == pytest.approx(hits / support)


def test_churn_importance(collected):
    rows = collected("c14_feature_importance")
    assert [r["splits"] for r in rows] == sorted((r["splits"] for r in rows), reverse=True)
    assert sum(r["gain"] for r in rows) == pytest.approx(1)
    assert all((r["splits"] > 0) == (r["gain"] > 0) for r in rows)
    # In these tables churn follows from the months between the first and the last order.
    assert max(rows, key=lambda r: r["gain"])["feature"].startswith("tenure")


def test_churn_regression(spark, sf_dir, collected):
    """Residuals add up to nothing over every column, all levels of all categories included."""
    from catalog.churn import encoded

    fitted = {r["feature"]: r for r in collected("c11_logistic_summary")}
    rows = [r.asDict() for r in encoded(spark, sf_dir).collect()]
    names = [n for n in fitted if n != "Intercept"]
    assert {"gender", "TenureCluster_Low"} <= set(names)
    x = np.array([[float(r[n]) for n in names] + [1.0] for r in rows])
    y = np.array([float(r["Churn"]) for r in rows])
    beta = np.array([fitted[n]["coefficient"] for n in [*names, "Intercept"]])
    residual = y - 1 / (1 + np.exp(-x @ beta))
    scale = np.abs(x).sum(0)
    assert (np.abs(residual @ x) <= 1e-4 * (scale + 1)).all() and np.abs(beta).max() > 0.1
    assert all(math.isfinite(r["std_error"]) and 0 <= r["p_value"] <= 1 for r in fitted.values())
    ratios = {r["feature"]: r["odds_ratio"] for r in collected("c12_odds_ratios")}
    assert ratios == pytest.approx({n: math.exp(r["coefficient"]) for n, r in fitted.items()})


def responses(collected):
    return collected("u07_train_response")


def test_response_scores(collected):
    rows = responses(collected)
    assert all(r["prediction"] == float(r["proba"] > 0.5) for r in rows)
    # Thirty customers say little of the model; what it has learnt shows in the uplift classes, fitted on the same columns.
    assert np.std([r["proba"] for r in rows]) > 0.05


@pytest.mark.parametrize("name, everybody", [("u02_scored_uptick_fitted", False), ("u03_population_uptick_fitted", True)])
def test_upticks_of_fitted_scores(collected, name, everybody):
    rows = responses(collected)
    rate = {
        (offer, target): np.mean([r[target] for r in rows if r["offer"] == offer])
        for offer in {r["offer"] for r in rows} for target in ("conversion", "proba")
    }
    found = collected(name)
    assert {(r["offer"], r["target"]) for r in found} == {k for k in rate if k[0] != "No Offer"}
    for r in found:
        up = rate[r["offer"], r["target"]] - rate["No Offer", r["target"]]
        n = len(rows) if everybody else sum(x["offer"] == r["offer"] for x in rows)
        assert r["customers"] == n
        assert r["conversion_uplift"] == pytest.approx(up, abs=1e-9)
        assert r["revenue_uplift"] == pytest.approx(up * n * ORDER_VALUE, abs=1e-6)


def test_calibration_of_fitted_scores(collected):
    rows = responses(collected)
    for r in collected("u08_calibration_by_group_fitted"):
        own = [x for x in rows if r["offer"] in ("(all)", x["offer"])]
        assert r["rows"] == len(own)
        assert r["actual"] == pytest.approx(np.mean([x["conversion"] for x in own]))
        assert r["predicted"] == pytest.approx(np.mean([x["proba"] for x in own]))


def test_uplift_classes(collected):
    rows = collected("u12_train_uplift")
    for r in rows:
        chances = [r[c] for c in CLASSES]
        assert sum(chances) == pytest.approx(1)
        assert chances[int(r["prediction"])] == max(chances)
    learnt([r for r in rows if r["is_train"]], "target_class", lambda r: [r[c] for c in CLASSES])


def test_uplift_score_is_its_formula(collected):
    rows = collected("u13_uplift_score_fitted")
    for r in rows:
        assert r["uplift_score"] == pytest.approx(r["proba_CN"] + r["proba_TR"] - r["proba_TN"] - r["proba_CR"], abs=1e-9)
    assert np.std([r["uplift_score"] for r in rows]) > 0.05


@pytest.mark.parametrize("name, unseen", [("u15_fitted_high_targeting", False), ("u16_fitted_unseen_high_targeting", True)])
def test_targeting_by_fitted_scores(collected, name, unseen):
    """The group recounted; the cut is checked by how many scores lie below, at and above it."""
    pool = [r for r in collected("u13_uplift_score_fitted") if not (unseen and r["is_train"])]
    scores = np.array([r["uplift_score"] for r in pool])
    cut = float(np.quantile(scores, 0.75))
    below, at, above = (int((scores < cut).sum()), int((scores == cut).sum()), int((scores > cut).sum()))
    assert below <= 0.75 * (len(scores) - 1) + 1 and above <= 0.25 * (len(scores) - 1) + 1 and below + at + above == len(scores)
    group = [r for r in pool if r["uplift_score"] > cut + 1e-12 and r["offer"] != "Buy One Get One"]
    for r in collected(name):
        own = [x["conversion"] for x in group if x["offer"] == r["offer"]]
        base = [x["conversion"] for x in group if x["offer"] == "No Offer"]
        assert r["customers"] == len(own) and r["group_size"] == len(group)
        if own and base:
            assert r["conversion_uplift"] == pytest.approx(np.mean(own) - np.mean(base), abs=1e-9)


def test_value_clusters(collected):
    rows = collected("l09_train_multiclass")
    names = ("proba_0", "proba_1", "proba_2")
    for r in rows:
        chances = [r[n] for n in names]
        assert sum(chances) == pytest.approx(1)
        assert chances[int(r["prediction"])] == max(chances)
    learnt([r for r in rows if r["is_train"]], "LTVCluster", lambda r: [r[n] for n in names])


@pytest.mark.parametrize("name", ["x08_required_sample_size", "x08_sample_size_for_target"])
def test_sample_sizes_reach_the_power(collected, name):
    """The whole part of the size just fails, one more suffices."""
    for r in collected(name):
        effect, n = r["effect_size"], r["sample_size"]
        assert t_power(effect, n, 0.05, 1.0) <= 0.8 + 1e-9 and t_power(effect, n + 1, 0.05, 1.0) >= 0.8 - 1e-9


def test_forecasts_by_store_are_least_squares(spark, sf_dir, collected):
    """Against NumPy, store by store; and the levels follow from them."""
    from catalog.forecasting import LAGS, SERIES, split

    rows = [r.asDict() for r in split(spark, sf_dir, SERIES).collect()]
    found = {(r["store"], r["date"]): r["pred"] for r in collected("f07_forecast_next_by_store")}
    for store in {r["store"] for r in rows}:
        own = [r for r in rows if r["store"] == store]
        x = lambda part: np.array([[1.0] + [float(r[c]) for c in LAGS] for r in part])
        train, test = [r for r in own if r["is_train"]], [r for r in own if not r["is_train"]]
        weights = np.linalg.lstsq(x(train), np.array([float(r["diff"]) for r in train]), rcond=None)[0]
        for r, p in zip(test, x(test) @ weights):
            assert found[store, r["date"]] == pytest.approx(p, rel=1e-5, abs=1e-3)
    levels = collected("f09_forecast_report_by_store")
    sales = {(r["store"], r["date"]): r["sales"] for r in levels}
    for r in levels:
        pred = found.get((r["store"], r["date"]))
        if pred is None:
            assert r["pred_value"] is None
        else:
            month = r["date"]
            before = month.replace(year=month.year - (month.month == 1), month=(month.month - 2) % 12 + 1)
            assert abs(r["pred_value"] - (pred + sales[r["store"], before])) <= 1 + 1e-6
