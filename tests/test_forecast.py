import datetime as dt

import numpy as np
import pytest

from tidemark.operators import forecast


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture
def sales(rows):
    return lambda data: rows([(s, day(d), v) for s, d, v in data], "store string, date date, sales double")


def test_months_without_rows_appear_with_zero(sales, table):
    monthly = forecast.resample_month(sales([("a", "2010-11-30", 1.0), ("a", "2010-11-02", 2.0), ("a", "2011-02-01", 4.0)]))
    assert table(monthly, "date", "sales") == [
        (day("2010-11-01"), 3.0),
        (day("2010-12-01"), 0.0),
        (day("2011-01-01"), 0.0),
        (day("2011-02-01"), 4.0),
    ]


def test_every_series_has_its_own_calendar(sales, table):
    data = sales([("a", "2011-01-01", 1.0), ("a", "2011-03-01", 1.0), ("b", "2011-02-01", 5.0)])
    assert table(forecast.resample_month(data, series=["store"]), "store", "sales") == [
        ("a", 0.0),
        ("a", 1.0),
        ("a", 1.0),
        ("b", 5.0),
    ]


def series(spark, n=40, stores=("a", "b")):
    rng = np.random.default_rng(0)
    data = []
    for s in stores:
        level = 100.0
        for i in range(n):
            level += float(rng.integers(-9, 10))
            data.append((s, dt.date(2008 + i // 12, i % 12 + 1, 1), level))
    return spark.createDataFrame(data, "store string, date date, sales double")


def test_lags_follow_the_dates(spark):
    lagged = forecast.add_lags(forecast.difference(series(spark, 10, ("a",))), n=2).orderBy("date").collect()
    assert len(lagged) == 10 - 1 - 2
    for older, newer in zip(lagged, lagged[1:]):
        assert (newer["lag_1"], newer["lag_2"]) == (older["diff"], older["lag_1"])


def test_split_is_by_date_and_series(spark):
    split = forecast.chronological_split(series(spark, 10), 3, ["store"])
    test = split.where("not is_train").groupBy("store").agg({"date": "min", "*": "count"}).collect()
    assert {(r[1], r[2]) for r in test} == {(dt.date(2008, 8, 1), 3)} or {(r[2], r[1]) for r in test} == {(dt.date(2008, 8, 1), 3)}


def test_batch_fit_equals_least_squares_per_series(spark):
    lags = forecast.lag_names(3)
    lagged = forecast.add_lags(forecast.difference(series(spark), series=["store"]), n=3, series=["store"])
    split = forecast.chronological_split(lagged, 6, ["store"])
    got = forecast.forecast_next(split, features=lags, series=["store"]).collect()
    assert len(got) == 12
    local = split.toPandas().sort_values("date")
    for store, group in local.groupby("store"):
        x = np.column_stack([np.ones(len(group)), group[lags]])
        train = group["is_train"].to_numpy()
        w, *_ = np.linalg.lstsq(x[train], group["diff"].to_numpy()[train], rcond=None)
        want = dict(zip(group["date"][~train], (x @ w)[~train]))
        for r in got:
            if r.store == store:
                assert r.pred == pytest.approx(want[r.date], abs=1e-8)


def test_one_fit_for_the_total_equals_the_per_series_fit(spark):
    lags = forecast.lag_names(3)
    lagged = forecast.add_lags(forecast.difference(series(spark, stores=("a",))), n=3)
    split = forecast.chronological_split(lagged, 6)
    total = {r.date: r.pred for r in forecast.forecast_next(split, features=lags).collect()}
    single = {r.date: r.pred for r in forecast.forecast_next(split, features=lags, series=["store"]).collect()}
    assert total == pytest.approx(single, abs=1e-6)


def test_series_without_training_months_stays_unknown(spark):
    lags = forecast.lag_names(2)
    lagged = forecast.add_lags(forecast.difference(series(spark, 6), series=["store"]), n=2, series=["store"])
    split = forecast.chronological_split(lagged, 6, ["store"])
    assert {r.pred for r in forecast.forecast_next(split, features=lags, series=["store"]).collect()} == {None}


def test_adjusted_r2_for_one_feature_both_ways(spark):
    lagged = forecast.add_lags(forecast.difference(series(spark, stores=("a",))), n=2)
    plain = forecast.adjusted_r2_single(lagged, "diff", "lag_1").first()
    fitted = forecast.adjusted_r2(lagged, "diff", ["lag_1"]).first()
    assert (plain.r2, plain.adjusted_r2) == pytest.approx((fitted.r2, fitted.adjusted_r2))


def test_levels_are_cut_and_joined_by_month(rows, sales, table):
    monthly = forecast.resample_month(sales([("a", "2010-11-01", 10.0), ("a", "2010-12-01", 20.0), ("a", "2011-01-01", 30.0)]))
    predicted = rows([(day("2010-12-01"), 1.9), (day("2011-01-01"), -50.9)], "date date, pred double")
    levels = forecast.rebuild_levels(predicted, monthly)
    assert table(levels) == [(day("2010-12-01"), 11), (day("2011-01-01"), -30)]
    compared = forecast.actual_vs_predicted(monthly, levels)
    assert table(compared, "sales", "pred_value") == [(10.0, None), (20.0, 11), (30.0, -30)]


def test_store_forecasts_come_with_their_facts(spark, monkeypatch):
    """Learnt from all training months, predicted where there are some, and checked against all of them."""
    from catalog import ORACLES, QUERIES, forecasting

    draw = np.random.default_rng(3)
    rows = [("a", day("2010-01-01") + dt.timedelta(31 * i), i < 40) for i in range(46)]
    rows += [("b", day("2010-01-01") + dt.timedelta(31 * i), False) for i in range(6)]
    rows = [(s, d, *draw.normal(size=13).tolist(), t) for s, d, t in rows]
    lags = ", ".join(f"{c} double" for c in forecast.lag_names())
    months = spark.createDataFrame(rows, f"store string, date date, diff double, {lags}, is_train boolean")
    monkeypatch.setattr(forecasting, "split", lambda *_: months)
    name = "f07_forecast_next_by_store"
    assert name in ORACLES
    found = QUERIES[name](spark, "").collect()
    assert len(found) == 12
    for r in found:
        assert (r["predicted"], r["fits"]) == ((True, True) if r["store"] == "a" else (False, None))
        assert (r["pred"] is None) == (r["store"] == "b")

    weights = forecast._weights
    monkeypatch.setattr(forecast, "_weights", lambda *a: weights(*a).selectExpr("store", "transform(_w, x -> x + 0.1) AS _w"))
    assert {r["fits"] for r in QUERIES[name](spark, "").collect() if r["store"] == "a"} == {False}
