"""Sales forecasting: F01 – F09."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalog.registry import D, SUPERVISED, check, rounded
from tidemark.operators import features, forecast
from tidemark.plans import sales
from tidemark.session import materialize
from tidemark.sources.star import daily_sales

LAGS = forecast.lag_names()
SCALED = ["diff", *LAGS]
SERIES = ["store"]


def monthly(spark, sf_dir, series=()):
    return forecast.resample_month(daily_sales(spark, sf_dir), series=series)


def split(spark, sf_dir, series=()):
    return sales.supervised_months(monthly(spark, sf_dir, series), series)


def supervised(spark, sf_dir):
    return split(spark, sf_dir).drop("is_train")


def scaled(spark, sf_dir):
    both = materialize(split(spark, sf_dir), "split-months")
    bounds = features.minmax_bounds(both.where("is_train"), SCALED)
    return features.minmax_scale(both, bounds, SCALED), bounds


@check("f01_resample_month", f"WITH {D} SELECT date, sales FROM monthly")
def f01(spark, sf_dir):
    return monthly(spark, sf_dir)


@check(
    "f01_resample_month_by_store",
    """WITH d AS (SELECT l_suppkey AS store, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
      sum(CAST(l_quantity AS DECIMAL(18, 4))) AS v FROM lineitem GROUP BY ALL),
    cal AS (SELECT store, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 MONTH)) AS DATE) AS date FROM d GROUP BY store)
    SELECT store, date, CAST(coalesce(v, 0) AS DOUBLE) AS sales FROM cal LEFT JOIN d USING (store, date)""",
)
def f01_store(spark, sf_dir):
    return monthly(spark, sf_dir, SERIES)


@check("f02_difference", f"WITH {D} SELECT date, sales, prev_sales, diff FROM diffs")
def f02(spark, sf_dir):
    return forecast.difference(monthly(spark, sf_dir))


@check("f03_add_lags", f"WITH {SUPERVISED} SELECT * FROM lagged")
def f03(spark, sf_dir):
    return supervised(spark, sf_dir)


@check(
    "f04_adjusted_r2_one_lag",
    f"""WITH {SUPERVISED} SELECT count(*) AS rows, round(regr_r2(diff, lag_1), 6) AS r2,
      round(1 - (1 - regr_r2(diff, lag_1)) * (count(*) - 1) / (count(*) - 2), 6) AS adjusted_r2 FROM lagged""",
)
def f04_single(spark, sf_dir):
    return rounded(forecast.adjusted_r2_single(supervised(spark, sf_dir), "diff", "lag_1"), 6, "r2", "adjusted_r2")


def elimination_sql(rows: str, wanted: str, lags: int = 12, key: str = "one") -> str:
    """Least squares of ``diff`` on a constant and the lags by elimination, for each ``key`` of ``rows``.

    In the table of products the constant is column 0, the lags follow and ``diff`` is last.  After
    column k is taken out, the product of ``diff`` with itself is what k columns leave unexplained.
    Rows of ``wanted`` stand below the table with a 0 for ``diff``; there it becomes the
    prediction, with its sign turned.
    """
    cells = f"[1.0::DOUBLE, {', '.join(f'lag_{i}' for i in range(1, lags + 1))}, diff]"
    tables = [
        f"""px AS (SELECT {key}, {cells} AS x FROM {rows}),
pc AS (SELECT {key}, n, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM (SELECT *, row_number() OVER () AS n FROM px)),
wx AS (SELECT {key}, date, {cells} AS x FROM {wanted}),
g0 AS MATERIALIZED (
  SELECT a.{key}, CAST(NULL AS DATE) AS date, a.i, b.i AS j, sum(a.v * b.v) AS v FROM pc a JOIN pc b ON a.n = b.n GROUP BY ALL
  UNION ALL
  SELECT {key}, date, {lags + 2}, j, CASE WHEN j > {lags} THEN 0 ELSE v END
  FROM (SELECT {key}, date, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS j FROM wx))"""
    ]
    for k in range(lags + 1):
        tables.append(
            f"""g{k + 1} AS MATERIALIZED (
  SELECT s.{key}, s.date, s.i, s.j, s.v - c.v * r.v / p.v AS v
  FROM g{k} s JOIN g{k} p ON p.{key} = s.{key} AND p.i = {k} AND p.j = {k} JOIN g{k} r ON r.{key} = s.{key} AND r.i = {k} AND r.j = s.j
  JOIN g{k} c ON c.{key} = s.{key} AND c.j = {k} AND c.i = s.i AND c.date IS NOT DISTINCT FROM s.date
  WHERE s.i > {k} AND s.j > {k})"""
        )
    return ",\n".join(tables)


def _left_sql(k: int) -> str:
    return f"(SELECT v FROM g{k} WHERE i = 13 AND j = 13)"


@check(
    "f04_adjusted_r2",
    f"""WITH {SUPERVISED}, numbered AS (SELECT *, 1 AS one FROM lagged), {elimination_sql("numbered", "(SELECT * FROM numbered WHERE FALSE)")},
    fit AS (SELECT CAST(k AS INTEGER) AS features, 1 - rss / {_left_sql(1)} AS r2, (SELECT count(*) FROM lagged) AS n
      FROM (VALUES (1, {_left_sql(2)}), (5, {_left_sql(6)}), (12, {_left_sql(13)})) AS t(k, rss))
    SELECT features, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - features - 1), 6) AS adjusted_r2 FROM fit""",
)
def f04(spark, sf_dir):
    """One, five and twelve lags."""
    rows = materialize(supervised(spark, sf_dir), "lagged-months")
    fits = [forecast.adjusted_r2(rows, "diff", LAGS[:n]) for n in (1, 5, 12)]
    return rounded(reduce(lambda a, b: a.unionByName(b), fits), 6, "r2", "adjusted_r2")


@check("f05_chronological_split", f"WITH {SUPERVISED} SELECT date, diff, lag_1, is_train FROM split")
def f05(spark, sf_dir):
    return split(spark, sf_dir).select("date", "diff", "lag_1", "is_train")


def _scaled_sql() -> str:
    bounds = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in SCALED)
    values = ", ".join(
        f"round(({c} - lo_{c}) / CASE WHEN hi_{c} = lo_{c} THEN 1 ELSE hi_{c} - lo_{c} END * 2 - 1, 9) AS {c}" for c in SCALED
    )
    return f"{SUPERVISED}, b AS (SELECT {bounds} FROM split WHERE is_train), sc AS (SELECT date, is_train, {values} FROM split, b)"


@check("f06_minmax_scale", f"WITH {_scaled_sql()} SELECT * FROM sc")
def f06(spark, sf_dir):
    return rounded(scaled(spark, sf_dir)[0].drop("sales"), 9, *SCALED)


@check("f06_minmax_inverse", f"WITH {SUPERVISED} SELECT date, round(diff, 4) AS diff, round(lag_12, 4) AS lag_12 FROM split")
def f06_inverse(spark, sf_dir):
    rows, bounds = scaled(spark, sf_dir)
    restored = features.minmax_inverse(rows, bounds, {"diff": "diff", "lag_12": "lag_12"})
    return rounded(restored.select("date", "diff", "lag_12"), 4, "diff", "lag_12")


PREDICTED = f"""{SUPERVISED}, numbered AS (SELECT *, 1 AS one FROM split),
{elimination_sql("(SELECT * FROM numbered WHERE is_train)", "(SELECT * FROM numbered WHERE NOT is_train)")},
predicted AS (SELECT date, -v AS pred FROM g13 WHERE date IS NOT NULL AND j = 13)"""


@check("f07_forecast_next", f"WITH {PREDICTED} SELECT date, round(pred, 4) AS pred FROM predicted")
def f07(spark, sf_dir):
    """Predicted change of the last six months, on scaled values, back in units."""
    rows, bounds = scaled(spark, sf_dir)
    predicted = features.minmax_inverse(forecast.forecast_next(rows), bounds, {"pred": "diff"})
    return rounded(predicted.select("date", "pred"), 4, "pred")


def fit_facts(rows, series=()):
    """``fits``: residuals of the training months, and their products with each lag, add up to nothing.

    The training months are predicted too, as if they were test months.
    """
    train = rows.where("is_train")
    again = train.withColumn("is_train", F.lit(False)).withColumn("_again", F.lit(True))
    both = train.withColumn("_again", F.lit(False)).unionByName(again)
    predicted = forecast.forecast_next(both, series=series)
    residual = F.col("diff") - F.col("pred")
    products = [F.abs(F.sum(residual * x)) <= 1e-5 * (F.sum(F.abs(F.col("diff") * x)) + 1e-3) for x in [F.lit(1.0), *map(F.col, LAGS)]]
    return predicted.groupBy(*series).agg(reduce(lambda a, b: a & b, products).alias("fits"))


STORE_LAGS = ", ".join(f"lag(diff, {i}) OVER (PARTITION BY store ORDER BY date) AS lag_{i}" for i in range(1, len(LAGS) + 1))
STORES = f"""d AS (SELECT l_suppkey AS store, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
  sum(CAST(l_quantity AS DECIMAL(18, 4))) AS v FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY ALL),
cal AS (SELECT store, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 MONTH)) AS DATE) AS date FROM d GROUP BY store),
monthly AS (SELECT store, date, CAST(coalesce(v, 0) AS DOUBLE) AS sales FROM cal LEFT JOIN d USING (store, date)),
diffs AS (SELECT *, sales - lag(sales) OVER (PARTITION BY store ORDER BY date) AS diff,
  row_number() OVER (PARTITION BY store ORDER BY date) AS i FROM monthly),
lagged AS (SELECT *, {STORE_LAGS} FROM diffs),
split AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY date DESC) > 6 AS is_train FROM lagged WHERE i > 13)"""


@check(
    "f07_forecast_next_by_store",
    f"""WITH {STORES},
    {elimination_sql("(SELECT * FROM split WHERE is_train)", "(SELECT * FROM split WHERE NOT is_train)", key="store")},
    forecasts AS (SELECT store, date, -v AS pred FROM g13 WHERE date IS NOT NULL AND j = 13),
    learnt AS (SELECT *, bool_or(is_train) OVER (PARTITION BY store) AS predicted FROM split)
    SELECT store, date, diff, round(pred, 4) AS pred, predicted, CASE WHEN predicted THEN TRUE END AS fits
    FROM learnt LEFT JOIN forecasts USING (store, date) WHERE NOT is_train""",
)
def f07_store(spark, sf_dir):
    """A fit per store, with its facts; where a store has fewer months than lags, the shortest of the best weights.

    Such weights are not in the SQL, whose elimination needs months that determine them.
    """
    rows = materialize(split(spark, sf_dir, SERIES), "split-store-months")
    predicted = rounded(forecast.forecast_next(rows, series=SERIES), 4, "pred")
    found = predicted.select("store", "date", "diff", "pred", F.col("pred").isNotNull().alias("predicted"))
    return found.join(fit_facts(rows, SERIES), SERIES, "left")


LEVELS = f"""{SUPERVISED}, levels AS (
  SELECT p.date AS date, CAST(trunc(p.lag_12 + m.sales) AS BIGINT) AS pred_value
  FROM split p JOIN monthly m ON m.date = CAST(p.date - INTERVAL 1 MONTH AS DATE) WHERE NOT is_train)"""


def naive_levels(spark, sf_dir):
    """The change of a year ago as a fixed prediction, so that the levels can be checked exactly."""
    test = split(spark, sf_dir).where(~F.col("is_train")).withColumn("pred", F.col("lag_12"))
    return forecast.rebuild_levels(test, monthly(spark, sf_dir))


@check("f08_rebuild_levels", f"WITH {LEVELS} SELECT date, pred_value FROM levels")
def f08(spark, sf_dir):
    return naive_levels(spark, sf_dir)


@check("f09_actual_vs_predicted", f"WITH {LEVELS} SELECT date, sales, pred_value FROM monthly LEFT JOIN levels USING (date)")
def f09(spark, sf_dir):
    return forecast.actual_vs_predicted(monthly(spark, sf_dir), naive_levels(spark, sf_dir))


@check(
    "f09_forecast_report",
    f"""WITH {PREDICTED}
    SELECT m.date AS date, m.sales AS sales, CAST(trunc(pred + before.sales) AS BIGINT) AS pred_value
    FROM monthly m LEFT JOIN predicted p ON p.date = m.date
    LEFT JOIN monthly before ON before.date = CAST(m.date - INTERVAL 1 MONTH AS DATE)""",
)
def f09_report(spark, sf_dir):
    """The whole way: fitted changes of the last six months as levels next to the actual months."""
    return sales.forecast_report(daily_sales(spark, sf_dir)).select("date", "sales", "pred_value")


@check("f09_forecast_report_by_store")
def f09_report_store(spark, sf_dir):
    return sales.forecast_report(daily_sales(spark, sf_dir), SERIES).select("store", "date", "sales", "pred_value")
