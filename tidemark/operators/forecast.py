"""Monthly sales forecasting, for one total series or for many series at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.regression import fit_least_squares
from tidemark.session import materialize

# Number of lags, number of test months.
N_LAGS = 12
N_TEST = 6


def lag_names(n: int = N_LAGS) -> list[str]:
    return [f"lag_{i}" for i in range(1, n + 1)]


def _in_order(series: Sequence[str], date: str = "date"):
    """Month rows of one series; without series keys all months of the total (a short list)."""
    return Window.partitionBy(*(series or [F.lit(1)])).orderBy(date)


def resample_month(sales: DataFrame, value: str = "sales", series: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Total per calendar month (and series), labelled by the first of the month.

    Months without rows between the first and last month of the data appear with 0.
    """
    series = list(series)
    total = F.sum(F.col(value).cast("double")).alias(value)
    # Calendar and values both come from the month totals, so these are stored: the sales are read once.
    monthly = materialize(sales.groupBy(*series, F.trunc(date, "month").alias("date")).agg(total), "month-totals")
    calendar = monthly.groupBy(*series).agg(F.min("date").alias("first"), F.max("date").alias("last")).select(
        *series, F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("date")
    )
    return calendar.join(monthly, [*series, "date"], "left").fillna(0.0, [value])


def difference(monthly: DataFrame, value: str = "sales", series: Sequence[str] = ()) -> DataFrame:
    """Previous month's value and the change; the first month is dropped."""
    previous = F.lag(value).over(_in_order(series))
    return (
        monthly.withColumn(f"prev_{value}", previous)
        .dropna()
        .withColumn("diff", F.col(value) - F.col(f"prev_{value}"))
    )


def add_lags(diffs: DataFrame, col: str = "diff", n: int = N_LAGS, series: Sequence[str] = ()) -> DataFrame:
    """``lag_1`` … ``lag_n`` of a column; months without a full history are dropped."""
    window = _in_order(series)
    lags = {name: F.lag(col, i).over(window) for i, name in enumerate(lag_names(n), 1)}
    return diffs.withColumns(lags).dropna(subset=list(lags))


def adjusted_r2(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Adjusted R² of a least-squares fit with intercept; null where rows are too few for it."""
    n, k = df.dropna(subset=[label, *features]).count(), len(features)
    r2 = fit_least_squares(df, label, features).r2()
    adjusted = 1 - (1 - r2) * (n - 1) / (n - k - 1) if n > k + 1 else None
    return df.sparkSession.createDataFrame([(k, r2, adjusted)], "features int, r2 double, adjusted_r2 double")


def adjusted_r2_single(df: DataFrame, label: str, feature: str, series: Sequence[str] = ()) -> DataFrame:
    """:func:`adjusted_r2` for one feature as a plain aggregate, for any number of series."""
    n = F.count(F.lit(1))
    r2 = F.regr_r2(label, feature)
    adjusted = 1 - (1 - r2) * F.try_divide((n - 1).cast("double"), (n - 2).cast("double"))
    return df.groupBy(*series).agg(n.alias("rows"), r2.alias("r2"), adjusted.alias("adjusted_r2"))


def chronological_split(df: DataFrame, n_test: int = N_TEST, series: Sequence[str] = ()) -> DataFrame:
    """Adds ``is_train``: false for the last ``n_test`` months (of each series)."""
    from_end = F.row_number().over(Window.partitionBy(*(series or [F.lit(1)])).orderBy(F.desc("date")))
    return df.withColumn("is_train", from_end > n_test)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(upper: pd.Series, right: pd.Series) -> pd.Series:
    """Least-squares weights of many series at once, from their sums of products.

    The pseudo-inverse gives the smallest solution when a series has too few months.
    """
    if upper.empty:
        return pd.Series([], dtype=object)
    y = np.stack(right.to_numpy())
    n = y.shape[1]
    rows, cols = np.triu_indices(n)
    gram = np.zeros((len(y), n, n))
    gram[:, rows, cols] = gram[:, cols, rows] = np.stack(upper.to_numpy())
    weights = np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ y[:, :, None]
    return pd.Series(list(weights[:, :, 0]))


def _weights(train: DataFrame, label: str, features: Sequence[str], series: Sequence[str]) -> DataFrame:
    """Intercept and weights per series.

    Spark adds up the products of each pair of columns, so no series is ever collected
    and only these sums, one row per series, reach Python.
    """
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    upper = [F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
    right = [F.sum(c * F.col(label)) for c in x]
    sums = train.groupBy(*series).agg(F.array(*upper).alias("_upper"), F.array(*right).alias("_right"))
    return sums.select(*series, _solve("_upper", "_right").alias("_w"))


def forecast_next(
    split: DataFrame,
    label: str = "diff",
    features: Sequence[str] | None = None,
    series: Sequence[str] = (),
    output: str = "pred",
) -> DataFrame:
    """One-step-ahead linear prediction from the lags for every test month.

    Without series keys one distributed fit serves all rows.  With them each series gets
    its own fit, all of them in one aggregate; a series without training months gets null.
    """
    features = list(features or lag_names())
    series = list(series)
    if not series:
        weights = fit_least_squares(split.where("is_train"), label, features).weights.tolist()
        linear = reduce(lambda total, w: total + w[0] * F.col(w[1]), zip(weights[1:], features), F.lit(weights[0]))
        return split.where(~F.col("is_train")).withColumn(output, linear)

    weights = _weights(split.where("is_train"), label, features, series)
    predicted = reduce(
        lambda total, i: total + F.col("_w")[i + 1] * F.col(features[i]), range(len(features)), F.col("_w")[0]
    )
    test = split.where(~F.col("is_train")).join(weights, series, "left")
    return test.withColumn(output, predicted).drop("_w")


def rebuild_levels(
    predicted: DataFrame, monthly: DataFrame, value: str = "sales", series: Sequence[str] = (), diff: str = "pred"
) -> DataFrame:
    """Predicted level = predicted change + *actual* previous month, cut to a whole number."""
    series = list(series)
    previous = monthly.select(
        *series, F.add_months("date", 1).alias("date"), F.col(value).alias("_previous")
    )
    level = (F.col(diff) + F.col("_previous")).cast("bigint")
    return predicted.join(previous, [*series, "date"]).select(*series, "date", level.alias("pred_value"))


def actual_vs_predicted(monthly: DataFrame, levels: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Every month with its prediction, null outside the predicted months."""
    return monthly.join(levels, [*series, "date"], "left")
