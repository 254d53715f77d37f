"""Monthly sales forecast of the total or of every series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidemark.operators import features, forecast
from tidemark.session import materialize


def supervised_months(monthly: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Monthly changes with twelve lags, the last six months marked as test."""
    changes = forecast.difference(monthly, series=series).drop("prev_sales")
    return forecast.chronological_split(forecast.add_lags(changes, series=series), series=series)


def forecast_report(sales: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Every month with its actual level and, for the last six, the predicted one."""
    series = list(series)
    columns = ["diff", *forecast.lag_names()]
    monthly = materialize(forecast.resample_month(sales, series=series), "monthly-sales")
    split = materialize(supervised_months(monthly, series), "supervised-months")
    bounds = features.minmax_bounds(split.where("is_train"), columns, series)
    predicted = forecast.forecast_next(features.minmax_scale(split, bounds, columns, series), series=series)
    restored = features.minmax_inverse(predicted, bounds, {"pred": "diff"}, series)
    return forecast.actual_vs_predicted(monthly, forecast.rebuild_levels(restored, monthly, series=series), series)
