"""A/B tests: significance, analysis of variance, sample size, densities.

Spark reduces the customers to (count, mean, variance) per group; only those few rows
reach the statistical functions.  Extra ``by`` keys evaluate many experiments at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import over_groups, round_half_even, with_one_row
from tidemark.functions.tails import f_p_value, f_tail, group_size, t_p_value

# Significance level, power, histogram bin, points of a fitted curve.
ALPHA = 0.05
POWER = 0.8
BIN = 0.5
CURVE_POINTS = 100


def _cells(df: DataFrame, metric: str, keys: Sequence[str]) -> DataFrame:
    """Count, mean and within-group sum of squares per group."""
    value = F.col(metric).cast("double")
    n = F.count(metric)
    # The population variance of a single row is 0, where the sample variance is undefined.
    return (
        df.dropna(subset=[metric, *keys])
        .groupBy(*keys)
        .agg(n.alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * n).alias("within"))
    )


def verdict(p: str = "p_value", alpha: float = ALPHA) -> Column:
    """``significant`` if p is strictly below alpha; unknown without a p-value."""
    return F.when(F.col(p) < alpha, "significant").when(F.col(p) >= alpha, "not significant")


def t_test(
    df: DataFrame, metric: str, group: str, a: str, b: str, by: Sequence[str] = (), alpha: float = ALPHA
) -> DataFrame:
    """Two-sample, two-sided t-test of group ``a`` against ``b`` with pooled variance."""
    cells = _cells(df.where(F.col(group).isin(a, b)), metric, [*by, group])

    def of(name: str, column: str):
        return F.max(F.when(F.col(group) == name, F.col(column)))

    sides = cells.groupBy(*by).agg(
        *[of(name, c).alias(f"{c}_{side}") for name, side in ((a, "a"), (b, "b")) for c in ("n", "mean", "within")]
    )
    dof = F.col("n_a") + F.col("n_b") - 2
    pooled = F.try_divide(F.col("within_a") + F.col("within_b"), dof)
    error = F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b")))
    tested = sides.select(
        *by,
        "n_a",
        "n_b",
        "mean_a",
        "mean_b",
        dof.cast("bigint").alias("df"),
        F.try_divide(F.col("mean_a") - F.col("mean_b"), error).alias("t"),
    )
    return tested.withColumn("p_value", t_p_value("t", "df")).withColumn("verdict", verdict(alpha=alpha))


def anova_oneway(df: DataFrame, metric: str, group: str, by: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """F test of equal means over any number of groups."""
    cells = _cells(df, metric, [*by, group])
    grand = F.sum(F.col("n") * F.col("mean")).over(over_groups(by)) / F.sum("n").over(over_groups(by))
    spread = cells.withColumn("between", F.col("n") * F.pow(F.col("mean") - grand, 2))
    sums = spread.groupBy(*by).agg(
        (F.count(F.lit(1)) - 1).alias("df_between"),
        (F.sum("n") - F.count(F.lit(1))).alias("df_within"),
        F.sum("between").alias("ss_between"),
        F.sum("within").alias("ss_within"),
    )
    between = F.try_divide(F.col("ss_between"), F.col("df_between"))
    within = F.try_divide(F.col("ss_within"), F.col("df_within"))
    tested = sums.withColumn("F", F.try_divide(between, within))
    return tested.withColumn("p_value", f_p_value("F", "df_between", "df_within")).withColumn(
        "verdict", verdict(alpha=alpha)
    )


def _additive_table(cells: pd.DataFrame, f1: str, f2: str) -> list[tuple]:
    """Type II table of an additive two-factor model from the cell statistics of one experiment."""
    n = cells["n"].to_numpy(float)
    mean = cells["mean"].to_numpy(float)
    within = float(cells["within"].sum())

    def dummies(name: str) -> np.ndarray:
        return pd.get_dummies(cells[name], drop_first=True).to_numpy(float)

    def residual(*blocks: np.ndarray) -> tuple[float, int]:
        """Between-cell residual sum of squares, and rank, of a weighted fit on the cell means."""
        x = np.column_stack([np.ones(len(n)), *blocks])
        root = np.sqrt(n)
        beta, _, rank, _ = np.linalg.lstsq(x * root[:, None], mean * root, rcond=None)
        return float(np.sum(n * (mean - x @ beta) ** 2)), int(rank)

    one, two = dummies(f1), dummies(f2)
    full, rank = residual(one, two)
    without_one, rank_one = residual(two)
    without_two, rank_two = residual(one)
    dof = float(n.sum()) - rank
    residual_ss = full + within
    rows = []
    for name, ss, d in ((f1, without_one - full, rank - rank_one), (f2, without_two - full, rank - rank_two)):
        testable = d > 0 and dof > 0 and residual_ss > 0
        f = ss / d / (residual_ss / dof) if testable else math.nan
        rows.append((name, ss, float(d), f, f_tail(f, d, dof)))
    rows.append(("Residual", residual_ss, dof, math.nan, math.nan))
    return rows


def anova_twoway(
    df: DataFrame, metric: str, f1: str, f2: str, by: Sequence[str] = (), decimals: int = 4
) -> DataFrame:
    """Additive two-factor model with type II sums of squares, rounded half to even.

    The cells (levels of one factor times levels of the other) are the only rows that
    leave the aggregate, one small group per experiment.
    """
    by = list(by)
    cells = _cells(df, metric, [*by, f1, f2])
    key_fields = [cells.schema[k] for k in by]
    out = ["factor", "sum_sq", "df", "F", "p_value"]

    def table(group: pd.DataFrame) -> pd.DataFrame:
        rows = pd.DataFrame(_additive_table(group, f1, f2), columns=out)
        for k in by:
            rows[k] = group[k].iloc[0]
        return rows[[*by, *out]]

    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields]
        + ["factor string", "sum_sq double", "df double", "F double", "p_value double"]
    )
    result = cells.groupBy(*by).applyInPandas(table, schema)
    return result.select(
        *by, "factor", *[round_half_even(F.nanvl(c, F.lit(None).cast("double")), decimals).alias(c) for c in out[1:]]
    )


def effect_size(
    df: DataFrame, metric: str, lift: float | None = None, target: float | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Standardised change: to ``lift`` times the mean, or to an absolute ``target`` mean."""
    if (lift is None) == (target is None):
        raise ValueError("give either lift or target")
    value = F.col(metric).cast("double")
    stats = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    goal = F.col("mean") * F.lit(lift) if target is None else F.lit(float(target))
    return stats.withColumn("effect_size", F.try_divide(goal - F.col("mean"), F.col("std")))


def required_sample_size(
    df: DataFrame,
    metric: str,
    lift: float | None = None,
    ratio: float = 1.0,
    by: Sequence[str] = (),
    target: float | None = None,
    power: float = POWER,
    alpha: float = ALPHA,
) -> DataFrame:
    """Customers the first group needs, cut to a whole number; the other needs ``ratio`` times that."""
    sized = effect_size(df, metric, lift, target, by)
    n = group_size(F.col("effect_size"), F.lit(power), F.lit(alpha), F.lit(float(ratio)))
    return sized.withColumn("sample_size", n.cast("bigint"))


def histogram(df: DataFrame, metric: str, bin: float = BIN, by: Sequence[str] = ()) -> DataFrame:
    """Rows per bin ``[k * bin, (k + 1) * bin)``, as a count and as a density of total area 1."""
    value = F.col(metric).cast("double")
    start = F.floor(value / bin) * F.lit(float(bin))
    counts = (
        df.dropna(subset=[metric, *by]).groupBy(*by, start.alias("bin_start")).agg(F.count(F.lit(1)).alias("count"))
    )
    totals = counts.groupBy(*by).agg(F.sum("count").alias("_total"))
    wide = counts.join(totals, list(by)) if by else with_one_row(counts, totals)
    return wide.withColumn("density", F.col("count") / (F.col("_total") * F.lit(float(bin)))).drop("_total")


def normal_fit(df: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation per group: the best-fitting normal curve."""
    value = F.col(metric).cast("double")
    return (
        df.dropna(subset=[metric, *by])
        .groupBy(*by)
        .agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sigma"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    )


def normal_curve(df: DataFrame, metric: str, by: Sequence[str] = (), points: int = CURVE_POINTS) -> DataFrame:
    """The fitted normal density of each group on a grid over the whole range of the data."""
    fits = normal_fit(df, metric, by)
    span = over_groups([])
    # One row per group, then ``points`` rows per group.
    grid = fits.withColumns({"_low": F.min("_low").over(span), "_high": F.max("_high").over(span)}).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    )
    x = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("i") / F.lit(float(points - 1))
    z = F.try_divide(F.col("x") - F.col("mu"), F.col("sigma"))
    density = F.try_divide(F.exp(-z * z / 2), F.col("sigma") * F.sqrt(2 * F.pi()))
    return grid.withColumn("x", x).select(*by, "i", "x", density.alias("density"))
