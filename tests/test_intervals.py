"""Exact one-column clusters against all partitions."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import churn, intervals, ltv, segments


def brute(values, k):
    """Least squared error over all ways to cut the sorted distinct values, and the means there."""
    distinct = sorted(set(values))
    k = min(k, len(distinct))
    best = (float("inf"), None)
    for cuts in combinations(range(1, len(distinct)), k - 1):
        bounds = [0, *cuts, len(distinct)]
        groups = [[v for v in values if distinct[a] <= v <= distinct[b - 1]] for a, b in zip(bounds, bounds[1:])]
        error = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups)
        if error < best[0] - 1e-9:
            best = error, [float(np.mean(g)) for g in groups]
    return best


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(3)


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    draw = np.random.default_rng(seed)
    values = [float(v) for v in np.round(draw.gamma(0.6, 50.0, 40) - 5, 1)] + [7.0] * 20 + [-3.5]
    data = frame(spark, [*values, None, float("nan")])
    errors = intervals.best_errors(data, "x", 4)
    for k in range(1, 5):
        error, means = brute(values, k)
        assert errors[k - 1] == pytest.approx(error)
        assert intervals.best_centers(data, "x", k) == pytest.approx(means)
    labelled = segments.kmeans_1d(data.dropna(), "x", 4, "c").collect()
    means = brute(values, 4)[1]
    assert all(r.c == int(np.argmin([abs(r.x - m) for m in means])) for r in labelled if r.x == r.x)


def test_cuts_are_the_best_of_many_values(spark):
    """Against the plain quadratic recursion."""
    draw = np.random.default_rng(5)
    values = np.unique(np.round(np.concatenate([draw.normal(m, s, 150) for m, s in ((0, 1), (9, 4), (40, 2))]), 3))
    n = len(values)
    s, q = np.concatenate([[0], np.cumsum(values)]), np.concatenate([[0], np.cumsum(values**2)])
    cost = lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)
    layers = [[0.0] + [cost(0, b) for b in range(1, n + 1)]]
    for k in range(2, 6):
        layers.append([np.inf] * k + [min(layers[-1][a] + cost(a, b) for a in range(k - 1, b)) for b in range(k, n + 1)])
    found = intervals.best_errors(frame(spark, values.tolist()), "x", 5)
    assert found == pytest.approx([layer[n] for layer in layers], rel=1e-6)


def test_bins_hold_the_stated_bound(spark):
    draw = np.random.default_rng(6)
    values = np.concatenate([draw.lognormal(3, 1.5, 4000), -draw.lognormal(1, 1, 500)])
    data = frame(spark, values.tolist())
    exact = intervals.Partition(intervals.points_of(data, "x"), 4)
    points = intervals.points_of(data, "x", 800)
    assert 50 < len(points) <= 800 and float(points.rows.sum()) == len(values)
    binned = intervals.Partition(points, 4)
    # Errors of bins are exact, so fewer cuts can only cost more, and here very little.
    for few, all_ in zip(binned.errors(), exact.errors()):
        assert all_ * (1 - 1e-9) <= few <= all_ * 1.01
    assert binned.centers(4) == pytest.approx(exact.centers(4), rel=0.05)


@pytest.mark.parametrize("values, k, centers", [([], 3, []), ([2.0], 3, [2.0]), ([1.0, 1.0, 5.0], 4, [1.0, 5.0])])
def test_few_values(spark, values, k, centers):
    data = frame(spark, [*values, None])
    assert intervals.best_centers(data, "x", k) == centers
    assert len(intervals.best_errors(data, "x", k)) == k
    assert segments.kmeans_1d(data, "x", k, "c").count() == len(values) + 1


def test_equal_work_for_a_hot_value(spark):
    """A value that a third of all rows share is one point."""
    data = spark.range(30_000).selectExpr("double(if(id % 3 = 0, 5, id % 100)) AS x")
    assert len(intervals.points_of(data, "x")) == 100


# Three clusters of 33,333 whole numbers each: no cut lies at a round number.
THIRD = 33_333


def thirds(spark, more=0):
    return spark.range(3 * THIRD + more).withColumn("x", (F.col("id") * 7919) % (3 * THIRD + more))


def test_cuts_of_more_values_than_points_are_exact(spark):
    assert 3 * THIRD > intervals.MOST_POINTS
    assert segments.kmeans_centers(thirds(spark), "x", 3) == [16666.0, 49999.0, 83332.0]
    errors = intervals.best_errors(thirds(spark), "x", 3)
    # Of n neighbouring whole numbers: n (n² - 1) / 12.
    spread = [sum(n * (n * n - 1) / 12 for n in sizes) for sizes in ([3 * THIRD], [49_999, 50_000], [THIRD] * 3)]
    assert errors == pytest.approx(spread, rel=1e-12)


def test_groups_of_many_subscribers_are_exact(spark):
    """The clusters that the churn model is fitted on."""
    many = thirds(spark).select(F.col("x").alias("tenure"), (F.col("x") / 4 - 100).alias("MonthlyCharges"), (-F.col("x")).cast("double").alias("TotalCharges"))
    grouped = churn.numeric_groups(many)
    for name in churn.GROUPED_COLUMNS.values():
        found = grouped.groupBy(name).agg(F.count("*").alias("n"), F.min("tenure").alias("low")).collect()
        assert {(r[name], r.n, r.low) for r in found} == {("Low", THIRD, 0), ("Mid", THIRD, THIRD), ("High", THIRD, 2 * THIRD)}


def test_value_clusters_of_many_customers_are_exact(spark):
    """The clusters that the value model predicts; a hundredth is trimmed first."""
    many = thirds(spark, 1011).select("id", F.col("x").cast("double").alias("m6_Revenue"))
    found = ltv.ltv_clusters(many).groupBy("LTVCluster").agg(F.count("*").alias("n"), F.min("m6_Revenue").alias("low")).collect()
    assert {tuple(r) for r in found} == {(0, THIRD, 0.0), (1, THIRD, THIRD), (2, THIRD, 2 * THIRD)}


VALUES = {
    "heavy tail": lambda draw: draw.lognormal(3, 1.5, 3000),
    "both signs": lambda draw: np.concatenate([draw.standard_cauchy(2000), np.zeros(500)]),
    "far from zero": lambda draw: 1e9 + draw.random(2000),
    "money": lambda draw: np.round(draw.gamma(2.0, 1e6, 2500), 2),
    "groups": lambda draw: np.concatenate([draw.normal(m, s, 700) for m, s in ((0, 1), (9, 4), (40, 2), (1e4, 1))]),
    "huge": lambda draw: draw.gamma(2.0, 1e290, 1500),
    "mirrored": lambda draw: np.concatenate([x := np.round(draw.lognormal(3, 1, 1000), 2), -x]),
}


@pytest.mark.parametrize("name", VALUES)
def test_the_number_of_points_does_not_count(spark, name):
    data = frame(spark, VALUES[name](np.random.default_rng(11)).tolist()).persist()
    for ks in ([2], [4], range(1, 8)):
        few, all_ = intervals.best_partition(data, "x", ks, 40), intervals.best_partition(data, "x", ks)
        assert len(few.points) < len(all_.points)
        for k in ks:
            assert few.errors()[k - 1] == pytest.approx(all_.errors()[k - 1], rel=1e-9)
            # Mirrored cuts are as good.
            if name != "mirrored":
                assert few.centers(k) == pytest.approx(all_.centers(k), rel=1e-12, abs=1e-9)
    data.unpersist()
