"""Logistic regression against NumPy's pseudo-inverse, on full and on dependent columns."""

import math

import numpy as np
import pytest

from tidemark.operators import models, regression


def numpy_fit(x, y, steps=60):
    """Weighted least squares by the pseudo-inverse of the rows themselves."""
    x = np.column_stack([x, np.ones(len(y))])
    chance = (y + 0.5) / 2
    linear = np.log(chance / (1 - chance))
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-linear))
        root = np.sqrt(chance * (1 - chance))
        z = linear + (y - chance) / root**2
        inverse = np.linalg.pinv(x * root[:, None], rcond=1e-10)
        beta = inverse @ (root * z)
        linear = x @ beta
    chance = 1 / (1 + np.exp(-linear))
    inverse = np.linalg.pinv(x * np.sqrt(chance * (1 - chance))[:, None], rcond=1e-10)
    return beta, np.sqrt(np.diagonal(inverse @ inverse.T))


def table(spark, n, drop_first, seed=1):
    draw = np.random.default_rng(seed)
    a, b, c = draw.integers(0, 3, n), draw.integers(0, 4, n), draw.normal(50, 20, n)
    y = (draw.random(n) < 1 / (1 + np.exp(-(0.8 * (a == 1) - 0.7 * (b == 3) + (c - 50) / 30)))).astype(int)
    x = np.column_stack([a == k for k in range(drop_first, 3)] + [b == k for k in range(drop_first, 4)] + [c]).astype(float)
    names = [f"x.{i}" for i in range(x.shape[1])]
    frame = spark.createDataFrame([(int(l), *map(float, r)) for l, r in zip(y, x)], "y int, " + ", ".join(f"`{k}` double" for k in names))
    return frame.repartition(3), x, y, names


@pytest.mark.parametrize("drop_first", [0, 1])
def test_equals_numpy(spark, drop_first):
    frame, x, y, names = table(spark, 400, drop_first)
    beta, errors = numpy_fit(x, y)
    rows = models.logistic_summary(frame, "y", names).collect()
    assert [r.feature for r in rows] == [*names, "Intercept"]
    assert [r.coefficient for r in rows] == pytest.approx(beta.tolist(), abs=1e-6)
    assert [r.std_error for r in rows] == pytest.approx(errors.tolist(), abs=1e-6)
    for r in rows:
        assert r.z == pytest.approx(r.coefficient / r.std_error)
        assert r.p_value == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)))
        assert r.ci_low < r.coefficient < r.ci_high and r.significant == (r.p_value < 0.05)


def test_rank_and_fitted_chances_do_not_depend_on_the_coding(spark):
    full, x, _, names = table(spark, 300, 0)
    less, w, _, fewer = table(spark, 300, 1)
    a, b = regression.fit_logistic(full, "y", names), regression.fit_logistic(less, "y", fewer)
    assert a.rank == b.rank == len(fewer) + 1
    one = np.column_stack([x, np.ones(300)]) @ a.coefficients
    other = np.column_stack([w, np.ones(300)]) @ b.coefficients
    assert one == pytest.approx(other, abs=1e-6)
    # The shortest solution: levels of a category add up as the intercept says.
    assert a.coefficients[:3].sum() == pytest.approx(a.coefficients[-1]) == pytest.approx(a.coefficients[3:7].sum())


def test_units_do_not_hide_columns(spark):
    frame, x, y, names = table(spark, 300, 1)
    wide = frame.withColumn(names[-1], frame[f"`{names[-1]}`"] * 1e6)
    small, large = regression.fit_logistic(frame, "y", names), regression.fit_logistic(wide, "y", names)
    assert large.rank == small.rank
    assert large.coefficients[-2] * 1e6 == pytest.approx(small.coefficients[-2], rel=1e-5)


def test_odd_tables(spark):
    """A constant column, a repeated column, nulls, one class, no rows."""
    rows = [(i % 2, float(i % 5), 1.0, float(i % 5)) for i in range(40)] + [(None, 1.0, 1.0, 1.0), (1, None, 1.0, 2.0)]
    frame = spark.createDataFrame(rows, "y int, a double, one double, twice double")
    found = {r.feature: r for r in models.logistic_summary(frame, "y", ["a", "one", "twice"]).collect()}
    assert all(math.isfinite(v) for r in found.values() for v in (r.coefficient, r.std_error, r.p_value))
    assert found["a"].coefficient == pytest.approx(found["twice"].coefficient)
    assert found["one"].coefficient == pytest.approx(found["Intercept"].coefficient)
    for part in (frame.where("y = 1"), frame.limit(0)):
        assert all(math.isfinite(r.coefficient) for r in models.logistic_summary(part, "y", ["a", "one"]).collect())


@pytest.mark.parametrize("stacked", [64, 2])
def test_least_squares_equal_numpy_over_many_tasks(spark, monkeypatch, stacked):
    monkeypatch.setattr(regression, "STACKED", stacked)
    draw = np.random.default_rng(3)
    x = draw.normal(size=(200, 4)) * [1, 1e4, 1e-3, 1] + [0, 1e5, 0, 0]
    x[:, 3] = x[:, 0] + 2 * x[:, 2]
    y = x @ [2.0, 1e-4, 300.0, 1.0] + draw.normal(size=200)
    frame = spark.createDataFrame([(float(l), *map(float, r)) for l, r in zip(y, x)] + [(None, 1.0, 1.0, 1.0, 1.0)], "y double, a double, b double, c double, d double").repartition(7)
    fit = regression.fit_least_squares(frame, "y", ["a", "b", "c", "d"])
    design = np.column_stack([np.ones(200), x])
    want = np.linalg.lstsq(design, y, rcond=1e-12)[0]
    assert design @ fit.weights == pytest.approx(design @ want, rel=1e-8)
    assert fit.residual == pytest.approx(((y - design @ want) ** 2).sum())
    assert fit.total == pytest.approx(((y - y.mean()) ** 2).sum())


def test_least_squares_of_few_rows(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "y double, a double")
    assert regression.fit_least_squares(frame, "y", ["a"]).r2() == pytest.approx(1)
    assert regression.fit_least_squares(frame.limit(0), "y", ["a"]).weights.tolist() == [0.0, 0.0]
