import math

import numpy as np
import pytest

from tidemark.functions import tails
from tidemark.operators import experiment as ab


@pytest.mark.parametrize("t", [0.0, 0.3, 1.0, 2.5, 12.0])
def test_t_tail_closed_forms(t):
    assert tails.t_tail(t, 1) == pytest.approx(1 - 2 * math.atan(t) / math.pi, abs=1e-12)
    assert tails.t_tail(t, 2) == pytest.approx(1 - t / math.sqrt(t * t + 2), abs=1e-12)
    assert tails.f_tail(t * t, 1, 7) == pytest.approx(tails.t_tail(t, 7), abs=1e-12)


@pytest.mark.parametrize("f,d", [(0.5, 4.0), (3.0, 30.0), (9.0, 2000.0)])
def test_f_tail_with_two_degrees(f, d):
    assert tails.f_tail(f, 2, d) == pytest.approx((1 + 2 * f / d) ** (-d / 2), rel=1e-10)


@pytest.mark.parametrize("d", [1e6, 1e8, 2e10])
def test_tails_stay_right_for_very_many_customers(d):
    # With so many degrees of freedom t is normal and F is chi-squared.
    assert tails.t_tail(1.96, d) == pytest.approx(math.erfc(1.96 / math.sqrt(2)), rel=1e-5)
    assert tails.t_tail(6.0, d) == pytest.approx(math.erfc(6.0 / math.sqrt(2)), rel=1e-3)
    assert tails.f_tail(3.0, 2, d) == pytest.approx(math.exp(-3.0), rel=1e-5)


def test_sample_size_tends_to_the_normal_formula():
    effect = 0.05
    want = 2 * ((1.959963985 + 0.841621234) / effect) ** 2
    n = tails.solve_n1(effect, 0.8, 0.05, 1.0)
    assert want < n < want + 2
    assert tails.solve_n1(-effect, 0.8, 0.05, 1.0) == pytest.approx(n)
    assert tails.t_power(effect, n, 0.05, 1.0) == pytest.approx(0.8, abs=1e-6)
    # A textbook value: 64 per group for a medium effect.
    assert math.ceil(tails.solve_n1(0.5, 0.8, 0.05, 1.0)) == 64
    assert tails.solve_n1(0.5, 0.8, 0.05, 2.0) < tails.solve_n1(0.5, 0.8, 0.05, 1.0)
    assert math.isnan(tails.solve_n1(0.0, 0.8, 0.05, 1.0))


def planted(spark, shift=1.0, n=400):
    rng = np.random.default_rng(1)
    data = [
        (i, "high" if i % 5 else "low", "test" if i % 2 else "control", float(rng.poisson(2) + shift * (i % 2) + (i % 5 > 0)))
        for i in range(n)
    ]
    return spark.createDataFrame(data, "id int, segment string, group string, y double")


def test_t_test_equals_its_formula(spark):
    data = planted(spark)
    got = ab.t_test(data, "y", "group", "test", "control").first()
    local = data.toPandas()
    a, b = (local.loc[local.group == g, "y"] for g in ("test", "control"))
    pooled = ((len(a) - 1) * a.var() + (len(b) - 1) * b.var()) / (len(a) + len(b) - 2)
    t = (a.mean() - b.mean()) / math.sqrt(pooled * (1 / len(a) + 1 / len(b)))
    assert (got.t, got.df, got.verdict) == (pytest.approx(t), 398, "significant")


def test_two_groups_anova_is_the_squared_t_test(spark):
    data = planted(spark, 0.1)
    t = ab.t_test(data, "y", "group", "test", "control").first()
    f = ab.anova_oneway(data, "y", "group").first()
    assert (f.F, f.p_value, f.verdict) == (pytest.approx(t.t**2), pytest.approx(t.p_value, abs=1e-10), t.verdict)


def test_many_experiments_at_once(spark):
    data = planted(spark)
    got = {r.segment: r for r in ab.t_test(data, "y", "group", "test", "control", by=["segment"]).collect()}
    for s in ("high", "low"):
        alone = ab.t_test(data.where(f"segment = '{s}'"), "y", "group", "test", "control").first()
        assert got[s].t == pytest.approx(alone.t) and got[s].df == alone.df


def test_degenerate_groups_give_no_verdict(rows):
    single = rows([("a", 1.0), ("b", 2.0)], "g string, y double")
    got = ab.t_test(single, "y", "g", "a", "b").first()
    assert (got.t, got.p_value, got.verdict) == (None, None, None)
    missing = ab.t_test(rows([("a", 1.0), ("a", 2.0)], "g string, y double"), "y", "g", "a", "b").first()
    assert missing.p_value is None


def regression_ss(frame, *factors):
    import pandas as pd

    x = np.column_stack([np.ones(len(frame)), *[pd.get_dummies(frame[f], drop_first=True).to_numpy(float) for f in factors]])
    y = frame["y"].to_numpy()
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    return float(((y - x @ beta) ** 2).sum()), np.linalg.matrix_rank(x)


def test_two_way_anova_equals_the_raw_rows(spark):
    rng = np.random.default_rng(4)
    data = [(f"s{rng.integers(3)}", f"g{rng.integers(4)}", float(rng.normal())) for _ in range(300)]
    frame = spark.createDataFrame(data, "segment string, group string, y double")
    got = {r.factor: r for r in ab.anova_twoway(frame, "y", "segment", "group", decimals=8).collect()}
    local = frame.toPandas()
    full, rank = regression_ss(local, "segment", "group")
    for factor, other in (("segment", "group"), ("group", "segment")):
        reduced, reduced_rank = regression_ss(local, other)
        assert got[factor].sum_sq == pytest.approx(reduced - full, abs=1e-7)
        assert got[factor].df == rank - reduced_rank
    assert (got["Residual"].sum_sq, got["Residual"].df) == (pytest.approx(full, abs=1e-7), 300 - rank)


def test_effect_and_sample_size(spark):
    data = planted(spark)
    local = data.toPandas()["y"]
    got = ab.required_sample_size(data, "y", lift=1.05).first()
    effect = (local.mean() * 1.05 - local.mean()) / local.std()
    assert got.effect_size == pytest.approx(effect)
    assert got.sample_size == int(tails.solve_n1(effect, 0.8, 0.05, 1.0))
    target = ab.required_sample_size(data, "y", target=local.mean() * 1.05).first()
    assert target.sample_size == got.sample_size
    with pytest.raises(ValueError):
        ab.effect_size(data, "y")


def test_densities_integrate_to_one(spark):
    data = planted(spark)
    for r in ab.histogram(data, "y", 0.5, ["group"]).groupBy("group").agg({"density": "sum"}).collect():
        assert r[1] * 0.5 == pytest.approx(1.0)
    curve = ab.normal_curve(data, "y", ["group"]).where("group = 'test'").orderBy("i").toPandas()
    assert len(curve) == 100 and curve.x.iloc[0] == data.toPandas().y.min()
    whole = ab.histogram(data, "y", 1.0).toPandas()
    assert whole["count"].sum() == 400 and whole["density"].sum() == pytest.approx(1.0)
