"""A/B tests: X01 – X09."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import check, experiment_sql, rounded
from tidemark.operators import experiment as ab
from tidemark.operators import sampling
from tidemark.sources.star import experiment, table

E2 = experiment_sql("control", "test")
E3 = experiment_sql("A", "B", "C")


def two_arms(spark, sf_dir):
    return experiment(spark, sf_dir)


def three_arms(spark, sf_dir):
    return experiment(spark, sf_dir, ("A", "B", "C"))


def tail_sql(x: str, a: str, b: str) -> str:
    """Regularised incomplete beta function by the midpoint rule, after a smoothing substitution."""
    points = 200_000
    return f"""(exp({a} * ln({x}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) / ({a})
      * (SELECT avg(pow(1 - {x} * pow((i + 0.5::DOUBLE) / {points}, 1 / ({a})), {b} - 1)) FROM range({points}) AS g(i)))"""


def _t_sql(ctes: str, by: str = "") -> str:
    key, group = (f"{by},", f"GROUP BY {by}") if by else ("", "")
    return f"""WITH {ctes},
    m AS (SELECT {key} count(*) FILTER (grp = 'test') AS n_a, count(*) FILTER (grp = 'control') AS n_b,
      avg(purchase_count) FILTER (grp = 'test') AS mean_a, avg(purchase_count) FILTER (grp = 'control') AS mean_b,
      var_samp(purchase_count) FILTER (grp = 'test') AS v_a, var_samp(purchase_count) FILTER (grp = 'control') AS v_b
      FROM e {group}),
    s AS (SELECT *, n_a + n_b - 2 AS df,
      (mean_a - mean_b) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2) * (1.0::DOUBLE / n_a + 1.0::DOUBLE / n_b)) AS t FROM m),
    p AS (SELECT *, df / (df + t * t) AS x, df / 2.0::DOUBLE AS a FROM s),
    q AS (SELECT *, {tail_sql('x', 'a', '0.5::DOUBLE')} AS pv FROM p)
    SELECT {key} n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, CAST(df AS BIGINT) AS df, round(t, 6) AS t,
      round(pv, 5) AS p_value, CASE WHEN pv < 0.05 THEN 'significant' ELSE 'not significant' END AS verdict FROM q"""


T_DIGITS = {"mean_a": 6, "mean_b": 6, "t": 6, "p_value": 5}


@check("x01_t_test", _t_sql(E2))
def x01(spark, sf_dir):
    return rounded(ab.t_test(two_arms(spark, sf_dir), "purchase_count", "group", "test", "control"), T_DIGITS)


@check("x01_t_test_by_segment", _t_sql(E2, "segment"))
def x01_by(spark, sf_dir):
    tested = ab.t_test(two_arms(spark, sf_dir), "purchase_count", "group", "test", "control", by=["segment"])
    return rounded(tested, T_DIGITS)


@check(
    "x02_verdict",
    _t_sql(f"{E2.replace('c_acctbal >= 4500', 'c_nationkey >= 13').replace('AS segment', 'AS half')}", "half").replace(
        "SELECT half, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, CAST(df AS BIGINT) AS df, round(t, 6) AS t,\n      round(pv, 5) AS p_value,",
        "SELECT half,",
    ),
)
def x02(spark, sf_dir):
    """Verdict of one test per half of the nations."""
    halves = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.when(F.col("c_nationkey") >= 13, "high-value").otherwise("low-value").alias("half"),
    )
    rows = two_arms(spark, sf_dir).join(halves, "customer_id")
    tested = ab.t_test(rows, "purchase_count", "group", "test", "control", by=["half"])
    return tested.select("half", "verdict")


def _split_sql(by: str = "") -> str:
    partition = f"PARTITION BY {by}" if by else ""
    return f"""WITH {E2},
    k AS (SELECT customer_id, segment, row_number() OVER ({partition} ORDER BY md5(customer_id || '|11'), customer_id) AS i,
      count(*) OVER ({partition}) AS n FROM e),
    arms AS (SELECT customer_id, segment, CASE WHEN i <= round_even(0.9::DOUBLE * n, 0) THEN 'test' ELSE 'control' END AS arm FROM k)"""


def pool(spark, sf_dir):
    return two_arms(spark, sf_dir).select("customer_id", "segment")


@check("x03_random_split", f"{_split_sql()} SELECT * FROM arms")
def x03(spark, sf_dir):
    return sampling.random_split(pool(spark, sf_dir), "customer_id", 0.9, seed=11)


@check("x04_stratified_split", f"{_split_sql('segment')} SELECT * FROM arms")
def x04(spark, sf_dir):
    return sampling.stratified_split(pool(spark, sf_dir), "customer_id", ["segment"], 0.9, seed=11)


@check("x05_balance_check", f"{_split_sql('segment')} SELECT arm, segment, count(*) AS count FROM arms GROUP BY ALL")
def x05(spark, sf_dir):
    return sampling.balance_check(sampling.stratified_split(pool(spark, sf_dir), "customer_id", ["segment"], 0.9, seed=11))


@check("x05_group_sizes", f"WITH {E3} SELECT grp AS \"group\", count(*) AS count FROM e GROUP BY grp")
def x05_groups(spark, sf_dir):
    return sampling.balance_check(three_arms(spark, sf_dir), ["group"])


def _anova_sql(by: str = "") -> str:
    key, group, partition = (f"{by},", f"GROUP BY {by}", f"PARTITION BY {by}") if by else ("", "", "")
    return f"""WITH {E3},
    g AS (SELECT {key} grp, purchase_count AS y, avg(purchase_count) OVER ({partition}) AS grand,
      avg(purchase_count) OVER (PARTITION BY {key} grp) AS mean FROM e),
    s AS (SELECT {key} count(DISTINCT grp) - 1 AS db, count(*) - count(DISTINCT grp) AS dw,
      sum(pow(mean - grand, 2)) AS sb, sum(pow(y - mean, 2)) AS sw FROM g {group}),
    f AS (SELECT *, (sb / db) / (sw / dw) AS fs FROM s),
    p AS (SELECT *, dw / (dw + db * fs) AS x, dw / 2.0::DOUBLE AS a, db / 2.0::DOUBLE AS b FROM f),
    q AS (SELECT *, {tail_sql('x', 'a', 'b')} AS pv FROM p)
    SELECT {key} CAST(db AS BIGINT) AS df_between, CAST(dw AS BIGINT) AS df_within, round(sb, 6) AS ss_between,
      round(sw, 4) AS ss_within, round(fs, 6) AS "F", round(pv, 5) AS p_value,
      CASE WHEN pv < 0.05 THEN 'significant' ELSE 'not significant' END AS verdict FROM q"""


F_DIGITS = {"ss_between": 6, "ss_within": 4, "F": 6, "p_value": 5}


@check("x06_anova_oneway", _anova_sql())
def x06(spark, sf_dir):
    return rounded(ab.anova_oneway(three_arms(spark, sf_dir), "purchase_count", "group"), F_DIGITS)


@check("x06_anova_oneway_by_segment", _anova_sql("segment"))
def x06_by(spark, sf_dir):
    return rounded(ab.anova_oneway(three_arms(spark, sf_dir), "purchase_count", "group", by=["segment"]), F_DIGITS)


# For two factors of two levels each the type II sums of squares have a closed form: the
# difference within each level of the other factor, pooled with weights n1*n0/(n1+n0).
def _factor_sql(name: str, this: str, other: str, one: str) -> str:
    return f"""{name} AS (
      SELECT pow(sum(w * d), 2) / sum(w) AS ss FROM (
        SELECT n1 * n0 / (n1 + n0) AS w, m1 - m0 AS d FROM (
          SELECT {other}, count(*) FILTER ({this} = '{one}') AS n1, count(*) FILTER ({this} <> '{one}') AS n0,
            avg(purchase_count) FILTER ({this} = '{one}') AS m1, avg(purchase_count) FILTER ({this} <> '{one}') AS m0
          FROM e GROUP BY {other})))"""


X07_SQL = f"""WITH {E2},
{_factor_sql('fs', 'segment', 'grp', 'high-value')},
{_factor_sql('fg', 'grp', 'segment', 'test')},
tot AS (SELECT var_pop(purchase_count) * count(*) AS st, count(*) AS n FROM e),
bg AS (SELECT sum(pow(m - (SELECT avg(purchase_count) FROM e), 2) * c) AS sg FROM
  (SELECT avg(purchase_count) AS m, count(*) AS c FROM e GROUP BY grp)),
res AS (SELECT st - sg - (SELECT ss FROM fs) AS sr, n - 3 AS dr FROM tot, bg),
tab AS (SELECT 'segment' AS factor, ss, ss / (sr / dr) AS f, dr FROM fs, res UNION ALL SELECT 'group', ss, ss / (sr / dr), dr FROM fg, res),
p AS (SELECT *, dr / (dr + f) AS x, dr / 2.0::DOUBLE AS a FROM tab)
SELECT factor, round_even(ss * 1e4::DOUBLE, 0) / 1e4::DOUBLE AS sum_sq, 1.0::DOUBLE AS df,
  round_even(f * 1e4::DOUBLE, 0) / 1e4::DOUBLE AS "F",
  round_even({tail_sql('x', 'a', '0.5::DOUBLE')} * 1e4::DOUBLE, 0) / 1e4::DOUBLE AS p_value FROM p
UNION ALL SELECT 'Residual', round_even(sr * 1e4::DOUBLE, 0) / 1e4::DOUBLE, CAST(dr AS DOUBLE), NULL, NULL FROM res"""


@check("x07_anova_twoway", X07_SQL)
def x07(spark, sf_dir):
    return ab.anova_twoway(two_arms(spark, sf_dir), "purchase_count", "segment", "group")


# A factor of two levels is adjusted for one of any number of levels by the same pooled
# difference; the other factor follows from the residuals of both models.  With two degrees
# of freedom the tail of F is a power.
X07_THREE_SQL = f"""WITH {E3},
{_factor_sql('fs', 'segment', 'grp', 'high-value')},
tot AS (SELECT var_pop(purchase_count) * count(*) AS st, count(*) AS n, avg(purchase_count) AS m FROM e),
bg AS (SELECT sum(pow(a - m, 2) * c) AS sg FROM (SELECT avg(purchase_count) AS a, count(*) AS c FROM e GROUP BY grp), tot),
bs AS (SELECT sum(pow(a - m, 2) * c) AS sb FROM (SELECT avg(purchase_count) AS a, count(*) AS c FROM e GROUP BY segment), tot),
res AS (SELECT st - sg - ss AS sr, n - 4 AS dr, ss, (st - sb) - (st - sg - ss) AS sgrp FROM tot, bg, bs, fs),
f AS (SELECT *, ss / (sr / dr) AS f1, sgrp / 2 / (sr / dr) AS f2 FROM res),
p AS (SELECT *, dr / (dr + f1) AS x, dr / 2.0::DOUBLE AS a FROM f)
SELECT 'segment' AS factor, round_even(ss * 1e4::DOUBLE, 0) / 1e4::DOUBLE AS sum_sq, 1.0::DOUBLE AS df,
  round_even(f1 * 1e4::DOUBLE, 0) / 1e4::DOUBLE AS "F",
  round_even({tail_sql('x', 'a', '0.5::DOUBLE')} * 1e4::DOUBLE, 0) / 1e4::DOUBLE AS p_value FROM p
UNION ALL SELECT 'group', round_even(sgrp * 1e4::DOUBLE, 0) / 1e4::DOUBLE, 2.0::DOUBLE, round_even(f2 * 1e4::DOUBLE, 0) / 1e4::DOUBLE,
  round_even(pow(dr / (dr + 2 * f2), dr / 2.0::DOUBLE) * 1e4::DOUBLE, 0) / 1e4::DOUBLE FROM p
UNION ALL SELECT 'Residual', round_even(sr * 1e4::DOUBLE, 0) / 1e4::DOUBLE, CAST(dr AS DOUBLE), NULL, NULL FROM res"""


@check("x07_anova_twoway_three_arms", X07_THREE_SQL)
def x07_three(spark, sf_dir):
    return ab.anova_twoway(three_arms(spark, sf_dir), "purchase_count", "segment", "group")


@check(
    "x08_effect_size",
    f"""WITH {E2} SELECT segment, round(avg(prev_purchase_count), 6) AS mean, round(stddev_samp(prev_purchase_count), 6) AS std,
      round((avg(prev_purchase_count) * 1.05::DOUBLE - avg(prev_purchase_count)) / stddev_samp(prev_purchase_count), 6) AS effect_size
    FROM e GROUP BY segment""",
)
def x08(spark, sf_dir):
    sized = ab.effect_size(two_arms(spark, sf_dir), "prev_purchase_count", lift=1.05, by=["segment"])
    return rounded(sized, 6, "mean", "std", "effect_size")


@check("x08_required_sample_size")
def x08_size(spark, sf_dir):
    """The size per segment that shows a lift by a twentieth."""
    return ab.required_sample_size(two_arms(spark, sf_dir), "prev_purchase_count", lift=1.05, by=["segment"])


@check("x08_sample_size_for_target")
def x08_target(spark, sf_dir):
    return ab.required_sample_size(two_arms(spark, sf_dir), "prev_purchase_count", target=1.6)


@check(
    "x09_histogram",
    f"""WITH {E2}, h AS (SELECT grp, floor(purchase_count / 0.5::DOUBLE) * 0.5::DOUBLE AS bin_start, count(*) AS n FROM e GROUP BY ALL)
    SELECT grp AS "group", bin_start, n AS count,
      round(n / (sum(n) OVER (PARTITION BY grp) * 0.5::DOUBLE), 6) AS density FROM h""",
)
def x09(spark, sf_dir):
    return rounded(ab.histogram(two_arms(spark, sf_dir), "purchase_count", 0.5, ["group"]), 6, "density")


FIT = """fit AS (SELECT grp, avg(purchase_count) AS mu, stddev_pop(purchase_count) AS sigma FROM e GROUP BY grp)"""


@check("x09_normal_fit", f"WITH {E2}, {FIT} SELECT grp AS \"group\", round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM fit")
def x09_fit(spark, sf_dir):
    fits = ab.normal_fit(two_arms(spark, sf_dir), "purchase_count", ["group"]).select("group", "mu", "sigma")
    return rounded(fits, 6, "mu", "sigma")


@check(
    "x09_normal_curve",
    f"""WITH {E2}, {FIT}, span AS (SELECT min(purchase_count) AS lo, max(purchase_count) AS hi FROM e),
    pts AS (SELECT grp, mu, sigma, CAST(i AS INTEGER) AS i, lo + (hi - lo) * i / 99.0::DOUBLE AS x FROM fit, span, range(100) AS g(i))
    SELECT grp AS "group", i, round(x, 6) AS x, round(exp(-pow((x - mu) / sigma, 2) / 2) / (sigma * sqrt(2 * pi())), 6) AS density FROM pts""",
)
def x09_curve(spark, sf_dir):
    curve = ab.normal_curve(two_arms(spark, sf_dir), "purchase_count", ["group"])
    return rounded(curve, 6, "x", "density")
