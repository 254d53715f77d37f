import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, features, sampling


@pytest.mark.parametrize("n,share", [(1, 0.1), (10, 0.1), (101, 0.05), (1000, 0.2), (7, 0.0), (7, 1.0)])
def test_split_has_the_exact_size(spark, n, share):
    split = sampling.train_test_split(spark.range(n), "id", share, 42)
    assert split.where("not is_train").count() == math.ceil(share * n)
    assert split.count() == n


def test_split_does_not_depend_on_partitions(spark):
    ids = spark.range(500)
    one = sampling.train_test_split(ids.repartition(1), "id", 0.2, 1).where("is_train")
    many = sampling.train_test_split(ids.repartition(9), "id", 0.2, 1).where("is_train")
    assert one.exceptAll(many).count() == 0
    other = sampling.train_test_split(ids, "id", 0.2, 2).where("is_train")
    assert one.exceptAll(other).count() > 0


def test_arms_cover_everything_once(spark):
    split = sampling.random_split(spark.range(205), "id", 0.9, seed=3)
    sizes = {r.arm: r["count"] for r in sampling.balance_check(split, ["arm"]).collect()}
    assert sizes == {"test": round(205 * 0.9), "control": 205 - round(205 * 0.9)}
    assert split.select("id").distinct().count() == 205


def test_strata_are_cut_exactly_also_hot_and_tiny_ones(spark):
    # One segment holds 90 % of the rows, one has a single row, one is null.
    segment = F.when(F.col("id") < 900, "hot").when(F.col("id") == 900, "tiny").when(F.col("id") < 990, "mid")
    people = spark.range(1000).withColumn("segment", segment)
    split = sampling.stratified_split(people, "id", ["segment"], 0.9, seed=3)
    counts = {(r.arm, r.segment): r["count"] for r in sampling.balance_check(split).collect()}
    assert counts == {
        ("test", "hot"): 810,
        ("control", "hot"): 90,
        ("test", "tiny"): 1,
        ("test", "mid"): 80,
        ("control", "mid"): 9,
        ("control", None): 10,
    }


def test_rounding_mode_is_checked(spark):
    with pytest.raises(ValueError):
        sampling.exact_share(spark.range(3), "id", 0.5, 1, rounding="floor")


def test_tolerant_parse_then_fill(rows, table):
    data = rows([(1, " ", 5.0), (2, "12.5", 6.0), (3, "abc", 7.0), (4, None, 8.0)], "id int, t string, m double")
    parsed = features.parse_numeric(data, "t")
    assert table(parsed, "id", "t") == [(1, None), (2, 12.5), (3, None), (4, None)]
    assert table(features.missing_report(parsed, "t", ["id"])) == [(1,), (3,), (4,)]
    assert table(features.fill_from(parsed, "t", "m"), "id", "t") == [(1, 5.0), (2, 12.5), (3, 7.0), (4, 8.0)]


def test_one_hot_ignores_unseen_and_null(rows, table):
    fitted = features.fit_categories(rows([("b",), ("a",), (None,)], "c string"))
    assert fitted == {"c": ["a", "b"]}
    encoded = features.one_hot(rows([(1, "a"), (2, "z"), (3, None)], "id int, c string"), fitted)
    assert encoded.columns == ["id", "c_a", "c_b"]
    assert table(encoded) == [(1, 1, 0), (2, 0, 0), (3, 0, 0)]
    assert features.one_hot(encoded.withColumn("c", F.lit("b")), fitted, drop_first=True).columns[-1] == "c_b"


def test_too_many_categories_are_refused(spark):
    ids = spark.range(30).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="more than 10"):
        features.fit_categories(ids, max_categories=10)


def test_two_categories_become_codes(rows, table):
    data = rows([("x", "Male", "a"), ("y", "Female", "b"), ("z", None, "c")], "id string, g string, k string")
    encoded = features.encode_categoricals(data, "id")
    assert encoded.columns == ["id", "g", "k_a", "k_b", "k_c"]
    assert table(encoded) == [("x", 1, 1, 0, 0), ("y", 0, 0, 1, 0), ("z", None, 0, 0, 1)]


def test_wide_columns_are_encoded_sparse(spark):
    wide = spark.range(1500).selectExpr("id", "concat('c', lpad(id % 1200, 4, '0')) AS c", "concat('d', id % 3) AS d")
    with pytest.raises(ValueError, match=r"\['c'\]"):
        features.fit_categories(wide, max_categories=1000)
    assert features.fit_categories(wide.select("d"), max_categories=3) == {"d": ["d0", "d1", "d2"]}
    encoded, model = features.encode_sparse(wide, ["c", "d"])
    row = encoded.where("id = 1203").first()
    assert (row.c_vector.size, list(row.c_vector.indices), list(row.d_vector.indices)) == (1200, [3], [0])
    unknown = spark.createDataFrame([(1, "new", None)], "id long, c string, d string")
    again, _ = features.encode_sparse(unknown, ["c", "d"], model)
    assert again.first().c_vector.numNonzeros() == again.first().d_vector.numNonzeros() == 0


def test_split_does_not_shuffle_ids(spark):
    split = sampling.train_test_split(spark.range(1000), "id", 0.25, 3)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert split.where("not is_train").count() == 250


def test_clean_names(rows):
    data = rows([(1, 2)], "`a b(c)-d` int, e int")
    assert features.sanitize_columns(data).columns == ["a_b_c__d", "e"]
    with pytest.raises(ValueError, match="collide"):
        features.sanitize_columns(rows([(1, 2)], "`a b` int, `a-b` int"))


def test_scaling_is_fitted_on_training_rows(rows, table):
    data = rows([(True, 0.0, 5.0), (True, 10.0, 5.0), (False, 20.0, 6.0)], "is_train boolean, x double, c double")
    bounds = features.minmax_bounds(data.where("is_train"), ["x", "c"])
    scaled = features.minmax_scale(data, bounds, ["x", "c"])
    assert table(scaled, "x", "c") == [(-1.0, -1.0), (1.0, -1.0), (3.0, 1.0)]
    back = features.minmax_inverse(scaled, bounds, {"x": "x", "c": "c"})
    assert table(back, "x", "c") == [(0.0, 5.0), (10.0, 5.0), (20.0, 6.0)]


def test_scaling_per_series(rows, table):
    data = rows([("a", 0.0), ("a", 2.0), ("b", 100.0), ("b", 300.0)], "s string, x double")
    bounds = features.minmax_bounds(data, ["x"], ["s"])
    assert table(features.minmax_scale(data, bounds, ["x"], ["s"])) == [("a", -1.0), ("a", 1.0), ("b", -1.0), ("b", 1.0)]


def test_correlation_of_a_constant_is_unknown(rows):
    data = rows([(1, 1.0, 5), (2, 2.0, 5), (3, 3.0, 5)], "y int, x double, k int")
    got = {r.feature: r.correlation for r in features.label_correlation(data, "y").collect()}
    assert got["x"] == pytest.approx(1.0) and got["k"] is None


def test_report(rows):
    pairs = [(0, 0.0)] * 8 + [(0, 1.0)] * 2 + [(1, 1.0)] * 3 + [(1, 0.0)] * 1 + [(2, 0.0)] * 1
    scored = rows(pairs, "y int, prediction double")
    got = {r["class"]: r for r in evaluation.classification_report(scored, "y").collect()}
    assert (got["0"].precision, got["0"].recall, got["0"].support) == (0.8, 0.8, 10)
    assert (got["1"].precision, got["1"].recall) == (0.6, 0.75)
    assert (got["2"].precision, got["2"].recall, got["2"].f1) == (0.0, 0.0, 0.0)
    assert got["accuracy"].f1 == pytest.approx(11 / 15)
    assert got["macro avg"].recall == pytest.approx((0.8 + 0.75) / 3)
    assert got["weighted avg"].recall == pytest.approx(11 / 15)
    assert evaluation.accuracy(scored, "y").first()["accuracy"] == pytest.approx(11 / 15)
