import datetime as dt

import numpy as np
import pytest

from tidemark.operators import quantiles, segments

TX = "CustomerID long, InvoiceDate timestamp_ntz, Quantity double, UnitPrice double"


def test_recency_counts_full_days_to_the_latest_purchase_of_anybody(rows, table):
    data = rows(
        [
            (1, dt.datetime(2011, 12, 8, 23), 1.0, 1.0),
            (2, dt.datetime(2011, 12, 9, 1), 1.0, 1.0),
            (3, dt.datetime(2011, 12, 7, 1), 1.0, 1.0),
            (None, dt.datetime(2011, 12, 30), 1.0, 1.0),
        ],
        TX,
    )
    assert table(segments.recency(data)) == [(1, 0), (2, 0), (3, 2)]
    assert table(segments.rfm_measures(data)) == [(1, 0, 1, 1.0), (2, 0, 1, 1.0), (3, 2, 1, 1.0)]


def test_kmeans_finds_planted_groups(rows, table):
    values = [1, 2, 3, 101, 102, 103, 1001, 1002, 1003]
    data = rows([(i, float(v)) for i, v in enumerate(values)], "id long, x double")
    assert segments.kmeans_centers(data, "x", 3) == [2.0, 102.0, 1002.0]
    labelled = segments.ordered_kmeans(data, "x", 3, "c", ascending=False)
    assert table(labelled, "x", "c") == table(rows([(float(v), 2 - i // 3) for i, v in enumerate(values)], "x double, c int"))


def test_same_centres_however_partitioned(spark):
    rng = np.random.default_rng(3)
    values = [(float(round(v, 3)),) for v in np.concatenate([rng.normal(m, 1.0, 60) for m in (0, 50, 100)])]
    data = spark.createDataFrame(values, "x double")
    one = segments.kmeans_centers(data.repartition(1), "x", 3)
    many = segments.kmeans_centers(data.repartition(7), "x", 3)
    assert one == pytest.approx(many, abs=1e-6)


def test_fit_does_not_depend_on_the_number_of_partitions(spark):
    """Also not on the shuffle that makes the points."""
    rng = np.random.default_rng(8)
    data = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.gamma(2.0, 1000.0, 3000))], "id long, x double")
    before, labels = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            frame = segments.ordered_kmeans(data.repartition(n), "x", 4, "c")
            labels.append(sorted((r.id, r.c) for r in frame.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert labels[0] == labels[1] == labels[2]


def test_nearest_centre_first_wins_a_tie(rows, table):
    data = rows([(0.0,), (5.0,), (10.0,), (None,)], "x double")
    assert table(segments.assign_to_centers(data, "x", [10.0, 0.0], "c")) == [(0.0, 1), (10.0, 0), (5.0, 0), (None, None)]


def test_order_cluster_breaks_ties_by_the_old_number(rows, table):
    data = rows([(0, 5.0), (1, 1.0), (2, 5.0), (None, 9.0)], "c int, y double")
    assert table(segments.order_cluster(data, "c", "y")) == [(0, 1.0), (1, 5.0), (2, 5.0), (None, 9.0)]
    assert table(segments.order_cluster(data, "c", "y", ascending=False)) == [(0, 5.0), (1, 5.0), (2, 1.0), (None, 9.0)]


@pytest.mark.parametrize("score,name", [(0, "Low-Value"), (2, "Low-Value"), (3, "Mid-Value"), (4, "Mid-Value"), (5, "High-Value"), (9, "High-Value")])
def test_value_segments(rows, score, name):
    assert rows([(score,)], "s int").select(segments.value_segment("s")).first()[0] == name


def test_fitted_rfm_scores_rank_good_customers_high(spark):
    data = []
    for c in range(40):
        for i in range(1 + c):
            data.append((c, dt.datetime(2011, 1, 1) + dt.timedelta(days=c * 5), 1.0, 10.0 + c))
    scored = segments.rfm_scores(spark.createDataFrame(data, TX)).collect()
    by_id = {r.CustomerID: r for r in scored}
    assert by_id[39].OverallScore == 9 and by_id[39].Segment == "High-Value"
    assert by_id[0].OverallScore == 0 and by_id[0].Segment == "Low-Value"
    assert all(r.OverallScore == r.RecencyCluster + r.FrequencyCluster + r.RevenueCluster for r in scored)


def test_recency_reads_the_lines_once(spark, tmp_path):
    data = [(1, dt.datetime(2011, 12, 8), 1.0, 1.0)]
    spark.createDataFrame(data, TX).write.parquet(str(tmp_path / "lines"))
    plan = segments.rfm_measures(spark.read.parquet(str(tmp_path / "lines")))._jdf.queryExecution().toString()
    assert "/lines" not in plan.split("== Physical Plan ==")[1]


def test_elbow_never_rises_and_starts_at_the_total_spread(spark):
    values = np.array([1.0, 2, 3, 101, 102, 103])
    frame = spark.createDataFrame([(float(v),) for v in values], "x double")
    errors = [r.inertia for r in segments.elbow(frame, ["x"], range(1, 4), seed=1).orderBy("k").collect()]
    assert errors[0] == pytest.approx(((values - values.mean()) ** 2).sum())
    assert errors[1] == pytest.approx(4.0)
    assert errors == sorted(errors, reverse=True)


def test_labels_and_points(rows, table):
    data = rows([(0, "a", 1.0, 1.0), (2, "b", 2.0, 9.0), (7, "c", 3.0, 1.0)], "c int, Segment string, x double, y double")
    assert table(segments.label_clusters(data, "c"), "c") == [("7",), ("High",), ("Low",)]
    assert table(segments.segment_points(data, "x", "y", {"y": 9.0})) == [("a", 1.0, 1.0), ("c", 3.0, 1.0)]


def brute(values, p):
    return float(np.quantile(np.array(values), p))


CASES = {
    "interpolated": [1.0, 2.0, 3.0, 10.0],
    "single": [4.0],
    "all equal": [7.0] * 500,
    "one value holds a third": [5.0] * 1000 + [float(i) for i in range(2000)],
    "heavy tail": [float(2**i) for i in range(60)],
    "negative and fractional": [((i * 7919) % 1009 - 500) / 8 for i in range(3000)],
}


@pytest.mark.parametrize("name", CASES)
def test_exact_quantiles_equal_brute_force(spark, name):
    values = CASES[name]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.99, "f": 1.0}
    got = quantiles.exact_quantiles(frame, "x", probs).first()
    assert [got[k] for k in probs] == pytest.approx([brute(values, p) for p in probs.values()], rel=1e-12)


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("most", [1, 25])
def test_narrowed_brackets_give_the_same_quantiles(spark, monkeypatch, name, most):
    monkeypatch.setattr(quantiles, "MOST_ORDERED", most)
    test_exact_quantiles_equal_brute_force(spark, name)


def test_quantiles_of_nothing(rows):
    assert quantiles.exact_quantiles(rows([(None,)], "x double"), "x", {"a": 0.5}).first()["a"] is None


def test_exact_quantiles_per_group(spark):
    data = [(g, v) for g, vs in CASES.items() for v in vs] + [(None, 1.0), ("empty", None)]
    frame = spark.createDataFrame(data, "g string, x double").repartition(6)
    got = {r.g: r for r in quantiles.exact_quantiles(frame, "x", {"q": 0.9, "m": 0.5}, ["g"]).collect()}
    assert set(got) == set(CASES)
    for g, values in CASES.items():
        assert (got[g].q, got[g].m) == pytest.approx((brute(values, 0.9), brute(values, 0.5)), rel=1e-12)


@pytest.mark.parametrize("most", [1, 20])
def test_narrowed_groups_give_the_same_quantiles(spark, monkeypatch, most):
    """No band that is ordered holds more than the bound, the hot group's neither."""
    monkeypatch.setattr(quantiles, "MOST_ORDERED", most)
    seen = []
    narrowed = quantiles._narrowed

    def watched(counted, by, probs):
        found = narrowed(counted, by, probs)
        seen.append(found.groupBy(*by, "_band").count().agg({"count": "max"}).first()[0])
        return found

    monkeypatch.setattr(quantiles, "_narrowed", watched)
    test_exact_quantiles_per_group(spark)
    hot = spark.range(60_000).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 7)) AS g", "double((id * 7919) % 50021) / 3 AS x")
    got = {r.g: r.q for r in quantiles.exact_quantiles(hot, "x", {"q": 0.37}, ["g"]).collect()}
    values = {}
    for r in hot.collect():
        values.setdefault(r.g, []).append(r.x)
    assert got == pytest.approx({g: brute(v, 0.37) for g, v in values.items()}, rel=1e-12)
    assert max(seen) <= most


def test_describe(rows):
    got = quantiles.describe(rows([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double"), "x").first()
    assert got.asDict() == pytest.approx(
        {"count": 4, "mean": 4.0, "std": 4.08248290463863, "min": 1.0, "p25": 1.75, "p50": 2.5, "p75": 4.75, "max": 10.0}
    )


def test_trim_is_strict(rows, table):
    data = rows([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert table(quantiles.trim_upper(data, "x", 0.75)) == [(1.0,), (2.0,), (3.0,)]
    assert table(quantiles.trim_upper(data, "x", 1.0)) == [(1.0,), (2.0,), (3.0,)]
