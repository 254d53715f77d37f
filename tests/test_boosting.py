"""Boosted trees against a plain booster that tries every split of every node."""

import math
import random

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from tidemark.operators import boosting, models

NAN = float("nan")


def rows_of(n, seed, classes, missing=0.0):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = draw.random(), draw.randrange(4), draw.gauss(0, 1)
        label = int(a > 0.6) + int(b == 2 and c > 0) if classes == 3 else int((a > 0.5) != (b == 1))
        if draw.random() < 0.1:
            label = draw.randrange(classes)
        rows.append((i, None if draw.random() < missing else a, b, c, label))
    return rows


def frame(spark, rows, partitions=3):
    return spark.createDataFrame(rows, "id long, a double, b int, c double, y int").repartition(partitions)


def plain_boost(rows, classes, rounds, depth, step, penalty=1.0, least=1.0):
    """Margins of every row, by trying every middle between neighbouring values."""
    x = np.array([[NAN if v is None else v for v in r[1:4]] for r in rows], float)
    y = np.array([r[4] for r in rows])
    width = 1 if classes == 2 else classes
    margins = np.zeros((len(rows), width))

    def grow(at, g, h, left, out):
        whole = g[at].sum(), h[at].sum()
        out[at] = -step * whole[0] / (whole[1] + penalty)
        best = (1e-9, None)
        for f in range(x.shape[1]):
            values = np.unique(x[at, f][~np.isnan(x[at, f])])
            # Cuts of the whole table, as a histogram has them.
            every = np.unique(x[:, f][~np.isnan(x[:, f])])
            for cut in every[:-1] + (every[1:] - every[:-1]) / 2 if len(values) > 0 else ():
                for missing_left in (False, True):
                    goes = np.where(np.isnan(x[at, f]), missing_left, x[at, f] < cut)
                    a, b = at[goes], at[~goes]
                    if h[a].sum() < least or h[b].sum() < least:
                        continue
                    parts = [g[s].sum() ** 2 / (h[s].sum() + penalty) for s in (a, b)]
                    gain = (sum(parts) - whole[0] ** 2 / (whole[1] + penalty)) / 2
                    if gain > best[0] + 1e-7:
                        best = gain, (a, b)
        if best[1] is not None and left:
            for side in best[1]:
                grow(side, g, h, left - 1, out)

    for _ in range(rounds):
        if classes == 2:
            p = 1 / (1 + np.exp(-margins[:, 0]))
            pairs = [(p - y, p * (1 - p))]
        else:
            p = np.exp(margins) / np.exp(margins).sum(1, keepdims=True)
            pairs = [(p[:, k] - (y == k), 2 * p[:, k] * (1 - p[:, k])) for k in range(classes)]
        for k, (g, h) in enumerate(pairs):
            out = np.zeros(len(rows))
            grow(np.arange(len(rows)), g, h, depth, out)
            margins[:, k] += out
    return margins


@pytest.mark.parametrize("classes, missing", [(2, 0.0), (3, 0.0), (2, 0.2)])
def test_equals_the_plain_booster(spark, classes, missing):
    rows = rows_of(160, classes, classes, missing)
    model = boosting.boost(frame(spark, rows), "y", ["a", "b", "c"], rounds=6, depth=3, step=0.3)
    values = np.array([[NAN if v is None else v for v in r[1:4]] for r in rows], float)
    assert np.allclose(model.margins(values), plain_boost(rows, classes, 6, 3, 0.3), atol=1e-4)


def test_scores_are_the_models_chances(spark):
    rows = rows_of(200, 5, 3, 0.1)
    data = frame(spark, rows)
    model = models.train_multiclass(data, "y", ["a", "b", "c"], rounds=4)
    found = {r["id"]: r for r in models.score_classes(data, model, ["p0", "p1", "p2", "p3"]).collect()}
    margins = model.margins(np.array([[NAN if v is None else v for v in r[1:4]] for r in rows], float))
    for r, m in zip(rows, margins):
        chances = np.exp(m) / np.exp(m).sum()
        row = found[r[0]]
        assert [row["p0"], row["p1"], row["p2"]] == pytest.approx(chances.tolist())
        assert row["p3"] == 0.0 and row["prediction"] == chances.argmax()


def test_partitions_do_not_matter(spark):
    rows = rows_of(3_000, 7, 3)
    fits = [boosting.boost(frame(spark, rows, n), "y", ["a", "b", "c"], rounds=12, depth=4) for n in (1, 7)]
    for one, other in zip(*[f.rounds for f in fits]):
        for a, b in zip(one, other):
            assert a.feature.tolist() == b.feature.tolist() and a.value.tolist() == b.value.tolist()


def test_margins_survive_several_blocks_and_checkpoints(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 100)
    monkeypatch.setattr(boosting, "DIRECT_SUMS", 2)
    rows = rows_of(500, 8, 2)
    many = boosting.boost(frame(spark, rows, 5), "y", ["a", "b", "c"], rounds=21, depth=2)
    monkeypatch.undo()
    one = boosting.boost(frame(spark, rows, 1), "y", ["a", "b", "c"], rounds=21, depth=2)
    assert [t[0].value.tolist() for t in many.rounds] == [t[0].value.tolist() for t in one.rounds]


def test_finds_what_was_planted(spark):
    rows = rows_of(4_000, 9, 2)
    train, test = frame(spark, rows[:3_000]), frame(spark, rows[3_000:])
    model = models.train_binary(train, "y", ["a", "b", "c"], rounds=30, step=0.3)
    right = models.score(test, model).agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0]
    # A tenth of the labels is a coin flip; the rule takes both features together.
    assert right > 0.9
    used = {r["feature"]: r["gain"] for r in models.feature_importance(train, model).collect()}
    assert used["a"] + used["b"] > 0.8 and sum(used.values()) == pytest.approx(1)


@pytest.mark.parametrize("labels", [[], [None, None], [1, 1, 1], [0]])
def test_odd_tables(spark, labels):
    data = spark.createDataFrame([(i, None, 1, 0.5, y) for i, y in enumerate(labels)], "id long, a double, b int, c double, y int")
    model = models.train_binary(data, "y", ["a", "b", "c"], rounds=3)
    scored = models.score(spark.createDataFrame([(1, None, None, 2.0, 1)], data.schema), model).first()
    assert math.isfinite(scored["proba"]) and 0 <= scored["proba"] <= 1


def test_many_values_are_cut_at_quantiles():
    column = np.concatenate([np.arange(10_000.0), [NAN] * 5])
    (cuts,) = boosting.cut_points(column[:, None], 255)
    assert len(cuts) == 254 and (np.diff(cuts) > 0).all()
    codes = boosting.bin_codes(column[:, None], [cuts])
    assert codes.max() == 255 and np.bincount(codes[0, :-5]).max() < 45


def test_the_driver_gets_large_sums_once(spark, monkeypatch):
    """Whatever the number of tasks; one task alone has no more than that."""
    got = []
    collect = RDD.collect

    def counted(rdd):
        found = collect(rdd)
        got.append(sum((x[1] if isinstance(x, tuple) else x).nbytes for x in found))
        return found

    parts = [np.arange(60_000).reshape(10, 3_000, 2) * i for i in range(12)]
    monkeypatch.setattr(RDD, "collect", counted)
    found = boosting._summed(spark.sparkContext.parallelize(parts, 12), parts[0].shape)
    assert (found == parts[0] + 66 * parts[1]).all() and found.shape == (10, 3_000, 2)
    assert sum(got) == parts[0].nbytes


@pytest.mark.parametrize("sizes", [[3, 257, 3, 3, 90, 3, 3, 4, 2], [2], [256, 256], [3, 3]])
def test_features_of_few_bins_share_codes(sizes):
    draw = np.random.default_rng(len(sizes))
    cuts = [np.arange(1.0, s - 1) for s in sizes]
    values = np.column_stack([draw.integers(0, s - 1, 500) for s in sizes]).astype(float)
    values[draw.random(values.shape) < 0.1] = NAN
    layout = boosting.Layout.of(np.array(sizes))
    codes, bins = layout.codes(values, cuts), boosting.bin_codes(values, cuts)
    assert len(codes) < len(sizes) or max(sizes) ** 2 > boosting.SHARED or len(sizes) == 1
    for f, size in enumerate(sizes):
        assert (codes[layout.code[f]] // layout.unit[f] % size == bins[f]).all()
    sums = [np.stack([np.bincount(c, minlength=w)] * 2)[:, None] for c, w in zip(codes, layout.widths)]
    plain = np.concatenate([np.bincount(b, minlength=s) for b, s in zip(bins, sizes)])
    assert (layout.by_feature(sums) == np.stack([plain, plain], 1)).all()


def test_rows_of_one_partition_are_dealt_over_the_cores(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 100)
    data = frame(spark, rows_of(2_000, 11, 2), 1)
    layout = boosting.Layout.of(np.array([2, 2, 2]))
    blocks = boosting._blocks(data, "y", ["a", "b", "c"], (np.empty(0),) * 3, layout, 2_000, 1)
    rows = blocks.mapPartitions(lambda part: [sum(len(label) for _, label, _ in part)]).collect()
    assert len(rows) == spark.sparkContext.defaultParallelism and sum(rows) == 2_000
    assert max(rows) <= 2 * min(rows)


def test_trees_that_end_early(spark):
    """Nobody is of class 3, so its trees stay roots while the others grow."""
    rows = rows_of(300, 12, 3)
    model = boosting.boost(frame(spark, rows), "y", ["a", "b", "c"], n_classes=4, rounds=3, depth=3, least_weight=30.0)
    sizes = [[len(t.feature) for t in trees] for trees in model.rounds]
    assert max(map(max, sizes)) > min(map(min, sizes))
    layout = boosting.Layout.of(np.array([3, 3, 257]))
    assert layout.by_feature([np.zeros((2, 0, w), np.int64) for w in layout.widths]).shape == (0, 263, 2)
