"""Hard negatives against the plain matrix of all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, key string, cell string, block long, windows double, id string"


def usable(row):
    _, vec, label = row[:3]
    return label is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec)


def expected(rows):
    rows = list({(i, tuple(np.float32(x) for x in v), label) for i, v, label in filter(usable, rows)})
    dim = max((len(v) for _, v, _ in rows), default=0)
    whole = np.zeros((len(rows), dim))
    for r, (_, v, _) in enumerate(rows):
        whole[r, : len(v)] = [math.floor(256 * float(x)) for x in v]
    labels = np.array([x[2] for x in rows])
    ids = np.array([2**63 - 1 if x[0] is None else x[0] for x in rows])
    found = []
    for a, (id_, _, label) in enumerate(rows):
        if id_ is None or id_ % 100:
            continue
        scores = (whole @ whole[a]).astype(np.int64)
        order = np.lexsort((ids, -scores))
        good = [i for i in order if labels[i] == label and i != a][:5]
        for g in good:
            p = int(scores[g])
            fits = [i for i in order if labels[i] != label and 80 * p <= 100 * int(scores[i]) <= 100 * p][:5]
            found += [(id_, rows[g][0], k + 1, rows[i][0], p, int(scores[i])) for k, i in enumerate(fits)]
    return sorted(found, key=str)


def got(rows, spark):
    frame = spark.createDataFrame([(*r, "clash", "clash", 1, 0.5, "clash") for r in rows], SCHEMA)
    found = negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0, "vec_id", "label", "embedding")
    return sorted((tuple(r) for r in found.collect()), key=str)


def clustered(n, seed, spread=0.05):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, 16))
    return [
        (i, (centres[c] + spread * draw.normal(size=16)).astype(np.float32).tolist(), int(draw.integers(4)))
        for i, c in enumerate(draw.integers(12, size=n))
    ]


def test_clusters_over_many_blocks(spark):
    rows = clustered(6_000, 1)
    assert got(rows, spark) == expected(rows)


def test_one_very_common_vector(spark):
    rows = clustered(400, 2) + [(400 + i, [0.5] * 16, i % 3) for i in range(5_000)]
    assert got(rows, spark) == expected(rows)


def test_odd_rows(spark):
    draw = random.Random(3)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(draw.choice([4, 4, 4, 3, 0]))], draw.randrange(3)) for i in range(0, 1200, 4)]
    rows += [(100, [1.0, float("nan"), 0.0, 1.0], 1), (200, [1.0, None, 0.0, 1.0], 1), (300, None, 1), (400, [1.0] * 4, None)]
    rows += [(700, [float("inf")] * 4, 0), (None, [0.7, 0.7, 0.7, 0.7], 1), (None, [0.7, 0.7, 0.7, 0.6], 2)]
    rows += [(800, [0.0] * 4, 1), (900, [-0.4] * 4, 1), (0, rows[0][1], rows[0][2])] + rows[5:9]
    assert got(rows, spark) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(100, [1.0], 1)], [(100, [1.0], 1), (200, [2.0], 1)], [(100, [], 1), (101, [], 1), (102, [], 2)]])
def test_small_tables(rows, spark):
    assert got(rows, spark) == expected(rows)


def test_tree_covers_and_skips():
    rows = clustered(4_000, 4, spread=0.02)
    whole = np.floor(256 * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    labels, ids = np.array([r[2] for r in rows]), np.arange(len(rows))
    top = float(negatives._norm(whole).max()) * (1 + 1e-12)
    tree = negatives.CoverTree(ids, labels, whole, top)
    assert sorted(i for m in tree.members for i in m) == list(range(len(rows)))
    # What each node covers: the rows of all nodes under it.
    under = [list(m) for m in tree.members]
    for node in reversed(range(len(under))):
        for child in tree.children[node]:
            assert child > node
            under[node] += under[child]
    sphere = negatives._on_sphere(whole, top)
    for node, centre in enumerate(tree.centres):
        away = np.sqrt(((sphere[under[node]] - sphere[centre]) ** 2).sum(1))
        assert away.max() <= tree.radii[node] + 1e-9
    # The search scores a part of the rows only, and finds what the matrix has.
    query = whole[17].astype(np.float64)
    scored = []

    class Counting(np.ndarray):
        def __getitem__(self, rows):
            found = np.asarray(self)[rows]
            scored.append(len(found))
            return found

    dots = np.asarray(tree._centre_rows) @ query
    tree._rows = tree._rows.view(Counting)
    found = tree.search(query, 17, int(labels[17]), True, [[-(2**62), 2**62, 5]], ids, dots, negatives._norm(whole[17]))[0]
    scores = (whole @ whole[17]).astype(np.int64)
    order = [i for i in np.lexsort((ids, -scores)) if labels[i] == labels[17] and i != 17][:5]
    assert [row for _, _, row in found] == order
    assert sum(scored) < len(rows) / 4


def test_bounds_hold():
    draw = np.random.default_rng(5)
    rows = draw.integers(-300, 300, size=(500, 8))
    top = float(negatives._norm(rows).max()) * (1 + 1e-12)
    sphere = negatives._on_sphere(rows, top)
    for _ in range(50):
        q = draw.integers(-300, 300, size=8)
        c = int(draw.integers(500))
        near = np.argsort(((sphere - sphere[c]) ** 2).sum(1))[: int(draw.integers(1, 200))]
        radius = np.sqrt(((sphere[near] - sphere[c]) ** 2).sum(1)).max()
        low, high = negatives.score_bounds(np.array([rows[c] @ q], float), negatives._norm(q), top, np.array([radius]))
        assert (rows[near] @ q >= low).all() and (rows[near] @ q <= high).all()
