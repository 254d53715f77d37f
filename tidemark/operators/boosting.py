"""Boosted trees of second order, grown from histograms, for two or more classes.

Every feature is cut into at most ``BINS`` bins once.  A round grows one tree per class
(one in all for two classes), level by level: a single pass over the rows adds up, for every
(tree, node, feature, bin), the first and second derivatives of the loss, and the
best split of every node of the level follows from these sums.  Only sums leave a task.
Of two siblings the lighter one is added up; the other is what is left of their parent.
Large sums are added up by slice in tasks, so the driver gets each number once, however
many tasks there are.

Gradients are whole multiples of 2^-24, so sums are exact and a model does not
depend on the partitions or on the order in which they are read.

Rows are kept as blocks of numbers that tasks add up (the one place where rows are not
a DataFrame), dealt evenly over all cores: a level is one small job without a plan.  Features
of few bins share a byte, so they are read and added up together.  The margins of a round
are stored next to the rows; every ``CHECKPOINT_ROUNDS`` rounds they are written to
``spark.checkpoint.dir``, so that a lost executor costs some rounds at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import shared_folder

BINS = 255
# Bounded sample that chooses the cut points; every row counts in every histogram.
CUT_ROWS = 50_000
BLOCK = 16_384
# Rows of a task at most, where there are more than the cores share out.
TASK_ROWS = 1 << 20
CHECKPOINT_ROUNDS = 10
# Tasks, and bytes of all of them, whose sums the driver adds up itself; others are added up by slice in tasks first.
DIRECT_SUMS = 32
DIRECT_BYTES = 1 << 19
SLICES = 8
# Values of a code that several features share.
SHARED = 256
UNIT = float(1 << 24)
MOST_CLASSES = 100


@dataclass(frozen=True)
class Layout:
    """Where the bins of the features stand in the codes of a row.

    A feature is one digit of a code: features of few bins share one, up to ``SHARED`` values.
    A missing value is the last bin of its feature.
    """

    sizes: np.ndarray  # bins by feature, the one for missing values included
    code: np.ndarray  # the code a feature belongs to
    unit: np.ndarray  # what a step of its digit adds to the code
    widths: np.ndarray  # values by code

    @staticmethod
    def of(sizes: np.ndarray) -> Layout:
        code, unit, widths = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), []
        for f in np.argsort(sizes, kind="stable").tolist():
            if not widths or widths[-1] * sizes[f] > SHARED:
                widths.append(1)
            code[f], unit[f] = len(widths) - 1, widths[-1]
            widths[-1] *= int(sizes[f])
        return Layout(sizes, code, unit, np.array(widths, np.int64))

    @property
    def kind(self) -> np.dtype:
        return np.min_scalar_type(int(self.widths.max(initial=1)) - 1)

    def codes(self, values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
        """Codes by (code, row) of values by (row, feature)."""
        found = np.zeros((len(self.widths), len(values)), self.kind)
        for f, cut in enumerate(cuts):
            found[self.code[f]] += (bin_codes(values[:, f : f + 1], [cut])[0] * self.unit[f]).astype(self.kind)
        return found

    def by_feature(self, sums: Sequence[np.ndarray]) -> np.ndarray:
        """Sums by (node, bin of any feature, derivative) from those by (derivative, node, value) of each code."""
        found = []
        for size, code, unit in zip(self.sizes.tolist(), self.code.tolist(), self.unit.tolist()):
            digits = sums[code].reshape(2, sums[code].shape[1], int(self.widths[code]) // (size * unit), size, unit)
            found.append(digits.sum((2, 4)).transpose(1, 2, 0))
        return np.concatenate(found, 1)


@dataclass(frozen=True)
class Tree:
    """Node 0 is the root; a row goes left where its value is below the cut of the node's feature.

    ``feature`` is -1 in a leaf; ``missing_left`` says where rows without a value go.
    """

    feature: np.ndarray
    cut: np.ndarray  # the last bin that goes left
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves(self, codes: np.ndarray, layout: Layout) -> np.ndarray:
        """The node of each row of ``codes`` by (code, row)."""
        rows, at = np.arange(codes.shape[1]), np.zeros(codes.shape[1], np.int64)
        nodes, width = np.arange(len(self.feature)), int(layout.widths.max(initial=1))
        inner = np.flatnonzero(self.feature >= 0)
        feature = self.feature[inner]
        # The next node by (node, code); a leaf is followed by itself.
        bins = np.arange(width) // layout.unit[feature, None] % layout.sizes[feature, None]
        goes_left = np.where(
            bins == layout.sizes[feature, None] - 1, self.missing_left[inner, None], bins <= self.cut[inner, None]
        )
        following = np.repeat(nodes[:, None], width, 1)
        following[inner] = np.where(goes_left, self.left[inner, None], self.right[inner, None])
        start = np.zeros(len(nodes), np.int64)
        start[inner] = layout.code[feature] * len(rows)
        level, flat, following = np.zeros(1, np.int64), codes.ravel(), following.ravel()
        while (level := level[self.feature[level] >= 0]).size:
            at = following.take(at * width + flat.take(start.take(at) + rows))
            level = np.concatenate([self.left[level], self.right[level]])
        return at


@dataclass(frozen=True)
class BoostedTrees:
    """A fitted model; ``rounds[r][k]`` is the tree of class ``k`` (the only one for two classes) in round ``r``."""

    features: tuple[str, ...]
    n_classes: int
    cuts: tuple[np.ndarray, ...]
    rounds: tuple[tuple[Tree, ...], ...]

    def margins(self, values: np.ndarray) -> np.ndarray:
        """Added leaf values by (row, class)."""
        layout = Layout.of(np.array([len(c) + 2 for c in self.cuts], np.int64))
        codes = layout.codes(values, self.cuts)
        found = np.zeros((len(values), 1 if self.n_classes == 2 else self.n_classes))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                found[:, k] += tree.value[tree.leaves(codes, layout)]
        return found

    def probabilities(self) -> Column:
        """The chance of each class, in class order, as an array column."""
        model = self

        @F.pandas_udf("array<double>")
        def chances(*columns: pd.Series) -> pd.Series:
            # The last column only says how many rows there are.
            values = np.empty((len(columns[-1]), len(columns) - 1))
            for i, column in enumerate(columns[:-1]):
                values[:, i] = column.to_numpy(np.float64, na_value=np.nan)
            return pd.Series(list(_chances(model.margins(values))))

        return chances(*[F.col(f"`{c}`").cast("double") for c in self.features], F.lit(1))

    def used(self) -> dict[str, tuple[int, float]]:
        """Splits and gain of each feature."""
        found = {name: (0, 0.0) for name in self.features}
        for trees in self.rounds:
            for tree in trees:
                for f, g in zip(tree.feature.tolist(), tree.gain.tolist()):
                    if f >= 0:
                        splits, gain = found[self.features[f]]
                        found[self.features[f]] = splits + 1, gain + g
        return found


def bin_codes(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bins by (feature, row) of values by (row, feature): how many cuts are not above the value; a missing value has a bin of its own, the last."""
    codes = np.empty(values.shape[::-1], np.int16)
    for f, cut in enumerate(cuts):
        codes[f] = np.searchsorted(cut, values[:, f], "right")
        codes[f, np.isnan(values[:, f])] = len(cut) + 1
    return codes


def cut_points(sample: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, ...]:
    """Per feature the middles between neighbouring values, or between ``bins`` quantiles where there are more values."""
    found = []
    for column in sample.T:
        values = np.unique(column[~np.isnan(column)])
        if len(values) > bins:
            ordered = np.sort(column[~np.isnan(column)])
            values = np.unique(ordered[np.linspace(0, len(ordered) - 1, bins).astype(np.int64)])
        found.append(values[:-1] + (values[1:] - values[:-1]) / 2)
    return tuple(found)


def _chances(margins: np.ndarray) -> np.ndarray:
    if margins.shape[1] == 1:
        one = 1 / (1 + np.exp(-margins))
        return np.concatenate([1 - one, one], 1)
    powers = np.exp(margins - margins.max(1, keepdims=True))
    return powers / powers.sum(1, keepdims=True)


def _derivatives(margins: np.ndarray, label: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss by (row, tree), in whole units."""
    chance = _chances(margins)
    if n_classes == 2:
        chance = chance[:, 1:]
        first, second = chance - label[:, None], chance * (1 - chance)
    else:
        first, second = chance - (label[:, None] == np.arange(n_classes)), 2 * chance * (1 - chance)
    return np.round(first * UNIT), np.round(np.maximum(second, 1e-16) * UNIT)


class _Growing:
    """A tree under construction."""

    def __init__(self):
        self.nodes = [[-1, 0, True, 0, 0, 0.0, 0.0]]
        self.open = [0]
        # Open nodes whose rows are added up, each with its sibling and the sums of its parent.
        self.counted: dict[int, tuple[int, np.ndarray] | None] = {0: None}

    def tree(self) -> Tree:
        columns = list(zip(*self.nodes))
        kinds = (np.int64, np.int64, bool, np.int64, np.int64, np.float64, np.float64)
        return Tree(*(np.array(c, k) for c, k in zip(columns, kinds)))

    def level_sums(self, counted: np.ndarray) -> list[np.ndarray]:
        """Sums of the open nodes, from those of the counted ones."""
        found = {}
        for (node, kin), sums in zip(self.counted.items(), counted):
            found[node] = sums
            if kin:
                found[kin[0]] = kin[1] - sums
        return [found[node] for node in self.open]

    def split(
        self, node: int, feature: int, cut: int, missing_left: bool, gain: float, values: tuple[float, float], sums: np.ndarray, left_lighter: bool
    ) -> None:
        at = len(self.nodes)
        self.nodes[node][:5] = [feature, cut, missing_left, at, at + 1]
        self.nodes[node][6] = gain
        self.nodes += [[-1, 0, True, 0, 0, v, 0.0] for v in values]
        self.open += [at, at + 1]
        lighter, other = (at, at + 1) if left_lighter else (at + 1, at)
        self.counted[lighter] = other, sums


def _histograms(trees: list[Tree], counted: list[list[int]], layout: Layout, n_classes: int):
    """Adds up the derivatives of the rows of a task by (tree, counted node, bin of any feature, derivative)."""

    def add(blocks: Iterator[tuple]) -> Iterator[np.ndarray]:
        sums = [[np.zeros((2, len(nodes), w), np.int64) for w in layout.widths] for nodes in counted]
        for codes, label, margins in blocks:
            derivatives = _derivatives(margins, label, n_classes)
            for k, (tree, nodes) in enumerate(zip(trees, counted)):
                if not nodes:
                    continue
                slot = np.full(len(tree.feature), -1)
                slot[nodes] = np.arange(len(nodes))
                place = slot.take(tree.leaves(codes, layout))
                here = np.flatnonzero(place >= 0)
                everywhere = len(here) == len(place)
                place, weights = place[here], [d[here, k] for d in derivatives]
                for code, width, found in zip(codes, layout.widths.tolist(), sums[k]):
                    cells = place * width + (code if everywhere else code.take(here))
                    for d in range(2):
                        # Whole numbers, far below 2^53 in one block: exact in doubles.
                        found[d] += np.bincount(cells, weights[d], len(nodes) * width).astype(np.int64).reshape(len(nodes), width)
        yield np.concatenate([layout.by_feature(s) for s in sums])

    return add


def _best_splits(sums: np.ndarray, first_bin: np.ndarray, last_cut: np.ndarray, missing_bin: np.ndarray, penalty: float, least: float):
    """For each node: gain, place among all bins, whether missing values go left, and the sums of both sides.

    ``sums`` is by (node, bin, derivative); a cut after bin ``b`` sends it and all before it left.
    """
    g, h = sums[..., 0], sums[..., 1]
    ends = np.concatenate([first_bin[1:], [sums.shape[1]]])
    of = np.repeat(np.arange(len(first_bin)), ends - first_bin)

    def running(x):
        up = np.cumsum(x, axis=1)
        return up - (up[:, first_bin] - x[:, first_bin])[:, of]

    whole_g, whole_h = (running(x)[:, ends - 1][:, :1] for x in (g, h))
    left_g, left_h = running(g), running(h)
    lost_g, lost_h = g[:, missing_bin][:, of], h[:, missing_bin][:, of]
    best = []
    for with_missing in (False, True):
        gl, hl = left_g + lost_g * with_missing, left_h + lost_h * with_missing
        gr, hr = whole_g - gl, whole_h - hl
        allowed = last_cut[None, :] & (hl >= least * UNIT) & (hr >= least * UNIT)
        parts = [np.where(allowed, (x / UNIT) ** 2 / (y / UNIT + penalty), 0.0) for x, y in ((gl, hl), (gr, hr))]
        whole = (whole_g / UNIT) ** 2 / (whole_h / UNIT + penalty)
        best.append(np.where(allowed, (parts[0] + parts[1] - whole) / 2, -np.inf))
    gains = np.stack(best, 1)
    at = gains.reshape(len(sums), -1).argmax(1)
    side, place = at // sums.shape[1], at % sums.shape[1]
    node = np.arange(len(sums))
    gl = left_g[node, place] + lost_g[node, place] * side
    hl = left_h[node, place] + lost_h[node, place] * side
    return gains[node, side, place], place, side == 1, (gl, hl), (whole_g[:, 0] - gl, whole_h[:, 0] - hl)


def _blocks(train: DataFrame, label: str, features: Sequence[str], cuts: tuple[np.ndarray, ...], layout: Layout, rows: int, width: int) -> RDD:
    """Codes by (code, row), labels, and margins by (row, tree) of blocks of rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def out():
            codes, labels = np.concatenate([h[0] for h in held], 1), np.concatenate([h[1] for h in held])
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (codes, labels)], ["codes", "labels"])

        for batch in batches:
            if len(batch):
                values = np.column_stack([_doubles(c) for c in batch.columns[1:]] or [np.zeros((len(batch), 0))])
                held.append((layout.codes(values, cuts), batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)))
                count += len(batch)
            if count >= BLOCK:
                yield out()
                held, count = [], 0
        if held:
            yield out()

    chosen = train.select(F.col(f"`{label}`").cast("int"), *[F.col(f"`{c}`").cast("double") for c in features])

    def unpack(row):
        labels = np.frombuffer(row["labels"], np.int32)
        return np.frombuffer(row["codes"], layout.kind).reshape(len(layout.widths), len(labels)), labels, np.zeros((len(labels), width))

    # A block for each task at least; then as many tasks as cores, with the same number of rows each.
    tasks = max(min(1 + rows // BLOCK, train.sparkSession.sparkContext.defaultParallelism), 1 + rows // TASK_ROWS)
    packed = chosen.repartition(tasks).mapInArrow(pack, "codes binary, labels binary")
    return packed.rdd.map(unpack)


def _doubles(column: pa.Array) -> np.ndarray:
    return column.fill_null(float("nan")).to_numpy(zero_copy_only=False)


def _summed(sums: RDD, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of the arrays of all tasks; the driver gets it once, not once per task, where it is large."""
    tasks, cells = sums.getNumPartitions(), int(np.prod(shape))
    if tasks <= DIRECT_SUMS and tasks * cells * 8 <= DIRECT_BYTES:
        return np.sum(sums.collect(), axis=0)
    slices = min(SLICES, tasks)
    parts = sums.flatMap(lambda x: enumerate(np.array_split(x.ravel(), slices))).reduceByKey(np.add, slices)
    return np.concatenate([part for _, part in sorted(parts.collect(), key=lambda x: x[0])]).reshape(shape)


def boost(
    train: DataFrame,
    label: str,
    features: Sequence[str],
    n_classes: int | None = None,
    rounds: int = 100,
    depth: int = 5,
    step: float = 0.1,
    penalty: float = 1.0,
    least_weight: float = 1.0,
    bins: int = BINS,
) -> BoostedTrees:
    """Fits on rows whose ``label`` is 0, 1, …; rows with another or no label are left out.

    ``penalty`` is added to the second derivatives of a leaf, whose value is shrunk by
    ``step``; both sides of a split hold second derivatives of ``least_weight`` at least.
    With no rows, or no useful split, all classes are equally likely.
    """
    spark = train.sparkSession
    features = list(features)
    known = F.col(f"`{label}`").cast("int")
    train = train.where(known >= 0)
    count, most = train.agg(F.count(F.lit(1)), F.max(known)).first()
    n_classes = n_classes or max(2, 1 + (most or 0))
    if n_classes > MOST_CLASSES:
        raise ValueError(f"{n_classes} classes: more than {MOST_CLASSES}")
    train = train.where(known < n_classes)
    values = [F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(features)]
    if not count or not features:
        return BoostedTrees(tuple(features), n_classes, tuple(np.empty(0) for _ in features), ())
    sample = train.select(*values).orderBy(F.xxhash64(*[f"v{i}" for i in range(len(features))])).limit(CUT_ROWS).toArrow()
    cuts = cut_points(np.column_stack([_doubles(c.combine_chunks()) for c in sample.columns]), bins)

    # Bins of a feature: one more than cuts, and one for missing values.
    sizes = np.array([len(c) + 2 for c in cuts])
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    total, missing, layout = int(sizes.sum()), sizes - 1, Layout.of(sizes)
    last_cut = np.ones(total, bool)
    last_cut[offsets + missing] = last_cut[offsets + missing - 1] = False
    width = 1 if n_classes == 2 else n_classes

    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    rows = _blocks(train, label, features, cuts, layout, count, width).persist(StorageLevel.MEMORY_AND_DISK)
    done: list[tuple[Tree, ...]] = []
    before = rows
    try:
        for r in range(rounds):
            growing = [_Growing() for _ in range(width)]
            for _ in range(depth):
                if not any(g.open for g in growing):
                    break
                counted = [list(g.counted) for g in growing]
                job = _histograms([g.tree() for g in growing], counted, layout, n_classes)
                found = _summed(rows.mapPartitions(job), (sum(map(len, counted)), total, 2))
                if before is not rows:
                    # The margins of the last round are stored now.
                    before.unpersist()
                    before = rows
                places = np.cumsum([0, *map(len, counted)])
                sums = [x for g, a, b in zip(growing, places, places[1:]) for x in g.level_sums(found[a:b])]
                best = _best_splits(np.stack(sums), offsets, last_cut, offsets + missing, penalty, least_weight)
                node = 0
                for g in growing:
                    level, g.open, g.counted = g.open, [], {}
                    for open_node in level:
                        gain, place, missing_left, left, right = (
                            best[0][node], best[1][node], best[2][node], [x[node] for x in best[3]], [x[node] for x in best[4]]
                        )
                        if open_node == 0:
                            whole = left[0] + right[0], left[1] + right[1]
                            g.nodes[0][5] = -step * (whole[0] / UNIT) / (whole[1] / UNIT + penalty)
                        own, node = sums[node], node + 1
                        if gain > 1e-9:
                            feature = int(np.searchsorted(offsets, place, "right")) - 1
                            leaves = tuple(-step * (x / UNIT) / (y / UNIT + penalty) for x, y in (left, right))
                            cut = int(place - offsets[feature])
                            g.split(open_node, feature, cut, bool(missing_left), float(gain), leaves, own, bool(left[1] <= right[1]))
            trees = tuple(g.tree() for g in growing)
            done.append(trees)
            rows = rows.map(_moved(trees, layout)).persist(StorageLevel.MEMORY_AND_DISK)
            if (r + 1) % CHECKPOINT_ROUNDS == 0:
                rows.checkpoint()
    finally:
        before.unpersist()
        rows.unpersist()
    return BoostedTrees(tuple(features), n_classes, cuts, tuple(done))


def _moved(trees: tuple[Tree, ...], layout: Layout):
    """Adds the leaf values of a round to the margins."""

    def move(block: tuple) -> tuple:
        codes, label, margins = block
        return codes, label, margins + np.column_stack([t.value.take(t.leaves(codes, layout)) for t in trees])

    return move
