"""Hard negatives: for each anchor and positive, the best other-label rows just below the positive.

A score is the inner product of integer vectors.  Rows are augmented to one norm,
``x' = (x, sqrt(M^2 - |x|^2))``, so that a score is ``M |q| cos(angle(q', x'))`` and a ball of
rows bounds the scores in it from both sides.

1. Some rows, a bounded sample (``CENTRES``), are chosen as centres by farthest-first
   search; every row goes to its nearest centre, a large cell is split by a hash into
   blocks of about ``BLOCK`` rows.  The centres and the covering radius of each cell are all
   that the driver holds.
2. Anchors are sent, in chunks of about ``CHUNK``, to the blocks of the cells that may hold a wanted
   score.  A task reads the rows of a block, builds their cover tree and lets the anchors
   stream past it.
3. In the tree, nodes are split level by level with shrinking covering radii.  An anchor
   descends best-first: the node with the highest bound comes first, nodes wholly outside
   the anchor's windows or without a wanted label are skipped, the rows of a leaf are scored
   exactly in integers, and the search ends when no bound reaches the last place wanted.
4. An anchor first asks its own cell; what it finds there narrows what it asks of the others.
   This is done for the positives, and then once for the windows below them.

Every row is indexed and the bounds are safe, so the result is exact: recall is 1.

Defined cases: rows with a null label, a null vector or a null or non-finite component take
no part; exactly repeated rows are one row, rows with the same id but other values are
rows of their own; shorter vectors are filled with zeros; components are cut to +-2^25, so
that scores of 64 of them fit a long; null ids come last in ties and are no anchors; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import materialize

BLOCK = 4096
CENTRES, SAMPLE = 256, 8192
CHUNK = 50_000
MOST_TASKS = 10_000
LEAF = 64
SHRINK = 0.7
LIMIT = 1 << 25
NO_ID = 2**63 - 1


def vectors(column: pa.ListArray, dim: int) -> np.ndarray:
    """A list column as a matrix of whole numbers, short rows filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    found = np.zeros((len(column), dim), np.int64)
    found[np.arange(dim) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return found


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(-1))


def _on_sphere(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with the component that gives all of them the norm ``top``."""
    x = x.astype(np.float64)
    rest = np.sqrt(np.maximum(top * top - (x * x).sum(-1), 0.0))
    return np.concatenate([x, rest[..., None]], -1)


def _farthest_first(points: np.ndarray, most: int, radius: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres until all points are within ``radius`` or there are ``most``; for each point its centre's place and distance."""
    chosen = [0]
    distance = np.sqrt(((points - points[0]) ** 2).sum(1))
    nearest = np.zeros(len(points), np.int64)
    while len(chosen) < most and distance.max() > radius:
        far = int(distance.argmax())
        new = np.sqrt(((points - points[far]) ** 2).sum(1))
        closer = new < distance
        nearest[closer], distance[closer] = len(chosen), new[closer]
        chosen.append(far)
    return np.array(chosen), nearest, distance


def score_bounds(dots: np.ndarray, query_norm: np.ndarray, top: float, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and highest score of rows within ``radius`` of centres whose scores are ``dots``."""
    scale = np.maximum(query_norm * top, 1e-300)
    angle = np.arccos(np.clip(dots / scale, -1.0, 1.0))
    width = 2 * np.arcsin(np.clip(radius / max(2 * top, 1e-300), 0.0, 1.0))
    # Some room for rounding, far above what double arithmetic loses.
    room = 1e-6 * (1.0 + scale)
    return scale * np.cos(np.minimum(angle + width, np.pi)) - room, scale * np.cos(np.maximum(angle - width, 0.0)) + room


@dataclass
class CoverTree:
    """Nodes over the rows of a block: each has a centre row, a covering radius, and either children or rows."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    top: float
    centres: list[int] = field(default_factory=list)
    radii: list[float] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    members: list[np.ndarray] = field(default_factory=list)
    kinds: list[set[int]] = field(default_factory=list)

    def __post_init__(self):
        self._sphere = _on_sphere(self.rows, self.top)
        # Doubles are exact, and much faster, while sums stay under 2^53.
        self._exact = float(np.abs(self.rows).max(initial=0)) ** 2 * self.rows.shape[1] < 2**50
        self.scored = self.rows.astype(np.float64) if self._exact else self.rows
        everything = np.arange(len(self.rows))
        self._grow(everything, 0)
        self._centre_rows = self.scored[np.array(self.centres)]
        self._radii = np.array(self.radii)
        # Rows in the order of their leaves: a leaf is a slice, scored without a copy.
        self._order = np.concatenate(self.members)
        ends = np.cumsum([len(m) for m in self.members])
        self._slices = list(zip((ends - [len(m) for m in self.members]).tolist(), ends.tolist()))
        self._rows, self._own_labels = self.scored[self._order], self.labels[self._order]

    def _grow(self, rows: np.ndarray, centre: int) -> None:
        """Adds a node and, level by level with smaller radii, the nodes under it."""
        open_ = [(rows, centre, -1)]
        while open_:
            rows, centre, parent = open_.pop()
            away = np.sqrt(((self._sphere[rows] - self._sphere[centre]) ** 2).sum(1))
            node = len(self.centres)
            self.centres.append(centre)
            self.radii.append(float(away.max()))
            self.children.append([])
            self.members.append(rows)
            self.kinds.append(set(self.labels[rows].tolist()))
            if parent >= 0:
                self.children[parent].append(node)
            if len(rows) <= LEAF or away.max() == 0.0:
                continue
            order = np.concatenate([[rows[away.argmin()]], np.delete(rows, away.argmin())])
            most, radius = max(2, len(rows) // 8), float(away.max())
            while True:
                radius *= SHRINK
                chosen, nearest, far = _farthest_first(self._sphere[order], most, radius)
                if len(chosen) > 1:
                    break
            # Rows too spread for fewer centres stay one leaf: a deeper level would save nothing.
            if far.max() <= radius:
                self.members[node] = rows[:0]
                open_ += [(order[nearest == i], int(order[c]), node) for i, c in enumerate(chosen)]

    def search(self, query: np.ndarray, own: int, label: int, same: bool, windows: list[list], keys: np.ndarray, dots, norm):
        """The best rows in each window ``[least, most, wanted]``, as (-score, id, row), best first."""
        found: list[list] = [[] for _ in windows]
        least = [w[0] if w[0] <= w[1] else NO_ID for w in windows]
        highest = max((w[1] for w in windows), default=-NO_ID)

        def wanted(low: float, high: float) -> bool:
            return any(high >= lo and low <= w[1] for lo, w in zip(least, windows))

        low, high = score_bounds(dots, norm, self.top, self._radii)
        queue = [(-high[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if not any(-bound >= lo for lo in least):
                break
            if not wanted(low[node], -bound) or not (label in self.kinds[node] if same else self.kinds[node] != {label}):
                continue
            for child in self.children[node]:
                heapq.heappush(queue, (-high[child], child))
            start, end = self._slices[node]
            if start == end:
                continue
            scores = self._rows[start:end] @ query
            # What no window takes any more, or has another label than wanted, is not looked at again.
            may = (self._own_labels[start:end] == label) == same
            may &= scores >= min(least)
            may &= scores <= highest
            may = np.flatnonzero(may)
            if not len(may):
                continue
            scores, rows = scores[may].astype(np.int64), self._order[start + may]
            for i, (floor, ceiling, k) in enumerate(windows):
                fits = np.flatnonzero((scores >= least[i]) & (scores <= ceiling) & (keys[rows] != own))
                if len(fits) > k:
                    # Ties with the k-th score stay, ids decide among them.
                    cut = np.partition(scores[fits], len(fits) - k)[len(fits) - k]
                    fits = fits[scores[fits] >= cut]
                best = sorted(found[i] + [(-int(scores[j]), int(self.ids[rows[j]]), int(rows[j])) for j in fits])[:k]
                found[i] = best
                if len(best) == k:
                    least[i] = max(floor, -best[-1][0])
        return found


#: A block's rows (kind 0) come before the anchors (kind 1) that ask it.
_ASKED = "block long, kind int, key long, id long, label int, vec array<long>, windows array<array<long>>"
_ANSWER = "key long, window int, score long, id long, found_key long"
_ANSWER_ARROW = pa.schema([("key", pa.int64()), ("window", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("found_key", pa.int64())])


def _answer(dim: int, top: float, same: bool):
    """Reads blocks one after another; of each the rows first, then the anchors that ask."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, tree, keys = None, [], None, None
        for batch in batches:
            blocks, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "kind"))
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(blocks)]):
                part = batch.slice(low, high - low)
                if blocks[low] != block:
                    block, parts, tree = blocks[low], [], None
                if kinds[low] == 0:
                    parts.append(part)
                    continue
                if not parts:
                    continue
                if tree is None:
                    whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                    rows = vectors(whole.column("vec"), dim)
                    ids, labels, keys = (whole.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "key"))
                    tree = CoverTree(ids, labels, rows, top)
                queries = vectors(part.column("vec"), dim)
                norms = _norm(queries)
                scored = queries.astype(tree.scored.dtype)
                asked, labels_asked = part.column("key").to_pylist(), part.column("label").to_pylist()
                windows = part.column("windows").to_pylist()
                out: list[list] = [[], [], [], [], []]
                for at in range(0, len(queries), 256):
                    dots = (scored[at : at + 256] @ tree._centre_rows.T).astype(np.float64)
                    for j in range(len(dots)):
                        i = at + j
                        for w, best in enumerate(
                            tree.search(scored[i], asked[i], labels_asked[i], same, windows[i], keys, dots[j], norms[i])
                        ):
                            for score, id_, row in best:
                                for column, value in zip(out, (asked[i], w, -score, id_, int(keys[row]))):
                                    column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _ANSWER_ARROW.types)], schema=_ANSWER_ARROW)

    return answer


@dataclass
class Index:
    """Rows in blocks, and the little that says where an anchor has to ask."""

    rows: DataFrame  # key, id, label, vec, cell, block; stored
    dim: int
    top: float
    centres: np.ndarray
    radii: np.ndarray
    splits: list[int]  # blocks of each cell
    chunks: int

    def first_block(self) -> list[int]:
        return [0, *np.cumsum(self.splits).tolist()]


def build_index(rows: DataFrame, chunks: int) -> Index:
    """``rows (key, id, label, vec)``, stored, with their cells and blocks."""
    norm2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, dim, top = rows.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.max(norm2)).first()
    dim, top = dim or 0, math.sqrt(top or 0.0) * (1 + 1e-12)
    # A bounded sample only chooses the centres; every row is indexed.
    sample = rows.orderBy(F.xxhash64("key", F.lit("centres")), "key").limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
    points = _on_sphere(vectors(sample, dim), top)
    wanted = min(CENTRES, math.ceil(count / BLOCK))
    centres = points[_farthest_first(points, wanted)[0]] if len(points) else points

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, far = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for at in range(0, len(batch), 1024):
                x = _on_sphere(vectors(batch.column("vec").slice(at, 1024), dim), top)
                # The nearest centre on a sphere has the largest product.
                own = cells[at : at + 1024] = (x @ centres.T).argmax(1)
                far[at : at + 1024] = np.sqrt(((x - centres[own]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(far)], [*batch.schema.names, "cell", "away"])

    placed = materialize(rows.mapInArrow(place, "key long, id long, label int, vec array<long>, cell long, away double"), "cells")
    cells = {r["cell"]: (r["away"], r["n"]) for r in placed.groupBy("cell").agg(F.max("away").alias("away"), F.count("*").alias("n")).collect()}
    radii = np.array([cells.get(i, (0.0, 0))[0] for i in range(len(centres))]) * (1 + 1e-9)
    splits = [math.ceil(cells.get(i, (0.0, 0))[1] / BLOCK) for i in range(len(centres))]
    return Index(placed, dim, top, centres, radii, splits, chunks)


def _ask(index: Index, home: bool, other: bool):
    """Anchors to the blocks of their own cell, of the others, or of both, where a wanted score may be."""
    first, splits, chunks = index.first_block(), index.splits, index.chunks
    dim, top, centres, radii = index.dim, index.top, index.centres, index.radii

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries = vectors(batch.column("vec"), dim)
            norms = _norm(queries)
            dots = queries.astype(np.float64) @ centres[:, :-1].T
            low, high = score_bounds(dots, norms[:, None], top, radii)
            taken, blocks = [], []
            for i, (key, cell, windows) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "cell", "windows")))):
                may = np.zeros(len(splits), bool)
                for least, most, _ in windows:
                    may |= (high[i] >= least) & (low[i] <= most) & (least <= most)
                own = may[cell]
                may[cell] = own and home
                for c in np.flatnonzero(may) if other else [cell] * bool(may[cell]):
                    for b in range(first[c], first[c] + splits[c]):
                        taken.append(i)
                        blocks.append(b * chunks + key % chunks)
            # Few at a time: an anchor may go to many blocks.
            for at in range(0, len(taken), 4096):
                part = batch.take(pa.array(taken[at : at + 4096], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks[at : at + 4096], pa.int64()), *(part.column(c) for c in ("key", "id", "label", "vec", "windows"))],
                    ["block", "key", "id", "label", "vec", "windows"],
                )

    return ask


def _search(index: Index, anchors: DataFrame, same: bool, wanted: int) -> DataFrame:
    """The ``wanted`` best of each window of ``anchors (key, id, label, vec, cell, windows)``, with their ``place``; stored."""
    first = F.array(*[F.lit(b) for b in index.first_block()])
    splits = F.array(*[F.lit(max(1, s)) for s in index.splits])
    block = F.get(first, F.col("cell")) + F.pmod(F.xxhash64("key"), F.get(splits, F.col("cell")))
    rows = index.rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(index.chunks - 1))).alias("chunk"), block.alias("b"), "key", "id", "label", "vec"
    ).select(
        (F.col("b") * index.chunks + F.col("chunk")).cast("bigint").alias("block"), F.lit(0).alias("kind"), "key", "id", "label", "vec",
        F.lit(None).cast("array<array<long>>").alias("windows"),
    )

    def asked(frame: DataFrame, home: bool, other: bool) -> DataFrame:
        sent = frame.mapInArrow(
            _ask(index, home, other), "block long, key long, id long, label int, vec array<long>, windows array<array<long>>"
        ).select("block", F.lit(1).alias("kind"), "key", "id", "label", "vec", "windows")
        # Blocks nobody asks are not sent.
        needed = rows.join(sent.select("block").distinct(), "block", "left_semi").select(sent.columns)
        # A task for each block, however few bytes it has: the work is in the search.
        tasks = min(MOST_TASKS, max(1, sum(index.splits) * index.chunks))
        together = needed.unionByName(sent).repartition(tasks, "block").sortWithinPartitions("block", "kind", "key")
        return together.mapInArrow(_answer(index.dim, index.top, same), _ANSWER)

    def best(found: DataFrame) -> DataFrame:
        # A block answers with the best few of a window, and Spark keeps the best few of each task.
        place = Window.partitionBy("key", "window").orderBy(F.desc("score"), "id", "found_key")
        return found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= wanted)

    near = materialize(best(asked(anchors, True, False)), "near")
    # What is wanted of the other cells: at least as good as the last one found at home.
    last = near.where(F.col("place") == wanted).groupBy(F.col("key").alias("k"))
    had = last.agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("had"))
    narrower = F.transform(
        "windows", lambda w, i: F.array(F.greatest(w[0], F.try_element_at("had", i)), w[1], w[2])
    )
    narrowed = anchors.join(had, F.col("key") == F.col("k"), "left").select("key", "id", "label", "vec", "cell", narrower.alias("windows"))
    far = asked(narrowed, False, True)
    return materialize(best(near.drop("place").unionByName(far)), "found")


def _whole(hundredths: Column) -> Column:
    """Hundredths rounded down, in integers."""
    return F.call_function("div", hundredths - F.pmod(hundredths, F.lit(100)), F.lit(100))


def hard_negatives(
    table: DataFrame,
    anchor: Column,
    id_col: str = "id",
    label_col: str = "label",
    vector_col: str = "vector",
    positives: int = 5,
    negatives: int = 5,
    window: tuple[int, int] = (80, 100),
    scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` says, in terms of the id, which rows are anchors; ``window`` is the least and the
    highest negative score in hundredths of the positive's; a component ``x`` counts as ``floor(scale * x)``.
    """
    vec = F.col(vector_col)
    cut = F.transform(vec, lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * scale))))
    whole = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    clean = table.where(F.col(label_col).isNotNull() & vec.isNotNull() & whole).select(
        F.col(id_col).cast("bigint").alias("own"), F.col(label_col).cast("int").alias("label"), cut.alias("vec"),
        F.coalesce(anchor, F.lit(False)).alias("asks"),
    ).distinct()
    # Keys are given once and stored, so they stay what they are.
    rows = materialize(
        clean.select(F.monotonically_increasing_id().alias("key"), F.coalesce("own", F.lit(NO_ID)).alias("id"), "label", "vec", "asks"), "vectors"
    )
    chunks = max(1, math.ceil(rows.where("asks").count() / CHUNK))
    index = build_index(rows.select("key", "id", "label", "vec"), chunks)
    asking = rows.where("asks").select(F.col("key").alias("k"))
    anchors = materialize(index.rows.join(asking, F.col("key") == F.col("k"), "left_semi").drop("block", "away"), "anchors")
    lowest, highest = -(2**62), 2**62
    everything = F.array(F.array(F.lit(lowest), F.lit(highest), F.lit(positives).cast("bigint")))
    good = _search(index, anchors.withColumn("windows", everything), True, positives)
    # Whole scores from window[0] * positive / 100 up to window[1] * positive / 100.
    ranges = F.transform(
        F.sort_array(F.collect_list(F.struct("place", "score", "id"))),
        lambda p: F.struct(
            p["id"].alias("id"), p["score"].alias("score"),
            F.array(-_whole(-window[0] * p["score"]), _whole(window[1] * p["score"]), F.lit(negatives).cast("bigint")).alias("range"),
        ),
    )
    by_anchor = materialize(good.groupBy(F.col("key").alias("k")).agg(ranges.alias("pairs")), "positives")
    asked = anchors.join(by_anchor, F.col("key") == F.col("k")).withColumn("windows", F.transform("pairs", lambda p: p["range"]))
    bad = _search(index, asked.drop("k", "pairs"), False, negatives)
    pairs = asked.select(F.col("key").alias("k"), F.col("id").alias("a"), F.posexplode("pairs").alias("w", "pair"))

    def plain(c: Column) -> Column:
        return F.when(c != NO_ID, c)

    return bad.join(pairs, (F.col("key") == F.col("k")) & (F.col("window") == F.col("w"))).select(
        plain(F.col("a")).alias("anchor_id"), plain(F.col("pair")["id"]).alias("positive_id"), F.col("place").alias("rank"),
        plain(F.col("id")).alias("negative_id"), F.col("pair")["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )
