"""Near-duplicate classes by MinHash, with sequential Bayesian verification of candidates.

1. Every text becomes its set of distinct word shingles, a signature of ``rows * bands``
   minima, and a 128-bit hash of the set.  Equal sets are one node from here on, so exact
   copies never meet as pairs.
2. Nodes that share a band meet in a bucket.  Each is paired with the bucket's least node
   only, so a bucket of n nodes gives n - 1 candidates.
3. Candidates compare their signatures batch by batch.  After m equal minima of n the
   posterior of the similarity (flat prior) is Beta(m + 1, n - m + 1); a pair is given up
   as soon as its chance of reaching the threshold falls under ``miss``.
4. Survivors are decided exactly on the full shingle sets of the whole texts.
5. A node that failed with a bucket's least node may still be linked with others that met
   there.  It is compared with the whole class of that node and with the others that
   failed there, block against block of about ``BLOCK`` nodes, by steps 3 and 4 within the
   task.  Only a link that joins two classes not yet joined by that pair of blocks becomes
   a row, so buckets are exhausted without emitting pairs and no class is missed.
6. Links are joined to classes; the least ``doc_id`` names a class and stays.

With similarity s two nodes share no band with chance (1 - s^rows)^bands: 7e-7 at 0.85 for
24 bands of 5, 8e-7 at 0.80 for 27 bands of 4.

Defined cases: a null or wordless text has an empty set, is linked with nothing and stays;
fewer words than a shingle needs: the whole sequence is the one shingle; rows with equal
ids are kept or not together; a row without an id is kept only where no row of its class has
one.  ``drop_near_duplicates`` leaves a single row of each class, and of repeats (equal id and
text) without words one row too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.components import components
from tidemark.llm.frames import ID, ROW, materialize, plain_id, rows_of

BATCH = 20
MISS = 1e-6
# Nodes, and characters, that one block of a class holds on average at most.
BLOCK, BLOCK_CHARS = 256, 4_000_000


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and rows: rows so that a band holds for about 4 in 10 pairs at the threshold."""
    s = percent / 100
    rows = max(1, round(math.log(0.43) / math.log(s))) if s < 1 else 10
    return math.ceil(math.log(1e-6) / math.log(1 - s**rows)) if s < 1 else 1, rows


def least_matches(hashes: int, percent: int, miss: float, batch: int = BATCH) -> list[tuple[int, int]]:
    """After ``n`` compared minima, the least number of equal ones that keeps a pair alive.

    The upper tail of Beta(m + 1, n - m + 1) at t is the chance that n + 1 trials with
    chance t succeed at most m times.
    """
    t, bounds = percent / 100, []
    for n in [*range(batch, hashes, batch), hashes]:
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        bounds.append((n, m))
    return bounds


def shingle_sets(part: words.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct ``k``-word shingle hashes of each text, end to end, and their bounds."""
    grams = part.grams(k)
    low, high = part.gram_ranges(k)
    sets = []
    for d, n in enumerate(part.counts):
        if n >= k:
            sets.append(np.unique(grams[low[d] : high[d]]))
        elif n:
            sets.append(part.sequences(part.first[d : d + 1], part.first[d + 1 : d + 2]))
        else:
            sets.append(np.empty(0, np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    return np.concatenate(sets), bounds


def _factors(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = words.mix(np.arange(1, 2 * hashes + 1, dtype=np.uint64)).astype(np.uint32)
    return seeds[:hashes] | np.uint32(1), seeds[hashes:]


def _sketch(k: int, hashes: int):
    factor, shift = _factors(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, id_ = (np.asarray(batch.column(c)) for c in (ROW, ID))
            for part in words.cut(batch.column("_text"), words.LOWER):
                values, bounds = shingle_sets(part, k)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                minima = np.zeros((len(part), hashes), np.uint16)
                if len(full):
                    short = values.astype(np.uint32)
                    for i in range(hashes):
                        # The low half of a minimum tells minima apart as well as the whole.
                        minima[full, i] = np.minimum.reduceat(short * factor[i] + shift[i], bounds[full]).astype(np.uint16)
                whole = [xxhash.xxh3_128_intdigest(values[a:b]) for a, b in zip(bounds, bounds[1:])]
                keys = np.array([(x >> 64, x & (1 << 64) - 1) for x in whole], np.uint64).reshape(-1, 2)
                at = slice(part.row, part.row + len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row[at]),
                        pa.array(id_[at]),
                        pa.array(sizes.astype(np.int64)),
                        words.signed(keys[:, 0]),
                        words.signed(keys[:, 1]),
                        pa.array([m.tobytes() for m in minima], pa.binary()),
                    ],
                    [ROW, ID, "n_shingles", "node", "check", "signature"],
                )

    return run


def _matrix(column: pa.Array, hashes: int) -> np.ndarray:
    flat = column.cast(pa.binary(2 * hashes))
    data = np.frombuffer(flat.buffers()[1], np.uint16)
    return data[flat.offset * hashes : (flat.offset + len(flat)) * hashes].reshape(-1, hashes)


def _still_likely(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of ``a`` and ``b`` survive all batches of their signatures."""
    alive, equal, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in bounds:
        equal = equal + (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        stay = equal >= least
        alive, equal, done = alive[stay], equal[stay], n
    return alive


def _prune(bounds: list[tuple[int, int]], hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(c), hashes) for c in ("signature_a", "signature_b"))
            yield batch.select(["a", "b"]).take(pa.array(_still_likely(a, b, bounds)))

    return run


def _linked(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sorted sets ``others`` share ``percent`` of the union with the sorted set ``own``."""
    sizes = np.array([len(o) for o in others])
    values = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, values), len(own) - 1)
    both = np.add.reduceat((own[at] == values).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= percent * (len(own) + sizes - both)


def _blocks(bounds: list[tuple[int, int]], hashes: int, k: int, percent: int):
    """Links between two blocks of one class; of links that join the same labels the first one."""

    def side(lists: pa.ListArray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        a, b = lists.offsets[r].as_py(), lists.offsets[r + 1].as_py()
        part = lists.values.slice(a, b - a)
        node, label = (np.asarray(part.field(f)) for f in ("node", "label"))
        return node, label, _matrix(part.field("signature"), hashes), part.field("text")

    def sets_of(texts: pa.Array, wanted: np.ndarray) -> dict[int, np.ndarray]:
        found = {}
        for part in words.cut(texts.take(pa.array(wanted)), words.LOWER):
            values, ends = shingle_sets(part, k)
            for d in range(len(part)):
                found[int(wanted[part.row + d])] = values[ends[d] : ends[d + 1]]
        return found

    def links(asked, others) -> Iterator[tuple[int, int]]:
        node_a, label_a, sig_a, text_a = asked
        node_b, label_b, sig_b, text_b = others
        likely = {}
        for i in range(len(node_a)):
            other = np.flatnonzero(label_b != label_a[i])
            near = other[_still_likely(np.broadcast_to(sig_a[i], (len(other), hashes)), sig_b[other], bounds)]
            if len(near):
                likely[i] = near
        if not likely:
            return
        sets_a = sets_of(text_a, np.array(list(likely)))
        sets_b = sets_of(text_b, np.unique(np.concatenate(list(likely.values()))))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for i, near in likely.items():
            near = [j for j in near.tolist() if root(int(label_b[j])) != root(int(label_a[i]))]
            if not near:
                continue
            for j, right in zip(near, _linked(sets_a[i], [sets_b[j] for j in near], percent)):
                one, two = root(int(label_a[i])), root(int(label_b[j]))
                if right and one != two:
                    parent[one] = two
                    yield int(node_a[i]), int(node_b[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                link
                for r in range(len(batch))
                for link in links(side(batch.column("asked"), r), side(batch.column("others"), r))
            ]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _exact(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[int, np.ndarray] = {}
            for side in "ab":
                nodes = np.asarray(batch.column(side))
                fresh, at = np.unique(nodes, return_index=True)
                wanted = np.array([n not in sets for n in fresh.tolist()], bool)
                fresh, at = fresh[wanted], at[wanted]
                for part in words.cut(batch.column(f"text_{side}").take(pa.array(at)), words.LOWER):
                    values, bounds = shingle_sets(part, k)
                    for d in range(len(part)):
                        sets[int(fresh[part.row + d])] = values[bounds[d] : bounds[d + 1]]
            linked = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                linked.append(100 * both >= percent * (len(sets[a]) + len(sets[b]) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    miss: float = MISS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``_row, _id, n_shingles, component_id, kept``, a row for each row of ``docs``.

    Two texts are linked when their shingle sets share at least ``percent`` of their union.
    Stores sketches, candidates and the texts of candidates in the shared folder.
    """
    return _classed(docs, shingle, percent, miss, id_col, text_col).drop("label")


def _apart(nodes: DataFrame) -> DataFrame:
    """Sets are known by both halves of their hash; a ``node`` that two sets share is renamed by both.

    The first half stays as ``half``.  Of 10^10 sets a handful share a half; that a new name is
    taken as well has a chance of 10^-8.
    """
    shared = materialize(nodes.groupBy("node").agg(F.count("*").alias("_sets")).where("_sets > 1"), "shared-halves")
    name = F.when(F.col("_sets").isNull(), F.col("node")).otherwise(F.xxhash64("node", "check"))
    return nodes.join(shared, "node", "left").withColumns({"half": F.col("node"), "node": name}).drop("_sets")


def _classed(docs: DataFrame, shingle: int, percent: int, miss: float, id_col: str, text_col: str) -> DataFrame:
    """``near_duplicates`` with the ``label`` of each row's class, null without words."""
    bands, rows_each = bands_for(percent)
    hashes = bands * rows_each
    bounds = least_matches(hashes, percent, miss)
    rows = rows_of(docs, id_col=id_col, text_col=text_col)
    sets = materialize(
        rows.mapInArrow(
            _sketch(shingle, hashes),
            f"{ROW} long, {ID} long, n_shingles long, node long, check long, signature binary",
        ),
        "sets",
    )
    filled = sets.where("n_shingles > 0")
    nodes = _apart(
        materialize(
            filled.groupBy("node", "check").agg(
                F.min(plain_id()).alias("least_id"),
                F.min_by("signature", ROW).alias("signature"),
                F.min(F.struct(ROW, ID)).alias("at"),
            ),
            "nodes",
        )
    )
    signatures = nodes.select("node", "signature")

    size = 2 * rows_each
    buckets = F.explode(
        F.array(*[F.xxhash64(F.lit(i), F.substring("signature", 1 + i * size, size)) for i in range(bands)])
    )
    banded = nodes.select("node", buckets.alias("bucket"))
    met = banded.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last")
    pairs = materialize(
        banded.join(met.drop("last"), "bucket").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(),
        "candidates",
    )
    involved = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")
    where = nodes.join(involved, "node").select("node", "at.*")
    # Equal sets may have different texts; any one of them has the set.
    named_texts = rows.select(ROW, ID, "_text").join(where, [ROW, ID]).select("node", "_text")
    texts = materialize(named_texts.dropDuplicates(["node"]), "texts")

    def with_both(found: DataFrame, of: DataFrame, column: str, name: str) -> DataFrame:
        for side in "ba":
            found = found.join(of.select(F.col("node").alias(side), F.col(column).alias(f"{name}_{side}")), side)
        return found.select("a", "b", f"{name}_a", f"{name}_b")

    def decided(likely: DataFrame) -> DataFrame:
        return with_both(likely, texts, "_text", "text").mapInArrow(_exact(shingle, percent), "a long, b long")

    likely = with_both(pairs, signatures, "signature", "signature").mapInArrow(_prune(bounds, hashes), "a long, b long")
    links = materialize(decided(likely), "links")
    labels = components(links)

    labelled = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "signature")
    hub_label = labels.select(F.col("node").alias("a"), F.col("label").alias("class"))
    failed = (
        pairs.join(links, ["a", "b"], "left_anti")
        .join(hub_label, "a", "left")
        .select(F.col("b").alias("node"), F.coalesce("class", "a").alias("class"))
        .distinct()
    )
    asked = materialize(failed.join(labelled, "node").where("class <> label"), "failed")
    classes = asked.groupBy("class").agg(F.count("*").alias("n_asked"))
    members = labelled.join(classes.select(F.col("class").alias("label")), "label").withColumn("class", F.col("label"))
    others = members.select(asked.columns).union(asked)

    def blocks(frame: DataFrame, name: str) -> DataFrame:
        frame = frame.join(texts, "node")
        room = F.greatest(F.lit(1.0 / BLOCK), F.length("_text") / F.lit(float(BLOCK_CHARS)))
        sizes = materialize(frame.groupBy("class").agg(F.ceil(F.sum(room)).alias("n")), "class-sizes")
        block = F.pmod(F.xxhash64("node"), F.col("n")).alias("block")
        entry = F.struct("node", "label", "signature", F.col("_text").alias("text"))
        listed = frame.join(sizes, "class").groupBy("class", block).agg(F.collect_list(entry).alias(name))
        # Stored, so that the join below can split a class with many blocks.
        return materialize(listed.drop("block"), name)

    compared = blocks(asked, "asked").join(blocks(others, "others"), "class").select("asked", "others")
    late_links = materialize(compared.mapInArrow(_blocks(bounds, hashes, shingle, percent), "a long, b long"), "late-links")
    if not late_links.isEmpty():
        labels = components(links.union(late_links))

    named = nodes.join(labels, "node", "left").select("half", "check", F.coalesce("label", "node").alias("label"), "least_id")
    named = materialize(named, "classes")
    class_id = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_node = named.join(class_id, "label").select(F.col("half").alias("node"), "check", "label", "component_id")
    return (
        sets.drop("signature")
        .join(of_node, ["node", "check"], "left")
        .select(
            ROW,
            ID,
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("label")).alias("label"),
            F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(plain_id()).alias("component_id"),
        )
        .withColumn("kept", plain_id().eqNullSafe(F.col("component_id")))
    )


def drop_near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    miss: float = MISS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row of ``docs`` for each class, with all its columns: the least id, then the least ``_row``.

    Of rows with equal id and text any one stays, also of those without words.
    """
    found = _classed(docs, shingle, percent, miss, id_col, text_col)
    # Classes and their rows, without those that another row of the class stands for.
    found = materialize(
        found.where("kept").groupBy(ROW, ID, "label").agg(F.count("*").alias("n")), "kept"
    )
    least = found.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(ID, ROW, "n")).alias("one"))
    stay = least.select("one.*").union(found.where("label IS NULL").select(ID, ROW, "n"))
    stay = materialize(stay, "stay")
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = rows_of(docs, *named, id_col=id_col, text_col=text_col).drop("_text")
    single = rows.join(stay.where("n = 1"), [ROW, ID], "left_semi")
    repeated = rows.join(stay.where("n > 1"), [ROW, ID], "left_semi").dropDuplicates([ROW, ID])
    return single.union(repeated).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
