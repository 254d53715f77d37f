"""Benchmark decontamination: passages that are nearly a benchmark item, wherever they stand.

Texts and items become lower-case words of letters and digits, then 5-word shingles, each
weighing as many bytes as its words have.  Over every text, windows as long as an item are
laid at every word.  A window without any shingle of the benchmark has similarity 0, so
only the windows around shared shingles, as long as the items that have them, get a
SimHash of 256 bits.

Multi-index search: the items' SimHashes are cut into 32 blocks of 8 bits and each block
value is filed with its 8 neighbours at one flipped bit.  Fingerprints that differ in at
most ``RADIUS`` = 63 bits differ in at most one bit of some block, so every item within the
radius is found.  Angles add the squares of votes, the similarity adds weights; so a shingle
votes with the root of its weight, and long words count alike in both.  Similarity 0.8 is
then a cosine of 2 x 0.8 / 1.8 at least: at most 39 bits are expected to differ, with a
deviation of 5.7, and the radius is more than four deviations away.

That holds while no shingle stands twice.  A window or an item that repeats one is compared
by the inverted lists instead: with every item that shares a shingle, unless the weight that
can be shared is too small for the threshold.  Candidates of both kinds are verified with
the exact weighted similarity: the sum of the lesser weights over the sum of the greater
ones, repeated shingles counted.

The benchmark is broadcast in blocks of at most ``block_words`` words; more blocks mean
more passes over the texts, one after the other, never a part left out.  Texts are not shuffled.

An item under five words is one shingle of its own length: it matches where its words stand
consecutively, with similarity 1.

Windows are made and searched region by region, equal windows of neighbouring regions once, so
memory does not grow with the text and a text that repeats itself costs little.

Defined cases: null and wordless texts match nothing; in a text shorter than the item the whole
text is the window; ties between windows go to the first; a repeated row of ``docs`` gives
its matches again, a repeated row of the benchmark does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.frames import ID, ROW, materialize, plain_id, rows_of

SHINGLE, PERCENT = 5, 80
LANES = 4
BLOCKS, RADIUS = 8 * LANES, 2 * 8 * LANES - 1
BLOCK_WORDS = 2_000_000
_SEEN_BITS = 20


def _weights(part: words.Words, k: int) -> np.ndarray:
    length = np.concatenate([[0], np.cumsum(part.ends - part.starts)])
    return (length[k:] - length[:-k]).astype(np.int64) if len(length) > k else np.empty(0, np.int64)


def _votes(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row per shingle: the root of its weight, negative where its bit is not set.

    In whole numbers, so that sums and ties do not depend on where a range starts.
    """
    weights = np.rint(64 * np.sqrt(weights)).astype(np.int64)
    lanes = [words.mix(shingles + np.uint64(i * 0x632BE59BD9B4E019 % (1 << 64))) for i in range(1, LANES + 1)]
    bits = np.unpackbits(np.stack(lanes, axis=1).view(np.uint8), axis=1)
    return np.where(bits, weights[:, None], -weights[:, None])


def _prints(votes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHashes of shingle ranges, as rows of bytes."""
    sums = np.zeros((len(votes) + 1, votes.shape[1]), np.int64)
    np.cumsum(votes, axis=0, out=sums[1:])
    return np.packbits(sums[ends] > sums[starts], axis=1)


def _similarity(a: dict[int, tuple[int, int]], b: dict[int, tuple[int, int]]) -> float:
    """Both map a shingle to its count and weight."""
    shared = sum(min(n, b[s][0]) * w for s, (n, w) in a.items() if s in b)
    total = sum(n * w for n, w in a.values()) + sum(n * w for n, w in b.values()) - shared
    return shared / total if total else 0.0


def _counted(shingles: np.ndarray, weights: np.ndarray) -> dict[int, tuple[int, int]]:
    values, at, counts = np.unique(shingles, return_index=True, return_counts=True)
    return dict(zip(values.tolist(), zip(counts.tolist(), weights[at].tolist())))


@dataclass
class Items:
    """One block of the benchmark, made ready for the search."""

    ids: list
    counted: list[dict[int, tuple[int, int]]]
    sizes: np.ndarray
    prints: np.ndarray
    shingles: np.ndarray
    holders: np.ndarray
    filed: list[list[np.ndarray]]
    seen: np.ndarray
    weights: np.ndarray
    repeats: np.ndarray
    # By number of words: hashes of the items that are shorter than a shingle, in order, and their places in ``ids``.
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple], k: int) -> Items:
        ids, counted, sizes, prints, shingles, few = [], [], [], [], [], []
        for part in words.cut(pa.array([t for _, t in rows], pa.string()), words.LOWER_ALNUM):
            grams, weights = part.grams(k), _weights(part, k)
            for d, (low, high) in enumerate(zip(*part.gram_ranges(k))):
                if high > low:
                    own, w = grams[low:high], weights[low:high]
                    ids.append(rows[part.row + d][0])
                    counted.append(_counted(own, w))
                    sizes.append(high - low)
                    prints.append(_prints(_votes(own, w), np.array([0]), np.array([high - low]))[0])
                    shingles.append(np.unique(own))
                elif part.counts[d]:
                    first, last = part.first[d : d + 2]
                    few.append((int(last - first), part.sequences(np.array([first]), np.array([last]))[0], rows[part.row + d][0]))
        n = len(ids)
        few.sort(key=lambda x: x[:2])
        short = {
            size: (np.array([h for s, h, _ in few if s == size], np.uint64), n + np.array([i for i, x in enumerate(few) if x[0] == size]))
            for size in {x[0] for x in few}
        }
        ids += [i for _, _, i in few]
        prints = np.array(prints, np.uint8).reshape(n, BLOCKS)
        filed = []
        for block in range(BLOCKS):
            near = [[] for _ in range(256)]
            for item, value in enumerate(prints[:, block].tolist()):
                for neighbour in [value, *(value ^ (1 << bit) for bit in range(8))]:
                    near[neighbour].append(item)
            filed.append([np.array(x, np.int64) for x in near])
        every = np.concatenate([np.empty(0, np.uint64), *shingles])
        holder = np.repeat(np.arange(n), np.array([len(s) for s in shingles], np.int64))
        order = np.argsort(every, kind="stable")
        seen = np.zeros(1 << _SEEN_BITS, bool)
        seen[(every & np.uint64((1 << _SEEN_BITS) - 1)).astype(np.int64)] = True
        total = np.array([sum(c * w for c, w in own.values()) for own in counted], np.int64)
        repeats = np.array([any(c > 1 for c, _ in own.values()) for own in counted], bool)
        return cls(ids, counted, np.array(sizes, np.int64), prints, every[order], holder[order], filed, seen, total, repeats, short)

    def within_radius(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) pairs at most ``RADIUS`` bits apart."""
        window, item = [], []
        for w, values in enumerate(prints.tolist()):
            near = np.unique(np.concatenate([self.filed[b][v] for b, v in enumerate(values)]))
            apart = np.bitwise_count(self.prints[near] ^ prints[w]).sum(axis=1)
            near = near[apart <= RADIUS]
            window.append(np.full(len(near), w))
            item.append(near)
        return np.concatenate(window), np.concatenate(item)

    def sharing(
        self, grams: np.ndarray, weights: np.ndarray, hits: np.ndarray, start: np.ndarray, end: np.ndarray, percent: int
    ) -> Iterator[tuple[int, int]]:
        """(window, item) where either repeats a shingle and the weight that may be shared reaches ``percent``."""
        # The first repetition of a shingle that stands at or after a place.
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        again = np.full(len(grams) + 1, len(grams))
        again[order[:-1][same]] = order[1:][same]
        repeated = np.minimum.accumulate(again[::-1])[::-1][start] < end
        low = np.searchsorted(self.shingles, grams[hits], "left")
        n = np.searchsorted(self.shingles, grams[hits], "right") - low
        place = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        holders, at = self.holders[place], np.repeat(hits, n)
        if not repeated.any():
            wanted = self.repeats[holders]
            holders, at = holders[wanted], at[wanted]
        order = np.argsort(holders, kind="stable")
        holders, at = holders[order], at[order]
        total = np.concatenate([[0], np.cumsum(weights)])
        firsts = np.flatnonzero(np.diff(holders, prepend=-1))
        for i, own in zip(holders[firsts].tolist(), np.split(at, firsts[1:])):
            fits = np.flatnonzero(repeated | self.repeats[i])
            s, e = start[fits], end[fits]
            sums = np.concatenate([[0], np.cumsum(weights[own])])
            shared = np.minimum(sums[np.searchsorted(own, e)] - sums[np.searchsorted(own, s)], self.weights[i])
            both = total[e] - total[s] + self.weights[i]
            yield from ((x, i) for x in fits[100 * shared >= percent * (both - shared)].tolist())

    def windows(self, n: int, grams: np.ndarray, hits: np.ndarray, span: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts and ends, in shingles, of the item-sized windows around shared shingles, by region of ``span`` starts.

        ``grams`` are the shingles at ``hits``, of ``n`` in the text.
        """
        low = np.searchsorted(self.shingles, grams, "left")
        count = np.searchsorted(self.shingles, grams, "right") - low
        runs = []
        for size in np.unique(self.sizes).tolist():
            # How many holders of each shingle have this size.
            of_size = np.concatenate([[0], np.cumsum(self.sizes[self.holders] == size)])
            own = hits[of_size[low + count] > of_size[low]]
            if len(own):
                last = np.maximum(0, np.minimum(own, n - size))
                first = np.minimum(np.maximum(0, own - size + 1), last)
                # Ranges of starts that touch are one.
                fresh = np.concatenate([[True], first[1:] > np.maximum.accumulate(last)[:-1] + 1])
                at = np.flatnonzero(fresh)
                runs.append((size, first[at], np.maximum.reduceat(last, at)))
        regions = np.unique(np.concatenate([np.concatenate([f // span, e // span, _between(f // span, e // span)]) for _, f, e in runs]))
        for region in regions.tolist():
            starts, ends = [], []
            for size, first, last in runs:
                a, b = np.searchsorted(last, region * span), np.searchsorted(first, (region + 1) * span)
                for f, e in zip(first[a:b].tolist(), last[a:b].tolist()):
                    start = np.arange(max(f, region * span), min(e, region * span + span - 1) + 1)
                    starts.append(start)
                    ends.append(np.minimum(start + size, n))
            if starts:
                found = np.unique(np.stack([np.concatenate(starts), np.concatenate(ends)], axis=1), axis=0)
                yield found[:, 0], found[:, 1]


def _between(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whole numbers strictly between ``first`` and ``last``, for all pairs."""
    n = np.maximum(last - first - 1, 0)
    return np.repeat(first + 1 - np.cumsum(n) + n, n) + np.arange(n.sum())


def _found(batch: pa.RecordBatch, items: Items, k: int, percent: int) -> Iterator[tuple[int, int, float, int, int]]:
    """Row, item, similarity, first word and number of words of each match."""
    low_bits = np.uint64((1 << _SEEN_BITS) - 1)
    for part in words.cut(batch.column("_text"), words.LOWER_ALNUM):
        best: dict[int, dict[int, tuple]] = {}
        for size, (known, place) in items.short.items():
            grams, (low, high) = part.grams(size), part.gram_ranges(size)
            hits = np.flatnonzero(np.isin(grams, known))
            row = np.searchsorted(low, hits, "right") - 1
            for hit, d in zip(hits.tolist(), row.tolist()):
                if hit < high[d]:
                    a, b = np.searchsorted(known, grams[hit], "left"), np.searchsorted(known, grams[hit], "right")
                    for i in place[a:b].tolist():
                        best.setdefault(d, {}).setdefault(i, (1.0, hit - int(low[d]), size))
        grams = part.grams(k)
        maybe = np.flatnonzero(items.seen[(grams & low_bits).astype(np.int64)])
        hits = maybe[np.isin(grams[maybe], items.shingles)]
        low, high = part.gram_ranges(k)
        weights = _weights(part, k)
        of = np.searchsorted(hits, np.stack([low, high]))
        for d in np.flatnonzero(of[1] > of[0]).tolist():
            own = hits[of[0, d] : of[1, d]] - low[d]
            g, w = grams[low[d] : high[d]], weights[low[d] : high[d]]
            mine = best.setdefault(d, {})
            before = np.empty(0, np.uint64)
            for start, end in items.windows(len(g), g[own], own):
                # Equal windows say the same; the first one counts.
                said = part.sequences(start + part.first[d], end + part.first[d] + k - 1)
                said, first = np.unique(said, return_index=True)
                first.sort()
                first = first[~np.isin(part.sequences(start[first] + part.first[d], end[first] + part.first[d] + k - 1), before)]
                before = said
                start, end = start[first], end[first]
                if not len(start):
                    continue
                base, top = start.min(), end.max()
                near_g, near_w, start, end = g[base:top], w[base:top], start - base, end - base
                window, item = items.within_radius(_prints(_votes(near_g, near_w), start, end))
                near = own[np.searchsorted(own, base) : np.searchsorted(own, top)] - base
                pairs = {*zip(window.tolist(), item.tolist()), *items.sharing(near_g, near_w, near, start, end, percent)}
                counted: dict[int, dict] = {}
                for x, i in sorted(pairs):
                    s, e = int(start[x]), int(end[x])
                    if x not in counted:
                        counted[x] = _counted(near_g[s:e], near_w[s:e])
                    same = _similarity(counted[x], items.counted[i])
                    if same * 100 >= percent and (i not in mine or same > mine[i][0]):
                        mine[i] = (same, int(base) + s, e - s + k - 1)
        for d in sorted(best):
            for i in sorted(best[d]):
                yield part.row + d, i, *best[d][i]


def _search(shared, k: int, percent: int):
    names = [ROW, ID, "item_id", "similarity", "first_word", "n_words"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in batches:
            row, id_ = (np.asarray(batch.column(c)) for c in (ROW, ID))
            found = [(int(row[at]), int(id_[at]), items.ids[i], *rest) for at, i, *rest in _found(batch, items, k, percent)]
            columns = list(zip(*found)) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def _keep(shared, k: int, percent: int, names: list[str]):
    """The rows without a match; the text searched stands last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = np.ones(len(batch), bool)
            for at, *_ in _found(batch, shared.value, k, percent):
                stays[at] = False
            yield batch.select(names).filter(pa.array(stays))

    return run


def _blocks(benchmark: DataFrame, shingle: int, block_words: int) -> Iterator[tuple]:
    """Each block of the benchmark as a broadcast, and whether it is the only one."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    # A word has a letter and a separator at least.
    n_blocks = max(1, -(-total // (2 * block_words)))
    for block in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        yield benchmark.sparkSession.sparkContext.broadcast(Items.of([tuple(r) for r in part.collect()], shingle)), n_blocks == 1


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    percent: int = PERCENT,
    shingle: int = SHINGLE,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``_row, _id, item_id, similarity, first_word, n_words``: each item a text has, at its best place.

    One row per row of ``docs`` and item.
    """
    rows = rows_of(docs, id_col=id_col, text_col=text_col)
    made = f"{ROW} long, {ID} long, item_id long, similarity double, first_word long, n_words long"
    found = None
    for shared, alone in _blocks(benchmark, shingle, block_words):
        here = rows.mapInArrow(_search(shared, shingle, percent), made)
        if not alone:
            # Stored, so that one block at a time is held.
            here = materialize(here, "matches")
            shared.unpersist()
        found = here if found is None else found.union(here)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words``; options as for ``matches``."""
    found = matches(docs, benchmark, **options)
    return found.select(plain_id().alias("doc_id"), "item_id", "similarity", "first_word", "n_words")


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    percent: int = PERCENT,
    shingle: int = SHINGLE,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` without any item, with all their columns; nothing is shuffled or joined."""
    names = docs.columns
    for shared, alone in _blocks(benchmark, shingle, block_words):
        places = [f"c{i}" for i in range(len(names))]
        wide = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(names, places)])
        schema = wide.schema
        text = wide.select("*", F.coalesce(F.col(places[names.index(text_col)]), F.lit("")).alias("_text"))
        stay = text.mapInArrow(_keep(shared, shingle, percent, places), schema)
        if not alone:
            stay = materialize(stay, "without-leaks")
            shared.unpersist()
        docs = stay.toDF(*names)
    return docs
