"""Language-model scores: Brown classes by exchange, class transitions and word emissions.

``P(word | word before) = P(class | class before) * P(word | class)``.

1. Texts become *slices* of about ``SLICE`` bytes: the distinct words of a slice, and each
   text as numbers into that list.  One pass over the texts; later steps read the slices.
2. Words are counted over all training texts.  The ``HEADS`` most frequent ones drive the
   exchange: their bigrams, over all training texts, are a table.  A round counts, in
   Spark, the classes before and after every head; then heads move, one after the other,
   to the class that gives the bigrams of classes the highest likelihood.  What the
   driver holds is heads x classes, whatever the corpus.
3. Every other word, however rare, goes to the class under which all its occurrences are
   likeliest, given the classes before them.  No word is left out.
4. A slice asks for its distinct words: one row each, joined with the table of all words, so a
   word in a third of all texts is one row per slice.  The answers come back to the slice and
   give each text its transitions, emissions and counts.

Transitions are smoothed towards the frequency of the class; a context gives unknown words the
share that words seen once have after it.  Emissions are relative frequencies, unknown
words are one word; so the probabilities after each context add up to one.

Words are known by 64-bit hashes.  Defined cases: a null or empty text is only its end; the
context of the first word is an end; rows without an id train like any other if the given
condition is null; repeated rows get equal scores and count twice; with no training text all
words are unknown; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.frames import ID, ROW, materialize, rows_of

SLICE = 4 << 20
HEADS, CLASSES = 4096, 32
ROUNDS = 8
# Pseudo-occurrences of the class frequencies in each context.
PRIOR = 10.0
END = np.uint64(0x5DEECE66D1234567)
#: Classes: 0 is the end of a text, then the classes of words, then unknown words.
# Answers to a slice leave a task in parcels of at most so many.
PARCEL = 1 << 20


def _numbers(packed: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), kind)


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(numbers).tobytes(), 1)


def _packed_docs(docs: list[tuple[int, int, bool, int]], codes: np.ndarray) -> bytes:
    """Row, id, whether it trains and number of tokens of each text, and the codes of all."""
    heads = np.array([(r, i, 2 * n + t) for r, i, t, n in docs], np.int64)
    return zstandard.compress(np.int64(len(docs)).tobytes() + heads.tobytes() + codes.astype(np.int32).tobytes(), 1)


def _docs(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, ids, which train, where each text starts (and where the last one ends), and the codes."""
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    heads = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3)
    starts = np.concatenate([[0], np.cumsum(heads[:, 2] >> 1)])
    return heads[:, 0], heads[:, 1], heads[:, 2] % 2 == 1, starts, np.frombuffer(raw, np.int32, -1, 8 + 24 * n)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a task to slices, one row each."""
    task, count, size = 0, 0, 0
    tokens: list[np.ndarray] = []
    docs: list[tuple[int, int, bool, int]] = []

    def row() -> pa.RecordBatch:
        flat = np.concatenate(tokens)
        known, place, times = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # frequent words get small numbers, which pack well
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        codes = number[place.reshape(-1)]
        trains = np.repeat([d[2] for d in docs], [d[3] for d in docs])
        seen = np.bincount(codes[trains], minlength=len(known)).astype(np.int64)
        values = [task << 32 | count, _packed(known[order]), _packed(seen), _packed_docs(docs, codes)]
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["slice", "words", "seen", "docs"])

    for batch in batches:
        task = batch.column("part")[0].as_py() if len(batch) else task
        keys = [batch.column(c).to_pylist() for c in (ROW, ID, "trains")]
        for part in words.cut(batch.column("_text"), words.LOWER):
            tokens.append(np.insert(part.hashes, part.first[1:], END))
            docs += [(*(k[part.row + d] for k in keys), int(n) + 1) for d, n in enumerate(part.counts)]
            size += len(part.data) + len(part)
            if size >= SLICE:
                yield row()
                tokens, docs, size, count = [], [], 0, count + 1
    if docs:
        yield row()


def slices_of(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``slice, words, seen, docs``, stored; ``trains`` says which texts are learnt from, null counts as true."""
    named = rows_of(docs, F.coalesce(trains, F.lit(True)).alias("trains"), id_col=id_col, text_col=text_col)
    parts = named.select(F.spark_partition_id().cast("bigint").alias("part"), "*")
    return materialize(parts.mapInArrow(_slices, "slice long, words binary, seen binary, docs binary"), "slices")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for known, seen in zip(batch.column("words"), batch.column("seen")):
            known, seen = _numbers(known.as_py(), np.uint64), _numbers(seen.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([words.signed(known[seen > 0]), pa.array(seen[seen > 0])], ["word", "n"])


def word_counts(slices: DataFrame) -> DataFrame:
    """``word, n`` over all training texts, the end as a word; stored."""
    counts = slices.select("words", "seen").mapInArrow(_word_counts, "word long, n long")
    return materialize(counts.groupBy("word").agg(F.sum("n").alias("n")), "words")


class Heads:
    """The words that drive the exchange, the end first, and the class of each."""

    def __init__(self, hashes: np.ndarray, classes: np.ndarray):
        self.hashes, self.classes = hashes, classes
        self._order = np.argsort(hashes)

    def places(self, known: np.ndarray) -> np.ndarray:
        """Place of each word among the heads, -1 for others."""
        ordered = self.hashes[self._order]
        at = np.minimum(np.searchsorted(ordered, known), len(ordered) - 1)
        return np.where(ordered[at] == known, self._order[at], -1)


def _training_texts(batch: pa.RecordBatch, heads: Heads) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice: its words, their places among the heads, and pairs of numbers of neighbours in training texts."""
    for known, docs in zip(batch.column("words"), batch.column("docs")):
        known = _numbers(known.as_py(), np.uint64)
        _, _, trains, starts, codes = _docs(docs.as_py())
        if trains.any():
            # Every text ends with an end, so the word before a text's first one is an end too.
            flat = codes[np.repeat(trains, np.diff(starts))]
            place = heads.places(known)
            end = int(np.flatnonzero(place == 0)[0])
            yield known, place, np.concatenate([[end], flat[:-1]]), flat


def _head_bigrams(heads: Heads):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(heads.hashes)
        for batch in batches:
            for _, place, before, after in _training_texts(batch, heads):
                a, b = place[before], place[after]
                both = (a >= 0) & (b >= 0)
                pair, times = np.unique(a[both] * n + b[both], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(times, pa.int64())], ["pair", "n"])

    return count


def _class_contexts(classes: np.ndarray, n_classes: int):
    """Heads' neighbours by class, added up over a task: left, right, and the head after itself."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(classes)
        width = 2 * n_classes + 1
        total = np.zeros(n * width, np.int64)
        for batch in batches:
            pair, times = batch.column("pair").to_numpy(), batch.column("n").to_numpy()
            a, b = pair // n, pair % n
            np.add.at(total, b * width + classes[a], times)
            np.add.at(total, a * width + n_classes + classes[b], times)
            own = a == b
            np.add.at(total, a[own] * width + 2 * n_classes, times[own])
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    return count


def contexts(bigrams: DataFrame, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each head: how often each class stands before it, after it, and itself after itself."""
    cells = bigrams.mapInArrow(_class_contexts(classes, n_classes), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = cells.toArrow()
    total = np.zeros(len(classes) * (2 * n_classes + 1), np.int64)
    total[found["cell"].to_numpy()] = found["n"].to_numpy()
    total = total.reshape(len(classes), -1)
    return total[:, :n_classes], total[:, n_classes:-1], total[:, -1]


def _plogp(x):
    x = np.maximum(x, 0.0)
    return x * np.log(np.maximum(x, 1.0))


def class_bigrams(left: np.ndarray, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """How often class follows class."""
    found = np.zeros((n_classes, n_classes), np.int64)
    np.add.at(found.T, classes, left)
    return found


def likelihood(pairs: np.ndarray) -> float:
    """What of the log likelihood of the bigrams depends on the classes."""
    return float(_plogp(pairs.astype(float)).sum() - _plogp(pairs.sum(0).astype(float)).sum() - _plogp(pairs.sum(1).astype(float)).sum())


def exchange(left: np.ndarray, right: np.ndarray, own: np.ndarray, classes: np.ndarray, n_classes: int, movable: np.ndarray) -> np.ndarray:
    """One sweep: each movable head goes where the likelihood is highest, the least class on a tie."""
    classes = classes.copy()
    pairs = class_bigrams(left, classes, n_classes).astype(float)
    before, after = pairs.sum(1), pairs.sum(0)
    for w in np.flatnonzero(movable):
        at, s = classes[w], float(own[w])
        l, r = left[w].astype(float), right[w].astype(float)
        n_after, n_before = l.sum(), r.sum()
        # Taken out of its class; the head after itself was counted on both sides.
        pairs[:, at] -= l
        pairs[at] -= r
        pairs[at, at] += s
        l[at] -= s
        r[at] -= s
        before[at] -= n_before
        after[at] -= n_after
        base = _plogp(pairs)
        gain = (_plogp(pairs + l[:, None]) - base).sum(0) + (_plogp(pairs + r[None, :]) - base).sum(1)
        # The cell of a class with itself takes both sides at once.
        diagonal = np.diagonal(pairs)
        gain += _plogp(diagonal + l + r + s) - _plogp(diagonal + l) - _plogp(diagonal + r) + np.diagonal(base)
        gain -= _plogp(before + n_before) - _plogp(before) + _plogp(after + n_after) - _plogp(after)
        to = 1 + int(gain[1:].argmax())
        classes[w] = to
        l[to] += s
        r[to] += s
        pairs[:, to] += l
        pairs[to] += r
        pairs[to, to] -= s
        before[to] += n_before
        after[to] += n_after
    return classes


def cluster(bigrams: DataFrame, hashes: np.ndarray, n_classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[Heads, np.ndarray]:
    """Classes of the heads and the bigrams of classes; half of the heads move in each round, by what all others are."""
    every = n_classes + 1
    # Neighbours in frequency start in different classes; the end is a class of its own.
    classes = np.concatenate([[0], 1 + np.arange(len(hashes) - 1) % n_classes]).astype(np.int64)
    best, kept, misses = -math.inf, None, 0
    for turn in range(rounds + 1):
        left, right, own = contexts(bigrams, classes, every)
        pairs = class_bigrams(left, classes, every)
        value = likelihood(pairs)
        misses = 0 if value > best + 1e-6 * abs(best if kept else value) else misses + 1
        if kept is None or value > best:
            best, kept = value, (classes, pairs)
        if turn == rounds or misses == 2:
            break
        movable = (hashes % np.uint64(2) == turn % 2) & (np.arange(len(hashes)) > 0)
        classes = exchange(left, right, own, classes, every, movable)
    return Heads(hashes, kept[0]), kept[1]


def _rare_contexts(heads: Heads, n_classes: int):
    """Classes before the other words, by slice; a neighbour that is no head counts as ``n_classes + 1``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = n_classes + 2
        for batch in batches:
            for known, place, before, after in _training_texts(batch, heads):
                class_of = np.where(place >= 0, heads.classes[place], n_classes + 1)
                rare = place[after] < 0
                cell, times = np.unique(after[rare].astype(np.int64) * width + class_of[before[rare]], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [words.signed(known[cell // width]), pa.array(cell % width, pa.int32()), pa.array(times, pa.int64())],
                    ["word", "before", "n"],
                )

    return count


def _choose(weights: np.ndarray):
    """Ordered contexts of words to their count and the class with the highest sum of weights, the least one on a tie."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(word, n, sums):
            return pa.RecordBatch.from_arrays(
                [pa.array(word), pa.array(n), pa.array(1 + sums.argmax(1), pa.int32())], ["word", "n", "class"]
            )

        last = None
        for batch in batches:
            if not len(batch):
                continue
            word, before, n = (c.to_numpy() for c in batch.columns)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            # Whole numbers: the order of the rows changes nothing.
            sums = np.add.reduceat(n[:, None] * weights[before], starts, axis=0)
            total = np.add.reduceat(n, starts)
            word = word[starts]
            if last is not None:
                if last[0][0] == word[0]:
                    total[0] += last[1][0]
                    sums[0] += last[2][0]
                else:
                    yield out(*last)
            if len(word) > 1:
                yield out(word[:-1], total[:-1], sums[:-1])
            last = word[-1:], total[-1:], sums[-1:]
        if last is not None:
            yield out(*last)

    return choose


def place_rare(slices: DataFrame, heads: Heads, pairs: np.ndarray, n_classes: int = CLASSES) -> DataFrame:
    """``word, n, class`` of every training word that is no head; stored."""
    after = pairs.sum(0)[1:]
    # log P(class | class before) - log n(class): how much likelier the class is here than a word of it is elsewhere.
    given = np.log(pairs[:, 1:] + 1.0) - np.log(pairs.sum(1, keepdims=True) + float(n_classes + 1))
    anywhere = np.log(after + 1.0) - math.log(after.sum() + n_classes + 1.0)
    weights = np.concatenate([given, anywhere[None], anywhere[None]])[: n_classes + 2] - np.log(after + 1.0)
    rare = slices.select("words", "docs").mapInArrow(_rare_contexts(heads, n_classes), "word long, before int, n long")
    ordered = rare.repartition("word").sortWithinPartitions("word")
    whole = np.round(weights * 65536).astype(np.int64)
    return materialize(ordered.mapInArrow(_choose(whole), "word long, n long, class int"), "rare")


def _asks(heads: Heads):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_, known in zip(batch.column("slice"), batch.column("words")):
                known = _numbers(known.as_py(), np.uint64)
                rare = np.flatnonzero(heads.places(known) < 0)
                yield pa.RecordBatch.from_arrays(
                    [words.signed(known[rare]), pa.array(np.full(len(rare), slice_.as_py()), pa.int64()), pa.array(rare, pa.int32())],
                    ["word", "slice", "number"],
                )

    return ask


def _parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of a task, put together by slice."""
    waiting, held = [], 0

    def out():
        slices, numbers, n, classes = (np.concatenate(c) for c in zip(*waiting))
        order = np.argsort(slices, kind="stable")
        slices = slices[order]
        cuts = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(slices)]
        parcels = [
            [_packed(c[order[low:high]].astype(t)) for low, high in zip(cuts, cuts[1:])]
            for c, t in ((numbers, np.int32), (n, np.int64), (classes, np.int32))
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(slices[cuts[:-1]]), *(pa.array(p, pa.binary()) for p in parcels)], ["slice", "a", "b", "c"]
        )

    for batch in batches:
        waiting.append([c.to_numpy() for c in batch.columns])
        held += len(batch)
        if held >= PARCEL:
            yield from out()
            waiting, held = [], 0
    if held:
        yield from out()


@dataclass
class Totals:
    """What is known of the training texts as a whole."""

    tokens: int
    words: int
    once: int
    by_class: np.ndarray

    def base(self, n: np.ndarray) -> np.ndarray:
        """log10 of the add-a-half unigram probability of words seen ``n`` times."""
        return np.log10((n + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


_COUNTED = "row long, id long, trains boolean, n_tokens long, n_known long, base_score double, emission double, steps array<int>, times array<int>, cells array<long>"
_COUNTED_ARROW = pa.schema([
    ("row", pa.int64()), ("id", pa.int64()), ("trains", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("base_score", pa.float64()), ("emission", pa.float64()), ("steps", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
    ("cells", pa.list_(pa.int64())),
])


def _counted(heads: Heads, head_counts: np.ndarray, totals: Totals, n_classes: int):
    """Answers of a slice, then its texts: each text's transitions and sums, and a row of all training transitions of the slice."""
    unknown, width = n_classes + 1, n_classes + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_, answers = None, []
        for batch in batches:
            slices, kinds = batch.column("slice").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(slices) != 0) | (np.diff(kinds) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(slices)]):
                part = batch.slice(low, high - low)
                if slices[low] != slice_:
                    slice_, answers = slices[low], []
                columns = zip(*(part.column(c).to_pylist() for c in ("a", "b", "c")))
                if kinds[low] == 0:
                    answers += [[_numbers(x, t) for x, t in zip(row, (np.int32, np.int64, np.int32))] for row in columns]
                else:
                    for known, docs, _ in columns:
                        yield texts(_numbers(known, np.uint64), docs, answers)

    def texts(known, docs, answers):
        n, classes = np.zeros(len(known), np.int64), np.full(len(known), unknown)
        place = heads.places(known)
        head = place >= 0
        n[head], classes[head] = head_counts[place[head]], heads.classes[place[head]]
        for number, seen, class_ in answers:
            n[number], classes[number] = seen, class_
        classes[n == 0] = unknown
        base = totals.base(n)
        emission = np.where(n > 0, np.log10(np.maximum(n, 1) / np.maximum(totals.by_class[classes], 1)), 0.0)
        end = int(np.flatnonzero(known == END)[0])
        once = (n == 1) & (np.arange(len(known)) != end)
        rows, cells = [], np.zeros(width * width, np.int64)
        row_keys, ids, trains, starts, every = _docs(docs)
        for row, id_, learns, low, high in zip(row_keys.tolist(), ids.tolist(), trains.tolist(), starts[:-1], starts[1:]):
            codes = every[low:high]
            own = classes[codes]
            before = np.concatenate([[classes[end]], own[:-1]])
            step, times = np.unique(before * width + own, return_counts=True)
            rows.append([
                row, id_, learns, len(codes), int((n[codes] > 0).sum()), float(base[codes].sum()),
                float(emission[codes].sum()), step, times, None,
            ])
            if learns:
                cells[step] += times
                # Words seen once stand for unknown ones: after what, and before what, they come.
                rare = once[codes]
                cells += np.bincount(before[rare] * width + unknown, minlength=width * width)
                cells += np.bincount(unknown * width + own[1:][rare[:-1]], minlength=width * width)
        rows.append([None] * 9 + [cells])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _COUNTED_ARROW.types)], schema=_COUNTED_ARROW)

    return count


def transitions(cells: np.ndarray, totals: Totals, n_classes: int) -> np.ndarray:
    """log10 P(class | class before), as a table by class before."""
    seen = cells.reshape(n_classes + 2, n_classes + 2).astype(float)
    followed, once = seen[:, :-1], seen[:, -1]
    n = followed.sum(1)
    share = (followed[:-1].sum(0) + 0.5) / (followed[:-1].sum() + 0.5 * (n_classes + 1))
    new = (once + PRIOR * (totals.once + 0.5) / (totals.tokens + 1)) / (n + PRIOR)
    known = (1 - new)[:, None] * (followed + PRIOR * share) / (n + PRIOR)[:, None]
    return np.log10(np.concatenate([known, new[:, None]], 1))


def score_texts(
    docs: DataFrame,
    trains: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_heads: int = HEADS,
    n_classes: int = CLASSES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``_row, _id, trains, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every text."""
    slices = slices_of(docs, trains, id_col, text_col)
    vocabulary = word_counts(slices)
    end = int(END.astype(np.int64))
    tokens, distinct, once = vocabulary.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count(F.when((F.col("n") == 1) & (F.col("word") != end), 1))
    ).first()
    top = vocabulary.where(F.col("word") != end).orderBy(F.desc("n"), "word").limit(n_heads - 1).toArrow()
    ends = vocabulary.where(F.col("word") == end).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hashes = np.concatenate([[END], top["word"].to_numpy().astype(np.int64).view(np.uint64)]).astype(np.uint64)
    head_counts = np.concatenate([[ends], top["n"].to_numpy()]).astype(np.int64)

    unplaced = Heads(hashes, np.zeros(len(hashes), np.int64))
    bigrams = materialize(
        slices.select("words", "docs").mapInArrow(_head_bigrams(unplaced), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")),
        "bigrams",
    )
    heads, pairs = cluster(bigrams, hashes, n_classes, rounds)
    rare = place_rare(slices, heads, pairs, n_classes)
    by_class = np.bincount(heads.classes, head_counts, n_classes + 2)
    for r in rare.groupBy("class").agg(F.sum("n").alias("n")).collect():
        by_class[r["class"]] += r["n"]
    totals = Totals(tokens, distinct, once, by_class)

    asks = slices.select("slice", "words").mapInArrow(_asks(heads), "word long, slice long, number int")
    answers = asks.join(rare, "word").select("slice", "number", "n", "class").mapInArrow(
        _parcels, "slice long, a binary, b binary, c binary"
    ).select("slice", F.lit(0).alias("kind"), "a", "b", "c")
    texts = slices.select(
        "slice", F.lit(1).alias("kind"), F.col("words").alias("a"), F.col("docs").alias("b"), F.lit(None).cast("binary").alias("c")
    )
    together = answers.unionByName(texts).repartition("slice").sortWithinPartitions("slice", "kind")
    counted = materialize(together.mapInArrow(_counted(heads, head_counts, totals, n_classes), _COUNTED), "counted")
    cells = np.zeros((n_classes + 2) ** 2, np.int64)
    sums = counted.where(F.col("cells").isNotNull()).select(F.posexplode("cells").alias("cell", "n"))
    for r in sums.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        cells[r["cell"]] = r["n"]
    table = transitions(cells, totals, n_classes).reshape(-1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps, times = batch.column("steps"), batch.column("times")
            ends = steps.offsets.to_numpy() - steps.offsets[0].as_py()
            running = np.concatenate([[0.0], table[steps.flatten().to_numpy()] * times.flatten().to_numpy()])
            # Each text has a step at least, its end.
            sums = np.add.reduceat(running[1:], ends[:-1]) if len(batch) else np.zeros(0)
            columns = [batch.column(c) for c in ("row", "id", "trains", "n_tokens", "n_known", "base_score")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sums + batch.column("emission").to_numpy())],
                ["row", "id", "trains", "n_tokens", "n_known", "base_score", "score"],
            )

    scored = counted.where(F.col("cells").isNull()).mapInArrow(
        score, "row long, id long, trains boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        F.col("row").alias(ROW), F.col("id").alias(ID), "trains", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
