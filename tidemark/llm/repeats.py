"""Substring dedup: long passages that an earlier document has too are cut out.

Seed and extend.  Winnowing picks, in each window of ``window`` words, the ``seed``-word
sequence with the least hash (the last one on a tie), so equal windows pick the same
anchor at the same place.  Documents are joined on their anchors; an anchor that one
document alone has is done with.  Around a shared anchor the match is extended both ways
over all windows that picked it.  Where the whole extension agrees in every document, one
row settles all its windows; elsewhere the windows are told apart one by one, by the hash
of their whole word sequence.  Groups are matched by key, never pair by pair, so copies
cost a row each.  Adjacent matched windows merge to maximal repeats.

A window counts as repeated when its word sequence also starts in a document with a
smaller ``doc_id``; all windows are judged on the input.  Defined cases: a null text has
no words; texts under ``window`` words keep everything; rows without an id, and rows that
share one id, do not cut each other; repeated rows get the same answer each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.frames import ID, ROW, materialize, plain_id, rows_of

WINDOW, SEED = 50, 10


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The position of the least of each ``width`` consecutive values, the last one on a tie."""
    n = len(values)
    place = np.uint64((1 << 32) - 1) - np.arange(n, dtype=np.uint64)
    least = (values & np.uint64(0xFFFFFFFF00000000)) | place
    done = 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    return (np.uint64((1 << 32) - 1) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)


def _anchor_runs(part: words.Words, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, first window, last window) of every run of windows with one anchor."""
    if len(part.hashes) < window:
        return (np.empty(0, np.int64),) * 4
    grams = part.grams(seed)
    picked = _least(grams, window - seed + 1)
    from_, to = part.gram_ranges(window)
    text = np.repeat(np.arange(len(part)), to - from_)
    start = np.arange(len(text)) + np.repeat(from_ - np.concatenate([[0], np.cumsum(to - from_)[:-1]]), to - from_)
    anchor = picked[start]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    return text[first], grams[anchor[first]], start[first], start[last]


def _seeds(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, id_ = (np.asarray(batch.column(c)) for c in (ROW, ID))
            for part in words.cut(batch.column("_text"), words.AS_IS):
                text, anchor, low, high = _anchor_runs(part, window, seed)
                if not len(text):
                    continue
                at = part.row + text
                yield pa.RecordBatch.from_arrays(
                    [
                        words.signed(anchor.astype(np.uint64)),
                        words.signed(part.sequences(low, high + window)),
                        pa.array(row[at]),
                        pa.array(id_[at]),
                        pa.array((low - part.first[text]).astype(np.int32)),
                        pa.array((high - part.first[text]).astype(np.int32)),
                    ],
                    ["anchor", "extension", ROW, ID, "low", "high"],
                )

    return run


def _windows(window: int):
    """Every window of the given runs with the hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, id_ = (np.asarray(batch.column(c)) for c in (ROW, ID))
            runs = batch.column("runs")
            offsets = np.asarray(runs.offsets)
            low, high, anchor = (np.asarray(runs.values.field(c)) for c in ("low", "high", "anchor"))
            for part in words.cut(batch.column("_text"), words.AS_IS):
                of = slice(offsets[part.row], offsets[part.row + len(part)])
                text = np.repeat(np.arange(len(part)), np.diff(offsets[part.row : part.row + len(part) + 1]))
                n = high[of] - low[of] + 1
                if not n.sum():
                    continue
                which = np.repeat(np.arange(len(n)), n)
                start = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[of][which]
                at = part.first[text[which]] + start
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[of][which]),
                        words.signed(part.sequences(at, at + window)),
                        pa.array(row[part.row + text[which]]),
                        pa.array(id_[part.row + text[which]]),
                        pa.array(start.astype(np.int32)),
                    ],
                    ["anchor", "words", ROW, ID, "start"],
                )

    return run


def _cut_out(window: int):
    schema = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, spans, kept = [], [], [], []
            for text, runs in zip(batch.column("_text"), batch.column("runs")):
                all_words = text.as_py().encode().split()
                merged: list[list[int]] = []
                for r in sorted(runs.as_py() or [], key=lambda r: r["low"]):
                    end = r["high"] + window
                    if merged and r["low"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([r["low"], end])
                n_words.append(len(all_words))
                n_removed.append(sum(e - s for s, e in merged))
                spans.append([{"start": s, "end": e} for s, e in merged])
                for s, e in reversed(merged):
                    del all_words[s:e]
                kept.append(b" ".join(all_words).decode())
            arrays = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(ID), *arrays, pa.array(spans, pa.list_(schema)), pa.array(kept, pa.string())],
                [ID, "n_words", "n_removed", "removed", "kept_text"],
            )

    return run


def cut_repeats(
    docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_words, n_removed, removed`` (word spans) and ``kept_text`` of every document.

    Stores the anchors, and of those the shared ones, in the shared folder; texts are
    shuffled by row once, for both passes that need them.
    """
    rows = rows_of(docs, id_col=id_col, text_col=text_col)
    seeds = materialize(
        rows.where(plain_id().isNotNull()).mapInArrow(
            _seeds(window, seed), f"anchor long, extension long, {ROW} long, {ID} long, low int, high int"
        ),
        "anchors",
    )
    # Aggregates are stored before they are joined back: read from a table, the side with all
    # rows is a plain shuffle, which adaptive execution can split where a key is hot.
    shared = materialize(
        seeds.groupBy("anchor")
        .agg(
            F.min(ID).alias("least"),
            F.max(ID).alias("most"),
            (F.min("extension") == F.max("extension")).alias("agrees"),
        )
        .where("least < most")
        .select("anchor", "least", "agrees"),
        "shared",
    )
    found = materialize(
        seeds.join(shared, "anchor").where(f"NOT agrees OR {ID} > least").drop("extension"), "shared-anchors"
    )
    runs = F.collect_list(F.struct("low", "high", "anchor")).alias("runs")
    told_apart = (
        rows.join(found.where("NOT agrees").groupBy(ROW, ID).agg(runs), [ROW, ID])
        .select(ROW, ID, "_text", "runs")
        .mapInArrow(_windows(window), f"anchor long, words long, {ROW} long, {ID} long, start int")
    )
    told_apart = materialize(told_apart, "windows")
    earliest = materialize(
        told_apart.groupBy("anchor", "words")
        .agg(F.min(ID).alias("least"), F.max(ID).alias("most"))
        .where("least < most")
        .drop("most"),
        "earliest",
    )
    repeated = (
        told_apart.join(earliest, ["anchor", "words"])
        .where(f"{ID} > least")
        .select(ROW, ID, F.col("start").alias("low"), F.col("start").alias("high"))
        .union(found.where("agrees").select(ROW, ID, "low", "high"))
    )
    by_row = repeated.groupBy(ROW, ID).agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    span = "array<struct<start:int,end:int>>"
    return (
        rows.join(by_row, [ROW, ID], "left")
        .select(ID, "_text", "runs")
        .mapInArrow(_cut_out(window), f"{ID} long, n_words long, n_removed long, removed {span}, kept_text string")
        .select(plain_id().alias("doc_id"), "n_words", "n_removed", "removed", "kept_text")
    )
