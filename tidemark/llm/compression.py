"""Quality rules by compression: repetitive and incompressible texts are rejected.

zstandard compresses the whole text and each of its chunks of ``CHUNK`` bytes, the last of
which is as long as is left.  The ratio of compressed to raw bytes must lie within limits
that depend on the length, since short texts compress worse.  Whole-text ratios find
repeats at any distance; chunk ratios find a bad stretch that a long clean text would hide,
and reject when chunks with more than ``MAX_CHUNKS`` of the bytes fall outside.

There are two kinds of limits and a ratio must keep both.  The fixed ones (``LIMITS``) hold for
any written language: repeated material lies far below, random strings above.  The fitted
ones follow the corpus: for each length class (bytes between two powers of two, and full
chunks) ``FENCE`` times the distance of the quartiles below the lower and above the upper
one, never closer to the median than ``SLACK`` of it.  Quartiles are counted in thousandths
over all texts that pass the base rules; texts of one size and ratio count once, so copies
do not move the limits.  A class with fewer than ``LEAST`` ratios has fixed limits only.

Base rules, on words ``[^\\x20\\x09-\\x0D]+``: at least ``MIN_WORDS`` words, and at most
``MAX_REPEATED`` percent of them inside 8-word windows that the text has more than once.

Defined cases: a null text is empty and fails the base rules; a text shorter than the
first limit has no ratio limits; one shorter than a chunk has no chunks, the limits of the
whole text are the same; a last chunk under the first limit counts as inside, a longer one
is judged by the limits of its own length; repeated rows are judged alike.  Texts are read once, where they lie;
what is stored are the counts and ratios of each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.frames import ID, materialize, plain_id, rows_of

LEVEL, CHUNK = 3, 4096
# From so many bytes on: least and greatest ratio.
LIMITS = ((128, 0.40, 1.00), (256, 0.30, 0.85), (1024, 0.25, 0.70), (4096, 0.18, 0.65), (16384, 0.12, 0.65))
CHUNK_LIMITS = (0.20, 0.65)
MAX_CHUNKS = 0.25
FENCE, SLACK, LEAST = 3.0, 0.15, 100
MIN_WORDS, MAX_REPEATED, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"


def _totals(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set within each of the ranges between bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])


def repeated_words(part: words.Words, window: int = REPEAT_WINDOW) -> np.ndarray:
    """Per text, the words inside ``window``-word sequences that it has at least twice."""
    low, high = part.gram_ranges(window)
    n = high - low
    text = np.repeat(np.arange(len(part)), n)
    at = np.arange(len(text)) + np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    grams = part.grams(window)[at] if len(at) else np.empty(0, np.uint64)
    own = words.mix(grams ^ words.mix(text.astype(np.uint64)))
    order = np.argsort(own)
    same = own[order[1:]] == own[order[:-1]]
    again = np.zeros(len(own), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    steps = np.zeros(len(part.hashes) + 1, np.int64)
    np.add.at(steps, at[again], 1)
    np.add.at(steps, at[again] + window, -1)
    return _totals(np.cumsum(steps[:-1]) > 0, part.first)


def _duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _within(ratio: Column, size: Column) -> Column:
    """By the fixed limits of a text of ``size`` bytes."""
    inside = F.lit(True)
    for least, low, high in LIMITS:
        inside = F.when(size >= least, ratio.between(low, high)).otherwise(inside)
    return inside


def _rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        raw, offsets = words.text_buffers(batch.column("_text"))
        for part in words.cut(batch.column("_text"), words.AS_IS):
            bounds = offsets[part.row : part.row + len(part) + 1]
            data = raw[bounds[0] : bounds[-1]]
            local = bounds - bounds[0]
            whole, chunks, duplicates = [], [], []
            for a, b in zip(local, local[1:]):
                text = data[a:b].tobytes()
                duplicates.append(_duplicate_lines(text.decode()))
                whole.append(len(packer.compress(text)) / len(text) if text else 0.0)
                own = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)] if len(text) >= CHUNK else []
                chunks.append([len(packer.compress(c)) / len(c) for c in own])
            counts, repeated = part.counts, repeated_words(part)
            failed = (counts < MIN_WORDS) | (100 * repeated > MAX_REPEATED * counts)
            leads = ((data & 0xC0) != 0x80) & (part.data != 32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(ID).slice(part.row, len(part)),
                    pa.array(counts.astype(np.int64)),
                    pa.array(_totals(leads, local).astype(np.int64)),
                    pa.array(_totals(symbol[data], local).astype(np.int64)),
                    pa.array(duplicates, pa.int64()),
                    pa.array(repeated.astype(np.int64)),
                    pa.array(whole, pa.float64()),
                    pa.array(failed),
                    pa.array(np.diff(local).astype(np.int64)),
                    pa.array(chunks, pa.list_(pa.float64())),
                ],
                list(_COLUMNS),
            )


_COLUMNS = {
    ID: "long", "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
    "n_repeat_words": "long", "ratio": "double", "base_failed": "boolean", "n_bytes": "long", "chunks": "array<double>",
}


def _length_class(size: Column) -> Column:
    """The power of two at or below the size; null under the first limit, which has no class."""
    return F.when(size >= LIMITS[0][0], F.floor(F.log2(size)).cast("int"))


# Full chunks are a class of their own.
_CHUNK_CLASS = 0


def bands(rated_rows: DataFrame) -> DataFrame:
    """``class, low, high``: the fitted limits, a row for each length class with ``LEAST`` ratios."""
    texts = (
        rated_rows.where("NOT base_failed").groupBy("n_bytes", "ratio").agg(F.max("chunks").alias("chunks"))
    )
    full = F.slice("chunks", 1, F.floor(F.col("n_bytes") / CHUNK).cast("int"))
    whole = F.array(F.struct(_length_class(F.col("n_bytes")).alias("class"), "ratio"))
    parts = F.transform(full, lambda r: F.struct(F.lit(_CHUNK_CLASS).alias("class"), r.alias("ratio")))
    seen = texts.select(F.inline(F.concat(whole, parts))).where("class IS NOT NULL")
    # From here on there are at most a few thousand rows: thousandths per length class.
    counts = seen.groupBy("class", F.floor(F.col("ratio") * 1000).alias("bin")).agg(F.count("*").alias("n"))
    of_class = Window.partitionBy("class")
    ranked = counts.withColumns(
        {"up_to": F.sum("n").over(of_class.orderBy("bin")), "total": F.sum("n").over(of_class)}
    ).where(F.col("total") >= LEAST)

    def quartile(i: int) -> Column:
        return F.min(F.when(F.col("up_to") * 4 >= F.col("total") * i, F.col("bin"))) / 1000

    fitted = ranked.groupBy("class").agg(*[quartile(i).alias(f"q{i}") for i in (1, 2, 3)])
    reach = F.col("q3") - F.col("q1")
    return fitted.select(
        "class",
        F.least(F.col("q1") - FENCE * reach, (1 - SLACK) * F.col("q2")).alias("low"),
        F.greatest(F.col("q3") + FENCE * reach, (1 + SLACK) * F.col("q2")).alias("high"),
    )


def rated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts, ratios and verdict of every row of ``docs``; stores them once in between."""
    rows = rows_of(docs, id_col=id_col, text_col=text_col).select(ID, "_text")
    found = materialize(rows.mapInArrow(_rate, ", ".join(f"{c} {t}" for c, t in _COLUMNS.items())), "ratios")
    # A row per power of two: small at any number of documents.
    fitted = materialize(bands(found), "bands")

    def fit(prefix: str) -> DataFrame:
        return F.broadcast(fitted.select(*[F.col(c).alias(f"{prefix}_{c}") for c in fitted.columns]))

    def inside(ratio: Column, prefix: str) -> Column:
        return F.coalesce(ratio.between(F.col(f"{prefix}_low"), F.col(f"{prefix}_high")), F.lit(True))

    n_chunks = F.size("chunks")
    left = F.col("n_bytes") % CHUNK
    tailed = (n_chunks > 0) & (left > 0)
    found = (
        found.withColumns({"own_class": _length_class(F.col("n_bytes")), "tail_class": _length_class(F.when(tailed, left))})
        .join(fit("own"), "own_class", "left")
        .join(fit("tail"), "tail_class", "left")
        .join(fit("chunk").where(F.col("chunk_class") == _CHUNK_CLASS), F.lit(True), "left")
    )
    full = F.slice("chunks", 1, F.floor(F.col("n_bytes") / CHUNK).cast("int"))
    bad = F.size(F.filter(full, lambda r: ~(r.between(*CHUNK_LIMITS) & inside(r, "chunk"))))
    tail = F.try_element_at("chunks", F.lit(-1))
    bad_tail = F.coalesce(tailed & ~(_within(tail, left) & inside(tail, "tail")), F.lit(False)).cast("int")
    enough = bad.cast("bigint") * CHUNK + bad_tail * left <= MAX_CHUNKS * F.col("n_bytes")
    kept = ~F.col("base_failed") & _within(F.col("ratio"), F.col("n_bytes")) & inside(F.col("ratio"), "own") & enough
    return found.select(
        plain_id().alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "ratio",
        n_chunks.cast("bigint").alias("n_chunks"),
        (bad + bad_tail).cast("bigint").alias("n_chunks_outside"),
        "base_failed",
        kept.alias("kept"),
    )
