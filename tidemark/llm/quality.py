"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Every whole text becomes sixteen statistics (length, letter, symbol and line shares,
   repetition, compression); one pass, nothing shuffled, stored once.
2. A forest of shallow trees is fitted on a bounded sample of the labelled texts.  Every
   path from a root to a node is a rule: a conjunction of comparisons of statistics.
3. A logistic model with a lasso penalty weighs the rules; most weights become zero.
4. The rules with a weight are compiled to one Spark column expression, the score.

Labels come from a table; language, source and id are never inputs.  The sample has at
most about ``max_rows`` labelled texts, and ``LEAST_OF_CLASS`` more of a rare class, chosen by
a hash of the id; every statistic and every score covers all texts.  The sample is put in one order before it is fitted, so
reruns agree whatever the partitions.

Defined cases: a null or empty text has all statistics 0 and is scored like any other;
labels without a text and null labels are ignored; a text labelled twice trains twice; with
labels of fewer than two classes every score is their smoothed share of ones (0.5 when there
are none); repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm import words
from tidemark.llm.compression import repeated_words
from tidemark.llm.frames import ID, ROW, materialize, rows_of

MAX_ROWS = 20_000
LEAST_OF_CLASS = 1_000
LEAF_ROWS = 2
STATISTICS = [
    "bytes_log", "word_count_log", "word_length", "upper", "digits", "symbols", "marks", "bars", "spaces", "high_bytes",
    "capital_words", "distinct_words", "repeated_words", "line_length", "repeated_lines", "ratio",
]


def _class_of(characters: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(characters, np.uint8))


_UPPER = _class_of(bytes(range(65, 91)))
_DIGITS = _class_of(b"0123456789")
_SYMBOLS = _class_of(b"#*$%&<>@^~=+_{}[]\\/")
_MARKS = _class_of(b"!?")
_BARS = _class_of(b"|")
_HIGH = np.arange(256) >= 128


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The statistics of a text column that stands last, behind the columns that come along."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        *along, texts = batch.columns
        raw, offsets = words.text_buffers(texts)
        for part in words.cut(texts, words.AS_IS):
            bounds = offsets[part.row : part.row + len(part) + 1]
            data, local = raw[bounds[0] : bounds[-1]], bounds - bounds[0]
            size, n = np.diff(local), part.counts

            def share(flags: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(flags)])[at]) / np.maximum(of, 1)

            distinct, line_length, repeated_lines, ratio = np.zeros((4, len(part)))
            for d in range(len(part)):
                text = data[local[d] : local[d + 1]].tobytes()
                if text:
                    lines = [x for x in text.split(b"\n") if x.strip()]
                    distinct[d] = len(np.unique(part.hashes[part.first[d] : part.first[d + 1]])) / max(n[d], 1)
                    line_length[d] = np.log1p(size[d] / max(len(lines), 1))
                    repeated_lines[d] = 1 - len(set(lines)) / max(len(lines), 1)
                    ratio[d] = len(packer.compress(text)) / len(text)
            lengths = np.concatenate([[0], np.cumsum(part.ends - part.starts)])
            columns = [
                np.log1p(size),
                np.log1p(n),
                np.diff(lengths[part.first]) / np.maximum(n, 1),
                *(share(c[data], size, local) for c in (_UPPER, _DIGITS, _SYMBOLS, _MARKS, _BARS)),
                share(part.data == 32, size, local),
                share(_HIGH[data], size, local),
                share(_UPPER[data[part.starts]], n, part.first),
                distinct,
                repeated_words(part) / np.maximum(n, 1),
                line_length,
                repeated_lines,
                ratio,
            ]
            kept = [c.slice(part.row, len(part)) for c in along]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(c, pa.float64()) for c in columns)], [*batch.schema.names[:-1], *STATISTICS]
            )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", along: bool = False) -> DataFrame:
    """``_row, _id`` and the statistics of every row; stored in the shared folder.

    With ``along`` the columns of ``docs`` come too, as ``c0, c1, …``.
    """
    places = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)] if along else []
    rows = rows_of(docs, *places, id_col=id_col, text_col=text_col)
    rows = rows.select(ROW, ID, *[c for c in rows.columns if c not in (ROW, ID, "_text")], "_text")
    schema = StructType(rows.schema.fields[:-1] + [StructField(s, DoubleType()) for s in STATISTICS])
    return materialize(rows.mapInArrow(_statistics, schema), "statistics")


@dataclass(frozen=True)
class Rule:
    """Bounds on statistics, all of which must hold: ``low < x <= high``."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        held = F.lit(True)
        for name, low, high in self.bounds:
            if low > -np.inf:
                held = held & (F.col(name) > low)
            if high < np.inf:
                held = held & (F.col(name) <= high)
        return held


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The chance of label 1 as one column expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _paths(node, bounds: dict[str, tuple[float, float]], found: set[Rule]) -> None:
    """Adds the path to every node under ``node``."""
    if bounds:
        found.add(Rule(tuple(sorted((k, *v) for k, v in bounds.items()))))
    if node.subtreeDepth() == 0:
        return
    split = node.split()
    name, at = STATISTICS[split.featureIndex()], split.threshold()
    low, high = bounds.get(name, (-np.inf, np.inf))
    _paths(node.leftChild(), bounds | {name: (low, min(high, at))}, found)
    _paths(node.rightChild(), bounds | {name: (max(low, at), high)}, found)


def fit(
    labelled: DataFrame, max_rows: int = MAX_ROWS, trees: int = 30, depth: int = 3, penalty: float = 0.002, leaf_rows: int = LEAF_ROWS
) -> RuleEnsemble:
    """Fits the ensemble on ``label`` (0 or 1) and the statistics; ``labelled`` is read twice.

    Both sides of a split of a tree have ``leaf_rows`` rows of the sample at least.
    """
    count, ones = labelled.agg(F.count("label"), F.sum("label")).first()
    ones = ones or 0
    if ones in (0, count):
        share = (ones + 0.5) / (count + 1)
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    # The same share of both classes, but a rare one is taken whole up to LEAST_OF_CLASS rows.
    share = [min(1.0, max(max_rows / count, LEAST_OF_CLASS / n)) for n in (count - ones, ones)]
    place = F.pmod(F.xxhash64(F.lit("sample"), ID, ROW), F.lit(1_000_000)) / 1_000_000
    part = place < F.when(F.col("label") == 1, share[1]).otherwise(share[0])
    order = [ID, ROW, "label"]
    features = F.array(*STATISTICS)
    # Bounded by max_rows, so that one ordered partition is small; what it is drawn from is
    # joined and filtered before the shuffle, in all tasks.
    sample = materialize(
        labelled.where(part).repartition(1).sortWithinPartitions(*order)
        .select(F.col("label").cast("double").alias("label"), *STATISTICS), "sample",
    )
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=11, minInstancesPerNode=leaf_rows
    ).fit(sample.select("label", array_to_vector(features).alias("features")))
    found: set[Rule] = set()
    for tree in forest.trees:
        _paths(tree._call_java("rootNode"), {}, found)
    rules = sorted(found, key=lambda r: (len(r.bounds), r.bounds))
    if not rules:
        return RuleEnsemble(float(np.log(ones / (count - ones))), ())
    held = F.array(*[r.column().cast("double") for r in rules])
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=200).fit(
        sample.select("label", array_to_vector(held).alias("features"))
    )
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w]
    # What the sampling changed in the odds of the classes is taken back.
    return RuleEnsemble(float(lasso.intercept + np.log(share[0] / share[1])), tuple(weights))


def scored(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    max_rows: int = MAX_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``_row, _id, score`` of every row, learnt from ``labels (id_col, label_col)``."""
    stats = statistics(docs, id_col, text_col)
    model = _learn(stats, labels, label_col, max_rows, id_col)
    return stats.select(ROW, ID, model.score().alias("score"))


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    least: float = 0.5,
    max_rows: int = MAX_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns.

    Rows are stored next to their statistics, so no text is shuffled.
    """
    stats = statistics(docs, id_col, text_col, along=True)
    model = _learn(stats, labels, label_col, max_rows, id_col)
    return stats.where(model.score() >= least).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _learn(stats: DataFrame, labels: DataFrame, label_col: str, max_rows: int, id_col: str) -> RuleEnsemble:
    known = labels.where(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).cast("bigint").alias(ID), F.col(label_col).cast("int").alias("label")
    )
    return fit(stats.select(ROW, ID, *STATISTICS).join(known, ID), max_rows)


def held_out(id_col: Column) -> Column:
    """A third of the ids, kept out of training to measure the score; a missing id is not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))
