"""Regressions on any design, also one whose columns depend on each other.

Least squares: each task brings its rows to a triangle by an orthogonal decomposition, and
triangles are stacked and brought to one again.  Products of the columns, whose errors are those of
the squares, are never formed.

Logistic regression: Newton steps as weighted least squares: a pass over the rows adds up the weighted products
of the columns and of the columns with the response, one small square table whatever the
number of rows; the step follows from it.  Where columns depend on each other (all levels of several
categories next to an intercept) many solutions fit equally well; the shortest one is
taken, and its standard errors come from the pseudo-inverse, so they are finite too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

MAX_STEPS, TOLERANCE = 100, 1e-10
# A direction whose share of the scaled products is below this has no information.
NO_INFORMATION = 1e-9
LEAST_WEIGHT = 1e-10


@dataclass(frozen=True)
class Logistic:
    """Coefficients in the order of the columns, the intercept last; their covariances; the steps it took."""

    coefficients: np.ndarray
    covariance: np.ndarray
    rank: int
    steps: int


def shortest_solution(products: np.ndarray, response: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The shortest solution of ``products @ x = response``, the pseudo-inverse of ``products``, and its rank.

    Columns are scaled before the dependent directions are looked for, so that large units do
    not hide small ones; the result is that of the unscaled columns.
    """
    scale = np.sqrt(np.maximum(np.diagonal(products), 0.0))
    scale[scale == 0] = 1.0
    values, vectors = np.linalg.eigh(products / scale[:, None] / scale)
    known = values > NO_INFORMATION * max(values.max(initial=0.0), 1e-300)
    inverse = (vectors[:, known] / values[known]) @ vectors[:, known].T / scale[:, None] / scale
    project = np.eye(len(scale))
    if not known.all():
        lost = np.linalg.qr(vectors[:, ~known] / scale[:, None])[0]
        project -= lost @ lost.T
    inverse = project @ inverse @ project
    return inverse @ response, inverse, int(known.sum())


def _products(coefficients: np.ndarray | None, width: int):
    """Weighted products of the columns (with the intercept) and the response, and the log likelihood, of a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss = np.zeros((width, width + 1)), 0.0
        for batch in batches:
            label, *columns = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)
            x = np.column_stack([*columns, np.ones(len(label))])
            if coefficients is None:
                chance = (label + 0.5) / 2
                linear = np.log(chance / (1 - chance))
            else:
                linear = np.clip(x @ coefficients, -700, 700)
                chance = 1 / (1 + np.exp(-linear))
            loss += float(np.logaddexp(0.0, -np.where(label > 0.5, linear, -linear)).sum())
            weight = np.maximum(chance * (1 - chance), LEAST_WEIGHT)
            z = linear + (label - chance) / weight
            total += (x * weight[:, None]).T @ np.column_stack([x, z])
        cells = np.concatenate([total.ravel(), [loss]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "value"])

    return add


def fit_logistic(df: DataFrame, label: str, features: Sequence[str]) -> Logistic:
    """Fits a 0/1 label on all rows without a null; the rows are cached while it lasts."""
    chosen = df.select(F.col(f"`{label}`").cast("double").alias("y"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    rows = chosen.dropna().persist(StorageLevel.MEMORY_AND_DISK)
    width = len(features) + 1
    coefficients, covariance, rank, before, steps = None, np.zeros((width, width)), 0, math.inf, 0
    try:
        for steps in range(MAX_STEPS):
            parts = rows.mapInArrow(_products(coefficients, width), "cell long, value double")
            sums = parts.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
            cells = np.zeros(width * (width + 1) + 1)
            cells[sums["cell"].to_numpy()] = sums["value"].to_numpy()
            if coefficients is not None and abs(before - cells[-1]) <= TOLERANCE * (abs(cells[-1]) + 1e-6):
                # The sums at the solution give its covariances.
                covariance = shortest_solution(cells[:-1].reshape(width, width + 1)[:, :-1], np.zeros(width))[1]
                break
            before = cells[-1] if coefficients is not None else math.inf
            table = cells[:-1].reshape(width, width + 1)
            coefficients, covariance, rank = shortest_solution(table[:, :-1], table[:, -1])
    finally:
        rows.unpersist()
    return Logistic(coefficients, covariance, rank, steps)


# Triangles that one task, or the driver, stacks.
STACKED = 64


def _triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task as a triangle with the same products; zero rows are left out."""
    held, names = None, None
    for batch in batches:
        names = batch.schema.names
        rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
        held = np.linalg.qr(rows if held is None else np.concatenate([held, rows]), mode="r")
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in held.T], names)


def triangle(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The triangle of an orthogonal decomposition of a constant and the columns, over all rows without a null."""
    chosen = df.select(F.lit(1.0).alias("x0"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns, 1)]).dropna()
    parts = chosen.mapInArrow(_triangles, chosen.schema)
    tasks = chosen.rdd.getNumPartitions()
    while tasks > STACKED:
        tasks = -(-tasks // STACKED)
        parts = parts.repartition(tasks).mapInArrow(_triangles, chosen.schema)
    rows = np.array([list(r) for r in parts.collect()], float).reshape(-1, len(columns) + 1)
    found = np.zeros((len(columns) + 1, len(columns) + 1))
    last = np.linalg.qr(rows, mode="r") if len(rows) else rows
    found[: len(last)] = last
    return found


@dataclass(frozen=True)
class LeastSquares:
    """Weights of the constant and the columns, and the squares around the mean and around the fit."""

    weights: np.ndarray
    total: float
    residual: float

    def r2(self) -> float:
        return 1 - self.residual / self.total if self.total else 0.0


def fit_least_squares(df: DataFrame, label: str, features: Sequence[str]) -> LeastSquares:
    """The shortest of the weights with the least squared error."""
    whole = triangle(df, [*features, label])
    x, y = whole[:, :-1], whole[:, -1]
    weights = np.linalg.lstsq(x, y, rcond=1e-12)[0]
    return LeastSquares(weights, float((y[1:] ** 2).sum()), float(((y - x @ weights) ** 2).sum()))
