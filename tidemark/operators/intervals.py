"""Exact clusters of one column: the partition of the sorted values with the least squared error.

In one dimension the best k clusters are intervals.  Values are grouped to distinct ones with
their multiplicity in Spark; the best cuts for 1, 2, … k clusters then follow from one
another (the last cluster starts at some value, the others are the best partition
of what lies below it), with errors from prefix sums and cuts that only move right.  There is
no seed, no start and no stopping rule.

The driver holds about ``MOST_POINTS`` points.  Where there are more distinct values they are put into
bins first, by their leading binary digits.  Bins carry their number of rows, their sum and their
squares, so the error of a partition between bins is exact, and the best of them is an upper bound.
Moving a cut from inside a bin of ``m`` rows and the width ``w`` to its end costs at most ``2 m w d``, where the
clusters beside it have centres ``d`` apart.  That is a lower bound for all partitions with a cut in this
bin: where it is above the upper one, no best cut lies there.  The bins that are left are split into
finer ones until each is a single value, so the cuts are the best of all, however many values there are.
There are more points only where more bins than that may hold a best cut.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.session import materialize

MOST_POINTS = 65_536
# Rounding of sums of squares, as a share of all of them: what is closer than this is a tie.
ROUNDING = 1e-14
DIGITS = 64


@dataclass(frozen=True)
class Points:
    """Ascending values or bins: rows, sum and sum of squares around ``middle``, least and greatest value.

    ``values`` is the number of distinct values that a best cut may part, 1 where there is nothing to part.
    """

    rows: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    low: np.ndarray
    high: np.ndarray
    values: np.ndarray
    middle: float

    def __len__(self) -> int:
        return len(self.rows)

    def _columns(self) -> tuple[np.ndarray, ...]:
        return self.rows, self.sums, self.squares, self.low, self.high, self.values

    def __getitem__(self, chosen) -> Points:
        return Points(*(c[chosen] for c in self._columns()), self.middle)

    def with_points(self, other: Points) -> Points:
        both = Points(*map(np.concatenate, zip(self._columns(), other._columns())), self.middle)
        return both[np.argsort(both.low, kind="stable")]

    def merged(self, last: np.ndarray) -> Points:
        """One point of all up to each ``last`` one."""
        first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
        rows, sums, squares = (np.add.reduceat(c, first) for c in (self.rows, self.sums, self.squares))
        return Points(rows, sums, squares, self.low[first], self.high[last], self.values[first], self.middle)

    def most_lost(self) -> np.ndarray:
        """The most that moving a best cut from inside a point to its end can cost.

        Half the distance of the centres beside the cut is that of either to the middle
        between them, which lies in the point; no centre lies outside the values.
        """
        if not len(self):
            return self.rows
        low, high = self.low.astype(np.longdouble), self.high.astype(np.longdouble)
        apart = 2 * np.minimum(high - low[0], high[-1] - low)
        return np.where(self.values > 1, 2 * self.rows * (high - low) * apart, 0)


def _ordered_bits(value: np.ndarray) -> np.ndarray:
    """A whole number per value, in the same order; its leading digits are those of the value."""
    bits = (value + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _keys_inside(low: np.ndarray, high: np.ndarray) -> Column:
    """The ordered bits of the values that lie in one of the ascending bins, null for others."""

    @F.pandas_udf(LongType())
    def key(value: pd.Series) -> pd.Series:
        x = value.to_numpy(np.float64)
        at = np.searchsorted(low, x, "right") - 1
        return pd.Series(pd.arrays.IntegerArray(_ordered_bits(x), (at < 0) | (x > high[at])))

    return key("x")


def _finest(bins: Points, most: int, shift: int) -> int:
    """The least number of last digits below ``shift`` without which the values of the bins have ``most`` keys at most, or two less."""
    low, high = _ordered_bits(bins.low), _ordered_bits(bins.high)
    for finer in range(shift):
        # Differences of whole numbers with a sign may need all digits.
        keys = (high >> finer).view(np.uint64) - (low >> finer).view(np.uint64)
        if np.minimum(keys, bins.values.astype(np.uint64) - np.uint64(1)).sum() + len(bins) <= most:
            return finer
    return max(shift - 2, 0)


@dataclass(frozen=True)
class _Values:
    """The distinct values ``x`` of a column and their number of rows ``n``, written once; as one bin, but for its sums."""

    counted: DataFrame
    whole: Points

    @staticmethod
    def of(df: DataFrame, col: str) -> _Values:
        """Nulls and NaN are left out."""
        value = F.col(col).cast("double")
        # Negative zero is zero.
        counted = df.where(value.isNotNull() & ~F.isnan(value)).groupBy((value + F.lit(0.0)).alias("x")).agg(F.count(F.lit(1)).alias("n"))
        counted = materialize(counted, "values")
        facts = (F.min("x"), F.max("x"), F.count("*"), F.sum(F.col("x") * F.col("n")), F.sum("n"))
        low, high, distinct, total, rows = counted.agg(*facts).first()
        bins = min(distinct, 1)
        unknown = np.full(bins, np.nan, np.longdouble)
        bounds = (np.array([x] * bins, np.float64) for x in (low, high))
        whole = Points(unknown, unknown, unknown, *bounds, np.full(bins, distinct), (total or 0.0) / (rows or 1))
        return _Values(counted, whole)

    def points(self, most: int, shift: int = DIGITS, inside: Points | None = None) -> tuple[Points, int]:
        """The values, those of the bins ``inside`` only, in bins by their digits without the last ones, and how many are left out.

        These are fewer than ``shift``, and as few as keep the bins below ``most``.
        """
        bins = self.whole if inside is None else inside
        while True:
            shift = _finest(bins, most, shift)
            bins = self._binned(bins, shift)
            # Where the values fill few of the bins they might fill, the next ones are much finer.
            if not shift or _finest(bins, most, shift) >= shift - 2:
                return bins, shift

    def _binned(self, inside: Points, shift: int) -> Points:
        chosen = self.counted
        if shift or inside is not self.whole:
            chosen = chosen.withColumn("key", _keys_inside(inside.low, inside.high)).where("key IS NOT NULL")
        if not shift:
            found = chosen.select("x", "n").toPandas().sort_values("x")
            n, x = found["n"].to_numpy(np.longdouble), found["x"].to_numpy(np.float64)
            away = x.astype(np.longdouble) - np.longdouble(self.whole.middle)
            return Points(n, n * away, n * away * away, x, x, np.ones(len(x), np.int64), self.whole.middle)
        # Squares of very large values do not fit a double: distances are divided by a power of two.
        unit = math.ldexp(1.0, math.frexp(max(self.whole.high[0] - self.whole.middle, self.whole.middle - self.whole.low[0]))[1] - 1)
        n, away = F.col("n"), (F.col("x") - F.lit(self.whole.middle)) / F.lit(unit)
        sums = {"n": F.sum(n), "s": F.sum(away * n), "q": F.sum(away * away * n)}
        facts = {"low": F.min("x"), "high": F.max("x"), "values": F.count("*")}
        binned = chosen.groupBy(F.shiftright("key", shift).alias("bin")).agg(*[c.alias(name) for name, c in (sums | facts).items()])
        found = binned.toPandas().sort_values("low")
        rows, distances, squares = (found[c].to_numpy(np.longdouble) for c in sums)
        unit = np.longdouble(unit)
        return Points(rows, distances * unit, squares * unit * unit, *(found[c].to_numpy() for c in facts), self.whole.middle)


def points_of(df: DataFrame, col: str, most: int = MOST_POINTS) -> Points:
    """The distinct values of a column with their multiplicity, or bins where there are more than ``most``.

    Best cuts may lie inside bins: :func:`best_partition` splits those.
    """
    return _Values.of(df, col).points(most)[0]


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.longdouble), np.cumsum(x)])


class Partition:
    """Best errors and cuts of the points for every number of clusters up to ``k``."""

    def __init__(self, points: Points, k: int):
        self.points = points
        self._n, self._s, self._q = _sums(points.rows), _sums(points.sums), _sums(points.squares)
        n = len(points)
        first = np.full(n + 1, np.inf, np.longdouble)
        first[0] = 0
        first[1:] = self._error(np.zeros(n, np.int64), np.arange(1, n + 1))
        self._best, self._cuts = [first], [np.zeros(n + 1, np.int64)]
        for used in range(2, min(k, n) + 1):
            best, cuts = self._layer(self._best[-1], used)
            self._best.append(best)
            self._cuts.append(cuts)

    def _error(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Squared error of one cluster of the points ``[start, end)``."""
        rows = self._n[end] - self._n[start]
        sums = self._s[end] - self._s[start]
        return np.maximum(self._q[end] - self._q[start] - sums * sums / rows, 0)

    def _least(self, lost: np.ndarray, k: int) -> list[np.ndarray]:
        """Lower bounds of the error of 1, 2, … ``k`` clusters for every end, where cuts lie anywhere inside points.

        ``lost`` is what a cut moved to an end may have cost.  Two cuts may be moved to the same one.
        """
        found = [self._best[0]]
        while len(found) < k:
            free = found[-1] - lost
            found.append(np.minimum(self._layer(free, 1)[0], free))
        return found

    def narrowed(self, ks: Sequence[int]) -> Points:
        """The points, merged where no best cut into any number ``ks`` of clusters lies inside or between them."""
        points, n = self.points, len(self.points)
        if not (points.values > 1).any():
            return points
        lost, most = np.concatenate([[0], points.most_lost()]), max(ks)
        below = self._least(lost, most - 1)
        above = [b[::-1] for b in Partition(points[::-1], 1)._least(lost[::-1], most - 1)]
        possible = np.zeros(n + 1, bool)
        for k in ks:
            if k > n:
                possible[:] = True
            else:
                bound = self._best[k - 1][-1] + ROUNDING * self._q[-1]
                for j in range(1, k):
                    possible |= below[j - 1] + above[k - j - 1] - lost <= bound
        # A cut inside a point counts at its end.
        possible = possible[1:]
        values = np.where(possible, points.values, 1)
        return replace(points, values=values).merged(possible | np.append(values[1:] > 1, True))

    def _layer(self, before: np.ndarray, used: int) -> tuple[np.ndarray, np.ndarray]:
        """One cluster more: for every end the start of the last cluster.

        Starts never move left as ends move right, so an end is searched only between the starts
        found for its neighbours: first the middle, then the middles of both halves, …
        """
        n = len(self.points)
        best = np.full(n + 1, np.inf, np.longdouble)
        cuts = np.zeros(n + 1, np.int64)
        ranges = np.array([[used, n, used - 1, n - 1]])  # ends from, to; starts from, to
        while len(ranges):
            low, high, least, most = ranges.T
            end = (low + high) // 2
            last = np.minimum(most, end - 1)
            sizes = last - least + 1
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            start = np.arange(sizes.sum()) - np.repeat(first - least, sizes)
            cost = before[start] + self._error(start, np.repeat(end, sizes))
            lowest = np.minimum.reduceat(cost, first)
            # The first of equally good starts.
            place = np.minimum.reduceat(np.where(cost == np.repeat(lowest, sizes), start, n), first)
            best[end], cuts[end] = lowest, place
            left = np.stack([low, end - 1, least, place], 1)[low <= end - 1]
            right = np.stack([end + 1, high, place, most], 1)[end + 1 <= high]
            ranges = np.concatenate([left, right])
        return best, cuts

    def errors(self) -> list[float]:
        """The squared error of 1, 2, … clusters."""
        return [float(b[-1]) if len(self.points) else 0.0 for b in self._best]

    def centers(self, k: int) -> list[float]:
        """Means of the best ``k`` clusters in ascending order; fewer where there are fewer values."""
        end, found = len(self.points), []
        for used in range(min(k, end, len(self._best)), 0, -1):
            start = int(self._cuts[used - 1][end])
            mean = (self._s[end] - self._s[start]) / (self._n[end] - self._n[start])
            found.append(float(mean + np.longdouble(self.points.middle)))
            end = start
        return found[::-1]


def best_partition(df: DataFrame, col: str, ks: Sequence[int], most: int | None = None) -> Partition:
    """The best partitions of a column into each number ``ks`` of clusters.

    Bins in which a best cut may lie are split, others are not read again.
    """
    values, most = _Values.of(df, col), most or MOST_POINTS
    points, shift = values.points(most)
    while True:
        partition = Partition(points, max(ks))
        points = partition.narrowed(ks)
        wide = points.values > 1
        if not wide.any():
            return partition
        split, shift = values.points(most - int((~wide).sum()), shift, points[wide])
        points = points[~wide].with_points(split)


def best_centers(df: DataFrame, col: str, k: int) -> list[float]:
    """Centres of the best ``k`` clusters of a column, in ascending order."""
    return best_partition(df, col, [k]).centers(k)


def best_errors(df: DataFrame, col: str, k: int) -> list[float]:
    """Squared errors of the best 1, 2, … ``k`` clusters of a column, all from one table."""
    errors = best_partition(df, col, range(1, k + 1)).errors()
    return errors + [0.0] * (k - len(errors))
