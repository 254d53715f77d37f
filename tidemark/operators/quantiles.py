"""Exact quantiles without sorting a whole column in one place.

Spark's ``percentile`` keeps every distinct value of a group in one task, and
``percentile_approx`` returns an approximate data point.  Here a sketch only *brackets*
each wanted rank between two values; counting says exactly how many rows lie below the
bracket, and only the narrow band of values inside it is ordered.  The brackets, of all groups at
once, are narrowed again until they hold few values, so no task orders more than
``MOST_ORDERED`` values however long the column or a group is.  The sketch decides how much is ordered,
never the answer.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import over_groups, with_one_row
from tidemark.functions.joins import join_per_key
from tidemark.session import materialize

QUARTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75}

# A bracket spans 0.2 % of the rows; the sketch is ten times as precise as that.
HALF_WIDTH = 0.001
ACCURACY = 10_000
MOST_ORDERED = 1_000_000
# Parts that a band of a group is cut into at each step.
PARTS = 64


def exact_quantiles(
    df: DataFrame, col: str, probs: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated quantiles of ``col``, one row per group (one row without ``by``).

    ``probs`` maps output names to probabilities.  Null values and null groups do not count.
    ``df`` is read several times, all but the last at once: pass a stored frame rather than
    a long computation.
    """
    by = list(by)
    values = df.dropna(subset=[col, *by]).select(*by, F.col(col).cast("double").alias("_v"))
    if not by:
        return _ungrouped(values, probs)
    edges = sorted({min(1.0, max(0.0, p + s)) for p in probs.values() for s in (-HALF_WIDTH, HALF_WIDTH)})
    sketch = F.percentile_approx("_v", edges, ACCURACY).alias("_edges")
    # Two runs of a sketch may differ, and both steps below must see the same brackets:
    # they are computed once and kept.
    brackets = materialize(values.groupBy(*by).agg(sketch, F.count(F.lit(1)).alias("_rows")), "brackets")
    values = join_per_key(values, brackets, by, "_rows")
    # Which side of each edge a value lies on; equal values always share a band.
    band = reduce(
        lambda a, b: a + b,
        [(F.col("_edges")[i] < F.col("_v")).cast("int") for i in range(len(edges))],
    )
    banded = values.select(*by, "_v", band.alias("_band"))

    sizes = banded.groupBy(*by, "_band").agg(F.count(F.lit(1)).alias("_n"))
    up_to_here = F.sum("_n").over(over_groups(by, ["_band"]))
    sizes = sizes.withColumns(
        {"_before": up_to_here - F.col("_n"), "_total": F.sum("_n").over(over_groups(by))}
    )

    wanted_bands = sizes.where(_holds_a_rank(probs)).drop("_n")

    counted = (
        banded.join(wanted_bands, [*by, "_band"])
        .groupBy(*by, "_band", "_before", "_total", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    counted = _narrowed(materialize(counted, "bands"), by, probs)
    in_band = Window.partitionBy(*by, "_band").orderBy("_v")
    stop = F.col("_before") + F.sum("_c").over(in_band)
    ranked = counted.withColumn("_stop", stop).withColumn("_start", F.col("_stop") - F.col("_c"))

    def value_at(rank):
        return F.max(F.when((F.col("_start") <= rank) & (F.col("_stop") > rank), F.col("_v")))

    picked = []
    for i, p in enumerate(probs.values()):
        picked += [
            value_at(F.floor(_position(p))).alias(f"_lo{i}"),
            value_at(F.ceil(_position(p))).alias(f"_hi{i}"),
        ]
    result = ranked.groupBy(*by).agg(F.max("_total").alias("_total"), *picked)
    return result.select(
        *by,
        *[
            (
                F.col(f"_lo{i}")
                + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (_position(p) - F.floor(_position(p)))
            ).alias(name)
            for i, (name, p) in enumerate(probs.items())
        ],
    )


def _position(p: float) -> Column:
    """The place of a quantile among the ``_total`` values of its group."""
    return (F.col("_total") - 1) * F.lit(float(p))


def _holds_a_rank(probs: Mapping[str, float]) -> Column:
    """Whether one of the wanted places lies among the ``_n`` rows behind ``_before`` others."""
    start, stop = F.col("_before"), F.col("_before") + F.col("_n")
    places = [(F.floor(_position(p)), F.ceil(_position(p))) for p in probs.values()]
    return reduce(lambda a, b: a | b, [(start <= high) & (stop > low) for low, high in places])


def _narrowed(counted: DataFrame, by: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Distinct values ``_v`` with their rows ``_c`` by group and band, until no band has more than ``MOST_ORDERED``.

    Each step cuts every band into ``PARTS`` parts, counts them, and keeps the parts that hold a
    wanted place; all groups in the same few passes.
    """
    keys = [*by, "_band"]
    shares = [i / PARTS for i in range(1, PARTS)]
    before = None
    while True:
        most = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= MOST_ORDERED or most == before:
            return counted
        before = most
        cuts = counted.groupBy(*keys).agg(F.percentile_approx("_v", shares, ACCURACY).alias("_edges"), F.count(F.lit(1)).alias("_rows"))
        wide = join_per_key(counted, materialize(cuts, "cuts"), keys, "_rows")
        part = F.aggregate("_edges", F.lit(0), lambda n, edge: n + (edge < F.col("_v")).cast("int"))
        parts = wide.select(*keys, "_before", "_total", "_v", "_c", part.alias("_part"))
        sizes = parts.groupBy(*keys, "_before", "_total", "_part").agg(F.sum("_c").alias("_n"))
        up_to_here = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")
        sizes = sizes.withColumn("_before", F.col("_before") + up_to_here).where(_holds_a_rank(probs)).drop("_n", "_total")
        kept = parts.drop("_before").join(sizes, [*keys, "_part"])
        finer = (F.col("_band") * PARTS + F.col("_part")).cast("bigint").alias("_band")
        counted = materialize(kept.select(*by, finer, "_before", "_total", "_v", "_c"), "bands")


def _within(value: Column, low: float | None, high: float | None) -> Column:
    """``low < value <= high``, where None is an open end."""
    above = F.lit(True) if low is None else value > F.lit(low)
    return above if high is None else above & (value <= F.lit(high))


def _ungrouped(values: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """Quantiles of the whole column ``_v``: one row, nulls where there are no values."""
    value, total = F.col("_v"), values.count()
    spots = {name: (total - 1) * float(p) for name, p in probs.items()} if total else {}
    ranks = sorted({edge for s in spots.values() for edge in (math.floor(s), math.ceil(s))})
    # Bands of values with the rows below them and inside them; each holds a wanted rank.
    bands: list[tuple[float | None, float | None, int, int]] = [(None, None, 0, total)] if total else []
    narrowing = True
    while narrowing and sum(band[3] for band in bands) > MOST_ORDERED:
        # Where the ranks are within each band, as shares of its rows.
        sketches = []
        for low, high, before, rows in bands:
            own = [(r - before) / rows for r in ranks if before <= r < before + rows]
            shares = sorted({min(1.0, max(0.0, p + s)) for p in own for s in (-HALF_WIDTH, HALF_WIDTH)})
            sketches.append(F.percentile_approx(F.when(_within(value, low, high), value), shares, ACCURACY))
        cuts = values.agg(*[s.alias(f"c{i}") for i, s in enumerate(sketches)]).first()
        parts = []
        for (low, high, _, _), edges in zip(bands, cuts):
            inner = [e for e in sorted(set(edges or [])) if (low is None or e > low) and (high is None or e < high)]
            ends = [low, *inner, high]
            parts.append(list(zip(ends, ends[1:])))
        sizes = values.agg(
            *[F.count_if(_within(value, *part)).alias(f"n{i}_{j}") for i, own in enumerate(parts) for j, part in enumerate(own)]
        ).first()
        finer, at = [], 0
        for (_, _, before, _), own in zip(bands, parts):
            for low, high in own:
                if any(before <= r < before + sizes[at] for r in ranks):
                    finer.append((low, high, before, sizes[at]))
                before, at = before + sizes[at], at + 1
        # A band that no sketch can cut has one value only, or next to it.
        narrowing = sum(band[3] for band in finer) < sum(band[3] for band in bands)
        bands = finer

    chosen = F.lit(None).cast("bigint")
    for i, (low, high, _, _) in enumerate(bands):
        chosen = F.when(_within(value, low, high), F.lit(i).cast("bigint")).otherwise(chosen)
    # Equal values collapse before they are ordered.
    counted = values.select("_v", chosen.alias("_band")).where("_band IS NOT NULL").groupBy("_band", "_v").agg(F.count("*").alias("_c"))
    before = F.element_at(F.array(*[F.lit(band[2]) for band in bands] or [F.lit(0)]), F.col("_band").cast("int") + 1)
    stop = before + F.sum("_c").over(Window.partitionBy("_band").orderBy("_v"))
    ranked = counted.withColumn("_stop", stop).withColumn("_start", F.col("_stop") - F.col("_c"))

    def value_at(rank: int) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (F.col("_stop") > rank), value))

    if not spots:
        return ranked.agg(*[F.max("_v").alias(name) for name in probs])
    return ranked.agg(
        *[
            (value_at(math.floor(s)) + (value_at(math.ceil(s)) - value_at(math.floor(s))) * F.lit(s - math.floor(s))).alias(name)
            for name, s in spots.items()
        ]
    )


def describe(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std (n-1), min, quartiles and max of a column, per group when ``by`` is given."""
    by = list(by)
    value = F.col(col).cast("double")
    basics = df.dropna(subset=by) if by else df
    basics = basics.groupBy(*by).agg(
        F.count(col).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quartiles = exact_quantiles(df, col, QUARTILES, by)
    joined = basics.join(quartiles, by, "left") if by else with_one_row(basics, quartiles)
    return joined.select(*by, "count", "mean", "std", "min", *QUARTILES, "max")


def trim_upper(df: DataFrame, col: str, q: float = 0.99) -> DataFrame:
    """Rows strictly below the exact quantile."""
    return df.where(F.col(col) < exact_quantiles(df, col, {"cut": q}).scalar())
