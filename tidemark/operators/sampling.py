"""Exact-size random splits that do not sort the table.

Rows are ordered by a digest of their id.  Counting rows per leading digits of the digest
(at most 65,536 counts) shows in which slice the cut falls; only that slice, about one row
in 65,536, is ranked.  The same id and seed always land on the same side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import over_groups
from tidemark.functions.hashing import digest
from tidemark.functions.joins import join_per_key
from tidemark.session import materialize

PREFIX_DIGITS = 4


def exact_share(
    df: DataFrame,
    id_col: str,
    share: float,
    seed: int,
    by: Sequence[str] = (),
    rounding: str = "ceil",
    flag: str = "is_selected",
) -> DataFrame:
    """Adds a boolean flag that is true for exactly ``share`` of the rows (of each group).

    ``id_col`` must be unique.  ``rounding`` says how a fractional row count is made whole:
    ``ceil`` or ``round`` (half to even).  Rows whose group key is null are never selected.
    """
    if rounding not in ("ceil", "round"):
        raise ValueError("rounding must be 'ceil' or 'round'")
    by = list(by)
    key = F.struct(digest(id_col, seed).alias("h"), F.col(id_col).alias("id"))
    keyed = (df.dropna(subset=by) if by else df).select(*by, key.alias("_key"))
    keyed = keyed.withColumn("_slice", F.substring("_key.h", 1, PREFIX_DIGITS))

    slices = keyed.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    up_to_here = F.sum("_n").over(over_groups(by, ["_slice"]))
    slices = slices.withColumns(
        {"_before": up_to_here - F.col("_n"), "_total": F.sum("_n").over(over_groups(by))}
    )
    exact = F.lit(float(share)) * F.col("_total")
    quota = (F.ceil(exact) if rounding == "ceil" else F.rint(exact)).cast("bigint")
    cut_slice = slices.withColumn("_need", quota - F.col("_before")).where(
        (F.col("_need") > 0) & (F.col("_need") <= F.col("_n"))
    )

    # Without groups there is one cut; it travels as a scalar, so ids are not shuffled for it.
    if by:
        in_cut = keyed.join(cut_slice.select(*by, "_slice", "_need"), [*by, "_slice"])
    else:
        cut = F.col("_cut")
        in_cut = keyed.withColumn("_cut", cut_slice.select(F.struct("_slice", "_need")).scalar())
        in_cut = in_cut.where(F.col("_slice") == cut["_slice"]).withColumn("_need", cut["_need"]).drop("_cut")
    rank = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_key"))
    last = (
        in_cut.withColumn("_rank", rank)
        .where(F.col("_rank") == F.col("_need"))
        .select(*by, F.col("_key").alias("_last"))
    )
    # No such row means a quota of zero.
    if by:
        sizes = slices.groupBy(*by).agg(F.max("_total").alias("_total"))
        cuts = materialize(sizes.join(last, by, "left"), "cuts")
        # Rows without a group have no cut but stay.
        known = join_per_key(df.dropna(subset=by), cuts, by, "_total")
        unknown = df.where(~reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by]))
        marked = known.unionByName(unknown.withColumn("_last", F.lit(None).cast(cuts.schema["_last"].dataType)))
    else:
        marked = df.withColumn("_last", last.scalar())
    chosen = F.coalesce(key <= F.col("_last"), F.lit(False))
    return marked.select(*df.columns, chosen.alias(flag))


def train_test_split(df: DataFrame, id_col: str, test_share: float, seed: int) -> DataFrame:
    """Adds ``is_train``; the test side has exactly ``ceil(test_share * rows)`` rows."""
    split = exact_share(df, id_col, test_share, seed, flag="_is_test")
    return split.withColumn("is_train", ~F.col("_is_test")).drop("_is_test")


def _arms(split: DataFrame) -> DataFrame:
    arm = F.when(F.col("_in_test"), "test").otherwise("control")
    return split.withColumn("arm", arm).drop("_in_test")


def random_split(df: DataFrame, id_col: str, share: float = 0.9, seed: int = 0) -> DataFrame:
    """Test and control arms; the test arm has exactly ``round(share * rows)`` rows."""
    return _arms(exact_share(df, id_col, share, seed, rounding="round", flag="_in_test"))


def stratified_split(
    df: DataFrame, id_col: str, by: Sequence[str] = ("segment",), share: float = 0.9, seed: int = 0
) -> DataFrame:
    """:func:`random_split` inside each segment; rows without a segment go to control."""
    return _arms(exact_share(df, id_col, share, seed, by, "round", "_in_test"))


def balance_check(split: DataFrame, by: Sequence[str] = ("arm", "segment")) -> DataFrame:
    """Rows per arm and segment."""
    return split.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))
