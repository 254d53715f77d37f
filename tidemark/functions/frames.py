"""Small helpers on whole frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def with_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row.

    The aggregate becomes a scalar subquery: Spark runs it once and inlines the
    values, so neither a join nor a trip through the driver program is needed.
    """
    names = one_row.columns
    packed = df.withColumn("_one_row", one_row.select(F.struct(*names)).scalar())
    return packed.select(*df.columns, *[F.col(f"_one_row.`{n}`").alias(n) for n in names])


def over_groups(keys: Sequence[str], order: Sequence[Column | str] = ()) -> WindowSpec:
    """A window for *aggregated* rows; without keys all of them form one window.

    Only for frames whose row count is bounded by the number of periods, classes or
    offers, never for customers or transaction lines.
    """
    spec = Window.partitionBy(*(keys or [F.lit(1)]))
    return spec.orderBy(*order) if order else spec


def growth(value: str, order: str, keys: Sequence[str] = ()) -> Column:
    """Relative change against the previous *present* row; null for the first."""
    previous = F.lag(value).over(over_groups(keys, [order]))
    return F.try_divide(F.col(value).cast("double"), previous.cast("double")) - F.lit(1.0)


def round_half_even(col: Column, digits: int) -> Column:
    """Rounds the scaled double half to even, as array libraries do (``bround`` rounds its text form)."""
    scale = F.lit(float(10**digits))
    return F.rint(col * scale) / scale
