"""Order-independent sums of money.

A sum of doubles depends on the order in which partitions arrive, so two runs of
the same query can differ in the last digits.  Amounts are therefore summed exactly, in
ten-thousandths unless the caller says otherwise, and turned into doubles once, at the end.
"""

from __future__ import annotations

import decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Four digits hold a three-digit unit price times a whole quantity without loss.
DIGITS = 4

# A sum of decimals costs an object per row.  Whole numbers do not, and summing the upper
# and the lower part apart leaves room for 10^12 rows before a long is full.
LOW_BITS = 20


def exact_sum(col: Column | str, digits: int = DIGITS) -> Column:
    """Sum as a decimal, for totals that are added up again.

    Each amount is first rounded to ``digits`` decimals: choose as many as the amounts have.
    """
    amount = F.col(col) if isinstance(col, str) else col
    units = F.rint(amount * F.lit(float(10**digits)))
    # Split before the number becomes whole, so that large amounts fit.
    upper = F.floor(units / F.lit(float(1 << LOW_BITS)))
    lower = (units - upper * F.lit(float(1 << LOW_BITS))).cast("bigint")
    high = F.sum(upper).cast("decimal(20,0)")
    low = F.sum(lower).cast("decimal(20,0)")
    whole = (high * F.lit(1 << LOW_BITS) + low).cast("decimal(38,0)")
    return (whole * F.lit(decimal.Decimal(1).scaleb(-digits))).cast(T.DecimalType(28, digits))


def money_sum(col: Column | str, digits: int = DIGITS) -> Column:
    return exact_sum(col, digits).cast("double")


def money_avg(col: Column | str) -> Column:
    """Mean of the non-null amounts; null when there are none."""
    return F.try_divide(money_sum(col), F.count(col).cast("double"))
