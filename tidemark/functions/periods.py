"""Calendar periods as readable codes and as gap-free integers.

The *code* is what reports show (``201104``).  The *index* counts periods without
gaps, so "the month before" is always ``index - 1``, also across a year end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("year", "quarter", "month", "day")


def _check(grain: str) -> None:
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, got {grain!r}")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def period_code(ts: Column | str, grain: str = "month") -> Column:
    _check(grain)
    ts = _col(ts)
    year = F.year(ts)
    if grain == "year":
        return year
    if grain == "quarter":
        return year * 10 + F.quarter(ts)
    if grain == "month":
        return year * 100 + F.month(ts)
    return year * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)


def code_to_index(code: Column | str, grain: str = "month") -> Column:
    """The gap-free index of a period code."""
    _check(grain)
    code = _col(code)
    if grain == "year":
        return code
    if grain == "quarter":
        return F.floor(code / 10).cast("int") * 4 + code % 10 - 1
    if grain == "month":
        return F.floor(code / 100).cast("int") * 12 + code % 100 - 1
    return F.unix_date(F.to_date(code.cast("string"), "yyyyMMdd"))


def index_to_code(index: Column | str, grain: str = "month") -> Column:
    """Inverse of :func:`code_to_index`."""
    _check(grain)
    index = _col(index)
    if grain == "year":
        return index.cast("int")
    if grain == "quarter":
        return (F.floor(index / 4) * 10 + index % 4 + 1).cast("int")
    if grain == "month":
        return (F.floor(index / 12) * 100 + index % 12 + 1).cast("int")
    return period_code(F.date_from_unix_date(index.cast("int")), "day")
