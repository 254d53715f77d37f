"""Repeatable pseudo-random numbers taken from a row's id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(id_col: Column | str, salt: str | int) -> Column:
    """md5 of ``id|salt`` in hex: the same on every run, retry and partitioning."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(col.cast("string"), F.lit(f"|{salt}")))


def hash_bucket(id_col: Column | str, salt: str | int, buckets: int) -> Column:
    """An integer in ``0 .. buckets-1`` from the first eight hex digits."""
    head = F.conv(F.substring(digest(id_col, salt), 1, 8), 16, 10).cast("bigint")
    return (head % buckets).cast("int")


def hash_unit(id_col: Column | str, salt: str | int) -> Column:
    """A number in ``[0, 1)`` with six decimals."""
    return hash_bucket(id_col, salt, 1_000_000).cast("double") / F.lit(1_000_000.0)
