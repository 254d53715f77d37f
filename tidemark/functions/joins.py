"""Joining many rows to one row per key when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARE of all rows, so there are fewer than
# HOT_SHARE hot keys, whatever the size of the data.  It is spread over as many places as it
# holds such shares: no place gets much more than 1/HOT_SHARE of all rows.
HOT_SHARE = 1000


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """Inner join of ``rows`` to ``per_key``, which has one row per key and its row count.

    The rows of a hot key are spread by their content and input partition, which a repeated
    task finds again, and its one row is copied to each place.  ``per_key`` is read three
    times: pass a stored frame.
    """
    keys = list(keys)
    total = per_key.agg(F.sum(count)).scalar()
    places = F.ceil(F.col(count) * HOT_SHARE / total).cast("int")
    hot = per_key.where(F.col(count) * HOT_SHARE > total).select(*keys, places.alias("_places"))
    hot = F.broadcast(hot)
    content = F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in rows.columns])
    place = F.when(F.col("_places").isNotNull(), F.pmod(content, F.col("_places")).cast("int")).otherwise(0)
    every = F.when(F.col("_places").isNotNull(), F.sequence(F.lit(0), F.col("_places") - 1)).otherwise(F.array(F.lit(0)))
    spread = rows.join(hot, keys, "left").withColumn("_place", place)
    copies = per_key.drop(count).join(hot, keys, "left").withColumn("_place", F.explode(every))
    return spread.drop("_places").join(copies.drop("_places"), [*keys, "_place"]).drop("_place")
