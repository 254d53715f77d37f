"""The sample is drawn in all tasks; only what was drawn reaches a single one."""

from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.frames import ID, ROW
from tidemark.session import materialize


def test_join_and_filter_stay_parallel(spark, monkeypatch):
    plans = {}

    def stored(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return materialize(df, name)

    monkeypatch.setattr(quality, "materialize", stored)
    place = F.col("id")
    numbers = [((place * (i + 3)) % 17).cast("double").alias(c) for i, c in enumerate(quality.STATISTICS)]
    labelled = spark.range(400).select(
        place.alias(ID), F.xxhash64(place).alias(ROW), (place % 17 > 8).cast("int").alias("label"), *numbers
    )
    quality.fit(labelled, trees=2)
    assert "Coalesce" not in plans["sample"] and "Exchange" in plans["sample"]
