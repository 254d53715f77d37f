from pyspark.sql import functions as F

from tidemark.functions import joins
from tidemark.functions.joins import join_per_key


def skewed(spark):
    """A third of the rows belongs to key 0, the rest to 3000 keys."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 3000 + 1)
    return spark.range(30_000).select("id", key.alias("k")).repartition(16)


def test_hot_keys_are_spread_and_nothing_is_lost(spark):
    rows = skewed(spark)
    per_key = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), (F.max("k") * 2).alias("twice")).cache()
    joined = join_per_key(rows, per_key, ["k"], "n")
    assert joined.columns == ["k", "id", "twice"]
    assert joined.count() == 30_000
    assert joined.where(F.col("twice") != F.col("k") * 2).count() == 0
    assert joined.select("id").distinct().count() == 30_000


def test_hot_rows_land_in_many_tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = skewed(spark)
        per_key = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("m")).cache()
        tasks = join_per_key(rows, per_key, ["k"], "n").where("k = 0").groupBy(F.spark_partition_id()).count()
        largest = tasks.agg(F.max("count")).first()[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert largest < 10_000


def test_number_of_hot_keys_is_bounded(spark):
    even = spark.range(10 * joins.HOT_SHARE).select((F.col("id") % joins.HOT_SHARE).alias("k"))
    counts = even.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    assert counts.where(F.col("n") * joins.HOT_SHARE > total).count() == 0
