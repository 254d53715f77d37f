from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = QUERIES["op3_quality_classifier"](spark, sf_dir).join(labels, "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert found.count() > 20 and right > 0.9
    least = found.groupBy("quality").agg(F.avg("score").alias("s")).collect()
    assert {r.quality: r.s > 0.5 for r in least} == {0: False, 1: True}


def test_held_out_third():
    import zlib

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    ids = spark.range(-50, 200).select("id", quality.held_out(F.col("id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in ids)


def test_rules_are_plain_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stats = quality.statistics(docs)
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("label"))
    fits = [quality.fit(stats.join(known, "_id").repartition(n)) for n in (1, 7)]
    assert fits[0] == fits[1], "the fit depends on the partitions"
    model = fits[0]
    assert 0 < len(model.weights) < 200
    assert "Python" not in stats.select(model.score())._jdf.queryExecution().toString()
    rows = stats.select(*quality.STATISTICS, model.score().alias("score")).limit(50).collect()
    for r in rows:
        total = model.bias
        for rule, weight in model.weights:
            total += weight * all(low < r[name] <= high for name, low, high in rule.bounds)
        assert abs(r.score - 1 / (1 + 2.718281828459045 ** -total)) < 1e-9


def test_bounded_sample(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.scored(docs, labels, max_rows=60)
    assert found.count() == docs.count() and found.where("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_odd_rows(spark, odd, no_rows):
    schema = "doc_id long, quality int"
    few = spark.createDataFrame([(7, 1), (8, 1), (2, 0), (2, 0), (3, None), (99, 0), (None, 1)], schema)
    for labels in (few, few.where("quality = 1"), few.limit(0)):
        found = quality.scored(odd, labels)
        assert found.count() == odd.count() and found.where("NOT (score BETWEEN 0 AND 1)").count() == 0
        assert found.groupBy("_row", "_id").agg(F.count_distinct("score").alias("n")).where("n > 1").count() == 0
    assert quality.scored(odd, few.limit(0)).where("score <> 0.5").count() == 0
    assert quality.scored(no_rows, few).collect() == []
