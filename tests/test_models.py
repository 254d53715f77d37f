import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_unit
from tidemark.operators import campaign, evaluation, models, sampling


@pytest.fixture(scope="module")
def planted(spark):
    """The label follows ``signal``; ``noise`` says nothing."""
    base = spark.range(600).select(
        "id", hash_unit("id", "signal").alias("signal"), hash_unit("id", "noise").alias("noise"), hash_unit("id", "flip").alias("u")
    )
    yes = F.when(F.col("u") < 0.9, F.col("signal") > 0.6).otherwise(F.col("signal") <= 0.6)
    three = F.when(F.col("signal") > 0.8, 2).when(F.col("signal") > 0.6, 1).otherwise(0)
    frame = base.withColumn("y", yes.cast("int")).withColumn("three", three)
    return sampling.train_test_split(frame, "id", 0.2, 1).cache()


def majority(df, label):
    return df.groupBy(label).count().agg(F.max("count") / F.sum("count")).first()[0]


def test_boosted_trees_beat_the_majority(planted):
    model = models.train_binary(planted.where("is_train"), "y", ["signal", "noise"], rounds=5, step=0.3)
    test = models.score(planted.where("not is_train"), model)
    assert evaluation.accuracy(test, "y").first()["accuracy"] > majority(planted, "y") + 0.1
    assert test.where("proba < 0 or proba > 1").count() == 0
    ranked = models.feature_importance(planted, model).collect()
    # Ranked by splits, of which noise gets many; the gain tells the signal.
    assert [r.splits for r in ranked] == sorted((r.splits for r in ranked), reverse=True)
    assert max(ranked, key=lambda r: r.gain).feature == "signal"
    assert sum(r.splits for r in ranked) == sum(int((t.feature >= 0).sum()) for trees in model.rounds for t in trees)
    assert models.score(planted, model).count() == planted.count()


def test_class_probabilities_add_up(planted):
    model = models.train_multiclass(planted.where("is_train"), "three", ["signal", "noise"], rounds=10)
    names = ["a", "b", "c"]
    scored = models.score_classes(planted, model, names)
    assert scored.where(F.abs(F.col("a") + F.col("b") + F.col("c") - 1) > 1e-9).count() == 0
    assert evaluation.accuracy(scored.where("not is_train"), "three").first()["accuracy"] > 0.9
    again = models.train_multiclass(planted.where("is_train"), "three", ["signal", "noise"], rounds=10)
    same = scored.join(models.score_classes(planted, again, names).select("id", F.col("a").alias("a2")), "id")
    assert same.where(F.abs(F.col("a") - F.col("a2")) > 1e-9).count() == 0


def test_logistic_summary_finds_the_signal(planted):
    summary = models.logistic_summary(planted, "y", ["signal", "noise"]).collect()
    by_name = {r.feature: r for r in summary}
    assert set(by_name) == {"signal", "noise", "Intercept"}
    assert by_name["signal"].significant and by_name["signal"].coefficient > 0
    for r in summary:
        assert r.ci_low < r.coefficient < r.ci_high
        assert r.z == pytest.approx(r.coefficient / r.std_error)
        assert r.significant == (r.p_value < 0.05)
    ratios = {r.feature: r.odds_ratio for r in models.odds_ratios(planted.sparkSession.createDataFrame(summary)).collect()}
    assert ratios["signal"] > 1


def test_uplift_is_found_where_it_was_planted(spark):
    """Only segment ``a`` reacts to the offer."""
    frame = spark.range(3000).select(
        F.col("id").alias("customer_id"),
        F.when(hash_unit("id", "seg") < 0.5, 1).otherwise(0).alias("in_a"),
        F.when(hash_unit("id", "offer") < 0.5, "No Offer").otherwise("Discount").alias("offer"),
        hash_unit("id", "conv").alias("u"),
    )
    chance = F.when((F.col("in_a") == 1) & (F.col("offer") == "Discount"), 0.9).otherwise(0.1)
    frame = frame.withColumn("conversion", (F.col("u") < chance).cast("int"))
    labelled = campaign.target_class(campaign.campaign_group(frame))
    model = models.train_multiclass(labelled, "target_class", ["in_a"], rounds=20)
    scored = campaign.uplift_score(models.score_classes(labelled, model, campaign.CLASS_PROBABILITIES))
    by_segment = {r.in_a: r.s for r in scored.groupBy("in_a").agg(F.avg("uplift_score").alias("s")).collect()}
    assert by_segment[1] > by_segment[0] + 0.5
    attached = campaign.attach_scores(frame, scored, "customer_id")
    assert attached.count() == 3000 and attached.where("uplift_score is null").count() == 0
