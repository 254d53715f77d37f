"""How good a classifier is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import over_groups


def accuracy(scored: DataFrame, label: str, prediction: str = "prediction", by: str | None = None) -> DataFrame:
    """Share of rows whose prediction equals the label, for instance by train/test side."""
    equal = (F.col(label).cast("double") == F.col(prediction).cast("double")).cast("double")
    return scored.groupBy(*([by] if by else [])).agg(F.avg(equal).alias("accuracy"), F.count(label).alias("rows"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per class, in class order: the baseline a classifier has to beat."""
    counts = df.dropna(subset=[label]).groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(over_groups([]))).orderBy(label)


def confusion_counts(scored: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    return scored.groupBy(
        F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def classification_report(scored: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages.

    One pass counts the (label, prediction) pairs; the rest is arithmetic on those few rows.
    A ratio without a denominator is 0.
    """
    pairs = confusion_counts(scored, label, prediction)
    right = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    # Each pair contributes to its true class and to its predicted class.
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )
    counts = (
        pairs.select(F.posexplode(sides).alias("side", "s"), right.alias("right"))
        .groupBy("s.class")
        .agg(
            F.sum("s.support").alias("support"),
            F.sum("s.predicted").alias("predicted"),
            F.sum(F.when(F.col("side") == 0, F.col("right"))).alias("right"),
        )
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    right_, support, predicted = (F.col(c).cast("double") for c in ("right", "support", "predicted"))
    per_class = counts.withColumns(
        {
            "precision": ratio(right_, predicted),
            "recall": ratio(right_, support),
            "f1": ratio(2 * right_, predicted + support),
        }
    )
    total = F.sum("support")
    weighted = {c: F.sum(F.col(c) * F.col("support")) / total for c in ("precision", "recall", "f1")}
    summary = per_class.agg(
        total.alias("support"),
        (F.sum("right") / total).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in weighted],
        *[v.alias(f"weighted_{c}") for c, v in weighted.items()],
    )
    nothing = F.lit(None).cast("double")
    extra = F.array(
        F.struct(
            F.lit("accuracy").alias("class"), nothing.alias("precision"), nothing.alias("recall"),
            F.col("accuracy").alias("f1"),
        ),
        *[
            F.struct(
                F.lit(f"{kind} avg").alias("class"),
                *[F.col(f"{kind}_{c}").alias(c) for c in ("precision", "recall", "f1")],
            )
            for kind in ("macro", "weighted")
        ],
    )
    summary_rows = summary.select(F.explode(extra).alias("s"), "support").select("s.*", "support")
    classes = per_class.select(F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support")
    return classes.unionByName(summary_rows)
