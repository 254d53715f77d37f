"""Models: training, scoring and what they say about the features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.boosting import BoostedTrees, boost
from tidemark.operators.regression import fit_logistic

# Tree depth and learning rates of the value, churn and response models.
TREE_DEPTH = 5
VALUE_STEP = 0.1
CHURN_STEP = 0.08
RESPONSE_DEPTH = 6
RESPONSE_STEP = 0.3
SIGNIFICANCE = 0.05
Z_95 = 1.959963984540054


def train_multiclass(
    train: DataFrame,
    label: str,
    features: Sequence[str],
    rounds: int = 100,
    depth: int = TREE_DEPTH,
    step: float = VALUE_STEP,
) -> BoostedTrees:
    """Boosted trees with softmax loss for a label 0, 1, …, with class probabilities."""
    return boost(train, label, features, rounds=rounds, depth=depth, step=step)


def train_binary(
    train: DataFrame,
    label: str,
    features: Sequence[str],
    rounds: int = 100,
    depth: int = TREE_DEPTH,
    step: float = CHURN_STEP,
) -> BoostedTrees:
    """Boosted trees with logistic loss for a 0/1 label."""
    return boost(train, label, features, 2, rounds, depth, step)


def score_classes(df: DataFrame, model: BoostedTrees, names: Sequence[str]) -> DataFrame:
    """Adds ``prediction`` and one probability column per class, in class order, to every row.

    A class above those of the training rows has probability 0; the first of equally likely
    classes is predicted.
    """
    scored = df.withColumn("_p", model.probabilities())
    likeliest = (F.array_position("_p", F.array_max("_p")) - 1).cast("double").alias("prediction")
    probabilities = [F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0)).alias(n) for i, n in enumerate(names)]
    return scored.select(*[F.col(f"`{c}`") for c in df.columns], likeliest, *probabilities)


def score(df: DataFrame, model: BoostedTrees, output: str = "proba") -> DataFrame:
    """Adds ``prediction`` and the probability of class 1 to every row, training rows included."""
    return score_classes(df, model, ["_p0", output]).drop("_p0")


def feature_importance(df: DataFrame, model: BoostedTrees) -> DataFrame:
    """Features ranked by how many splits of the trees use them; ``gain`` is their share of the gain of all splits."""
    used = model.used()
    total = sum(gain for _, gain in used.values()) or 1.0
    rows = [(name, splits, gain / total) for name, (splits, gain) in used.items()]
    ranked = df.sparkSession.createDataFrame(rows, "feature string, splits long, gain double")
    return ranked.orderBy(F.desc("splits"), F.desc("gain"), "feature")


def logistic_summary(df: DataFrame, label: str, features: Sequence[str], alpha: float = SIGNIFICANCE) -> DataFrame:
    """Binomial regression with intercept: coefficient, standard error, z, p and 95 % interval.

    Every level of every category may be a column: of the solutions that fit equally well the
    shortest is taken.  Rows with a null are left out.
    """
    fit = fit_logistic(df, label, features)
    rows = []
    for i, name in enumerate([*features, "Intercept"]):
        c, e = float(fit.coefficients[i]), math.sqrt(max(float(fit.covariance[i, i]), 0.0))
        z = c / e if e else 0.0
        p = math.erfc(abs(z) / math.sqrt(2)) if e else 1.0
        rows.append((name, c, e, z, p, c - Z_95 * e, c + Z_95 * e, p < alpha))
    return df.sparkSession.createDataFrame(
        rows, "feature string, coefficient double, std_error double, z double, p_value double, ci_low double, ci_high double, significant boolean"
    )


def odds_ratios(summary: DataFrame) -> DataFrame:
    """How the odds change when a feature grows by one."""
    return summary.select("feature", F.exp("coefficient").alias("odds_ratio"))
