"""Encoding, parsing and scaling of model features."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.frames import with_one_row
from tidemark.session import materialize

# Characters of a column name that become an underscore.
UNWANTED_IN_NAMES = r"[ ()\-]"

SCALE_LOW, SCALE_HIGH = -1.0, 1.0


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    kinds = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in exclude]


def fit_categories(
    df: DataFrame, cols: Sequence[str] | None = None, max_categories: int = 1000
) -> dict[str, list[str]]:
    """The sorted categories of each column, learned in one scan.

    Each category becomes a column of the table, so an id-like column is refused, not cut
    off; :func:`encode_sparse` takes any number of categories.
    """
    cols = list(cols) if cols is not None else string_columns(df)
    if not cols:
        return {}
    found = (
        df.select(*cols)
        .unpivot([], cols, "feature", "category")
        .where(F.col("category").isNotNull())
        .distinct()
    )
    found = materialize(found, "categories")
    wide = [r["feature"] for r in found.groupBy("feature").count().where(F.col("count") > max_categories).collect()]
    if wide:
        raise ValueError(f"more than {max_categories} categories in {sorted(wide)}: use encode_sparse for them")
    categories: dict[str, list[str]] = {c: [] for c in cols}
    for row in found.collect():
        categories[row["feature"]].append(row["category"])
    return {c: sorted(values) for c, values in categories.items()}


def encode_sparse(df: DataFrame, cols: Sequence[str], model: PipelineModel | None = None) -> tuple[DataFrame, PipelineModel]:
    """One sparse 0/1 vector ``col_vector`` per column, whatever its number of categories.

    Categories go in alphabetical order; a null or a category unknown at fit time is all
    zeros.  Give the returned model back to encode other rows alike.
    """
    cols = list(cols)
    if model is None:
        index = StringIndexer(
            inputCols=cols, outputCols=[f"{c}_index" for c in cols], stringOrderType="alphabetAsc", handleInvalid="keep"
        )
        # The one place for unknown values is the last, which the encoder leaves out.
        vectors = OneHotEncoder(inputCols=[f"{c}_index" for c in cols], outputCols=[f"{c}_vector" for c in cols], dropLast=True)
        model = Pipeline(stages=[index, vectors]).fit(df)
    return model.transform(df).drop(*[f"{c}_index" for c in cols]), model


def one_hot(df: DataFrame, categories: Mapping[str, Sequence[str]] | None = None, drop_first: bool = False) -> DataFrame:
    """Replaces each string column by one 0/1 column ``col_value`` per category.

    A null or a category unknown at fit time gives zeros everywhere.  With ``drop_first``
    the first category of each column is the reference level and gets no column.
    """
    if categories is None:
        categories = fit_categories(df)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in categories]
    dummies = [
        F.coalesce((F.col(f"`{c}`") == v).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c, values in categories.items()
        for v in list(values)[1 if drop_first else 0 :]
    ]
    return df.select(*kept, *dummies)


def encode_categoricals(
    df: DataFrame,
    id_col: str,
    categories: Mapping[str, Sequence[str]] | None = None,
    drop_first: bool = False,
) -> DataFrame:
    """String columns except the id: two categories become 0/1 in alphabetical order, more become dummies."""
    if categories is None:
        categories = fit_categories(df, string_columns(df, [id_col]))
    binary = {c: v for c, v in categories.items() if len(v) == 2}
    codes = {c: F.when(F.col(c) == v[0], 0).when(F.col(c) == v[1], 1) for c, v in binary.items()}
    coded = df.withColumns(codes) if codes else df
    return one_hot(coded, {c: v for c, v in categories.items() if c not in binary}, drop_first)


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Replaces blanks, parentheses and hyphens in column names; refuses to merge two names."""
    names = [re.sub(UNWANTED_IN_NAMES, "_", c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"column names collide after cleaning: {clashes}")
    return df.toDF(*names)


def parse_numeric(df: DataFrame, col: str, output: str | None = None) -> DataFrame:
    """Text to number; what is not a number becomes null instead of an error."""
    return df.withColumn(output or col, F.col(col).try_cast("double"))


def missing_report(df: DataFrame, col: str, show: Sequence[str]) -> DataFrame:
    """The rows in which ``col`` is null."""
    return df.where(F.col(col).isNull()).select(*show)


def fill_from(df: DataFrame, col: str, other: str) -> DataFrame:
    """Fills nulls of one column from another."""
    return df.withColumn(col, F.coalesce(F.col(col), F.col(other)))


def minmax_bounds(train: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest training value per column (and series): one row per series."""
    aggs = []
    for c in cols:
        aggs += [F.min(F.col(c).cast("double")).alias(f"_min_{c}"), F.max(F.col(c).cast("double")).alias(f"_max_{c}")]
    return train.groupBy(*by).agg(*aggs)


def _with_bounds(df: DataFrame, bounds: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.join(bounds, list(by), "left") if by else with_one_row(df, bounds)


def minmax_scale(df: DataFrame, bounds: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Maps the training range of each column to [-1, 1]; a constant column becomes -1.

    Bounds come from the training rows only, so test rows may fall outside the range.
    """
    wide = _with_bounds(df, bounds, by)

    def scaled(c: str):
        low, high = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        width = F.when(high == low, F.lit(1.0)).otherwise(high - low)
        return (F.col(c) - low) / width * F.lit(SCALE_HIGH - SCALE_LOW) + F.lit(SCALE_LOW)

    return wide.select(*[scaled(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def minmax_inverse(
    df: DataFrame, bounds: DataFrame, columns: Mapping[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """Undoes the scaling; ``columns`` maps each column to the fitted column whose bounds apply."""
    wide = _with_bounds(df, bounds, by)

    def restored(c: str):
        low, high = F.col(f"_min_{columns[c]}"), F.col(f"_max_{columns[c]}")
        width = F.when(high == low, F.lit(1.0)).otherwise(high - low)
        return (F.col(c) - F.lit(SCALE_LOW)) / F.lit(SCALE_HIGH - SCALE_LOW) * width + low

    return wide.select(*[restored(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def label_correlation(df: DataFrame, label: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every numeric column with the label, strongest first.

    Rows in which either side is null do not count.  A constant column has no correlation
    (null); Spark's own ``corr`` stops with a division by zero there.
    """
    cols = numeric_columns(df, exclude)
    y = F.col(label).cast("double")

    def correlation(x: Column) -> Column:
        both = x.isNotNull() & y.isNotNull()
        spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
        return F.try_divide(F.covar_pop(x, y), spread)

    one_row = df.agg(*[correlation(F.col(f"`{c}`").cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("r")) for i, c in enumerate(cols)])
    return (
        one_row.select(F.explode(pairs).alias("p"))
        .select("p.feature", F.col("p.r").alias("correlation"))
        .orderBy(F.desc_nulls_last("correlation"), "feature")
    )
