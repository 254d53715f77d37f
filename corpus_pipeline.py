"""From raw documents to a training mix: quality, line dedup, near-duplicates, benchmark leaks, mix.

``run`` applies the stages in order; each result is written to the shared folder and read
again, so that a lost executor costs one stage at most.  All stages but the last return the
columns of ``documents``; the last adds ``copies``, how often the mix takes a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, lines, minhash, mixing, quality
from tidemark.llm.frames import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learnt from the labels outside the held-out third, scores under 0.5 go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out(F.col("doc_id")))
    return quality.keep_good(docs, labels, "quality")


def strip_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on ten sources or more, of one word too, are cut out of their documents; ``n_chars`` follows the text.

    Only copies of another document that are mostly such lines stay whole, for the next stage.
    """
    carry = tuple(c for c in docs.columns if c != "text")
    found = lines.strip_lines(docs, carry=carry)
    place = {c: f"_c{i}" for i, c in enumerate(carry)}
    changed = F.size("removed") > 0
    values = {c: F.col(n) for c, n in place.items()}
    values["text"] = F.when(F.col("_had_text"), F.col("kept_text"))
    if "n_chars" in values:
        length = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        values["n_chars"] = F.when(changed, length).otherwise(values["n_chars"])
    return found.select(*[values[c].alias(c) for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: 5-word shingles, similarity 0.8."""
    return minhash.drop_near_duplicates(docs, shingle=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that is nearly a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their ``copies``."""
    return mixing.mixed(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", strip_boilerplate),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("mix", mix_sources),
]

# A trained classifier has no SQL twin; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
