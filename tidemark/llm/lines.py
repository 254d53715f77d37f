"""Line dedup: boilerplate lines that stand on many distinct sites are removed.

A HyperLogLog sketch of the sites is kept per line hash and merged by aggregation, so a
line on every page of the corpus is one small sketch per task before anything is shuffled.
Lines whose estimate is clearly over or under ``min_sites`` are settled by it; those near
it get an exact distinct count, and so does every count that is reported.

A line is compared without ASCII spaces around it, by a hash of 128 bits; a line without a
word is no line.  All others count, whatever their length and script.

A text with more than ``max_share`` of its characters in boilerplate is left whole where
another document (another id, text or site) has the same set of lines, so that near-duplicate
removal gets a group of copies untorn.  Every other text loses its boilerplate, up to all of it.

Defined cases: a null text has no lines; a missing site is a site of its own; a line that a
document repeats counts once per site and is removed everywhere in it; repeated rows count
once and get the same answer each; ties at ``min_sites`` are boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.frames import ID, ROW, materialize, plain_id, rows_of, site

MIN_SITES = 10
MAX_SHARE = 0.5
LOG_SLOTS = 10
# Three standard errors of a sketch with 2^10 slots, and one site for small counts.
MARGIN, SLACK = 0.1, 1
_BLANK = " \t\x0b\x0c\r"
LINE = ["h1", "h2"]


def text_lines(docs: DataFrame, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row, _id, site, line`` (from 0), its hash ``h1, h2`` and ``size`` for every line."""
    rows = rows_of(docs, site(f"`{site_col}`").alias("site"), id_col=id_col, text_col=text_col)
    split = rows.select(ROW, ID, "site", F.posexplode(F.split("_text", "\n", -1)).alias("line", "_text"))
    trimmed = split.withColumn("_text", F.btrim("_text", F.lit(_BLANK))).where("_text <> ''")
    return trimmed.select(
        ROW, ID, "site", "line", F.xxhash64("_text").alias("h1"), F.xxhash64(F.lit(1), "_text").alias("h2"),
        F.length("_text").alias("size"),
    )


def widespread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``h1, h2`` of the lines on at least ``min_sites`` sites; reads ``lines`` twice."""
    sketched = lines.groupBy(*LINE).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_SLOTS))).alias("about")
    )
    high, low = min_sites * (1 + MARGIN) + SLACK, min_sites * (1 - MARGIN) - SLACK
    about = materialize(sketched.where(F.col("about") >= low), "spread")
    sure = about.where(F.col("about") > high).select(*LINE)
    near = about.where(F.col("about") <= high).select(*LINE)
    exact = (
        lines.select(*LINE, "site").join(near, LINE).groupBy(*LINE).agg(F.count_distinct("site").alias("n"))
        .where(F.col("n") >= min_sites)
    )
    return sure.union(exact.select(*LINE))


def copied(docs: DataFrame, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row, _id`` of the texts whose set of lines another document has too.

    Rows are one document when id, text and site are equal.
    """
    rows = rows_of(docs, site(f"`{site_col}`").alias("site"), id_col=id_col, text_col=text_col)
    own = F.transform(F.split("_text", "\n", -1), lambda line: F.btrim(line, F.lit(_BLANK)))
    own = F.array_sort(F.array_distinct(F.filter(own, lambda line: line != "")))
    sets = rows.select(ROW, ID, "site", own.alias("own")).where(F.size("own") > 0)
    hashed = [F.xxhash64("own").alias("s1"), F.xxhash64(F.lit(1), "own").alias("s2")]
    sets = materialize(sets.select(ROW, ID, "site", *hashed), "line-sets")
    document = F.struct(ROW, ID, "site")
    again = sets.groupBy("s1", "s2").agg(F.min(document).alias("least"), F.max(document).alias("most"))
    again = materialize(again.where("least <> most").select("s1", "s2"), "copied-sets")
    return sets.join(again, ["s1", "s2"]).select(ROW, ID).distinct()


def _rebuild(max_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hits, removed, kept = [], [], [], []
            along = [c for c in batch.schema.names if c not in (ROW, ID, "_text", "found", "whole")]
            for text, found, whole in zip(batch.column("_text"), batch.column("found"), batch.column("whole")):
                own = text.as_py().split("\n")
                sizes = [len(line.strip(_BLANK)) for line in own]
                bad = sorted(set(found.as_py() or []))
                counts.append(sum(map(bool, sizes)))
                hits.append(len(bad))
                if whole.as_py() and sum(sizes[i] for i in bad) > max_share * sum(sizes):
                    bad = []
                removed.append(bad)
                if bad:
                    gone = set(bad)
                    kept.append("\n".join(line for i, line in enumerate(own) if i not in gone))
                else:
                    kept.append(text.as_py())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in (ROW, ID)),
                    pa.array(counts, pa.int64()),
                    pa.array(hits, pa.int64()),
                    pa.array(removed, pa.list_(pa.int32())),
                    pa.array(kept, pa.string()),
                    *(batch.column(c) for c in along),
                ],
                names=[ROW, ID, "n_lines", "n_boilerplate", "removed", "kept_text", *along],
            )

    return run


def strip_lines(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    max_share: float = MAX_SHARE,
    site_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``_row, _id, n_lines, n_boilerplate, removed`` (line numbers) and ``kept_text`` of every text.

    Stores the line hashes in the shared folder.  Columns named in ``carry`` come along
    as ``_c0, _c1, …``, and ``_had_text`` says whether the text was no null.
    """
    lines = materialize(text_lines(docs, site_col, id_col, text_col), "lines")
    found = (
        lines.join(widespread(lines, min_sites), LINE)
        .groupBy(ROW, ID)
        .agg(F.collect_set("line").alias("found"))
    )
    copies = copied(docs, site_col, id_col, text_col).withColumn("whole", F.lit(True))
    found = found.join(copies, [ROW, ID], "left")
    carried = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)]
    known = F.col(f"`{text_col}`").isNotNull().alias("_had_text")
    rows = rows_of(docs, known, *carried, id_col=id_col, text_col=text_col)
    made = "n_lines long, n_boilerplate long, removed array<int>, kept_text string"
    schema = StructType([
        *(rows.schema[c] for c in (ROW, ID)), *StructType.fromDDL(made).fields,
        *(rows.schema[c] for c in rows.columns if c not in (ROW, ID, "_text")),
    ])
    return rows.join(found, [ROW, ID], "left").mapInArrow(_rebuild(max_share), schema)


def stripped(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_lines, n_boilerplate, removed, kept_text``; options as for ``strip_lines``."""
    return strip_lines(docs, **options).select(
        plain_id().alias("doc_id"), "n_lines", "n_boilerplate", "removed", "kept_text"
    )
