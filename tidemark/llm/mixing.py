"""Mixing sources to target weights by Pareto order sampling, in built-in functions only.

1. Sources in code-point order (null last) weigh ``weights`` in turn and share the words of
   the corpus.  A target stops at ``cap`` times the words of its source; the excess is
   shared again by weight until no target is above.
2. Within a source a document of size n is wanted ``min(cap, x * p)`` times, where
   p = 1 + floor(log2(n + 1)) / 8 favours longer documents a little and x is chosen so that
   the source's expected words are its target.  Both steps are solved in closed form: sort
   by where the cap is met, then take the first level that is not above its own cap.
3. Whole copies are certain.  The rest f < 1 is drawn by Pareto order sampling: with u a
   number in (0, 1) hashed from the id, documents are ranked by the random odds u / (1 - u)
   divided by the inclusion odds f / (1 - f), and the least ranks are taken until the
   words still missing are reached, the last one by rounding to the nearer side.

Ranks are cut without a global sort: words are summed per source and slice of the rank, the
slice of the cut is found among at most ``SLICES`` sums, and only that slice's documents
are ordered.  The sample depends on ids and sizes alone, so reruns agree.

Defined cases: a null text has size 0 and is never taken; a missing source is a source of its
own; without words all targets are 0; equal ranks go by id, then by text; repeated rows are
documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import ID, ROW, materialize, plain_id, rows_of, site

WEIGHTS, CAP = (5, 2, 1), 3
SLICES = 1 << 12
WORD = r"[^\x20\x09-\x0D]+"


def _level(share: Column, room: Column, total: Column, keys: list[str], tie: str) -> Column:
    """The level x with sum(min(room, x * share)) = total, for rows of ``keys``.

    Rows meet their cap in the order of room / share.  Were all rows before this one capped,
    the level would be the rest of the total over the rest of the shares; it is right at the
    first row that it does not push over its own cap.  Later rows give lower levels, so the
    greatest one that is not null is the level of the group.
    """
    every = Window.partitionBy(*(keys or [F.lit(1)]))
    order = every.orderBy(room / share, tie)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = total - F.coalesce(F.sum(room).over(before), F.lit(0.0))
    level = rest / (F.sum(share).over(every) - F.coalesce(F.sum(share).over(before), F.lit(0.0)))
    return F.when(level <= room / share, level)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``site, source_size, target`` for ``sizes (site, source, source_size)``, a row per source.

    The windows see one row per source.
    """
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place - 1) % len(weights) + 1)
    weighed = sizes.select("site", "source_size", place.alias("place"), weight.alias("share"))
    weighed = weighed.withColumn("room", (F.col("source_size") * cap).cast("double"))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1))).cast("double")
    levels = weighed.withColumn("level", _level(F.col("share"), F.col("room"), total, [], "place"))
    level = F.max("level").over(Window.partitionBy(F.lit(1)))
    return levels.select(
        "site", "source_size", F.least("room", F.coalesce(level, F.lit(0.0)) * F.col("share")).alias("target")
    )


def _unit(id_col: Column) -> Column:
    """A number in (0, 1) from the id, with 52 random bits."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("-")), F.lit("|mix"))), 1, 13), 16, 10)
    return (bits.cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 52))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    site_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``_row, _id, size, source_size, target, copies, taken``, a row for each row of ``docs``.

    Stores ids and sizes in the shared folder, reads the texts once.
    """
    source = F.col(f"`{site_col}`")
    rows = rows_of(docs, source.alias("source"), site(f"`{site_col}`").alias("site"), id_col=id_col, text_col=text_col)
    size = F.regexp_count("_text", F.lit(WORD)).cast("bigint")
    sized = rows.select(ROW, ID, "site", "source", size.alias("size"))
    sized = materialize(sized.withColumn("band", (F.length(F.bin(F.col("size") + 1)) - 1).cast("int")), "sizes")

    bands = sized.where("size > 0").groupBy("site", "band").agg(F.sum("size").alias("words"))
    of_site = sized.groupBy("site", "source").agg(F.sum("size").alias("source_size"))
    aims = materialize(targets(of_site, weights, cap), "targets")
    favour = F.lit(1.0) + F.col("band") / F.lit(8.0)
    banded = bands.join(aims, "site").select("site", "band", "words", "target", favour.alias("favour"))
    share, room = F.col("words") * F.col("favour"), (F.col("words") * cap).cast("double")
    banded = banded.withColumn("level", _level(share, room, F.col("target"), ["site"], "band"))
    level = F.coalesce(F.max("level").over(Window.partitionBy("site")), F.lit(float(cap)))
    wanted = banded.select("site", "band", F.least(F.lit(float(cap)), level * F.col("favour")).alias("wanted"))
    whole = F.floor("wanted").cast("bigint")
    wanted = wanted.select("site", "band", whole.alias("whole"), (F.col("wanted") - whole).alias("rest"))

    u = _unit(plain_id())
    odds = (u / (F.lit(1.0) - u)) / (F.col("rest") / (F.lit(1.0) - F.col("rest")))
    drawn = sized.join(wanted, ["site", "band"], "left").select(
        ROW, ID, "site", "size",
        F.when(F.col("size") > 0, F.col("whole")).otherwise(0).alias("whole"),
        F.when((F.col("size") > 0) & (F.col("rest") > 0), odds).alias("odds"),
    )
    drawn = materialize(
        drawn.withColumn("slice", F.floor(F.col("odds") / (F.col("odds") + 1) * SLICES).cast("int")), "odds"
    )

    certain = drawn.groupBy("site").agg(F.sum(F.col("size") * F.col("whole")).alias("certain"))
    missing = aims.join(certain, "site").select("site", (F.col("target") - F.col("certain")).alias("missing"))
    sums = drawn.where("slice IS NOT NULL").groupBy("site", "slice").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("site").orderBy("slice"))
    cuts = sums.join(missing, "site").select("site", "slice", "words", "missing", running.alias("upto"))
    cuts = cuts.select("site", "slice", "missing", (F.col("upto") - F.col("words")).alias("before"), "upto")
    placed = materialize(
        drawn.join(
            cuts.select(
                "site", "slice", "missing", "before",
                F.when(F.col("upto") <= F.col("missing"), 1).when(F.col("before") >= F.col("missing"), 0).alias("all"),
            ),
            ["site", "slice"], "left",
        ), "placed",
    )
    settled = placed.where("slice IS NULL OR all IS NOT NULL").withColumn("extra", F.coalesce("all", F.lit(0)))
    order = Window.partitionBy("site", "slice").orderBy("odds", ID, ROW)
    upto = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    middle = upto - F.col("size") / 2
    cut = placed.where("slice IS NOT NULL AND all IS NULL").withColumn("extra", (middle <= F.col("missing")).cast("int"))
    columns = [ROW, ID, "site", "size", (F.col("whole") + F.col("extra")).alias("copies")]
    copies = settled.select(*columns).union(cut.select(*columns))
    return copies.join(aims, "site").select(
        ROW, ID, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns and ``copies``, how often each is taken.

    Repeated rows share the greater of their copies; a column of ``docs`` that is called
    ``copies`` is replaced.
    """
    docs = docs.drop("copies")
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    taken = mix(docs, **options).where("copies > 0").groupBy(ROW, ID).agg(F.max("copies").alias("copies"))
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    found = rows_of(docs, *named, id_col=id_col, text_col=text_col).join(taken, [ROW, ID])
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], "copies")
