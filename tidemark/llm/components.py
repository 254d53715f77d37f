"""Connected components by repeated aggregation; no link list ever leaves the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every end of ``links (a, b)``; the label is the least node reachable.

    Each round takes the least label among a node's neighbours, then follows the label to
    its own label, so chains shorten by doubling.  The state of each round is written to
    the shared folder.  A node with very many links is a skewed join key only, which
    adaptive execution splits, and its messages are aggregated before they are shuffled.
    """
    both = materialize(
        links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        .select("col.a", "col.b")
        .where("a <> b")
        .distinct(),
        "links",
    )
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, F.col("node") == F.col("a"), "left").select(
            "node", F.col("label").alias("before"), F.least("label", "heard").alias("label")
        )
        jump = labels.select(F.col("node").alias("a"), F.col("label").alias("further"))
        after = materialize(
            nearer.join(jump, F.col("label") == F.col("a"), "left").select(
                "node", F.least("label", "further").alias("label"), (F.least("label", "further") < F.col("before")).alias("moved")
            ),
            "labels",
        )
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            return labels
