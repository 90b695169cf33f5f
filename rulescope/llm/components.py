"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulescope.llm.common import written_at
from rulescope.sources.folders import discard


def connected_components(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, label): the smallest node reachable over the links (a, b).

    Every round hooks each node's label to the smallest label among its
    neighbours' and then jumps to the label's label, so stars settle at once
    and a chain of n nodes in about log n rounds.  Each round is written to the
    shared folder, where only the last is left.  Nodes are those of the links and of ``nodes``.
    """
    ends = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = ends.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct()
    both, links_at = written_at(both, "cc-links")
    start = both.groupBy("u").agg(F.min("v").alias("low")).select(
        F.col("u").alias("node"), F.least("u", "low").alias("label")
    )
    labels, at = written_at(start, "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("theirs")), "v")
        low = near.groupBy("u").agg(F.min("theirs").alias("theirs"))
        hooked = labels.join(low.withColumnRenamed("u", "node"), "node").select(
            "node", "label", F.least("label", "theirs").alias("new")
        )
        # The smallest label that any node of the same old label has met.
        moved = hooked.groupBy("label").agg(F.min("new").alias("to"))
        settled = hooked.join(moved, "label").select("node", "label", F.least("new", "to").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("next"))
        done = settled.join(jump, "new", "left").select(
            "node", F.col("label").alias("old"), F.least("new", F.coalesce("next", "new")).alias("label")
        )
        done, new_at = written_at(done, "cc-labels")
        discard(links.sparkSession, at)
        labels, at = done.select("node", "label"), new_at
        if done.where("old <> label").isEmpty():
            break
    discard(links.sparkSession, links_at)
    if nodes is not None:
        labels = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    return labels
