"""Connected components of an edge table, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import scratch_table


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, label: connected components of (src, dst), labelled by their smallest node.

    Rounds of minimum-label exchange over the edges followed by pointer jumping, so a chain of n nodes takes about
    log n rounds and a star two. Neighbour labels are combined by ``min`` before they move, so a node with very many
    neighbours costs one row per task. Each round is written to the shared folder.
    """
    both = scratch_table(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
                         .distinct(), f"{name}-edges")
    labels = scratch_table(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low"))
                           .select("node", F.least("node", "low").alias("label")), f"{name}-labels")
    while True:
        # the smallest label among a node's neighbours
        near = (both.join(labels.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(F.min("label").alias("near"))
                .withColumnRenamed("dst", "node"))
        low = labels.join(near, "node", "left").select("node", "label", F.least("label", "near").alias("new"))
        # pointer jumping: take the label of the label
        up = labels.select(F.col("node").alias("new"), F.col("label").alias("up"))
        stepped = scratch_table(low.join(up, "new", "left").select("node", F.col("label").alias("old"),
                                                                   F.least("new", F.coalesce("up", "new")).alias("label")), f"{name}-labels")
        changed = not stepped.where("old <> label").isEmpty()
        labels = stepped.select("node", "label")
        if not changed:
            return labels
