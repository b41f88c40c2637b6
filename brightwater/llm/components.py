"""Connected components of a link table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link.

    Hash-min with hooking and pointer jumping: each round takes the least label among a node's
    neighbours, offers it to the node and to the node's present label, and then follows labels once.
    Labels and links are stored tables, so each join has two plain scans below it and adaptive
    execution can split a hub that holds a third of all links; the minima combine before the shuffle.
    Rounds stop when no label changes (about the logarithm of the longest path).
    Null ends and self-links are ignored; an empty table gives an empty table.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = stored(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    both = edges.union(edges.select("v", "u"))
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        offers = stored(seen.join(labels.withColumnRenamed("node", "u"), "u"), "offers")
        best = stored(
            labels.select("node", "label")
            .union(offers.select("u", "near"))
            .union(offers.select("label", "near"))
            .groupBy("node")
            .agg(F.min("label").alias("label")),
            "best",
        )
        jumped = best.join(best.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
        after = stored(jumped.select("node", F.least("label", F.coalesce("root", "label")).alias("label")), "labels")
        changed = after.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count()
        for old in (labels, offers, best):
            discard(old)
        labels = after
        if not changed:
            break
    discard(edges)
    return labels.select("node", F.col("label").alias("component"))
