"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.session import materialise


def components(links: DataFrame, checked_every: int = 2) -> DataFrame:
    """``node, root``: the smallest node reachable, for each node of ``links`` (a, b).

    Every round each node takes the smallest root among its own and its neighbours', and the
    nodes that named it their root follow it; then roots are replaced by their roots. Rounds
    grow as the logarithm of the longest path. Only counts reach the driver. Minima are
    aggregated before the shuffle, so a node of many links is no hot key.
    """
    links = links.select("a", "b").where("a <> b")
    both = materialise(links.union(links.select(F.col("b"), F.col("a"))).distinct())
    nodes = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
        "node", F.least("node", "least").alias("root")
    ))
    while True:
        for _ in range(checked_every):
            near = (
                both.join(nodes.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node"))
                .agg(F.min("root").alias("near"))
            )
            found = nodes.join(near, "node").select(
                "node", F.col("root").alias("old"), F.least("root", "near").alias("root")
            )
            # A node that finds a smaller root tells its old root, and so all that share it.
            told = found.groupBy(F.col("old").alias("node")).agg(F.min("root").alias("told"))
            found = found.join(told, "node", "left").select(
                "node", F.least("root", F.coalesce("told", "root")).alias("root")
            )
            above = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
            new = materialise(
                found.join(above, "root").select("node", F.least("root", "top").alias("root"))
            )
            before, nodes = nodes, new
        moved = nodes.join(before.withColumnRenamed("root", "was"), "node").where("root <> was")
        if moved.isEmpty():
            return nodes
