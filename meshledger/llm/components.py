"""Connected components by alternating large-star and small-star steps on a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshledger.llm import common


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fp, root, component): smallest fp and smallest ``rank`` of all nodes reachable over ``links`` (a, b).

    ``root`` names the component; ranks may repeat, so ``component`` need not. ``nodes`` has one row (fp, rank) per node; nodes without links are their own component. Every
    step groups the links by node and hangs neighbours on the smallest; links only ever get fewer
    or flatter, and each table is written to the shared folder, so lineage stays one step long. The
    number of steps grows with the logarithm of the longest path.
    """
    edges = common.store(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # larger neighbours go to the smallest of the neighbourhood
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = common.store(large, "large-star")
        # smaller neighbours, and the node itself, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        small = common.store(small, "small-star")
        moved = small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty()
        common.discard(large)
        common.discard(edges)
        edges = small
        if moved:
            break
    # every node now hangs on the smallest fingerprint of its component
    roots = nodes.join(edges.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "rank", F.coalesce("v", "fp").alias("root"))
    best = roots.groupBy("root").agg(F.min("rank").alias("component"))
    return roots.join(best, "root").select("fp", "root", "component")
