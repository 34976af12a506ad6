"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import materialise, remove


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, root): the smallest node of its component, for every other node.

    Each round is written once to the shared folder and read by the next, so lineage stays short
    and lost executors cost one round.  Hubs are joined with one row for each node; the join may
    be split where a hub holds most edges.  No edges, no rows.  Nulls and loops are no edges.
    """
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .where((F.col("u") != F.col("v"))).distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large)  # every u is larger than its v now
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        following = materialise(small)
        for old in (edges, large):
            remove(old)
        edges = following
