"""Connected components of an edge table, by alternating star contractions.

Each round links every node's larger neighbours, then its smaller ones, to the
least node around, until nothing changes.  Rounds grow with the logarithm of the
graph, each is two aggregations by node, and checkpoints in the shared folder end
its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_dir


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # the minima are written, so that the join reads two plain shuffles and AQE may split a star of many edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).checkpoint()
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) of every node that an edge
    (u, v: long) names.  Loops and repeated edges don't matter; null ends are
    dropped; no edge gives no row."""
    shared_dir(edges.sparkSession)
    tree = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = None
    while True:
        tree = _stars(_stars(tree, large=True), large=False).checkpoint()
        # the tree is flat when nothing changes any more
        state = tree.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    flat = tree.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return flat.unionByName(flat.select(F.col("component").alias("node"), "component").distinct())
