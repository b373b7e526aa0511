"""Connected components of a graph that no task holds, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import saved, spread_join


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: each node's neighbours (the larger ones, or the others) are tied to the least of its neighbours and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    both = saved(both.distinct(), "stars")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    met = spread_join(both, least, "u", "n", both.count())
    if large:
        return met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(met.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b), root being the least node of its component; edges from a node to itself, or with a null end, don't count, and no edges give no rows. Each round is written, so that lost executors cost one round at most."""
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    known = None
    while True:
        nxt = saved(_stars(_stars(now, True), False).where("a <> b").distinct(), "edges")
        said = nxt.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if said == known:
            break
        now, known = nxt, said
    return nxt.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(nxt.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
