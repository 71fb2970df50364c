"""Connected components by alternating star contraction, as DataFrame joins.

Every round attaches neighbours to smaller labels (large star, then small star)
and ends as a table in the shared folder; rounds grow with the logarithm of a
component's size.  No node's neighbours are ever collected.

Defined cases: repeated edges and loops count once or not at all; a null end is no
edge; without edges no node is labelled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewell.plans.scratch import discard, materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    moved = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes that ``edges`` (u, v: bigint) touch; label: smallest node."""
    e = materialize(edges.where("u != v").select("u", "v").distinct(), "edges")
    mark = None
    while True:
        last, e = e, materialize(_small_star(_large_star(e)), "stars")
        discard(last)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    labels = materialize(e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots), "labels")
    discard(e)
    return labels
