"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.plans.storage import discard, materialize


def _star(directed: DataFrame, keep_larger: bool) -> DataFrame:
    """Link every neighbour v of u to the smallest id around u; directed holds (u, v) and is a written table.

    The minimum is pre-aggregated map-side and written, so that both sides of the join back to a hub's neighbours are
    plain exchanges, which AQE can split: no neighbourhood is ever collected.
    """
    least = materialize(directed.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    linked = directed.join(least, "u")
    if keep_larger:
        linked = linked.filter("v > u")
    else:
        linked = linked.unionByName(least.select("u", F.col("u").alias("v"), "m"))
    out = materialize(linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
    discard(least)
    return out


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges; component is the smallest node reachable.

    Each step is written to the shared folder and replaces the one before, so lineage stays short, lost executors
    cost one step at most and disk holds a few copies of the links. Ends when a round changes nothing (edge count
    and checksum), in O(log^2 n) rounds; beyond max_rounds it raises.
    """
    edges = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v").distinct()
    current, before = materialize(edges), None
    for _ in range(max_rounds):
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = mark
        both = materialize(current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = _star(both, keep_larger=True)
        oriented = materialize(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        discard(current, both, large)
        current = _star(oriented, keep_larger=False)
        discard(oriented)
    raise RuntimeError("connected components did not settle")
