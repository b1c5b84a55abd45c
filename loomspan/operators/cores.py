"""What of a graph can lie on a cycle: trimming and splitting on the cluster, so that walks see only cyclic cores;
and the heights of nodes in large graphs that are taken apart in few rounds, so that these are not walked at all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.components import connected_components
from loomspan.plans.storage import BROADCAST_BYTES, discard, materialize

#: Graphs of more edges than this are trimmed and split before any of them is walked; smaller ones are walked whole.
WHOLE = 200_000
#: Trimming ends after so many rounds, or when a round frees less than this share of the edges. What it leaves is walked.
ROUNDS, SHARE = 40, 0.02
#: Bytes of a node's row in a broadcast.
_WIDTH = 128


def trimmed(arcs: DataFrame, both_ways: bool) -> DataFrame:
    """arcs (graph, src, dst, …) without those that lead to dead ends, round by round; with both_ways also those from
    nodes that nothing leads to. Arcs of cycles always stay."""
    arcs = materialize(arcs)
    n = arcs.count()
    for _ in range(ROUNDS):
        live = arcs.join(arcs.select("graph", F.col("src").alias("dst")).distinct(), ["graph", "dst"], "left_semi")
        if both_ways:
            live = live.join(arcs.select("graph", F.col("dst").alias("src")).distinct(), ["graph", "src"], "left_semi")
        arcs, before = materialize(live.select(*arcs.columns)), n
        n = arcs.count()
        if before - n <= SHARE * before:
            break
    return arcs


def cyclic_parts(arcs: DataFrame, both_ways: bool) -> DataFrame:
    """(graph, src, dst, …, part): the arcs that may matter to cycles, by parts that no arc joins.

    Graphs of at most WHOLE arcs come whole (part is null, nothing is trimmed), so that many small graphs cost no rounds.
    Of larger ones, trimming takes what reaches no cycle, and connected components part the rest; all steps are joins.
    """
    sizes = arcs.groupBy("graph").agg(F.count("*").alias("n")).filter(F.col("n") > WHOLE)
    large = materialize(sizes.select("graph"))
    if large.isEmpty():
        return arcs.withColumn("part", F.lit(None).cast("string"))
    small = arcs.join(large, "graph", "left_anti").select(*arcs.columns, F.lit(None).cast("string").alias("part"))
    live = trimmed(arcs.join(large, "graph", "left_semi").filter("src <> dst").select(*arcs.columns), both_ways)
    end = lambda c: F.struct("graph", F.col(c).alias("node"))
    part = connected_components(live.select(end("src").alias("src"), end("dst").alias("dst")))
    part = part.select("node.graph", F.col("node.node").alias("src"), F.col("component.node").cast("string").alias("part"))
    return small.unionByName(live.join(part, ["graph", "src"]).select(*small.columns))


def _bit(node: str) -> str:
    return f"shiftleft(1L, CAST(pmod(xxhash64({node}), 64) AS INT))"


def heights(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph, node, height, below) of the graphs that can be taken apart from their ends, and (graph) of all others.

    arcs: (graph, src, dst), distinct. A node's height is the length of its longest path ahead; below are 64 bits, those
    of hashes of all it reaches, itself included. A round takes the nodes without arcs that are left, with the arcs into
    them; every arc is gone once, so where rounds halve a graph all of them cost some two scans. Rounds end as in trimming:
    graphs with arcs left then, which have cycles or long paths, get no heights. No step holds a graph in one task.
    """
    out = arcs.groupBy("graph", "src").agg(F.count("*").alias("need"))
    left = first = materialize(arcs.select("graph", "src", "dst").join(out, ["graph", "src"]))
    ends = left.select("graph", F.col("dst").alias("node")).join(left.select("graph", F.col("src").alias("node")), ["graph", "node"], "left_anti").distinct()
    front = materialize(ends.select("graph", "node", F.lit(0).alias("height"), F.expr(_bit("node")).alias("below")))
    levels, waiting, n = [front], None, left.count()
    for r in range(ROUNDS):
        side = front.select("graph", F.col("node").alias("dst"), "below")
        side = F.broadcast(side) if side.count() * _WIDTH <= BROADCAST_BYTES else side.hint("merge")
        met = materialize(left.join(side, ["graph", "dst"], "left").select("graph", "src", "dst", "need", "below"))
        discard(first)
        left, first = met.filter("below IS NULL").drop("below"), met
        known = met.filter("below IS NOT NULL").select("graph", "src", "need", F.lit(1).cast("long").alias("got"), "below")
        known = known if waiting is None else known.unionByName(waiting)
        sums = materialize(known.groupBy("graph", "src").agg(F.max("need").alias("need"), F.sum("got").alias("got"), F.bit_or("below").alias("below")))
        waiting = sums.filter("got < need")
        front = sums.filter("got = need").select("graph", F.col("src").alias("node"), F.lit(r + 1).alias("height"), F.expr(f"below | {_bit('src')}").alias("below"))
        levels.append(front)
        n, before = left.count(), n
        if not n or before - n <= SHARE * before:
            break
    rest = materialize(left.select("graph").distinct())
    discard(first)
    return reduce(DataFrame.unionByName, levels).join(F.broadcast(rest), "graph", "left_anti"), rest
