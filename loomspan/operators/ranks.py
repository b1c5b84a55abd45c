"""Exact order statistics of groups of any size, by counting instead of sorting."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.plans.storage import broadcast_if_small, discard, materialize

#: Bins that a group's range is divided into in a round, and rows of a bin that are ranked rather than divided again.
BINS, FEW = 4096, 1000
#: Bytes of a group's row in a broadcast.
_WIDTH = 96


def _within(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows (g, x) with their group's range and rank, those within the range only."""
    side = broadcast_if_small(ranges.withColumnRenamed("g", "of"), _WIDTH)
    met = rows.join(side, rows["g"].eqNullSafe(side["of"]) & F.col("x").between(F.col("lo"), F.col("hi")))
    return met.drop("of")


def _narrowed(rows: DataFrame, ranges: DataFrame, bins: int) -> DataFrame:
    """For each range (g, rank, lo, hi) the bin that holds its rank: the bin's own least and greatest value, the rank in it, its rows.

    Bins are of equal width, or of equal ratio where all values are positive and far apart. Both are monotone in floating
    point too, and the least and the greatest value fall into different bins, so a range always gets smaller.
    """
    unit = F.when(F.greatest(F.abs("lo"), F.abs("hi")) > 1e307, 0.25).otherwise(1.0)  # no difference overflows
    share = (F.col("x") * unit - F.col("lo") * unit) / (F.col("hi") * unit - F.col("lo") * unit)
    ratio = (F.ln("x") - F.ln("lo")) / (F.ln("hi") - F.ln("lo"))
    share = F.when((F.col("lo") > 0) & (F.col("hi") / bins > F.col("lo")), ratio).otherwise(share)
    binned = _within(rows, ranges).withColumn("bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
    counts = binned.groupBy("g", "rank", "bin").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    below = F.sum("n").over(W.partitionBy("g").orderBy("bin")) - F.col("n")  # at most bins rows a group
    held = counts.withColumn("below", below).filter((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n")))
    return materialize(held.select("g", (F.col("rank") - F.col("below")).alias("rank"), "lo", "hi", "n"))


def nth_values(points: DataFrame, group: str, value: str, place: Callable[[Column], Column], bins: int = BINS, few: int = FEW) -> DataFrame:
    """(g, nth): of each group the value at a place (from 0, an expression of the group's size) of its ascending order.

    Nulls come first and NaN last, as in Spark's order; a place beyond the group, and one at a null, give null. A group
    is never sorted: a round counts its values by bins of the range that is left, pre-aggregated where they lie, and goes
    on with the one bin that holds the place, until that holds one value or few rows, which are ranked. What a round
    keeps is written, and shrinks with the bins.
    """
    x = F.col(value).cast("double")
    rows = points.select(F.col(group).alias("g"), x.alias("x"))
    finite = (F.abs("x") < float("inf")) & ~F.isnan("x")
    inf = float("inf")
    number = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    sizes = rows.groupBy("g").agg(
        F.count("*").alias("size"), number(F.col("x").isNull()).alias("nulls"), number(F.col("x") == -inf).alias("low"), number(finite).alias("n"),
        number(F.col("x") == inf).alias("high"), F.min(F.when(finite, F.col("x"))).alias("lo"), F.max(F.when(finite, F.col("x"))).alias("hi"),
    )
    rank = F.col("at") - F.col("nulls") - F.col("low")
    sizes = materialize(sizes.withColumn("at", place(F.col("size")).cast("long")).withColumn("rank", rank))
    inside = (F.col("rank") >= 0) & (F.col("rank") < F.col("n"))
    beyond = (
        F.when((F.col("at") < F.col("nulls")) | (F.col("at") >= F.col("size")), F.lit(None).cast("double"))
        .when(F.col("rank") < 0, -inf).when(F.col("rank") < F.col("n"), F.col("lo")).when(F.col("rank") < F.col("n") + F.col("high"), inf).otherwise(float("nan"))
    )
    settled = ~F.coalesce(inside & (F.col("lo") < F.col("hi")), F.lit(False))
    found = [sizes.filter(settled).select("g", beyond.alias("nth"))]
    ranges = materialize(sizes.filter(~settled).select("g", "rank", "lo", "hi"))
    rows, kept = rows.filter(finite), None
    while not ranges.isEmpty():
        bin_ = _narrowed(rows, ranges, bins)
        one = F.col("lo") == F.col("hi")
        found.append(bin_.filter(one).select("g", F.col("lo").alias("nth")))
        rest = bin_.filter(~one)
        left = materialize(_within(rows, rest.select("g", "lo", "hi")).select("g", "x"))
        ranked = _within(left, rest.filter(F.col("n") <= few).select("g", "rank", "lo", "hi"))
        ranked = ranked.withColumn("at", F.row_number().over(W.partitionBy("g").orderBy("x")) - 1).filter("at = rank")
        found.append(materialize(ranked.select("g", F.col("x").alias("nth"))))
        after = materialize(rest.filter(F.col("n") > few).select("g", "rank", "lo", "hi"))
        discard(ranges, *([kept] if kept is not None else []))
        ranges, rows, kept = after, left, left
    out = materialize(reduce(DataFrame.unionByName, found))
    discard(sizes, ranges, *([kept] if kept is not None else []))
    return out
