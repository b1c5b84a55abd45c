"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.plans.storage import Numbered, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Cells of the seeded order of a source's documents: a hot source is dealt over all of them.
CELL_DIGITS = 3


def seeded_order(id_col: Column, text: Column, seed: int) -> Column:
    """A document's place in the seeded order: an md5 of seed, id and the text's md5, so that an id (or null) that
    very many rows bear is spread like any other."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def water_fill(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """sizes (key, source, source_size) with weight and target added.

    Weights go to the sources by code point, null last, repeating. Sorted by cap/weight, clamping the first i
    sources gives the level (budget - their caps) / (weights that are left); this level rises while clamping is due
    and falls afterwards, so its maximum is the level at which no source is above its cap.
    One row per source: the windows without a key hold the sources alone, never documents.
    """
    alphabetical, everything = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(alphabetical) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    clamped = by_cap.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(clamped), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(clamped), F.lit(0))
    )
    filled = ranked.withColumn("level", level)
    filled = filled.withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("weight")))
    return filled.select("key", "source_size", "target")


def mix_sources(
    docs: DataFrame | Numbered,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: int = 42,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, row_id.

    Every document of a source is taken floor(target/source_size) times in whole; the fractional repetition takes
    documents in seeded order until the target's words are reached, the last one in part, so a source's taken words
    equal its target to the word. copies rounds that part to whole copies for consumers that emit documents.

    Nulls: a null text has size 0, a null source is a source of its own that sorts last, a null id is ordered by its
    text. Texts without words take 0. Repeated rows keep their own rows. Ties in the order (equal ids and texts) are
    rows of one size and resolve by row. An empty table gives an empty table. Other columns are ignored, whatever their names.
    docs may come with row numbers, which the result then bears; else rows are numbered here.
    """
    row = F.col(docs.row) if isinstance(docs, Numbered) else F.monotonically_increasing_id()
    base = (docs.df if isinstance(docs, Numbered) else docs).select(
        row.alias("row_id"),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        seeded_order(F.col(id_col), F.col(text_col), seed).alias("place"),
    ).withColumn("cell", F.substring("place", 1, CELL_DIGITS))
    slim = materialize(base)  # read twice: once for the sums, once to be dealt out

    cells = slim.groupBy("key", "cell").agg(F.first("source").alias("source"), F.sum("size").alias("cell_size"))
    sizes = cells.groupBy("key").agg(F.first("source").alias("source"), F.sum("cell_size").alias("source_size"))
    earlier_cells = W.partitionBy("key").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("key", "cell", F.coalesce(F.sum("cell_size").over(earlier_cells), F.lit(0)).alias("cells_before"))
    plan = cells.join(water_fill(sizes, weights, max_epochs), "key")

    earlier_rows = W.partitionBy("key", "cell").orderBy("place", "doc_id", "size", "row_id").rowsBetween(W.unboundedPreceding, -1)
    placed = slim.withColumn("rows_before", F.coalesce(F.sum("size").over(earlier_rows), F.lit(0))).join(plan, ["key", "cell"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    part_of_source = F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("words_left") - F.col("cells_before") - F.col("rows_before")))
    return (
        placed.withColumn("whole", whole.cast("long"))
        .withColumn("words_left", part_of_source.cast("long"))
        .withColumn("part", part.cast("long"))
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("whole") * F.col("size") + F.col("part")).alias("taken"),
            (F.col("whole") + F.when((F.col("part") > 0) & (F.col("part") * 2 >= F.col("size")), 1).otherwise(0)).alias("copies"),
            "row_id",
        )
    )
