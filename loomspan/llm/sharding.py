"""Sharding under a byte limit by extendible hashing. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.plans.storage import materialize, number_rows

#: 36 bits from the document's name, then 24 from its row: rows that repeat one name can still be told apart.
NAME_DIGITS, ROW_BITS = 9, 24
HASH_BITS = 4 * NAME_DIGITS + ROW_BITS
#: Bits that one round adds to the directory: a round looks at 4096 cells below each bucket that is still too large.
ROUND_BITS = 12


def _directory(rows: DataFrame, known: int, limit: int) -> DataFrame:
    """Cells of the next ROUND_BITS bits of rows' buckets, each with the bucket (depth, prefix) it belongs to.

    A bucket is a leaf at the first depth at which its bytes fit; cells that don't fit at their full depth have a
    null bucket and are split on further bits in the next round.
    """
    deepest = known + ROUND_BITS
    cells = rows.groupBy(F.shiftright("hash", HASH_BITS - deepest).alias("cell")).agg(F.sum("bytes").alias("bytes"))
    # bits are dropped one at a time, so a bucket's sum comes from the cells below it: 4096 * 13 rows per split bucket
    depths = F.explode(F.sequence(F.lit(known if known == 0 else known + 1), F.lit(deepest))).alias("depth")
    chain = cells.select("cell", "bytes", depths).withColumn("prefix", F.expr(f"shiftright(cell, {deepest} - depth)"))
    sums = chain.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes")).filter(F.col("shard_bytes") <= limit)
    fits = chain.join(sums, ["depth", "prefix"])
    leaf = fits.groupBy("cell").agg(F.min_by(F.struct("depth", "prefix", "shard_bytes"), "depth").alias("leaf"))
    return cells.join(leaf, "cell", "left").select("cell", "leaf.depth", "leaf.prefix", "leaf.shard_bytes")


def shard_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 16 << 20) -> DataFrame:
    """One row per document: doc_id, shard, depth, bytes, shard_bytes, oversize.

    shard is the bucket's hash prefix as bits (the empty string while one bucket holds all). Only buckets above
    limit bytes split on a further bit, until all fit; the last bits tell apart rows that repeat an id. Rows that share
    the whole hash by chance and still exceed the limit are cut by running bytes into shards with a suffix. A single
    document above the limit gets a shard that is marked oversize, since nothing smaller exists.

    Nulls: a null text has 0 bytes, a null id is hashed by its text. An empty table gives an empty table. Other
    columns are ignored, whatever their names.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    numbered = number_rows(docs)  # by file and place: shards of repeated ids stay the same under other splits
    rows = numbered.df.select(
        F.col(numbered.row).alias("row_id"),
        F.col(id_col).alias("doc_id"),
        F.conv(F.substring(F.md5(name), 1, NAME_DIGITS), 16, 10).cast("long").alias("name_bits"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("bytes"),
    )
    row_bits = F.xxhash64("row_id").bitwiseAND((1 << ROW_BITS) - 1)
    rows = materialize(rows.select("row_id", "doc_id", "bytes", F.shiftleft("name_bits", ROW_BITS).bitwiseOR(row_bits).alias("hash")))
    done, known = [], 0
    columns = ["doc_id", "shard", "depth", "bytes", "shard_bytes"]
    while known < HASH_BITS:
        cell = F.shiftright("hash", HASH_BITS - known - ROUND_BITS).alias("cell")
        directory = materialize(_directory(rows, known, limit))
        placed = rows.withColumn("cell", cell).join(directory, "cell")
        bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
        done.append(placed.filter("depth is not null").withColumn("shard", bits).select(*columns))
        if directory.filter("depth is null").isEmpty():
            rows = None
            break
        rows = materialize(placed.filter("depth is null").select("row_id", "doc_id", "hash", "bytes"))
        known += ROUND_BITS
    if rows is not None:  # whole hashes that exceed the limit
        before = W.partitionBy("hash").orderBy("doc_id", "row_id").rowsBetween(W.unboundedPreceding, -1)
        start = F.coalesce(F.sum("bytes").over(before), F.lit(0))
        # rows of at most half the limit that start within the same half limit fit one shard; larger rows stand alone
        alone, shared = F.concat(F.lit("r"), F.col("row_id")), F.concat(F.lit("p"), F.floor(F.col("start") * 2 / limit))
        cut = rows.withColumn("start", start).withColumn("slot", F.when(F.col("bytes") * 2 > limit, alone).otherwise(shared))
        sums = cut.groupBy("hash", "slot").agg(F.sum("bytes").alias("shard_bytes"))
        name = F.concat(F.expr(f"lpad(bin(hash), {HASH_BITS}, '0')"), F.lit("."), F.col("slot"))
        done.append(cut.join(sums, ["hash", "slot"]).select("doc_id", name.alias("shard"), F.lit(HASH_BITS).alias("depth"), "bytes", "shard_bytes"))
    return reduce(DataFrame.unionByName, done).withColumn("depth", F.col("depth").cast("int")).withColumn("oversize", F.col("shard_bytes") > limit)
