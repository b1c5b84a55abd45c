"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.components import connected_components
from loomspan.plans.storage import materialize, release_memory, small_batches

SEED = 42
BITS, SEGMENTS = 64, 2
WIDTH = BITS // SEGMENTS
#: Shingles whose bits are summed at a time.
BLOCK = 65_536
#: Index buckets with more fingerprints than this are divided further before any probe meets them.
HEAVY = 512


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, A-Z lower-cased; 0 for a text without words."""
    words = text.lower().split()  # bytes: ASCII letters, and white space as \\x20 and \\x09-\\x0D
    if not words:
        return 0
    k = words_per_shingle
    if len(words) < k:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), BLOCK):
        block = hashes[a : a + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def _fingerprints(words_per_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t or b"", words_per_shingle) for t in batch.column(2).cast(pa.large_binary()).to_pylist()]
            signed = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signed, pa.int64())], names=["row_id", "doc_id", "fp"])
        release_memory()

    return run


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * i).bitwiseAND((1 << WIDTH) - 1)


def _tagged(value: Column, tag: int, width: int) -> Column:
    return value + F.lit(tag << width).cast("long")


def _ball(value: Column, tag: int, width: int) -> Column:
    """The value and every value at one bit from it, tagged."""
    return F.array(_tagged(value, tag, width), *(_tagged(value.bitwiseXOR(F.lit(1 << b).cast("long")), tag, width) for b in range(width)))


def hamming_links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """(src, dst), src < dst, for all pairs of distinct fingerprints at up to distance (at most 3) differing bits.

    Two segments of 32 bits: of two fingerprints within 3 bits, one segment differs in at most 1. Each fingerprint
    stands in the table under its 2 segments and probes the 33 values of each segment's ball; the full distance
    is verified inside the join. Buckets of more than HEAVY fingerprints are divided by the other segment's two
    halves, probed in the same way, so a pair is never missed and buckets stay below 2^16 fingerprints.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius 1 cover distances up to 3")
    segments = [F.struct(_tagged(_segment(F.col("fp"), i), i, WIDTH).alias("key"), _segment(F.col("fp"), 1 - i).alias("rest")) for i in range(SEGMENTS)]
    index = prints.select("fp", F.explode(F.array(*segments)).alias("s")).select("s.key", "s.rest", F.col("fp").alias("dst"))
    balls = F.flatten(F.array(*(_ball(_segment(F.col("fp"), i), i, WIDTH) for i in range(SEGMENTS))))
    probes = prints.select(F.col("fp").alias("src"), F.explode(balls).alias("key"))
    near = (F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= distance)

    heavy = materialize(index.groupBy("key").count().filter(F.col("count") > HEAVY).select("key"))
    if heavy.isEmpty():
        return probes.join(index, (probes["key"] == index["key"]) & near).select("src", "dst").distinct()
    light = index.join(heavy, "key", "left_anti")
    links = probes.join(light, (probes["key"] == light["key"]) & near).select("src", "dst")
    half = WIDTH // 2
    halves = [F.shiftrightunsigned("rest", half * i).bitwiseAND((1 << half) - 1) for i in range(2)]
    finer = index.join(heavy, "key").select("key", "dst", F.explode(F.array(*(_tagged(h, i, half) for i, h in enumerate(halves)))).alias("part"))
    rest = F.when(F.shiftrightunsigned("key", WIDTH) == 0, _segment(F.col("src"), 1)).otherwise(_segment(F.col("src"), 0))
    asked = probes.join(heavy, "key").withColumn("rest", rest)
    parts = F.flatten(F.array(*(_ball(h, i, half) for i, h in enumerate(halves))))
    asked = asked.select("key", "src", F.explode(parts).alias("part"))
    refined = asked.join(finer, (asked["key"] == finer["key"]) & (asked["part"] == finer["part"]) & near).select("src", "dst")
    return links.unionByName(refined).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, words_per_shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, kept, row_id, first_row (that of the row kept).

    Documents with equal fingerprints are one class, found by a pre-aggregated groupBy; links are sought between
    classes only. component_id is the smallest doc_id of all documents that links reach.

    Nulls: a null text has no words and fingerprint zero, which links like any other; a null id counts as larger
    than any other, and component_id is null only if the whole component has none. kept marks one row of a component:
    that of component_id, the first such row where rows repeat. An empty table gives an empty table. Other columns are
    ignored, whatever their names. row_col names a unique row number of the caller's.
    """
    small_batches(docs.sparkSession)
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(row.alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = materialize(rows.mapInArrow(_fingerprints(words_per_shingle), "row_id long, doc_id long, fp long"))
    # nulls last: (is null, id, row)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("first")
    classes = materialize(prints.groupBy("fp").agg(first))
    links = materialize(hamming_links(classes.select("fp"), distance))
    component = connected_components(links).select(F.col("node").alias("fp"), F.col("component"))
    labelled = classes.join(component, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    labelled = materialize(labelled)
    best = materialize(labelled.groupBy("component").agg(F.min("first").alias("first")))  # written, so AQE can split a large component
    named = labelled.select("fp", "component").join(best, "component").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.row_id").alias("first_row"))
    return prints.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        (F.col("row_id") == F.col("first_row")).alias("kept"),
        "row_id",
        "first_row",
    )
