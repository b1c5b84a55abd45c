"""Near copies by the similarity of word shingles: min-hash bands find candidates, whole shingle sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.components import connected_components
from loomspan.plans.storage import Numbered, discard, materialize, number_rows, release_memory, row_digest, small_batches

SEED = 42
WORDS = 5
#: Documents are linked from this Jaccard similarity on, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: A pair at similarity s shares no band with probability (1 - s^5)^30: seven in a million at 0.8, less above.
BANDS, BAND_ROWS = 30, 5
#: Words of 64 bits, a bit of one min-hash each. At 0.8 some 19 of 192 bits differ (standard deviation 4).
SKETCH, SKETCH_BITS = 3, 41
#: Words of 64 bits that hold the parities of a set's hashes by their last bits. Two sets differ in as many shingles as
#: their parities do, at least, so for texts of some hundred words this tells pairs just below the similarity apart.
PARITY = 8
#: Shingles that are min-hashed at a time.
BLOCK = 4096
#: Bands shared by more classes than this first compare random groups of SLOT classes, then by their rarest shingles.
HEAVY, SLOT = 32, 6
#: Ratio of the bounds of a bin of sizes.
STEP = 1.02

_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 64, (64 * SKETCH, 1), np.uint64) | np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 64, (64 * SKETCH, 1), np.uint64)
_MIX = _RANDOM.integers(0, 1 << 64, BAND_ROWS, np.uint64) | np.uint64(1)
_BAND = _RANDOM.integers(0, 1 << 64, BANDS, np.uint64)


def shingle_set(text: bytes, words_per_shingle: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a UTF-8 text's word shingles, A-Z lower-cased; a shorter text is one shingle."""
    words = text.lower().split()  # bytes: ASCII letters, and white space as \\x20 and \\x09-\\x0D
    if not words:
        return np.empty(0, np.uint64)
    k = min(words_per_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(k)), strict=False)), np.uint64))


def band_keys(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One key per band of min-hashes, none for a text without words; and the sketch with the parities."""
    if not len(shingles):
        return np.empty(0, np.int64), np.zeros(SKETCH + PARITY, np.int64)
    least = np.full(64 * SKETCH, (1 << 64) - 1, np.uint64)
    for a in range(0, len(shingles), BLOCK):
        np.minimum(least, (shingles[a : a + BLOCK] * _FACTORS + _OFFSETS).min(axis=1), out=least)
    keys = (least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + _BAND
    bits = (least * _MIX[0] >> np.uint64(63)).astype(np.uint8)
    odd = np.bincount((shingles % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return keys.view(np.int64), np.packbits(np.concatenate([bits, odd.astype(np.uint8)])).view(np.int64)


def _class(shingles: np.ndarray) -> int:
    """Documents of one set are one class."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t or b"") for t in batch.column(2).cast(pa.large_binary()).to_pylist()]
        classes = [*map(_class, sets)]
        bands, sketches = zip(*map(band_keys, sets), strict=True) if sets else ((), ())
        columns = [pa.array(classes, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), *columns], names=["row_id", "doc_id", "tie", "class", "size", "bands", "sketch"])
    release_memory()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t or b"") for t in batch.column(0).cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([*map(_class, sets)], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "shingles"])
    release_memory()


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["src", "dst"])


def _sets_of(classes: DataFrame, heads: DataFrame, numbered: Numbered, text_col: str) -> DataFrame:
    """(class, shingles) of the listed classes, written: their texts alone leave the scan, as shingle sets."""
    rows = heads.join(classes, "class", "left_semi").select("row_id")
    return numbered.pick(rows, then=lambda found: found.select(F.col(text_col).alias("text")).mapInArrow(_sets, "class long, shingles binary"))


def _links(pairs: DataFrame, heads: DataFrame, numbered: Numbered, text_col: str) -> DataFrame:
    """Those of the pairs (src, dst) of classes whose whole shingle sets are similar enough, as a written table."""
    pairs = materialize(pairs.distinct())
    sets = _sets_of(pairs.select(F.explode(F.array("src", "dst")).alias("class")).distinct(), heads, numbered, text_col)
    sides = [sets.select(F.col("class").alias(side), F.col("shingles").alias(f"{side}_set")).hint("merge") for side in ("src", "dst")]
    joined = pairs.join(sides[0], "src").join(sides[1], "dst").select("src", "dst", "src_set", "dst_set")
    links = materialize(joined.mapInArrow(_similar, "src long, dst long"))
    discard(pairs, sets)
    return links


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cls, blob in zip(batch.column(0), batch.column(1), strict=True):
            shingles = pa.array(np.frombuffer(blob.as_buffer(), np.int64))
            for a in range(0, len(shingles), 1 << 16):
                part = shingles[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.repeat(cls, len(part)), part], names=["class", "shingle"])


def _least_of(size: Column, other: Column) -> Column:
    """Shingles that two sets of these sizes have in common at least, if they are similar enough (0.8: 4/9 of both)."""
    return F.ceil((size + other) * F.lit(NUMERATOR / (NUMERATOR + DENOMINATOR)) - F.lit(1e-9))


def rare_entries(sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(shingle, low, high, side, class): where similar classes are bound to meet, for classes in crowded bands.

    Put every set in one order, the rarest shingles first. Two sets that have at least c shingles in common meet in the
    first size - c + 1 of either, and c follows from both sizes. So sizes are dealt over bins whose bounds are STEP
    apart, and each set is entered once for every bin its partner may come from, under as many of its first shingles as
    that bin's least c leaves. Shingles of one set only can meet nobody: they fill places but are not entered. What a
    template repeats in all its texts is frequent and stands behind the texts' own shingles, so texts that differ in
    more than similarity allows share no entry.
    """
    elements = sets.mapInArrow(_elements, "class long, shingle long")
    often = materialize(elements.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1"))
    common = elements.join(often.hint("merge"), "shingle").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("common"))
    ordered = common.join(sizes.select("class", "size"), "class")
    alone = F.col("size") - F.size("common")  # these come first
    first = F.greatest(F.lit(0), F.col("size") - F.ceil(F.col("size") * F.lit(NUMERATOR / DENOMINATOR) - F.lit(1e-9)) + 1 - alone).cast("int")
    entries = ordered.select("class", "size", alone.alias("alone"), F.posexplode(F.slice("common", 1, first)).alias("at", "c"))
    bin_of = lambda size: F.floor(F.log(size.cast("double")) / F.lit(math.log(STEP))).cast("int")
    own, reach = bin_of(F.col("size")), math.ceil(math.log(DENOMINATOR / NUMERATOR) / math.log(STEP)) + 1
    bound = F.pow(F.lit(STEP), F.col("other").cast("double")) * F.lit(1 - 1e-9)  # the least size in the partner's bin
    entries = entries.withColumn("own", own).withColumn("other", F.explode(F.sequence(own - reach, own + reach)))
    entries = entries.filter(F.col("alone") + F.col("at") < F.col("size") - _least_of(F.col("size"), F.greatest(bound, F.col("size") * F.lit(NUMERATOR / DENOMINATOR))) + 1)
    side = F.signum(F.col("other") - F.col("own")).cast("int")
    return entries.select(F.col("c.shingle").alias("shingle"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), side.alias("side"), "class")


def _met(entries: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst) for classes of different components that share an entry, if sizes and sketches allow a link.

    Where an entry's largest component is met by others, only the others look at all of it: its own pairs are never made.
    """
    key = ["shingle", "low", "high"]
    placed = materialize(entries.join(members, "class"))
    parts = placed.groupBy(*key, "component").agg(F.count("*").alias("n"))
    main = parts.groupBy(*key).agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    main = materialize(main.select(*key, F.col("main.component").alias("main")))
    crowd = materialize(placed.join(main.hint("merge"), key))
    columns = ("side", "class", "component", "size", "sketch")
    few = crowd.filter("component <> main").select(*key, *(F.col(c).alias(f"src_{c}") for c in columns))
    every = crowd.select(*key, *(F.col(c).alias(f"dst_{c}") for c in columns))
    apart = (F.col("src_component") != F.col("dst_component")) & (F.col("src_side") == -F.col("dst_side"))
    pairs = materialize(_allowed(few.join(every, key).filter(apart)).distinct())
    discard(placed, main, crowd)
    return pairs


def _allowed(joined: DataFrame) -> DataFrame:
    """(src, dst) for those pairs whose sizes and sketches allow a link."""
    sizes = DENOMINATOR * F.least("src_size", "dst_size") >= NUMERATOR * F.greatest("src_size", "dst_size")
    bits = [F.bit_count(F.col("src_sketch")[i].bitwiseXOR(F.col("dst_sketch")[i])) for i in range(SKETCH + PARITY)]
    alike = sum(bits[1:SKETCH], bits[0]) <= SKETCH_BITS
    odds = (DENOMINATOR + NUMERATOR) * sum(bits[SKETCH + 1 :], bits[SKETCH]) <= (DENOMINATOR - NUMERATOR) * (F.col("src_size") + F.col("dst_size"))
    return joined.filter(sizes & alike & odds).select(F.least("src_class", "dst_class").alias("src"), F.greatest("src_class", "dst_class").alias("dst"))


def _pairs(members: DataFrame, keys: list[str]) -> DataFrame:
    """(src, dst) for all classes of equal keys whose sizes and sketches allow a link."""
    sides = [members.select(*keys, *(F.col(c).alias(f"{s}_{c}") for c in ("class", "size", "sketch"))) for s in ("src", "dst")]
    return _allowed(sides[0].join(sides[1], keys).filter("src_class < dst_class"))


def near_copies(docs: DataFrame | Numbered, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, component_id, kept, row_id, first_row (that of the row kept).

    Documents are linked when the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Candidates
    share a min-hash band and have sketches that allow a link; each is decided by the two whole sets. Bands of
    at most HEAVY classes compare all pairs. Larger ones compare random groups of some SLOT classes; what is then still
    in different components meets by its rarest shingles (rare_entries), which misses no link at all. So a linked
    group costs few pairs, and texts of one template that are not similar enough cost none.

    Nulls: a null text has no words, and texts without words are one class; a null id counts as larger than any
    other. kept marks one row of a component: that of the smallest doc_id; of rows that share it, the first by a digest
    of all their columns, and by row number only where rows are equal throughout. An
    empty table gives an empty table. Other columns are ignored, whatever their names. Ids must be numbers. docs may
    come with row numbers.
    """
    numbered = docs if isinstance(docs, Numbered) else number_rows(docs)
    small_batches(numbered.df.sparkSession)
    tie = row_digest(numbered.df.drop(numbered.row))
    rows = numbered.df.select(F.col(numbered.row).alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), tie.alias("tie"))
    prints = materialize(rows.mapInArrow(_prints, "row_id long, doc_id long, tie long, class long, size int, bands array<long>, sketch array<long>"))
    # nulls last: (is null, id, digest, row)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie", "row_id")).alias("first")
    classes = materialize(prints.groupBy("class").agg(first))
    heads = prints.join(classes.select(F.col("first.row_id").alias("row_id")), "row_id", "left_semi").select("class", "row_id", "size", "bands", "sketch")
    heads = materialize(heads)
    banded = heads.select("class", F.explode("bands").alias("key"))
    shared = materialize(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    # merged at any size: disk and shuffle then grow with the input, without a step
    members = materialize(banded.join(shared.hint("merge"), "key").join(heads.select("class", "size", "sketch"), "class"))
    discard(shared)

    light, heavy = members.filter(F.col("n") <= HEAVY), materialize(members.filter(F.col("n") > HEAVY))
    slots = heavy.withColumn("slot", F.pmod(F.xxhash64("key", "class"), F.ceil(F.col("n") / SLOT)))
    links = _links(_pairs(light, ["key"]).unionByName(_pairs(slots, ["key", "slot"])), heads, numbered, text_col)
    discard(members)
    component = connected_components(links)
    if not heavy.isEmpty():
        placed = heavy.join(component, F.col("class") == F.col("node"), "left")
        placed = materialize(placed.select("key", "class", "size", "sketch", F.coalesce("component", "class").alias("component")))
        mixed = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("key")
        crowded = materialize(placed.join(mixed, "key", "left_semi").drop("key").dropDuplicates(["class"]))
        if not crowded.isEmpty():
            sets = _sets_of(crowded.select("class"), heads, numbered, text_col)
            further = _links(_met(rare_entries(sets, crowded), crowded), heads, numbered, text_col)
            discard(sets)
            if not further.isEmpty():
                component = connected_components(links.unionByName(further))
        discard(placed, crowded)
    discard(heavy)

    component = component.select(F.col("node").alias("class"), "component")
    labelled = materialize(classes.join(component, "class", "left").withColumn("component", F.coalesce("component", "class")))
    best = materialize(labelled.groupBy("component").agg(F.min("first").alias("first")))  # written, so AQE can split a large component
    named = materialize(labelled.select("class", "component").join(best, "component").select("class", F.col("first.doc_id").alias("component_id"), F.col("first.row_id").alias("first_row")))
    return prints.join(named, "class").select("doc_id", "component_id", (F.col("row_id") == F.col("first_row")).alias("kept"), "row_id", "first_row")
