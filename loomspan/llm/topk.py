"""Exact top-k inner-product search on a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.plans.storage import discard, materialize, release_memory

#: Rows of one index block, and queries whose slices are added together.
BLOCK_ROWS, TOGETHER = 4096, 64
#: Bytes of the queries that are broadcast at a time, and bytes of a query besides its components.
QUERY_BYTES, QUERY_WIDTH = 16 << 20, 64
#: Slices of each attribute that the bitmap sums use, from the most significant; the rest is bounded, then resolved.
KEPT_SLICES = 7
#: Vectors whose quantised components all stay within this are indexed: sums of 2^13 products are then below 2^63.
LIMIT = 1 << 25


def _pack(rows: np.ndarray) -> np.ndarray:
    """0/1 values (..., n) as words (..., n/64)."""
    pad = -rows.shape[-1] % 64
    rows = np.concatenate([rows, np.zeros((*rows.shape[:-1], pad), np.uint8)], axis=-1)
    return np.packbits(np.ascontiguousarray(rows), axis=-1, bitorder="little").view(np.uint64)


def slice_block(values: np.ndarray) -> tuple[int, np.ndarray]:
    """Unsigned attributes (values less their least) as slices (attribute, bit from the least, words), and the least."""
    least = int(values.min()) if values.size else 0
    raised = (values - least).T
    bits = max(1, int(raised.max()).bit_length()) if values.size else 1
    return least, np.stack([_pack(((raised >> b) & 1).astype(np.uint8)) for b in range(bits)], axis=1)


def _add(total: list[np.ndarray], addend: list[np.ndarray], at: int) -> None:
    """total += addend << at, slice by slice, with a ripple carry."""
    carry = None
    for i in range(at, len(total)):
        x = addend[i - at] if i - at < len(addend) else None
        if x is None and carry is None:
            return
        a = total[i]
        if x is None:
            total[i], carry = a ^ carry, a & carry
        elif carry is None:
            total[i], carry = a ^ x, a & x
        else:
            half = a ^ x
            total[i], carry = half ^ carry, (a & x) | (carry & half)


def _kth(total: list[np.ndarray], rows: np.ndarray, k: int) -> list[int]:
    """For each query the k-th largest sum among its rows (its least, if fewer), from the top slice downward."""
    above, equal = np.zeros_like(rows), rows.copy()
    value = [0] * len(rows)
    for i in range(len(total) - 1, -1, -1):
        with_bit = equal & total[i]
        enough = np.bitwise_count(above | with_bit).sum(axis=1, dtype=np.int64) >= k
        mask = np.where(enough, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]
        above = np.where(mask != 0, above, above | with_bit)
        equal = np.where(mask != 0, with_bit, equal & ~total[i])
        value = [v | (int(e) << i) for v, e in zip(value, enough, strict=True)]
    return value


def _at_least(total: list[np.ndarray], rows: np.ndarray, bounds: list[int]) -> np.ndarray:
    """Rows whose sum is at least the query's bound."""
    above, equal = np.zeros_like(rows), rows.copy()
    for i in range(len(total) - 1, -1, -1):
        one = np.array([(b >> i) & 1 for b in bounds], bool)[:, None]
        above = np.where(one, above, above | (equal & total[i]))
        equal = np.where(one, equal & total[i], equal & ~total[i])
    return above | equal


def resolve_block(ids: np.ndarray, rows: np.ndarray, values: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best rows by exact sums of any width; sums beyond 64 bits count as the nearest that fits."""
    found = []
    wide = values.astype(object)
    for q, own in enumerate(query_rows.tolist()):
        sums = wide @ queries[q].astype(object) if values.shape[1] else np.zeros(len(ids), object)
        scores = np.array([min(max(int(x), -(1 << 63) + 1), (1 << 63) - 1) for x in sums], np.int64)
        at = np.flatnonzero(rows != own)
        best = np.lexsort((ids[at], -scores[at]))[:k]
        found.append((q, at[best], scores[at[best]]))
    return found


def search_block(ids: np.ndarray, rows: np.ndarray, values: np.ndarray, slices: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best rows of the block, but its own: (query's place, rows' places, scores)."""
    n, dims = values.shape
    found = []
    everything = np.uint64(0xFFFFFFFFFFFFFFFF)
    drop = max(0, slices.shape[1] - KEPT_SLICES)
    for begin in range(0, len(queries), TOGETHER):
        w = queries[begin : begin + TOGETHER]
        others = _pack((rows[None, :] != query_rows[begin : begin + TOGETHER, None]).astype(np.uint8))
        weight = np.abs(w)
        # a negative weight counts the complement of an attribute: the sum moves by a constant of the query
        flip = np.where(w < 0, everything, np.uint64(0))
        most = int(weight.sum(axis=1).max(initial=0)) << (slices.shape[1] - drop)
        total = [np.zeros_like(others) for _ in range(max(1, most.bit_length()))]
        for d in range(dims):
            attribute = [slices[d, b][None, :] ^ flip[:, d, None] for b in range(drop, slices.shape[1])]
            for j in range(int(weight[:, d].max(initial=0)).bit_length()):
                use = np.where((weight[:, d] >> j) & 1, everything, np.uint64(0))[:, None]
                _add(total, [s & use for s in attribute], j)
        # what the dropped slices hold back is below their full weight, so no row under this bound can be among the best
        slack = [-(-((1 << drop) - 1) * int(x) // (1 << drop)) for x in weight.sum(axis=1)]
        bounds = [max(0, v - s) for v, s in zip(_kth(total, others, k), slack, strict=True)]
        boundary = _at_least(total, others, bounds) & others
        bits = np.unpackbits(boundary.view(np.uint8), axis=1, bitorder="little")[:, :n]
        for q in range(len(w)):
            at = np.flatnonzero(bits[q])
            scores = values[at] @ w[q]
            best = np.lexsort((ids[at], -scores))[:k]
            found.append((begin + q, at[best], scores[best]))
    return found


INDEX = "dims int, wide boolean, row_ids binary, ids binary, components binary, slices binary, n_slices int"
_INDEX = pa.schema([("dims", pa.int32()), ("wide", pa.bool_()), ("row_ids", pa.binary()), ("ids", pa.binary()), ("components", pa.binary()), ("slices", pa.binary()), ("n_slices", pa.int32())])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition's vectors, by length and width: bitmaps of the bits of each attribute."""
    held: dict[tuple[int, bool], list[list[np.ndarray]]] = {}

    def block(key: tuple[int, bool]) -> pa.RecordBatch:
        dims, wide = key
        row_ids, ids, flat = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
        values = flat.reshape(len(ids), dims)
        slices = np.zeros((0, 0, 0), np.uint64) if wide or not dims else slice_block(values)[1]
        row = (dims, wide, row_ids.tobytes(), ids.tobytes(), (values if wide else values.astype(np.int32)).tobytes(), slices.tobytes(), slices.shape[1])
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _INDEX, strict=True)], schema=_INDEX)

    for batch in batches:
        keys = np.stack([batch.column(3).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False).astype(np.int32)])
        for dims, wide in np.unique(keys, axis=1).T.tolist():
            own = batch.filter(pa.array((keys[0] == dims) & (keys[1] == wide)))
            key = (dims, bool(wide))
            for a in range(0, own.num_rows, BLOCK_ROWS):
                part = own.slice(a, BLOCK_ROWS)
                held.setdefault(key, []).append([part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).flatten().to_numpy()])
                if sum(len(x[0]) for x in held[key]) >= BLOCK_ROWS:
                    yield block(key)
    for key in list(held):
        yield block(key)
    release_memory()


def _block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, row_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["row_ids"], np.int64)
    values = np.frombuffer(row["components"], np.int64 if row["wide"] else np.int32).reshape(len(ids), row["dims"])
    return ids, row_ids, values.astype(np.int64)


def _asked(every: int):
    """The queries among the blocks' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, row_ids, values = _block(row)
                at = np.flatnonzero(ids % every == 0)
                columns = [pa.array([row["dims"]] * len(at), pa.int32()), pa.array([row["wide"]] * len(at), pa.bool_()), pa.array(row_ids[at]), pa.array(ids[at]), pa.array([v.tobytes() for v in values[at]], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["dims", "wide", "row_id", "vec_id", "components"])

    return run


def _search(shared, k: int):
    """A partition's blocks against the broadcast queries: the k best rows of the partition for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, bool], list[np.ndarray]] = {}  # of each kind of query: ids and scores, k columns
        for batch in batches:
            for row in batch.to_pylist():
                ids, row_ids, values = _block(row)
                for (dims, wide), (query_rows, _, weights) in shared.value.items():
                    if dims != row["dims"]:
                        continue
                    if wide or row["wide"] or not dims:
                        found = resolve_block(ids, row_ids, values, query_rows, weights, k)
                    else:
                        found = search_block(ids, row_ids, values, np.frombuffer(row["slices"], np.uint64).reshape(dims, row["n_slices"], -1), query_rows, weights, k)
                    held = best.setdefault((dims, wide), [np.zeros((len(query_rows), 0), np.int64)] * 2 + [np.zeros((len(query_rows), 0), bool)])
                    new = [np.zeros((len(query_rows), k), np.int64), np.zeros((len(query_rows), k), np.int64), np.zeros((len(query_rows), k), bool)]
                    for q, at, scores in found:
                        new[0][q, : len(at)], new[1][q, : len(at)], new[2][q, : len(at)] = ids[at], scores, True
                    both = [np.concatenate([h, x], axis=1) for h, x in zip(held, new, strict=True)]
                    order = np.lexsort((both[0], -both[1], ~both[2]), axis=1)[:, :k]
                    best[dims, wide] = [np.take_along_axis(x, order, axis=1) for x in both]
        for key, (ids, scores, there) in best.items():
            query_rows, query_ids, _ = shared.value[key]
            q, at = np.nonzero(there)
            columns = [query_rows[q], query_ids[q], ids[q, at], scores[q, at]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_row", "query_id", "vec_id", "score"])
        release_memory()

    return run


def _chunks(asked: DataFrame) -> tuple[DataFrame, int]:
    """asked with a chunk number; the counted bytes of every chunk stay below QUERY_BYTES (or it holds one query)."""
    count, dims = asked.agg(F.count("*"), F.max("dims")).first()
    n = max(1, -(-count * (8 * (dims or 0) + QUERY_WIDTH) * 5 // 4 // QUERY_BYTES))
    while True:
        chunked = asked.withColumn("chunk", F.pmod(F.xxhash64("row_id"), F.lit(n)))
        if n == 1 or chunked.groupBy("chunk").agg((F.sum(8 * F.col("dims") + QUERY_WIDTH)).alias("b"), F.count("*").alias("c")).filter((F.col("b") > QUERY_BYTES) & (F.col("c") > 1)).isEmpty():
            return chunked, n
        n *= 2


def exact_top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, every: int = 100, k: int = 10) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank, vec_id, score.

    Components become floor(scale * x). Queries are the rows whose id is divisible by every; candidates are all rows
    but the query's own. Each partition's rows are indexed where they are, in blocks of bitmaps, one for each bit of
    each attribute. Queries come to the blocks by broadcasts of at most QUERY_BYTES; a block adds the weighted slices
    with bitmap arithmetic, finds each query's k-th sum from the top slice downward, and resolves the rows within the
    slack of the dropped slices exactly. A partition keeps the k best of each query over all its blocks, so what is
    shuffled is k rows per query and partition, whatever the partition's size.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id. Vectors of
    unlike lengths are never compared; those without components score 0 with each other. Ties go to the smaller vec_id.
    Repeated rows compete each for itself, and each repeated query row gets ranks of its own. Vectors with a component
    beyond 2^25 are summed exactly without an index; a sum beyond 64 bits counts as the nearest number that fits. Ids
    must be numbers. An empty table gives an empty table. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    floor = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    rows = vectors.filter(usable).select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("vec_id"), floor.alias("components"), F.size(x).alias("dims"))
    rows = rows.withColumn("wide", F.exists("components", lambda v: (v > LIMIT) | (v < -LIMIT)))
    index = materialize(rows.mapInArrow(_index, INDEX))
    asked = materialize(index.select("dims", "wide", "row_ids", "ids", "components").mapInArrow(_asked(every), "dims int, wide boolean, row_id long, vec_id long, components binary"))
    chunked, chunks = _chunks(asked)
    done = []
    for c in range(chunks):  # a bounded part of the stated queries at a time
        queries: dict[tuple[int, bool], list] = {}
        for r in chunked.filter(F.col("chunk") == c).collect():
            queries.setdefault((r.dims, r.wide), []).append((r.row_id, r.vec_id, np.frombuffer(bytes(r.components), np.int64)))
        shared = spark.sparkContext.broadcast({key: (np.array([q[0] for q in own]), np.array([q[1] for q in own]), np.stack([q[2] for q in own])) for key, own in queries.items()})
        done.append(materialize(index.mapInArrow(_search(shared, k), "query_row long, query_id long, vec_id long, score long")))
        shared.unpersist()
    discard(index, asked)
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    best = reduce(DataFrame.unionByName, done)
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
