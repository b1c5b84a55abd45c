"""Exact dedup by an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.plans.storage import Numbered, delete_folder, discard, materialize, number_rows, release_memory, row_digest, shared_root, small_batches

#: Spark's own limit.
MOST_BUCKETS = 100_000
#: Documents whose fingerprints a sender holds and codes at a time, and fingerprints that an owner should get.
CHUNK, OWNED = 50_000, 1 << 21


def golomb_encode(values: np.ndarray, low: int, span: int) -> tuple[int, bytes]:
    """Sorted unsigned values in [low, low+span) as Rice-coded gaps: k remainder bits each, then unary quotients."""
    gaps = np.diff(values, prepend=np.uint64(low))
    k = max(0, (span // max(1, len(values))).bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = (gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)
    return k, np.packbits(np.concatenate([rest.astype(np.uint8).ravel(), unary])).tobytes()


def golomb_decode(blob: bytes, n: int, k: int, low: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(blob, np.uint8))
    rest = bits[: n * k].reshape(n, k).astype(np.uint64) << np.arange(k, dtype=np.uint64)[None, :]
    ones = np.flatnonzero(bits[n * k :])[:n]
    quotients = np.diff(ones, prepend=-1) - 1
    gaps = (quotients.astype(np.uint64) << np.uint64(k)) + rest.sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)


def _owner_range(owner: int, owners: int) -> tuple[int, int]:
    width = -(-(1 << 64) // owners)
    return owner * width, width


def _normalised(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 texts with A-Z lower-cased (bytes.lower touches ASCII only); null is empty."""
    return [(t or b"").lower() for t in column.cast(pa.large_binary()).to_pylist()]


SENT = pa.schema(
    [
        ("sender", pa.int32()),
        ("chunk", pa.int32()),
        ("messages", pa.list_(pa.struct([("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("blob", pa.binary())]))),
        ("digests", pa.binary()),  # what stays: the distinct digests in order, and the rows of each
        ("times", pa.list_(pa.int32())),
        ("row_ids", pa.list_(pa.int64())),
        ("doc_ids", pa.list_(pa.int64())),
        ("ties", pa.list_(pa.int64())),
    ]
)
SENT_DDL = "sender int, chunk int, messages array<struct<owner:int,n:int,k:int,blob:binary>>, digests binary, times array<int>, row_ids array<long>, doc_ids array<long>, ties array<long>"


def _send(owners: int):
    """Per chunk of a partition: to each owner its sorted distinct fingerprints, Golomb-coded; and what they stand for.

    Owners hold ranges of fingerprints, so the owners' messages in order spell the chunk's sorted digests.
    """

    def flush(sender: int, chunk: int, held: dict[bytes, list[tuple[int, int | None, int]]]) -> pa.RecordBatch:
        digests = sorted(held)
        prints = np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)
        width = _owner_range(0, owners)[1]
        at = (prints // np.uint64(width)).astype(np.int64) if width < 1 << 64 else np.zeros(len(prints), np.int64)
        messages = []
        for owner in np.unique(at).tolist():
            own = prints[np.searchsorted(at, owner) : np.searchsorted(at, owner, "right")]
            k, blob = golomb_encode(own, *_owner_range(owner, owners))
            messages.append({"owner": owner, "n": len(own), "k": k, "blob": blob})
        rows = [r for d in digests for r in held[d]]
        columns = [sender], [chunk], [messages], [b"".join(digests)], [[len(held[d]) for d in digests]], *([[r[k] for r in rows]] for k in range(3))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SENT, strict=True)], schema=SENT)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        sender, chunk, n = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for row, doc, tie, text in zip(*(batch.column(k).to_pylist() for k in range(3)), _normalised(batch.column(3)), strict=True):
                held.setdefault(hashlib.sha256(text).digest(), []).append((row, doc, tie))
                n += 1
            if n >= CHUNK:
                yield flush(sender, chunk, held)
                held, chunk, n = {}, chunk + 1, 0
        if held:
            yield flush(sender, chunk, held)
        release_memory()

    return send


def _reply(owners: int):
    """An owner's answer: for each message, a bitmap of the fingerprints that other messages hold too."""

    def reply(key: tuple, table: pa.Table) -> pa.Table:
        owner = key[0].as_py()
        low = _owner_range(owner, owners)[0]
        counts, ks, blobs = (table.column(c).to_pylist() for c in ("n", "k", "blob"))
        lists = [golomb_decode(b, n, k, low) for b, n, k in zip(blobs, counts, ks, strict=True)]
        everything = np.sort(np.concatenate(lists))
        twice = everything[1:][everything[1:] == everything[:-1]]
        bitmaps = [np.packbits(np.isin(x, twice)).tobytes() for x in lists]
        return pa.table({"sender": table.column("sender"), "chunk": table.column("chunk"), "owner": table.column("owner"), "bitmap": pa.array(bitmaps, pa.binary())})

    return reply


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answers on a chunk's own rows: one row per document, suspect if its fingerprint occurs again anywhere."""
    for batch in batches:
        for chunk, messages, digests, times, row_ids, doc_ids, ties, answers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            bitmap = {a["owner"]: a["bitmap"] for a in answers if a["chunk"] == chunk}
            bits = np.concatenate([np.unpackbits(np.frombuffer(bitmap[m["owner"]], np.uint8))[: m["n"]] for m in messages])
            times = np.array(times)
            suspect = np.repeat((bits > 0) | (times > 1), times)
            at = np.repeat(np.arange(len(times)), times)
            spelled = pa.Array.from_buffers(pa.binary(32), len(times), [None, pa.py_buffer(digests)]).take(pa.array(at))
            columns = [*(pa.array(c, pa.int64()) for c in (row_ids, doc_ids, ties)), spelled.cast(pa.binary()), pa.array(suspect)]
            yield pa.RecordBatch.from_arrays(columns, names=["row_id", "doc_id", "tie", "digest", "suspect"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _normalised(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(texts, pa.binary())], names=["digest", "bytes"])


def _answered(rows: DataFrame, owners: int) -> DataFrame:
    """(row_id, doc_id, tie, digest, suspect), written: coded fingerprints travel to owners and bitmaps come back.

    What the senders keep lies in a table that is bucketed by sender, so joining the bitmaps moves the bitmaps alone.
    """
    spark = rows.sparkSession
    buckets = min(owners, MOST_BUCKETS)
    name = f"loomspan_sent_{uuid4().hex}"
    path = f"{shared_root(spark)}/loomspan/{name}"
    rows.mapInArrow(_send(owners), SENT_DDL).write.bucketBy(buckets, "sender").option("path", path).format("parquet").saveAsTable(name)
    try:
        sent = spark.table(name)
        messages = sent.select("sender", "chunk", F.inline("messages"))
        replies = messages.groupBy("owner").applyInArrow(_reply(owners), "sender int, chunk int, owner int, bitmap binary")
        answers = replies.groupBy("sender").agg(F.collect_list(F.struct("chunk", "owner", "bitmap")).alias("answers"))  # one bit a row
        known = sent.select("sender", "chunk", F.transform("messages", lambda m: F.struct(m["owner"].alias("owner"), m["n"].alias("n"))).alias("messages"), "digests", "times", "row_ids", "doc_ids", "ties")
        joined = known.hint("merge").join(answers, "sender").select("chunk", "messages", "digests", "times", "row_ids", "doc_ids", "ties", "answers")
        return materialize(joined.mapInArrow(_apply, "row_id long, doc_id long, tie long, digest binary, suspect boolean"))
    finally:
        spark.sql(f"DROP TABLE {name}")
        delete_folder(spark, path)


def exact_dedup(docs: DataFrame | Numbered, *, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, row_id.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest doc_id stays. Partitions send
    each owner of a fingerprint range its sorted distinct 64-bit fingerprints, Golomb-coded; owners answer with a
    bitmap of those that several senders hold, which meets the digests and ids where they lie. Suspects' numbers go
    back to the scan as bitmaps, so only suspects' texts are shuffled, for byte verification: they are grouped by
    their bytes, pre-aggregated map-side, so a group of copies of any size sends one text per task; the distinct texts
    are written once. Owners grow in number with the rows.

    Nulls: a null text is empty; a null id is smaller than any other and stays only where a group has no id. Rows
    that tie for the largest id are told apart by a digest of all their columns, so the same text stays wherever the
    files lie, and by row only where they are equal throughout: exactly one row of a group is kept. An empty table gives an
    empty table. Other columns are ignored, whatever their names. Ids must be numbers. docs may come with row numbers.
    """
    numbered = docs if isinstance(docs, Numbered) else number_rows(docs)
    spark = numbered.df.sparkSession
    small_batches(spark)
    owners = owners or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-numbered.df.count() // OWNED))
    tie = row_digest(numbered.df.drop(numbered.row))
    rows = numbered.df.select(F.col(numbered.row).alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), tie.alias("tie"), F.col(text_col).alias("text"))
    marked = _answered(rows, owners)

    suspects = marked.filter("suspect")
    wanted = suspects.groupBy("digest").agg(F.count("*").alias("expected"), F.max(F.struct("doc_id", "tie", "row_id")).alias("best"))
    texts = lambda rows: rows.select(F.col(text_col).alias("text")).mapInArrow(_texts, "digest binary, bytes binary")
    copies = numbered.pick(suspects.select("row_id"), then=lambda rows: texts(rows).groupBy("digest", "bytes").agg(F.count("*").alias("copies")))
    verified = copies.groupBy("digest", "bytes").agg(F.sum("copies").alias("copies")).groupBy("digest").agg(F.count("*").alias("texts"), F.sum("copies").alias("copies"))
    sound = (F.col("texts") == 1) & (F.col("copies") == F.col("expected"))
    groups = wanted.join(verified, "digest").select(
        "digest",
        F.col("best.doc_id").alias("keep_id"),
        F.col("best.row_id").alias("keep_row"),
        F.when(sound, F.col("expected")).otherwise(F.raise_error(F.lit("texts of one digest differ")).cast("long")).alias("group_size"),
    )
    # written first, so that both sides of the join are plain exchanges and AQE can split a large group of copies
    groups = materialize(groups)
    discard(copies)
    grouped = suspects.join(groups, "digest").withColumn("kept", F.col("row_id") == F.col("keep_row"))
    alone = marked.filter("not suspect").select("*", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    columns = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "row_id"]
    return grouped.select(*columns).unionByName(alone.select(*columns))
