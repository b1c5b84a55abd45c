"""Cutting lineage through the cluster's shared folder, size-checked broadcasts, and rows picked where they lie."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows times their width stay below this.
BROADCAST_BYTES = 32 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where it is unset and all runs on one machine (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("loomspan.shared.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set("loomspan.shared.dir", root)
    return root.rstrip("/")


def _folder(spark: SparkSession, path: str):
    """The path and its file system, as the JVM knows them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside go at the end, but for those handed to the function that this yields."""
    tables: list[DataFrame] = []
    kept: list[DataFrame] = []
    _SCRATCH.append(tables)
    try:
        yield lambda table: kept.append(table) or table
    finally:
        _SCRATCH.remove(tables)
        discard(*(t for t in tables if not any(t is k for k in kept)))


def materialize(*parts: DataFrame) -> DataFrame:
    """Write a DataFrame, or several of one schema one after the other, as a Parquet table in the shared folder; read it back.

    Unlike localCheckpoint the files survive the loss of any executor; unlike checkpoint() the rows are computed
    once and are pruned by column when read again. The table goes by discard(), or when the driver's file system closes.
    """
    spark = parts[0].sparkSession
    path = f"{shared_root(spark)}/loomspan/{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(path)
    hadoop, files = _folder(spark, path)
    files.deleteOnExit(hadoop)
    table = spark.read.schema(parts[0].schema).parquet(path)
    table._written_at = path
    for tables in _SCRATCH[-1:]:
        tables.append(table)
    return table


def is_written(df: DataFrame) -> bool:
    """Whether df is a table that materialize() returned."""
    return hasattr(df, "_written_at")


def delete_folder(spark: SparkSession, path: str) -> None:
    hadoop, files = _folder(spark, path)
    files.delete(hadoop, True)
    files.cancelDeleteOnExit(hadoop)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more; only what materialize() returned is touched."""
    for table in tables:
        path = getattr(table, "_written_at", None)
        if path:
            delete_folder(table.sparkSession, path)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after counting the (materialised) side; beyond the limit the join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


#: Rows of an Arrow batch that holds whole texts: a worker's memory follows this, not the partition.
TEXT_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python workers a few at a time, unless the session asks for even fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def release_memory() -> None:
    """At the end of a task: give a Python worker's free memory back, since idle workers are kept."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def spread(scan: DataFrame) -> DataFrame:
    """Deal a scan of few splits (small files) over all cores; larger inputs have more splits and stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


#: Rows of a narrow table that one task is dealt.
DEALT_ROWS = 50_000


def dealt(rows: DataFrame, *keys: str, most: int = DEALT_ROWS) -> DataFrame:
    """Rows dealt by keys over so many tasks that one gets some most rows, whatever a scan's splits are by their bytes.

    Files of narrow, well packed rows have few splits, and partitions are joined by their packed size too; what
    a task holds of such rows in sorts and groupings would grow with the table. Tables of few rows stay as they are.
    """
    parts = -(-rows.count() // most)
    return rows.repartition(parts, *keys) if parts > 1 else rows


#: Rows that one bitmap stands for (fixed by Spark's bitmap functions), and its bytes with its key in a broadcast.
BITMAP_ROWS, BITMAP_BYTES = 1 << 15, (1 << 12) + 64
#: Files are numbered by a hash of so many bits, in steps of a bitmap's rows.
FILE_BITS = 62
_MOST_ROWS = 1 << 40


def free_name(df: DataFrame, name: str) -> str:
    """name, with marks added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@dataclass
class Numbered:
    """A table whose rows bear numbers that every scan draws alike, whatever the splits of the moment."""

    df: DataFrame
    row: str  # the number's column
    first: Column  # the number of the first row of the row's file

    def marks(self, counts: DataFrame, most: int = 1) -> DataFrame:
        """The counts (0 to most) of listed row numbers, columns in this order, as a written table of bitmaps."""
        number, count = (F.col(c) for c in counts.columns)
        at = F.when(count > 0, number.bitwiseAND(BITMAP_ROWS - 1))
        planes = [F.bitmap_construct_agg(F.when(F.shiftright(count, p).bitwiseAND(1) == 1, at)).alias(f"bits{p}") for p in range(most.bit_length())]
        return materialize(counts.select(F.shiftright(number, 15).alias("block"), *counts.columns).groupBy("block").agg(*planes))

    def _marked(self, marks: DataFrame, name: str) -> DataFrame:
        row, out = F.col(self.row), self.df
        block = free_name(out, "__block")
        renamed, planes = [F.col("block").alias(block)], marks.columns[1:]
        for p in planes:
            renamed.append(F.col(p).alias(free_name(out, f"__{p}")))
        joined = out.withColumn(block, F.shiftright(row, 15)).join(F.broadcast(marks.select(*renamed)), block, "left")
        at, power = F.shiftright(row.bitwiseAND(BITMAP_ROWS - 1), 3).cast("int") + 1, F.element_at(F.array(*(F.lit(1 << b) for b in range(8))), row.bitwiseAND(7).cast("int") + 1)
        count = F.lit(0)
        for p in range(len(planes)):
            byte = F.conv(F.hex(F.substring(free_name(out, f"__bits{p}"), at, 1)), 16, 10).cast("int")
            count = count + F.when(byte.bitwiseAND(power) != 0, 1 << p).otherwise(0)
        return joined.withColumn(name, count).select(*out.columns, name)

    def _groups(self, marks: DataFrame, name: str, limit: int) -> list[DataFrame]:
        """The table with each row's count in column name, by groups of files whose bitmaps stay below limit bytes."""
        groups = max(1, -(-marks.count() * BITMAP_BYTES * (len(marks.columns) - 1) // limit))
        if groups == 1:
            return [self._marked(marks, name)]
        edges = [(1 << FILE_BITS) // groups * g >> 15 << 15 for g in range(groups)] + [(1 << FILE_BITS) + _MOST_ROWS]
        parts = []
        for low, high in zip(edges, edges[1:], strict=False):
            # the first condition prunes files; a file that reaches over an edge is read for both groups
            part = self.df.filter((self.first < high) & (self.first > low - _MOST_ROWS)).filter(F.col(self.row).between(low, high - 1))
            own = marks.filter(F.col("block").between(low >> 15, (high - 1) >> 15))
            parts.append(Numbered(part, self.row, self.first)._marked(own, name))
        return parts

    def counted(self, marks: DataFrame, name: str, then: Callable[[DataFrame], DataFrame], limit: int = BROADCAST_BYTES) -> DataFrame:
        """What then makes of the table with each row's count in column name, 0 where none is listed; no row is shuffled.

        The bitmaps, one bit a row and power of two, are broadcast to where the rows are read, for a group of files at
        a time, so a broadcast has the same bound at every size and each file is read once. then works row by row,
        and only what it returns is ever written: of several groups each is, one after the other, as one table that
        run() takes as the stage's own; of one group the caller writes it.
        """
        parts = [then(p) for p in self._groups(marks, name, limit)]
        return parts[0] if len(parts) == 1 else materialize(*parts)

    def pick(self, numbers: DataFrame, *, keep: bool = True, then: Callable[[DataFrame], DataFrame] = lambda rows: rows, limit: int = BROADCAST_BYTES) -> DataFrame:
        """What then makes of the rows whose numbers (the one column) are listed, or of all others, as a written table.

        Rows are left out and then is applied before anything is written, so what is written depends on neither
        the limit nor the number of groups.
        """
        name = free_name(self.df, "__listed")
        marks = self.marks(numbers.select(numbers.columns[0], F.lit(1).alias("n")))
        table = materialize(*(then(p.filter(F.col(name) == int(keep)).select(*self.df.columns)) for p in self._groups(marks, name, limit)))
        discard(marks)
        return table


def row_digest(df: DataFrame) -> Column:
    """A digest of a row's columns, which tells rows apart by what they hold; maps are read as JSON."""
    quoted = {f.name: "`" + f.name.replace("`", "``") + "`" for f in df.schema.fields}
    texts = [F.to_json(F.struct(quoted[f.name])) if "map<" in f.dataType.simpleString() else F.col(quoted[f.name]) for f in df.schema.fields]
    return F.xxhash64(*texts) if texts else F.lit(0).cast("long")


def number_rows(docs: DataFrame) -> Numbered:
    """docs with a long number for each row: a hash of its file's name plus its place in the file.

    Tables that are no plain Parquet scan are written first. Numbers of different files never meet: the ranges are
    compared (one row per file), and another hash is taken if two overlap.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta["file_path"], meta["row_index"])
    except AnalysisException:
        docs = materialize(docs)
        meta = docs.metadataColumn("_metadata")
    row = free_name(docs, "__row")
    for seed in range(8):
        first = F.shiftleft(F.shiftright(F.xxhash64(F.lit(seed), meta["file_path"]).bitwiseAND((1 << FILE_BITS) - 1), 15), 15)
        files = docs.select(first.alias("first"), meta["file_path"].alias("path"), meta["row_index"].alias("at")).groupBy("first", "path").agg(F.max("at").alias("last"))
        following = files.withColumn("next", F.lead("first").over(W.orderBy("first")))  # one row per file
        if following.filter(F.col("next") <= F.col("first") + F.col("last")).isEmpty():
            return Numbered(docs.withColumn(row, first + meta["row_index"]), row, first)
    raise RuntimeError("file names hash to overlapping numbers")
