"""Many small groups in one Python pass: rows arrive sorted by group, so no group costs a call of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a result batch.
BATCH = 10_000


def map_groups(df: DataFrame, keys: list[str], make: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows (of schema) that make returns for each group: its keys and its rows, the other columns in their order.

    Groups are hashed to partitions and sorted there; a task holds one group at a time and a batch of results.
    """
    fields, n = to_arrow_schema(StructType.fromDDL(schema)), len(keys)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        for key, group in groupby(rows, key=lambda row: row[:n]):
            out.extend(make(key, [row[n:] for row in group]))
            if len(out) >= BATCH:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    ordered = df.select(*keys, *(c for c in df.columns if c not in keys)).repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, schema)
