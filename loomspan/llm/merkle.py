"""A Merkle manifest of a dataset: a root over all rows, and for every row the proof that leads to it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.plans.storage import broadcast_if_small, materialize, scratch

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a run, and levels that one superblock collapses: a task holds 3^5 nodes of a tree at a time.
FANOUT, LEVELS = 3, 5
BLOCK = FANOUT**LEVELS
DIGEST = 64  # hex digits


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth(nodes: int) -> int:
    """Levels that lead from so many nodes to one."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FANOUT), levels + 1
    return levels


def _layers(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and what they become, level by level."""
    out = [nodes]
    for _ in range(levels):
        out.append([_hash("".join(out[-1][i : i + FANOUT])) for i in range(0, len(out[-1]), FANOUT)])
    return out


def _steps(layers: list[list[str]], at: int) -> list[str]:
    """A node's proof: per level its place in its run as a digit, then the run's other nodes."""
    steps = []
    for layer in layers[:-1]:
        first, place = at - at % FANOUT, at % FANOUT
        run = layer[first : first + FANOUT]
        steps.append(str(place) + "".join(run[:place] + run[place + 1 :]))
        at //= FANOUT
    return steps


def fold(node: str, proof: list[str]) -> str:
    """The root that a node and its proof lead to."""
    for step in proof:
        cut = 1 + int(step[0]) * DIGEST
        node = _hash(step[1:cut] + node + step[cut:])
    return node


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of the values, each with its length in bytes before it; nulls are told from empty strings."""
    return F.sha2(F.concat(*map(_field, columns)), 256)


def _count_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds part and local: this task's number, and the row's place among its key's rows in this task's sorted rows."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column(batch.schema.get_field_index("key")))
        ends = np.asarray(runs.run_ends, np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        local = np.arange(batch.num_rows) - np.repeat(starts, ends - starts)
        if runs.values[0].as_py() == last:
            local[: ends[0]] += seen
        last, seen = runs.values[-1].as_py(), int(local[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(local, pa.int64())], names=[*batch.schema.names, "part", "local"])


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with a column key that is never null) and pos, its place from 0 among its key's rows, and n, their number.

    Rows are dealt by ranges of key and order, so a key with any share of the rows lies in many tasks; each counts off
    its own part, and one row per task and key is summed up.
    """
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange("key", *order, "tie").sortWithinPartitions("key", *order, "tie").drop("tie")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    counted = materialize(dealt.mapInArrow(_count_off, f"{kinds}, part int, local long"))
    parts = counted.groupBy("key", "part").agg(F.count("*").alias("rows"))
    whole = W.partitionBy("key")
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = materialize(parts.select("key", "part", before.alias("before"), F.sum("rows").over(whole).alias("n")))
    return counted.join(broadcast_if_small(parts, 200), ["key", "part"]).withColumn("pos", F.col("before") + F.col("local")).select(*rows.columns, "pos", "n")


def _collapse(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """A superblock's root."""
    frame = frame.sort_values("pos")
    n = int(frame["n"].iloc[0])
    root = _layers(frame["node"].tolist(), min(LEVELS, depth(n)))[-1][0]
    return pd.DataFrame({"key": [key[0]], "pos": [key[1]], "node": [root], "n": [-(-n // BLOCK)]})


def reduce_tree(leaves: DataFrame) -> list[DataFrame]:
    """The nodes (key, pos, node, n) of every LEVELS-th level, leaves first; each key ends with one node."""
    stages, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while len(stages) == 1 or most > 1:
        nodes = stages[-1].select("key", "pos", "node", "n", F.expr(f"pos div {BLOCK}").alias("block"))
        stages.append(materialize(nodes.groupBy("key", "block").applyInPandas(_collapse, "key string, pos long, node string, n long")))
        most = -(-most // BLOCK)
    return stages


def _blocks(stage: DataFrame, above: DataFrame, task, schema: str) -> DataFrame:
    """task(key, a superblock's nodes, the one row that holds its root's proof) for every superblock."""
    nodes = stage.withColumn("block", F.expr(f"pos div {BLOCK}"))
    return nodes.groupBy("key", "block").cogroup(above.withColumnRenamed("pos", "block").groupBy("key", "block")).applyInArrow(task, schema)


def _proofs_of(nodes: pa.Table, above: pa.Table) -> Iterator[tuple[int, list[str]]]:
    """(row, proof) for a superblock's nodes: the steps within it, then those of its root."""
    pos = np.asarray(nodes.column("pos"), np.int64)
    rows = np.argsort(pos)
    layers = _layers(nodes.column("node").take(pa.array(rows)).to_pylist(), min(LEVELS, depth(nodes.column("n")[0].as_py())))
    upper = above.column("proof")[0].as_py()
    for at, row in enumerate(rows.tolist()):
        yield row, _steps(layers, at) + upper


def _descend(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
    proofs = [p for _, p in sorted(_proofs_of(nodes, above))]
    return pa.table({"key": nodes.column("key"), "pos": nodes.column("pos"), "proof": pa.array(proofs, pa.list_(pa.string()))})


def _prove(with_proofs: bool):
    def prove(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
        subroot, root = above.column("subroot")[0].as_py(), above.column("root")[0].as_py()
        given = nodes.column("given").to_pylist()
        proofs, digests, folded = [[] for _ in given], [""] * len(given), [""] * len(given)
        for row, proof in _proofs_of(nodes, above):
            digests[row] = _hash("".join(step[1:] for step in proof))
            folded[row] = fold(given[row], proof)
            proofs[row] = proof
        text = lambda values: pa.array(values, pa.string())
        out = {"doc_id": nodes.column("doc_id"), "leaf": nodes.column("node"), "subroot": text([subroot] * len(given)), "root": text([root] * len(given))}
        out |= {"proof_sha256": text(digests), "folded_root": text(folded), "verified": pa.array([f == root for f in folded])}
        return pa.table(out | ({"proof": pa.array(proofs, pa.list_(pa.string()))} if with_proofs else {}))

    return prove


def merkle_manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", given: dict[str, Column] | None = None, with_proofs: bool = False) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and the proof if asked for.

    A leaf is the digest of the row's fields. Per source, leaves in the order of their ids become one subroot, every
    FANOUT consecutive nodes their digest; subroots in the order of their sources become the root. given holds columns
    as somebody else has them: the leaf made with them is folded with the row's own proof, and verified tells whether
    the root comes out (given none: always).

    Superblocks of FANOUT^LEVELS nodes are collapsed in one task each, then their roots likewise, until one is left.
    Proofs come down the same way: a superblock's own steps, then those of its root, so no proof but the asked for is
    ever written, and a task holds one superblock.

    Nulls: a null field is told from an empty one; a null source is a source of its own, the first; null ids come
    first. Rows that repeat an id are ordered by their leaves, so rows that repeat throughout may change places. A lone
    leaf is its source's subroot, a lone subroot the root. An empty table gives an empty table. Other columns are
    ignored, whatever their names. Ids must be numbers.
    """
    own, other = ([(columns or {}).get(c, F.col(c)) for c in fields] for columns in (None, given))
    node = leaf_digest(own)
    key = F.coalesce(F.concat(F.lit("+"), F.col(source_col).cast("string")), F.lit(""))  # a null source sorts first
    leaves = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), node.alias("node"), (leaf_digest(other) if given else F.lit(None).cast("string")).alias("given"))
    with scratch() as keep:
        stages = reduce_tree(keep(materialize(ranked(leaves.withColumn("given", F.coalesce("given", "node")), ["doc_id", "node"]))))
        for stage in stages[1:]:
            keep(stage)
        # the tree of subroots, with its source in the place of a leaf
        subroots = stages[-1].select(F.lit("").alias("key"), F.col("key").alias("of"), "node")
        top = reduce_tree(materialize(ranked(subroots, ["of"])))
        proofs = top[-1].select("key", "pos", F.array().cast("array<string>").alias("proof"))
        for stage in reversed(top[:-1]):
            proofs = _blocks(stage.select("key", "pos", "node", "n"), proofs, _descend, "key string, pos long, proof array<string>")
        root = top[-1].select("key", F.col("node").alias("root"))
        above = top[0].join(proofs.select("pos", "proof"), "pos").join(root, "key")
        above = keep(materialize(above.select(F.col("of").alias("key"), F.lit(0).cast("long").alias("pos"), "proof", F.col("node").alias("subroot"), "root")))
    proofs = above.select("key", "pos", "proof")
    for stage in reversed(stages[1:-1]):
        proofs = _blocks(stage, proofs, _descend, "key string, pos long, proof array<string>")
    if len(stages) > 2:
        proofs = materialize(proofs)
    above = proofs.join(above.select("key", "subroot", "root"), "key")
    columns = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof array<string>" * with_proofs
    return _blocks(stages[0], above, _prove(with_proofs), columns)
