"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing, SentencePiece encoding and decoding.

Each stage works on all its predecessor kept, and all but the last return the columns of documents. Stages decide
by row, so null, repeated and tied ids are decided one by one: rows are numbered by file and place, the same in every
scan, and decisions go back to the scan as bitmaps, so no stage shuffles its whole input, and what it keeps is
written once. Where ids tie, a digest of the row decides, so copies of a table under other paths give one corpus.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import exact_dedup as exact
from loomspan.llm import mixing, near_copies, sentencepiece, simhash, toxicity
from loomspan.llm.queries import PIECES
from loomspan.operators.components import connected_components
from loomspan.plans.storage import Numbered, discard, free_name, is_written, materialize, number_rows, row_digest, scratch

#: Copies of a document that the mix may emit at most.
MAX_EPOCHS = 3

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go; texts are scored as they pass, nothing is shuffled."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = toxicity.score_udf(docs, model)
    name = free_name(docs, "__toxicity")
    return docs.withColumn(name, score(F.col("text"))).filter(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def _without(numbered: Numbered, judged: Callable[[], DataFrame], docs: DataFrame) -> DataFrame:
    """docs less the rows that an operator does not keep; the operator's tables go once its decisions are written."""
    with scratch() as keep:
        gone = judged().filter("not kept").select("row_id", F.lit(1).alias("gone"))
        marks = keep(numbered.marks(gone))
    name = free_name(numbered.df, "__gone")
    return numbered.counted(marks, name, lambda rows: rows.filter(F.col(name) == 0).select(*docs.columns))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    numbered = number_rows(docs)
    return _without(numbered, lambda: exact.exact_dedup(numbered), docs)


def _linked(numbered: Numbered) -> DataFrame:
    """(row_id, kept): components of documents that operator 6 links by their SimHashes or near_copies by their shingles.

    Either operator names each document's component by a row of it; these rows are joined where a document lies in both.
    Of a component the row with the smallest doc_id stays (null last), of those the first by a digest of all columns.
    """
    by_simhash = simhash.near_duplicates(numbered.df, row_col=numbered.row).select("row_id", F.col("first_row").alias("a"))
    by_shingles = near_copies.near_copies(numbered).select("row_id", F.col("first_row").alias("b"))
    # only documents that are not alone in both can be dropped
    both = materialize(by_simhash.join(by_shingles, "row_id"))
    moved = both.filter("a <> row_id or b <> row_id")
    links = materialize(moved.select(F.explode(F.array(F.struct(F.col("a").alias("src")), F.struct(F.col("b").alias("src")))).alias("s"), F.col("row_id").alias("dst")).select("s.src", "dst").filter("src <> dst"))
    component = connected_components(links)
    tie = row_digest(numbered.df.drop(numbered.row))
    rows = numbered.df.select(F.col(numbered.row).alias("node"), F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), tie.alias("tie"), F.col(numbered.row).alias("row_id")).alias("place"))
    placed = materialize(component.join(rows, "node"))
    first = materialize(placed.groupBy("component").agg(F.min("place").alias("first")))  # written, so AQE can split a large component
    return placed.join(first, "component").select(F.col("node").alias("row_id"), (F.col("place") == F.col("first")).alias("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 or more of their five-word shingles that with the smallest doc_id stays. Not the whole
    stage, but its second kind of links alone."""
    numbered = number_rows(docs)
    return _without(numbered, lambda: near_copies.near_copies(numbered), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHashes at 3 or fewer differing bits, or by 0.8 or more of their five-word shingles, that
    with the smallest doc_id stays."""
    numbered = number_rows(docs)
    return _without(numbered, lambda: _linked(numbered), docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the mix takes them, a document's part of a repetition rounded to a whole copy or none."""
    numbered = number_rows(docs)
    with scratch() as keep:
        taken = mixing.mix_sources(numbered, max_epochs=MAX_EPOCHS)
        marks = keep(numbered.marks(taken.select("row_id", "copies"), most=MAX_EPOCHS))
    name = free_name(numbered.df, "__copies")
    repeat = F.explode(F.sequence(F.lit(1), F.col(name)))
    return numbered.counted(marks, name, lambda rows: rows.filter(F.col(name) > 0).withColumn(name, repeat).select(*docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, their digest, and whether they decode to the whole text."""
    model = sentencepiece.load_model(spark, os.environ.get("LOOMSPAN_PIECES", PIECES))
    return sentencepiece.encode_documents(docs, model, with_text=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_to_weights),
    ("sentencepiece", encode),
]

#: The toxicity model and the tokenizer have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, out = docs, stage(spark, docs, sf_dir)
        docs = out if is_written(out) else materialize(out)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
