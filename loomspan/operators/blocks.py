"""Texts to blocks with provenance, blocks to terms, entities, relations and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions import text as T

BLANK_LINE = r"(?U)\n\s*\n"
#: Blocks that a text's running lengths gather at a time.
RUN = 512


def chunk_id(n: Column) -> Column:
    return F.concat(F.lit("c"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")))


def blocks(texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", page_col: str | None = None, separator: str = BLANK_LINE) -> DataFrame:
    """(doc_id, chunk_id, page, start, end, text) of every block, by exact code-point offsets.

    Newlines at the end go, separators split, blank paragraphs are dropped without a number. Pages of one document
    must come as rows with page_col; their chunk ids continue from page to page.
    """
    text = F.rtrim(F.regexp_replace(F.col(text_col), "\r\n?", "\n"), F.lit("\n"))
    page = F.col(page_col) if page_col else F.lit(0)
    parts = texts.select(F.col(id_col).alias("doc_id"), page.cast("int").alias("page"), F.split(text, separator, -1).alias("parts"), F.regexp_extract_all(text, F.lit(separator), F.lit(0)).alias("gaps"))
    zipped = F.arrays_zip(F.col("parts").alias("part"), F.col("gaps").alias("gap"))
    block_type = "struct<start: long, end: long, text: string>"

    def step(state: Column, pair: Column) -> Column:
        end = state["at"] + F.length(pair["part"])
        block = F.struct(state["at"].alias("start"), end.alias("end"), pair["part"].alias("text"))
        return F.struct((end + F.coalesce(F.length(pair["gap"]), F.lit(0))).alias("at"), F.array_append(state["out"], block).alias("out"))

    def run(state: Column, first: Column) -> Column:
        at = F.coalesce(F.try_element_at(state, F.lit(-1))["at"], F.lit(0).cast("long"))
        begin = F.struct(at.alias("at"), F.array().cast(f"array<{block_type}>").alias("out"))
        return F.array_append(state, F.aggregate(F.slice(F.col("zipped"), first, RUN), begin, step))

    # runs of blocks are gathered first, so the copies that appending makes stay few in long texts
    parts = parts.select("doc_id", "page", zipped.alias("zipped"))
    firsts = F.sequence(F.lit(1), F.greatest(F.size("zipped"), F.lit(1)), F.lit(RUN))
    runs = F.aggregate(firsts, F.array().cast(f"array<struct<at: long, out: array<{block_type}>>>"), run)
    kept = F.filter(F.flatten(F.transform(runs, lambda r: r["out"])), lambda b: b["text"].rlike(r"(?U)\S"))
    # outer, since of a plain explode Spark infers a filter on the array's size, which makes the array a second time
    rows = parts.select("doc_id", "page", F.posexplode_outer(kept).alias("n", "b")).filter("n IS NOT NULL").select("doc_id", "page", "n", "b.*")
    number = F.col("n") + 1 if page_col is None else F.row_number().over(W.partitionBy("doc_id").orderBy("page", "n"))
    return rows.select("doc_id", chunk_id(number).alias("chunk_id"), "page", "start", "end", "text")


def unique_ids(labels: DataFrame, graph: str, order: str, label: str = "label") -> DataFrame:
    """Adds id: slugs, numbered where they repeat within a graph, in the given order."""
    nth = F.row_number().over(W.partitionBy(graph, "__slug").orderBy(order))
    return labels.withColumn("__slug", T.slug(F.col(label))).withColumn("id", T.numbered(F.col("__slug"), nth)).drop("__slug")


def term_rows(blocks_: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, pos, term, key) of every term of every block."""
    rows = blocks_.select("doc_id", "chunk_id", F.posexplode_outer(T.terms(F.col("text"))).alias("pos", "term")).filter("pos IS NOT NULL")  # outer as in blocks()
    return rows.withColumn("key", F.lower("term"))


def entities(terms: DataFrame) -> DataFrame:
    """(doc_id, key, id, label, type, chunk_ids): one per term whatever its case; the first form seen is the label."""
    groups = terms.groupBy("doc_id", "key").agg(F.min_by("term", F.struct("chunk_id", "pos")).alias("label"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    named = unique_ids(groups, "doc_id", "key")
    return named.select("doc_id", "key", "id", "label", F.lit("concept").alias("type"), "chunk_ids")


def cooccurrence(terms: DataFrame, ents: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """(doc_id, src, rel, dst, chunk_ids): neighbours among a chunk's distinct terms in the order of first occurrence.

    Without ents the terms' own entities() are meant. Their ids are numbered where the pairs are found, so terms are
    found once and move once, to their document's task (of that many tasks, if given).
    """
    place = W.partitionBy("doc_id", "chunk_id").orderBy("pos")
    if ents is None:
        rows = terms.filter("doc_id IS NOT NULL").select("doc_id", "chunk_id", "pos", "key")
        rows = rows.repartition(tasks, "doc_id") if tasks else rows.repartition("doc_id")
        firsts = rows.groupBy("doc_id", "chunk_id", "key").agg(F.min("pos").alias("pos")).withColumn("slug", T.slug(F.col("key")))
        nth = F.dense_rank().over(W.partitionBy("doc_id", "slug").orderBy("key"))
        named = firsts.select("doc_id", "chunk_id", "pos", T.numbered(F.col("slug"), nth).alias("src"))
        named = named.withColumn("dst", F.lead("src").over(place)).filter("dst is not null")
    else:
        firsts = terms.groupBy("doc_id", "chunk_id", "key").agg(F.min("pos").alias("pos"))
        pairs = firsts.withColumn("next", F.lead("key").over(place)).filter("next is not null")
        ids = ents.select("doc_id", "key", "id")
        named = pairs.join(ids.withColumnRenamed("id", "src"), ["doc_id", "key"]).join(ids.select("doc_id", F.col("key").alias("next"), F.col("id").alias("dst")), ["doc_id", "next"])
    return named.groupBy("doc_id", "src", "dst").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids")).select("doc_id", "src", F.lit("related_to").alias("rel"), "dst", "chunk_ids")


def resolve_relations(named: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations given by label, resolved without regard to case.

    named: (graph, pos, label); relations: (graph, pos, src_label, rel, dst_label, chunk). The first entity of a label
    wins; unknown ends and self-relations go; of equal triples the first stays.
    """
    ids = unique_ids(named, "graph", "pos").withColumn("key", F.lower(F.trim("label"))).filter("key <> ''")
    ids = ids.groupBy("graph", "key").agg(F.min_by("id", "pos").alias("id"))
    end = lambda side: ids.select("graph", F.col("key").alias(f"{side}_key"), F.col("id").alias(side))
    keyed = relations.withColumn("src_key", F.lower(F.trim("src_label"))).withColumn("dst_key", F.lower(F.trim("dst_label")))
    found = keyed.join(end("src"), ["graph", "src_key"]).join(end("dst"), ["graph", "dst_key"]).filter("src <> dst")
    return found.groupBy("graph", "src", "rel", "dst").agg(F.min_by("chunk", "pos").alias("chunk"))


def rule_items(ents: DataFrame, blocks_: DataFrame) -> DataFrame:
    """Items from entities by template, with the provenance of their first chunk."""
    factual = F.col("type") == "factual"
    items = ents.select(
        "doc_id", "id", "label",
        F.concat(F.lit("State the definition of "), F.col("label"), F.lit(" and explain its role.")).alias("description"),
        F.when(factual, "remember").otherwise("understand").alias("bloom"),
        F.when(factual, "factual").otherwise("conceptual").alias("knowledge_type"),
        F.lit(1).alias("dok"),
        F.concat(F.lit("Learner can define "), F.col("label"), F.lit(" in their own words.")).alias("assessment_criteria"),
        F.array(F.col("type")).alias("tags"),
        F.coalesce(F.element_at("chunk_ids", 1), F.lit("c001")).alias("chunk_id"),
    )
    return resolve_provenance(items, blocks_)


def resolve_provenance(items: DataFrame, blocks_: DataFrame) -> DataFrame:
    """Adds page, start and end of an item's chunk; an unknown chunk falls back to the document's first block."""
    at = blocks_.select("doc_id", "chunk_id", F.struct("chunk_id", "page", "start", "end").alias("own"))
    first = blocks_.groupBy("doc_id").agg(F.min(F.struct("page", "start", "chunk_id", "end")).alias("f"))
    first = first.select("doc_id", F.struct("f.chunk_id", "f.page", "f.start", "f.end").alias("fallback"))
    none = F.struct(F.lit("c001").alias("chunk_id"), F.lit(0).alias("page"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
    joined = items.join(at, ["doc_id", "chunk_id"], "left").join(first, "doc_id", "left")
    return joined.withColumn("p", F.coalesce("own", "fallback", none)).drop("own", "fallback", "chunk_id").select("*", "p.chunk_id", "p.page", "p.start", "p.end").drop("p")


FLAGS = ("atomic", "assessable", "meaningful")


def gate_items(items: DataFrame) -> DataFrame:
    """(…, decision, reason, children): accepted, split into the children that pass, or dropped.

    Flags of a text model (FLAGS), where the items have them, are the last rules; children don't inherit them.
    """
    flags = {k: F.col(k) for k in FLAGS if k in items.columns}
    gated = items.withColumn("g", T.gate(F.col("label"), F.col("description"), flags))
    kept = F.filter(T.split_item(F.col("id").cast("string"), F.col("description")), lambda c: T.gate(F.col("label"), c["description"])["ok"])
    children = F.when(F.col("g.ok"), F.array().cast("array<struct<id: string, description: string>>")).otherwise(kept)
    decided = gated.withColumn("children", children).withColumn("reason", F.col("g.reason")).withColumn("ok", F.col("g.ok")).drop("g")
    decision = F.when(F.col("ok"), "accepted").when(F.size("children") > 0, "split").otherwise("dropped")
    return decided.withColumn("decision", decision).drop("ok")


def cap_items(items: DataFrame, graph: str, max_items: int = 300) -> DataFrame:
    """Adds kept: the first max_items of a graph by id."""
    return items.withColumn("kept", F.row_number().over(W.partitionBy(graph).orderBy("id")) <= max_items)
