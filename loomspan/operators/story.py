"""Story graphs: clusters, quest chains, grounding and pruning of drafts, validation."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.operators import graph as G

KINDS = ("choice", "ordering", "numeric")
# What every beat and check must have.
BEAT_KEYS = ("id", "title", "text", "choices", "requires", "teaches", "difficulty", "provenance")
ITEM_KEYS = ("id", "label", "description", "dok", "assessment_criteria", "provenance")


def check_items(items: DataFrame) -> DataFrame:
    """(id, missing): items that lack a required field or a provenance chunk."""
    lacks = F.array_compact(F.array(*(F.when(F.col(k).isNull(), k) for k in ITEM_KEYS), F.when(F.col("provenance.chunk_id").isNull(), "provenance.chunk_id")))
    return items.select("id", lacks.alias("missing")).filter(F.size("missing") > 0)


def clusters(items: DataFrame) -> DataFrame:
    """Adds cluster: an item's smallest tag, general without one."""
    return items.withColumn("cluster", F.coalesce(F.array_min("tags"), F.lit("general")))


def chains(items: DataFrame, edges: DataFrame, n_options: int = 3) -> DataFrame:
    """One linear quest per cluster: (graph, cluster, rank, beat, item, next, options, requires, title, …).

    Beats follow the cluster's smallest topological order along its inner edges; options are the own label and the
    first others of the whole graph; requirements count all edges. Only n_options + 1 labels of a graph can ever be
    options, so they travel with the graph and labels are never paired.
    """
    c = clusters(items)
    name = F.concat_ws("\u0001", "graph", "cluster")
    owner = c.select("graph", "id", "cluster").hint("merge")  # none of a row per item is broadcast, however small when packed
    inner = edges.join(owner.withColumnRenamed("id", "prereq"), ["graph", "prereq"]).join(owner.select("graph", F.col("id").alias("item"), F.col("cluster").alias("other")).hint("merge"), ["graph", "item"]).filter("cluster = other")
    order = G.topo_order(c.withColumn("graph", name), inner.select(name.alias("graph"), "prereq", "item"))
    place = F.split("graph", "\u0001", 2)
    ranked = order.select(place[0].alias("graph"), place[1].alias("cluster"), "id", "rank").join(items.hint("merge"), ["graph", "id"])
    ranked = ranked.withColumn("next", F.lead("id").over(W.partitionBy("graph", "cluster").orderBy("rank")))
    places = items.select("graph", "label").withColumn("n", F.row_number().over(W.partitionBy("graph").orderBy("label"))).filter(F.col("n") <= n_options + 1)
    first = places.groupBy("graph").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    needs = edges.groupBy("graph", F.col("item").alias("id")).agg(F.array_sort(F.collect_list("prereq")).alias("requires"))
    out = ranked.join(first, "graph").join(needs.hint("merge"), ["graph", "id"], "left")
    others = F.slice(F.filter("labels", lambda x: x != F.col("label")), 1, n_options)
    return out.select(
        "graph", "cluster", "rank", F.concat("id", F.lit("-beat")).alias("beat"), F.concat("id", F.lit("-check")).alias("check"), F.col("id").alias("item"),
        F.concat("next", F.lit("-beat")).alias("next"), F.concat(F.array("label"), others).alias("options"),
        F.coalesce("requires", F.array().cast("array<string>")).alias("requires"), "label", "dok",
    )


def ground(drafts: DataFrame, items: DataFrame) -> DataFrame:
    """(cluster, pos, id, teaches, anchor, status) of drafted beats.

    drafts: (cluster, pos, id, teaches, item). What a beat teaches is cut to known items; its anchor is its own item, or
    the first known one it teaches. Without an anchor it is an unknown item's; of equal ids in a cluster the first stays.
    """
    ids = items.select(F.col("id").alias("t")).distinct()
    taught = drafts.select("cluster", "pos", F.posexplode("teaches").alias("n", "t")).join(ids, "t", "left_semi")
    taught = taught.groupBy("cluster", "pos").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("k")).select("cluster", "pos", F.col("k.t").alias("known"))
    own = drafts.select("cluster", "pos", F.col("item").alias("t")).join(ids, "t", "left_semi").select("cluster", "pos", F.col("t").alias("own"))
    rows = drafts.join(taught, ["cluster", "pos"], "left").join(own, ["cluster", "pos"], "left")
    known = F.coalesce("known", F.array().cast("array<string>"))
    rows = rows.select("cluster", "pos", "id", known.alias("teaches"), F.coalesce("own", F.try_element_at("known", F.lit(1))).alias("anchor"))
    nth = F.row_number().over(W.partitionBy("cluster", "id", F.col("anchor").isNull()).orderBy("pos"))
    status = F.when(F.col("anchor").isNull(), "unknown item").when(nth > 1, "duplicate id").otherwise("kept")
    return rows.withColumn("status", status)


def prune_dangling(choices: DataFrame, beats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Choices (beat, to, …) whose target is a beat, and those whose target is none."""
    ids = beats.select(F.col("id").alias("to"))
    return choices.join(ids, "to", "left_semi"), choices.join(ids, "to", "left_anti")


def reachable(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(graph, id): nodes that links (graph, src, dst) reach from starts (graph, id), these included.

    A walk over one story at a time, stories spread over the cluster: one job whatever the length of the paths.
    """
    kind = starts.schema["id"].dataType.simpleString()

    def walk(own: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
        after = arcs.groupby("src")["dst"].agg(list).to_dict() if len(arcs) else {}
        seen, waiting = set(own["id"]), list(own["id"])
        while waiting:
            fresh = set(after.get(waiting.pop(), ())) - seen
            seen |= fresh
            waiting += fresh
        graph = own["graph"].iloc[0] if len(own) else None
        return pd.DataFrame({"graph": [graph] * len(seen), "id": list(seen)})

    graph = starts.schema["graph"].dataType.simpleString()
    own, arcs = starts.select("graph", "id"), links.select(F.col("graph").alias("story"), "src", "dst")
    return own.groupBy("graph").cogroup(arcs.groupBy("story")).applyInPandas(walk, f"graph {graph}, id {kind}")


def validate(beats: DataFrame, checks: DataFrame, choices: DataFrame, refs: DataFrame) -> DataFrame:
    """All issues (graph, issue, subject) of story graphs; nothing is dropped.

    beats: (graph, id), checks: (graph, id, kind), choices: (graph, src, dst), refs: (graph, beat, check). Entries are
    beats that nobody targets, themselves included.
    """
    issue = lambda df, name, subject: df.select("graph", F.lit(name).alias("issue"), F.col(subject).cast("string").alias("subject"))
    ids, check_ids = beats.select("graph", "id").distinct(), checks.select("graph", "id").distinct()
    repeated = lambda df: df.groupBy("graph", "id").count().filter("count > 1")
    valid = choices.join(ids.withColumnRenamed("id", "dst"), ["graph", "dst"], "left_semi")
    entries = ids.join(choices.select("graph", F.col("dst").alias("id")), ["graph", "id"], "left_anti")
    graphs = ids.select("graph").distinct()
    parts = [
        issue(repeated(beats), "duplicate beat id", "id"),
        issue(repeated(checks), "duplicate check id", "id"),
        issue(checks.filter(~F.col("kind").isin(*KINDS) | F.col("kind").isNull()), "unknown kind", "id"),
        issue(choices.join(ids.withColumnRenamed("id", "dst"), ["graph", "dst"], "left_anti"), "dangling choice", "dst"),
        issue(refs.join(check_ids.withColumnRenamed("id", "check"), ["graph", "check"], "left_anti"), "unknown check", "check"),
        issue(graphs.join(entries, "graph", "left_anti").withColumn("none", F.lit("")), "no entry", "none"),
        issue(ids.join(reachable(entries, valid.select("graph", "src", "dst")), ["graph", "id"], "left_anti"), "unreachable", "id"),
    ]
    return reduce(DataFrame.unionByName, parts)
