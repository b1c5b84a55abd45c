"""A text model's replies, one JSON document a row, as tables of entities, relations, items, edges and story drafts.

Replies are parsed with a schema; what is no JSON object gives no rows, so the caller's rules can stand in. All replies
of a corpus are worked on at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import blocks as B
from loomspan.operators import story as S
from loomspan.plans.storage import materialize

ENTITIES = "struct<entities: array<struct<label: string, type: string, chunk_ids: array<string>>>, relations: array<struct<src: string, rel: string, dst: string, chunk_ids: array<string>>>>"
ITEMS = (
    "struct<items: array<struct<id: string, label: string, description: string, bloom: string, knowledge_type: string, dok: string, assessment_criteria: string, "
    "required_competences: array<string>, tags: array<string>, provenance: struct<chunk_id: string>, atomicity: struct<atomic: boolean, assessable: boolean, meaningful: boolean>>>, "
    "competences: array<struct<label: string, type: string>>>"
)
EDGES = "struct<edges: array<struct<prereq: string, item: string, confidence: double>>>"
STORY = (
    "struct<beats: array<struct<id: string, title: string, text: string, choices: array<struct<label: string, to: string>>, requires: array<string>, teaches: array<string>, "
    "checks: array<string>, provenance: struct<item_id: string>>>, checks: array<struct<id: string, kind: string, prompt: string, payload: string, item_id: string, max_score: int>>>"
)


def parsed(replies: DataFrame, schema: str) -> DataFrame:
    """(doc_id, r) of the replies (doc_id, text) that are JSON objects, as a written table: each reply is parsed once."""
    read = replies.select("doc_id", T.unfenced(F.col("text")).alias("reply"))
    is_object = F.col("reply").rlike(r"^\s*\{") & F.try_parse_json("reply").isNotNull()
    return materialize(read.select("doc_id", F.when(is_object, F.from_json("reply", schema)).alias("r"))).filter("r is not null")


def _part(read: DataFrame, part: str) -> DataFrame:
    return read.select("doc_id", F.posexplode(f"r.{part}").alias("pos", "x")).filter("x is not null")


def _rows(replies: DataFrame, schema: str, part: str) -> DataFrame:
    return _part(parsed(replies, schema), part)


def _known_chunks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows with chunk_ids cut to the document's own chunks, sorted and distinct; without any, its first chunk."""
    own = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("__own"), F.min_by("chunk_id", F.struct("page", "start")).alias("__first"))
    joined = rows.join(own, "doc_id", "left")
    kept = F.array_sort(F.array_intersect(F.coalesce("chunk_ids", F.array().cast("array<string>")), F.coalesce("__own", F.array().cast("array<string>"))))
    return joined.withColumn("chunk_ids", F.when(F.size(kept) > 0, kept).otherwise(F.array(F.coalesce("__first", F.lit("c001"))))).drop("__own", "__first")


def _named(read: DataFrame) -> DataFrame:
    """Entities of parsed replies with their ids; a reply's rows stay together, so later groups of it need no shuffle."""
    rows = _part(read, "entities").select("doc_id", "pos", F.trim(F.coalesce("x.label", F.lit(""))).alias("label"), F.col("x.type").alias("type"), F.col("x.chunk_ids").alias("chunk_ids"))
    return B.unique_ids(rows.repartition("doc_id"), "doc_id", "pos")  # blank labels take a number before they go


def entities(replies: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, key, id, label, type, chunk_ids)."""
    kind = F.lower(F.trim("type"))
    rows = _known_chunks(_named(parsed(replies, ENTITIES)).filter("label <> ''"), blocks)
    return rows.select("doc_id", F.lower("label").alias("key"), "id", "label", F.when(kind != "", kind).otherwise("concept").alias("type"), "chunk_ids")


def relations(replies: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, src, rel, dst, chunk_ids): ends by label, the first entity of a label wins; of equal triples the first stays.

    Entities and ends of a reply are laid together and ends look up their label in a window, so all rows of a reply
    move once.
    """
    read = parsed(replies, ENTITIES)
    label = F.trim(F.coalesce("x.label", F.lit("")))
    named = _part(read, "entities").select("doc_id", "pos", F.lit(None).cast("string").alias("side"), label.alias("label"), F.lower(label).alias("key"))
    raw = _part(read, "relations").select("doc_id", "pos", F.lower(F.trim("x.src")).alias("src"), F.coalesce("x.rel", F.lit("related_to")).alias("rel"), F.lower(F.trim("x.dst")).alias("dst"), F.col("x.chunk_ids").alias("chunk_ids"))
    ends = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(k).alias("key")) for k in ("src", "dst")))).alias("e")
    carried = lambda k: F.when(F.col("e.side") == "src", F.col(k)).alias(k)
    ends = raw.select("doc_id", "pos", ends, "rel", "chunk_ids").select("doc_id", "pos", "e.side", "e.key", carried("rel"), carried("chunk_ids")).filter("key <> ''")
    rows = named.unionByName(ends, allowMissingColumns=True).repartition("doc_id")
    slug = F.when(F.col("side").isNull(), T.slug(F.col("label")))
    nth = F.row_number().over(W.partitionBy("doc_id", "slug").orderBy("pos"))
    rows = rows.withColumn("slug", slug).withColumn("own", F.when(F.col("side").isNull(), T.numbered(F.col("slug"), nth)))
    first = F.min(F.when(F.col("side").isNull(), F.struct("pos", "own"))).over(W.partitionBy("doc_id", "key"))
    found = rows.withColumn("id", first["own"]).filter("side is not null and id is not null")
    at = lambda side, k: F.max(F.when(F.col("side") == side, F.col(k)))
    chunks = F.first(F.when(F.col("side") == "src", F.struct("chunk_ids")), ignorenulls=True)["chunk_ids"]
    met = found.groupBy("doc_id", "pos").agg(at("src", "id").alias("src"), at("src", "rel").alias("rel"), at("dst", "id").alias("dst"), chunks.alias("chunk_ids")).filter("src <> dst")
    first = met.groupBy("doc_id", "src", "rel", "dst").agg(F.min_by("chunk_ids", "pos").alias("chunk_ids"))
    return _known_chunks(first, blocks)


def items(replies: DataFrame, blocks: DataFrame) -> DataFrame:
    """Item rows with coerced levels, numbered ids, resolved provenance and the model's own flags."""
    x = lambda k: F.col(f"x.{k}")
    text = lambda k: F.coalesce(x(k), F.lit(""))
    strings = lambda k: F.coalesce(x(k), F.array().cast("array<string>"))
    flag = lambda k: F.coalesce(F.col(f"x.atomicity.{k}"), F.lit(True))
    rows = _rows(replies, ITEMS, "items").select(
        "doc_id", "pos", F.trim(text("label")).alias("label"), F.trim(text("id")).alias("own"), text("description").alias("description"), T.coerce_level(x("bloom")).alias("bloom"),
        T.coerce_knowledge(x("knowledge_type")).alias("knowledge_type"), T.coerce_depth(x("dok")).alias("dok"), text("assessment_criteria").alias("assessment_criteria"),
        strings("required_competences").alias("required_competences"), strings("tags").alias("tags"), F.coalesce(F.col("x.provenance.chunk_id"), F.lit("c001")).alias("chunk_id"),
        *(flag(k).alias(k) for k in ("atomic", "assessable", "meaningful")),
    )
    rows = rows.withColumn("name", F.when(F.col("own") != "", F.col("own")).otherwise(F.col("label")))
    return B.resolve_provenance(B.unique_ids(rows.repartition("doc_id"), "doc_id", "pos", "name").filter("label <> ''").drop("own", "name", "pos"), blocks)


def competences(replies: DataFrame) -> DataFrame:
    """(doc_id, id, label, type): of equal slugs the first stays."""
    rows = _rows(replies, ITEMS, "competences").select("doc_id", "pos", F.trim(F.coalesce("x.label", F.lit(""))).alias("label"), F.col("x.type").alias("type")).filter("label <> ''")
    kind = F.when(F.col("type") != "", F.col("type")).otherwise("cognitive")
    best = rows.withColumn("id", T.slug(F.col("label"))).groupBy("doc_id", "id").agg(F.min_by(F.struct("label", kind.alias("type")), "pos").alias("b"))
    return best.select("doc_id", "id", "b.label", "b.type")


def edges(replies: DataFrame) -> DataFrame:
    """(graph, prereq, item, confidence) proposals, ends as given."""
    rows = _rows(replies, EDGES, "edges")
    return rows.select(F.col("doc_id").alias("graph"), F.trim("x.prereq").alias("prereq"), F.trim("x.item").alias("item"), F.coalesce("x.confidence", F.lit(1.0)).alias("confidence")).filter("prereq is not null and item is not null")


def story(replies: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Grounded beats and checks of story drafts, and the counts of what was pruned.

    replies: (doc_id, text), doc_id being the cluster; known: (id, label, description, dok, chunk_id) items. Titles and
    texts are the draft's, difficulty and provenance the item's own; choices and check references without a target go.
    """
    read = parsed(replies, STORY)
    part = lambda name: _part(read, name).filter("x.id is not null").withColumnRenamed("doc_id", "cluster")
    drafted = materialize(_grounded(part("beats"), known))
    beats = drafted.filter("status = 'kept'").drop("status")

    c = part("checks").select("cluster", "pos", "x.*")
    c = c.withColumn("kind", F.coalesce("kind", F.lit("choice"))).withColumn("max_score", F.coalesce("max_score", F.lit(1)))
    ids = known.select(F.col("id").alias("item_id")).distinct().withColumn("__known", F.lit(True))
    nth = F.row_number().over(W.partitionBy("cluster", "id").orderBy("pos"))
    status = F.when(F.col("nth") > 1, "duplicate id").when(F.col("__known").isNull(), "unknown item").when(~F.col("kind").isin(*S.KINDS), "unknown kind").otherwise("kept")
    checks = materialize(c.withColumn("nth", nth).join(ids, "item_id", "left").withColumn("status", status))
    good = checks.filter("status = 'kept'").select("cluster", "id", "kind", "prompt", "payload", "item_id", "max_score")

    beats, lost = _pruned(beats, good)
    counts = drafted.filter("status <> 'kept'").select(F.concat(F.lit("beat: "), "status").alias("what")).unionByName(checks.filter("status <> 'kept'").select(F.concat(F.lit("check: "), "status").alias("what"))).unionByName(lost)
    return beats, good, counts.groupBy("what").agg(F.count("*").alias("n"))


def _grounded(x: DataFrame, known: DataFrame) -> DataFrame:
    """Drafted beats (cluster, pos, x) with what they rest on and a status.

    A beat's items (its own first, then what it teaches) meet the known ones, then lie beside the beat itself: all rows of a
    draft move once. An id that repeats in a cluster's draft counts as a duplicate, whether or not the first was grounded.
    """
    items = known.groupBy(F.col("id").alias("t")).agg(F.min(F.struct("label", "description", "dok", "chunk_id")).alias("truth"))
    empty = lambda kind: F.array().cast(kind)
    named = F.concat(F.array("x.provenance.item_id"), F.coalesce("x.teaches", empty("array<string>")))
    found = x.select("cluster", "pos", F.posexplode(named).alias("n", "t")).join(items, "t").select("cluster", "pos", F.struct("n", "t", "truth").alias("found"))
    body = F.struct(
        "x.id", "x.title", "x.text", F.coalesce("x.choices", empty("array<struct<label: string, to: string>>")).alias("choices"),
        F.coalesce("x.requires", empty("array<string>")).alias("requires"), F.coalesce("x.checks", empty("array<string>")).alias("checks"),
    )
    rows = found.unionByName(x.select("cluster", "pos", body.alias("body")), allowMissingColumns=True).repartition("cluster")
    beats = rows.groupBy("cluster", "pos").agg(F.first("body", ignorenulls=True).alias("b"), F.sort_array(F.collect_list("found")).alias("f"))
    beats = beats.select("cluster", "pos", "b.*", F.filter("f", lambda i: i["n"] > 0)["t"].alias("teaches"), F.try_element_at("f", F.lit(1)).alias("a"))
    nth = F.row_number().over(W.partitionBy("cluster", "id").orderBy("pos"))
    status = F.when(nth > 1, "duplicate id").when(F.col("a").isNull(), "unknown item").otherwise("kept")
    return beats.select(
        "cluster", "pos", "id", "teaches", F.col("a.t").alias("anchor"), F.coalesce("title", "a.truth.label").alias("title"), F.coalesce("text", "a.truth.description").alias("text"), "choices", "requires", "checks",
        F.col("a.truth.dok").alias("difficulty"), F.col("a.truth.chunk_id").alias("chunk_id"), status.alias("status"),
    )


def _pruned(beats: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    choices = beats.select("cluster", "pos", F.posexplode("choices").alias("n", "c")).select("cluster", "pos", "n", "c", F.col("c.to").alias("to"))
    kept, dangling = S.prune_dangling(choices, beats)
    refs = beats.select("cluster", "pos", F.posexplode("checks").alias("n", "check"))
    found, unknown = (refs.join(checks.select(F.col("id").alias("check")), "check", how) for how in ("left_semi", "left_anti"))
    lists = kept.select("cluster", "pos", F.struct("n", "c").alias("c")).unionByName(found.select("cluster", "pos", F.struct("n", "check").alias("k")), allowMissingColumns=True)
    lists = lists.groupBy("cluster", "pos").agg(*(F.sort_array(F.collect_list(k)).alias(k) for k in "ck")).select("cluster", "pos", F.col("c.c").alias("__c"), F.col("k.check").alias("__check"))
    out = beats.join(lists, ["cluster", "pos"], "left")
    out = out.withColumn("choices", F.coalesce("__c", F.array().cast(beats.schema["choices"].dataType))).withColumn("checks", F.coalesce("__check", F.array().cast("array<string>"))).drop("__c", "__check")
    lost = dangling.select(F.lit("dangling choice").alias("what")).unionByName(unknown.select(F.lit("unknown check").alias("what")))
    return out, lost


def cluster_prompt(cluster: Column, rows: Column, links: Column) -> Column:
    """What is asked of the model for one cluster: its items and inner edges."""
    return F.concat_ws("\n", F.concat(F.lit("Write beats and checks as JSON for the cluster "), cluster), F.to_json(rows), F.to_json(links))
