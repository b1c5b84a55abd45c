"""Queries over a text model's replies: entities, relations, items, and what story drafts lose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.operators import drafts as D

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Lines in the order in which a reply names them.
_ORDERED = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS pos FROM lineitem WHERE l_orderkey % 5 <> 0)"
#: An order is a document; its lines are what the reply to it names. Every fifth reply is no JSON, so it gives no rows.
_LINES = f"""said AS (SELECT l_orderkey AS doc_id, *, CASE WHEN l_partkey % 7 = 0 THEN '' WHEN l_linenumber % 2 = 0 THEN 'Part ' ELSE 'PART ' END || CASE WHEN l_partkey % 7 = 0 THEN '' ELSE (l_partkey % 4)::VARCHAR END AS label FROM {_ORDERED}),
own AS (SELECT o_orderkey AS doc_id, i, 'c00' || i AS chunk_id FROM orders CROSS JOIN range(1, 4) t(i) WHERE i BETWEEN 1 + o_orderkey % 2 AND o_orderkey % 4),
lists AS (SELECT doc_id, list(chunk_id) AS chunks, min(chunk_id) AS first FROM own GROUP BY doc_id)"""
_SLUG = "coalesce(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item')"
_NAMED = f"""named AS (SELECT *, slug || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END AS id, lower(label) AS key FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY pos) AS nth FROM (SELECT *, {_SLUG.format("label")} AS slug FROM said)))"""
_CHUNKS = "array_to_string(CASE WHEN len(list_intersect({0}, coalesce(chunks, []))) > 0 THEN list_sort(list_intersect({0}, chunks)) ELSE [coalesce(first, 'c001')] END, ',')"


def _blocks(spark, sf_dir):
    """Up to two chunks an order, none for half of them."""
    key = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("doc_id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("i")).filter(F.col("i").between(1 + F.col("doc_id") % 2, F.col("doc_id") % 4))
    place = (F.col("i") * 10).cast("long")
    return rows.select("doc_id", F.concat(F.lit("c00"), "i").alias("chunk_id"), F.lit(0).alias("page"), place.alias("start"), (place + 5).alias("end"))


def _label(line: Column) -> Column:
    case = F.when(line["l_linenumber"] % 2 == 0, " Part ").otherwise("PART ")
    return F.when(line["l_partkey"] % 7 == 0, " ").otherwise(F.concat(case, line["l_partkey"] % 4))


def _chunk(n: Column) -> Column:
    return F.concat(F.lit("c00"), 1 + n)


def _replies(spark, sf_dir, **parts):
    """(doc_id, text): a reply for each order, its parts made from the order's lines in turn; every third is fenced."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("l")
    )
    made = F.to_json(F.struct(*(F.transform("l", make).alias(part) for part, make in parts.items())))
    fenced = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), made, F.lit("\n```"))).otherwise(made)
    return lines.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "no JSON for this").otherwise(fenced).alias("text"))


def _graph_replies(spark, sf_dir):
    def entity(x: Column) -> Column:
        kind = F.when(x["l_returnflag"] == "A", " Term ").when(x["l_returnflag"] == "R", "")
        chunks = F.array(_chunk(x["l_linenumber"] % 4), _chunk(x["l_suppkey"] % 3), F.lit("c999"))
        return F.struct(_label(x).alias("label"), kind.alias("type"), chunks.alias("chunk_ids"))

    def relation(x: Column, i: Column) -> Column:
        """From a line's entity to the one of the line after it, if that is there."""
        rel = F.when(x["l_linenumber"] % 3 > 0, x["l_returnflag"])
        return F.struct(_label(x).alias("src"), rel.alias("rel"), F.upper(_label(F.get("l", i + 1))).alias("dst"), F.array(_chunk(x["l_suppkey"] % 3)).alias("chunk_ids"))

    return _replies(spark, sf_dir, entities=entity, relations=relation)


@query(f"""WITH {_LINES}, {_NAMED}
SELECT doc_id, key, id, label, CASE WHEN l_returnflag = 'A' THEN 'term' ELSE 'concept' END AS type, {_CHUNKS.format("list_distinct(['c00' || (1 + l_linenumber % 4), 'c00' || (1 + l_suppkey % 3), 'c999'])")} AS chunk_ids
FROM named LEFT JOIN lists USING (doc_id) WHERE label <> ''""")
def q76_reply_entities(spark, sf_dir):
    """Entities of all replies: numbered ids, kinds, and chunks that the document has."""
    e = D.entities(_graph_replies(spark, sf_dir), _blocks(spark, sf_dir))
    return e.withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query(f"""WITH {_LINES}, {_NAMED}, firsts AS (SELECT doc_id, key, arg_min(id, pos) AS id FROM named WHERE key <> '' GROUP BY 1, 2),
links AS (SELECT doc_id, pos, key AS a, lead(key) OVER (PARTITION BY doc_id ORDER BY pos) AS b, CASE WHEN l_linenumber % 3 > 0 THEN l_returnflag ELSE 'related_to' END AS rel, 'c00' || (1 + l_suppkey % 3) AS chunk FROM named),
met AS (SELECT l.doc_id, s.id AS src, rel, d.id AS dst, arg_min(chunk, pos) AS chunk FROM links l JOIN firsts s ON s.doc_id = l.doc_id AND s.key = a JOIN firsts d ON d.doc_id = l.doc_id AND d.key = b WHERE s.id <> d.id GROUP BY 1, 2, 3, 4)
SELECT doc_id, src, rel, dst, {_CHUNKS.format("[chunk]")} AS chunk_ids FROM met LEFT JOIN lists USING (doc_id)""")
def q77_reply_relations(spark, sf_dir):
    """Relations of all replies: ends found by label whatever their case, of equal ones the first."""
    r = D.relations(_graph_replies(spark, sf_dir), _blocks(spark, sf_dir))
    return r.withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query(f"""WITH {_LINES}, given AS (SELECT *, {_SLUG.format("CASE WHEN l_suppkey % 3 = 0 THEN 'own ' || (l_partkey % 3) ELSE label END")} AS slug FROM said),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY pos) AS nth FROM given), firsts AS (SELECT doc_id, min(i) AS first FROM own GROUP BY doc_id),
placed AS (SELECT n.*, coalesce(o.i, f.first) AS i FROM numbered n LEFT JOIN own o ON o.doc_id = n.doc_id AND o.i = 1 + l_linenumber % 4 LEFT JOIN firsts f ON f.doc_id = n.doc_id)
SELECT doc_id, slug || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END AS id, label, CASE WHEN l_linenumber % 3 = 0 THEN 'apply' ELSE 'understand' END AS bloom, CASE WHEN l_suppkey % 2 = 0 THEN 'factual' ELSE 'conceptual' END AS knowledge_type,
 CASE WHEN l_linenumber <= 4 THEN l_linenumber ELSE 1 END::INT AS dok, 'c00' || coalesce(i, 1) AS chunk_id, coalesce(i, 0)::BIGINT * 10 AS "start", CASE WHEN i IS NULL THEN 0 ELSE i * 10 + 5 END::BIGINT AS "end", l_linenumber = 3 OR l_linenumber % 2 = 0 AS atomic, true AS assessable
FROM placed WHERE label <> ''""")
def q78_reply_items(spark, sf_dir):
    """Items of all replies: coerced levels, own or made ids, provenance, and the model's flags."""

    def item(x: Column) -> Column:
        n = x["l_linenumber"]
        own = F.when(x["l_suppkey"] % 3 == 0, F.concat(F.lit("own "), x["l_partkey"] % 3))
        bloom = F.when(n % 3 == 0, " Apply ").when(n % 3 == 1, "guess")
        flags = F.when(n != 3, F.struct((n % 2 == 0).alias("atomic")))
        return F.struct(
            own.alias("id"), _label(x).alias("label"), bloom.alias("bloom"), F.when(x["l_suppkey"] % 2 == 0, "Factual").alias("knowledge_type"), n.cast("string").alias("dok"),
            F.struct(_chunk(n % 4).alias("chunk_id")).alias("provenance"), flags.alias("atomicity"),
        )

    rows = D.items(_replies(spark, sf_dir, items=item), _blocks(spark, sf_dir))
    return rows.select("doc_id", "id", "label", "bloom", "knowledge_type", "dok", "chunk_id", "start", "end", "atomic", "assessable")


#: Each order's reply is the draft of one cluster; items are two thirds of the suppliers.
_DRAFTS = f"""known AS (SELECT 'k' || s_suppkey AS id, s_nationkey % 4 + 1 AS dok FROM supplier WHERE s_suppkey % 3 <> 0),
lines AS (SELECT l_orderkey AS cluster, pos, 'b' || l_orderkey || '-' || (l_partkey % 4) AS id, 'k' || l_suppkey AS t0, 'k' || (l_suppkey + 1) AS t1, CASE WHEN l_linenumber % 2 = 0 THEN 'k' || (l_suppkey + 2) END AS item,
  'b' || l_orderkey || '-' || ((l_partkey + 1) % 4) AS target, 'c' || l_orderkey || '-' || (l_linenumber % 5) AS c, CASE l_returnflag WHEN 'R' THEN 'essay' ELSE 'choice' END AS kind, l_linenumber FROM {_ORDERED}),
based AS (SELECT l.*, list_filter([CASE WHEN t0 IN (SELECT id FROM known) THEN t0 END, CASE WHEN t1 IN (SELECT id FROM known) THEN t1 END], lambda x: x IS NOT NULL) AS teaches, CASE WHEN item IN (SELECT id FROM known) THEN item END AS own FROM lines l),
anchored AS (SELECT *, coalesce(own, teaches[1]) AS anchor, row_number() OVER (PARTITION BY cluster, id ORDER BY pos) AS nth FROM based),
beats AS (SELECT *, CASE WHEN nth > 1 THEN 'duplicate id' WHEN anchor IS NULL THEN 'unknown item' ELSE 'kept' END AS status FROM anchored),
checks AS (SELECT cluster, c, CASE WHEN row_number() OVER (PARTITION BY cluster, c ORDER BY pos) > 1 THEN 'duplicate id' WHEN t0 NOT IN (SELECT id FROM known) THEN 'unknown item' WHEN kind = 'essay' THEN 'unknown kind' ELSE 'kept' END AS status FROM lines),
refs AS (SELECT cluster, pos, l_linenumber, 'c' || cluster || '-' || l_linenumber AS c FROM beats WHERE status = 'kept' UNION ALL SELECT cluster, pos, 99, 'c' || cluster || '-x' FROM beats WHERE status = 'kept')"""


def _draft(spark, sf_dir):
    def beat(x: Column) -> Column:
        n = x["l_linenumber"]
        name = lambda k: F.concat(F.lit("b"), "doc_id", F.lit("-"), k % 4)
        item = lambda k: F.concat(F.lit("k"), x["l_suppkey"] + k)
        check = lambda k: F.concat(F.lit("c"), "doc_id", F.lit("-"), k)
        own = F.when(n % 2 == 0, F.struct(item(2).alias("item_id")))
        choices = F.array(F.struct(F.lit("On").alias("label"), name(x["l_partkey"] + 1).alias("to")))
        return F.struct(name(x["l_partkey"]).alias("id"), F.array(item(0), item(1)).alias("teaches"), own.alias("provenance"), choices.alias("choices"), F.array(check(n), check(F.lit("x"))).alias("checks"))

    def check(x: Column) -> Column:
        kind = F.when(x["l_returnflag"] == "R", "essay").when(x["l_returnflag"] == "A", "choice")
        return F.struct(F.concat(F.lit("c"), "doc_id", F.lit("-"), x["l_linenumber"] % 5).alias("id"), kind.alias("kind"), F.concat(F.lit("k"), x["l_suppkey"]).alias("item_id"))

    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_suppkey % 3 <> 0")
    known = s.select(F.concat(F.lit("k"), "s_suppkey").alias("id"), F.col("s_name").alias("label"), F.col("s_name").alias("description"), (F.col("s_nationkey") % 4 + 1).alias("dok"), F.lit("c001").alias("chunk_id"))
    return D.story(_replies(spark, sf_dir, beats=beat, checks=check), known)


@query(f"""WITH {_DRAFTS}, named AS (SELECT r.cluster, r.pos, string_agg(c, ',' ORDER BY l_linenumber) AS checks FROM refs r SEMI JOIN (SELECT c FROM checks WHERE status = 'kept') k USING (c) GROUP BY 1, 2)
SELECT b.cluster, b.id, anchor, array_to_string(teaches, ',') AS teaches, dok AS difficulty, (target IN (SELECT id FROM beats WHERE status = 'kept'))::INT AS choices, coalesce(checks, '') AS checks
FROM beats b JOIN known k ON k.id = anchor LEFT JOIN named n ON n.cluster = b.cluster AND n.pos = b.pos WHERE status = 'kept'""")
def q79_draft_beats(spark, sf_dir):
    """Beats of all drafts that rest on known items, with the choices and checks that lead somewhere."""
    beats, _, _ = _draft(spark, sf_dir)
    return beats.select("cluster", "id", "anchor", F.array_join("teaches", ",").alias("teaches"), "difficulty", F.size("choices").alias("choices"), F.array_join("checks", ",").alias("checks"))


@query(f"""WITH {_DRAFTS} SELECT what, count(*) AS n FROM (SELECT 'beat: ' || status AS what FROM beats WHERE status <> 'kept' UNION ALL SELECT 'check: ' || status FROM checks WHERE status <> 'kept'
  UNION ALL SELECT 'dangling choice' FROM beats WHERE status = 'kept' AND target NOT IN (SELECT id FROM beats WHERE status = 'kept')
  UNION ALL SELECT 'unknown check' FROM refs ANTI JOIN (SELECT c FROM checks WHERE status = 'kept') k USING (c)) GROUP BY 1""")
def q80_draft_losses(spark, sf_dir):
    """What all drafts lost, by reason."""
    return _draft(spark, sf_dir)[2]
