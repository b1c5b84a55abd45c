"""Queries over blocks, terms, entities and items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import blocks as B
from loomspan.plans.storage import spread

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _blocks_sql(source: str, separator: str) -> str:
    """Blocks in SQL: pieces and the separators behind them, offsets by running lengths."""
    return f"""src AS ({source}), cut AS (SELECT doc_id, rtrim(text, chr(10)) AS text FROM src),
pieces AS (SELECT doc_id, unnest(regexp_split_to_array(text, '{separator}')) AS piece, unnest(range(len(regexp_split_to_array(text, '{separator}')))) AS i FROM cut),
gaps AS (SELECT doc_id, unnest(regexp_extract_all(text, '{separator}')) AS gap, unnest(range(len(regexp_extract_all(text, '{separator}')))) AS i FROM cut),
ends AS (SELECT doc_id, i, piece, (sum(length(piece) + coalesce(length(gap), 0)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT - coalesce(length(gap), 0) AS e FROM pieces LEFT JOIN gaps USING (doc_id, i)),
blocks AS (SELECT doc_id, 'c' || CASE WHEN rn < 1000 THEN lpad(rn::VARCHAR, 3, '0') ELSE rn::VARCHAR END AS chunk_id, e - length(piece) AS s, e, piece AS text FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM ends WHERE regexp_matches(piece, '\\S')))"""


DOCS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
TURNS = "SELECT conv_id AS doc_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role) AS text FROM conversations GROUP BY conv_id"
_OUT = 'SELECT doc_id, chunk_id, s AS "start", e AS "end", md5(text) AS text_md5 FROM blocks'


def _documents(spark, sf_dir) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def _turns(spark, sf_dir) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    return turns.select(F.col("conv_id").alias("doc_id"), F.array_join("t.text", "\n\n").alias("text"))


def _digest(b: DataFrame) -> DataFrame:
    return b.select("doc_id", "chunk_id", "start", "end", F.md5("text").alias("text_md5"))


@query(f"WITH {_blocks_sql(DOCS, chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')} {_OUT}")
def q01_blocks(spark, sf_dir):
    return _digest(B.blocks(_documents(spark, sf_dir)))


@query(f"WITH {_blocks_sql(DOCS, chr(92) + 'n')} {_OUT}")
def q02_blocks_lines(spark, sf_dir):
    return _digest(B.blocks(_documents(spark, sf_dir), separator="\n"))


@query(f"WITH {_blocks_sql(TURNS, chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')} {_OUT}")
def q03_blocks_turns(spark, sf_dir):
    return _digest(B.blocks(_turns(spark, sf_dir)))


@query("""WITH s AS (SELECT p_partkey, p_brand, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item') AS slug FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, slug ORDER BY p_partkey) AS nth FROM s) SELECT p_partkey, CASE WHEN nth = 1 THEN slug ELSE slug || '-' || nth END AS id FROM n""")
def q04_slug_ids(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return B.unique_ids(p, "p_brand", "p_partkey", "p_name").select("p_partkey", "id")


_STOP = "['" + "', '".join(T.STOP_WORDS) + "']"
#: RE2 knows ASCII word boundaries only, so other letters become underscores first and other marks become dots.
_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(text, '[\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]', ' ', 'g'), '[^\x00-\x7F\PL]|[^\x00-\x7F\PN]|[^\x00-\x7F\PM]', '_', 'g'), '[^\x00-\x7F]', '.', 'g')"


def _terms_sql(source: str) -> str:
    found = rf"regexp_extract_all({_PLAIN}, '\b[A-Z][A-Za-z0-9-]*(?:\s+[A-Z][A-Za-z0-9-]*){{0,2}}\b')"
    return rf"""phrases AS (SELECT doc_id, chunk_id, unnest({found}) AS phrase, unnest(range(len({found}))) AS pos FROM {source}),
words AS (SELECT doc_id, chunk_id, pos, regexp_split_to_array(phrase, '\s+') AS w FROM phrases),
flags AS (SELECT *, list_transform(w, lambda x: NOT list_contains({_STOP}, lower(x))) AS f FROM words),
terms AS (SELECT doc_id, chunk_id, pos, term, lower(term) AS key FROM (
  SELECT doc_id, chunk_id, pos, array_to_string(w[list_position(f, true):len(w) - list_position(list_reverse(f), true) + 1], ' ') AS term FROM flags WHERE list_contains(f, true)) WHERE length(term) >= 3)"""


@query(f"""WITH src AS ({DOCS}), one AS (SELECT doc_id, 'c001' AS chunk_id, text FROM src), {_terms_sql('one')},
per_doc AS (SELECT doc_id, count(*) AS n_terms, string_agg(term, '|' ORDER BY pos) AS terms FROM terms GROUP BY doc_id)
SELECT doc_id, coalesce(n_terms, 0) AS n_terms, md5(coalesce(terms, '')) AS terms_md5 FROM one LEFT JOIN per_doc USING (doc_id)""")
def q05_terms(spark, sf_dir):
    t = _documents(spark, sf_dir).withColumn("t", T.terms(F.col("text")))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", "|")).alias("terms_md5"))


_LINES = _blocks_sql(DOCS, chr(92) + "n")
_ENTITIES = f"""{_LINES}, {_terms_sql('blocks')},
grouped AS (SELECT doc_id, key, arg_min(term, (chunk_id, pos)) AS label, list_sort(list(DISTINCT chunk_id)) AS chunks FROM terms GROUP BY doc_id, key),
slugged AS (SELECT *, coalesce(nullif(trim(regexp_replace(key, '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item') AS slug FROM grouped),
entities AS (SELECT doc_id, key, label, chunks, CASE WHEN nth = 1 THEN slug ELSE slug || '-' || nth END AS id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY key) AS nth FROM slugged))"""


#: Documents whose terms one task pairs.
_TERM_DOCS = 4_000


def _line_terms(spark, sf_dir):
    b = B.blocks(_documents(spark, sf_dir), separator="\n")
    return b, B.term_rows(b)


@query(f"WITH {_ENTITIES} SELECT doc_id, id, label, array_to_string(chunks, ',') AS chunk_ids FROM entities")
def q06_entities(spark, sf_dir):
    return B.entities(_line_terms(spark, sf_dir)[1]).select("doc_id", "id", "label", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query(f"""WITH {_ENTITIES}, firsts AS (SELECT doc_id, chunk_id, key, min(pos) AS pos FROM terms GROUP BY ALL),
pairs AS (SELECT *, lead(key) OVER (PARTITION BY doc_id, chunk_id ORDER BY pos) AS next FROM firsts)
SELECT p.doc_id, s.id AS src, d.id AS dst, array_to_string(list_sort(list(DISTINCT p.chunk_id)), ',') AS chunk_ids
FROM pairs p JOIN entities s ON s.doc_id = p.doc_id AND s.key = p.key JOIN entities d ON d.doc_id = p.doc_id AND d.key = p.next GROUP BY 1, 2, 3""")
def q07_cooccur_edges(spark, sf_dir):
    _, t = _line_terms(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // _TERM_DOCS))
    return B.cooccurrence(t, tasks=tasks).select("doc_id", "src", "dst", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query("""WITH s AS (SELECT p_brand AS graph, p_partkey AS pos, p_name AS label, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item') AS slug FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY graph, slug ORDER BY pos) AS nth FROM s),
ids AS (SELECT graph, lower(label) AS key, arg_min(CASE WHEN nth = 1 THEN slug ELSE slug || '-' || nth END, pos) AS id FROM n GROUP BY 1, 2),
r AS (SELECT p_brand AS graph, p_partkey AS pos, lower(p_name) AS src_key, p_type AS rel, lower(lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey)) AS dst_key, p_size AS chunk FROM part)
SELECT r.graph, a.id AS src, r.rel, b.id AS dst, arg_min(r.chunk, r.pos) AS chunk FROM r JOIN ids a ON a.graph = r.graph AND a.key = r.src_key JOIN ids b ON b.graph = r.graph AND b.key = r.dst_key
WHERE a.id <> b.id GROUP BY 1, 2, 3, 4""")
def q08_label_join_edges(spark, sf_dir):
    from pyspark.sql import Window as W

    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    named = p.select(F.col("p_brand").alias("graph"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("label"))
    following = F.lead("p_name").over(W.partitionBy("p_brand").orderBy("p_partkey"))
    r = p.select(F.col("p_brand").alias("graph"), F.col("p_partkey").alias("pos"), F.upper("p_name").alias("src_label"), F.col("p_type").alias("rel"), F.concat(F.lit(" "), following).alias("dst_label"), F.col("p_size").alias("chunk"))
    return B.resolve_relations(named, r)


@query(f"""WITH {_ENTITIES} SELECT e.doc_id, e.id, 'State the definition of ' || e.label || ' and explain its role.' AS description, b.chunk_id, b.s AS "start", b.e AS "end"
FROM entities e JOIN blocks b ON b.doc_id = e.doc_id AND b.chunk_id = e.chunks[1]""")
def q09_rule_items(spark, sf_dir):
    b, t = _line_terms(spark, sf_dir)
    return B.rule_items(B.entities(t), b).select("doc_id", "id", "description", "chunk_id", "start", "end")


_VERBS = "['" + "', '".join(sorted(set(T.VERBS))) + "']"


def _gate_sql(label: str, d: str) -> str:
    return f"""CASE WHEN length({label}) NOT BETWEEN 3 AND 120 THEN 'label length ' || length({label}) || ' outside 3..120'
  WHEN length({d}) NOT BETWEEN 10 AND 2000 THEN 'description length ' || length({d}) || ' outside 10..2000'
  WHEN NOT list_has_any(regexp_extract_all(lower({d}), '[a-z]+'), {_VERBS}) THEN 'description has no assessable verb' ELSE 'pass' END"""


def _items(spark, sf_dir) -> DataFrame:
    """Documents as items: the text is the description, its first word the label."""
    d = _documents(spark, sf_dir)
    return d.select(F.col("doc_id").alias("id"), F.split("text", " ", 2)[0].alias("label"), F.col("text").alias("description"))


_ITEMS = f"src AS ({DOCS}), items AS (SELECT doc_id AS id, split_part(text, ' ', 1) AS label, text AS description FROM src)"


@query(f"WITH {_ITEMS} SELECT id, {_gate_sql('label', 'description')} AS reason FROM items")
def q10_gate(spark, sf_dir):
    return _items(spark, sf_dir).select("id", T.gate(F.col("label"), F.col("description"))["reason"].alias("reason"))


@query(rf"""WITH {_ITEMS}, g AS (SELECT *, {_gate_sql('label', 'description')} AS reason,
  list_filter(list_transform(string_split(regexp_replace(description, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, E' \n\t\r')), lambda x: x <> '') AS parts FROM items),
c AS (SELECT *, CASE WHEN len(parts) >= 2 THEN [parts[1], array_to_string(parts[2:], ' ')] ELSE [] END AS two FROM g),
k AS (SELECT *, CASE WHEN reason = 'pass' THEN [] ELSE list_filter(two, lambda x: {_gate_sql('label', 'x')} = 'pass') END AS kept FROM c)
SELECT id, CASE WHEN reason = 'pass' THEN 'accepted' WHEN len(kept) > 0 THEN 'split' ELSE 'dropped' END AS decision, len(kept)::INT AS n_children, md5(array_to_string(kept, '|')) AS children_md5 FROM k""")
def q11_split(spark, sf_dir):
    g = B.gate_items(_items(spark, sf_dir))
    return g.select("id", "decision", F.size("children").alias("n_children"), F.md5(F.array_join("children.description", "|")).alias("children_md5"))


@query("SELECT doc_id AS id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 30 AS kept FROM documents")
def q12_topk_items(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "source")
    return B.cap_items(d, "source", 30)


@query("""WITH raw AS (SELECT CASE p_size % 7 WHEN 0 THEN ' Apply ' WHEN 1 THEN 'REMEMBER' WHEN 2 THEN 'guess' WHEN 3 THEN 'create' WHEN 4 THEN '' WHEN 5 THEN 'Evaluate' END AS bloom,
  CASE p_size % 5 WHEN 0 THEN 'Factual ' WHEN 1 THEN 'procedural' WHEN 2 THEN 'x' END AS knowledge, CASE p_size % 6 WHEN 5 THEN 'n/a' ELSE p_size::VARCHAR END AS depth FROM part)
SELECT CASE WHEN lower(trim(bloom)) IN ('remember','understand','apply','analyze','evaluate','create') THEN lower(trim(bloom)) ELSE 'understand' END AS bloom,
  CASE WHEN lower(trim(knowledge)) IN ('factual','conceptual','procedural','metacognitive') THEN lower(trim(knowledge)) ELSE 'conceptual' END AS knowledge,
  CASE WHEN try_cast(depth AS INT) BETWEEN 1 AND 4 THEN try_cast(depth AS INT) ELSE 1 END AS dok, count(*) AS n FROM raw GROUP BY 1, 2, 3""")
def q13_enum_coerce(spark, sf_dir):
    size = F.col("p_size")
    b, k = size % 7, size % 5
    bloom = F.when(b == 0, " Apply ").when(b == 1, "REMEMBER").when(b == 2, "guess").when(b == 3, "create").when(b == 4, "").when(b == 5, "Evaluate")
    knowledge = F.when(k == 0, "Factual ").when(k == 1, "procedural").when(k == 2, "x")
    depth = F.when(size % 6 == 5, "n/a").otherwise(size.cast("string"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = p.select(T.coerce_level(bloom).alias("bloom"), T.coerce_knowledge(knowledge).alias("knowledge"), T.coerce_depth(depth).alias("dok"))
    return rows.groupBy("bloom", "knowledge", "dok").agg(F.count("*").alias("n"))
