"""The driver's queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import collocations as phrases
from loomspan.llm import main_text, merkle, mixing, pii, quality, secrets, sentencepiece, sharding, simhash, topk, toxicity
from loomspan.llm import exact_dedup as exact
from loomspan.plans.storage import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents for operators that work in Python, dealt over all cores where the files are few."""
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan_secrets(_table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_texts(spark, sf_dir))


#: The public byte-pair model that op4 and the pipeline encode with, unless LOOMSPAN_PIECES names another.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece.load_model(spark, os.environ.get("LOOMSPAN_PIECES", PIECES))
    return sentencepiece.encode_documents(_texts(spark, sf_dir), model)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_texts(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = secrets.span_list
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(spans(F.col("base")), 256).alias("base_sha256"), spans(F.concat("base", "added")).alias("spans"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_texts(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_texts(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_table(spark, sf_dir, "documents")).drop("row_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(spread(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, held against texts that half of the rows have without their line ends."""
    changed = F.crc32(F.col("doc_id").cast("long").cast("string")) % 2 == 0
    text = F.when(changed, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.merkle_manifest(_table(spark, sf_dir, "documents"), given={"text": text})


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(_table(spark, sf_dir, "pages"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_pii": op5_pii,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sharding": op9_sharding,
    "op10_topk": op10_topk,
    "op11_merkle": op11_merkle,
    "op12_main_text": op12_main_text,
    "op13_collocations": op13_collocations,
}

OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS place FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST)) - 1) % 3 + 1]::BIGINT AS weight FROM sources),
levels AS (SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(3 * source_size) OVER clamped, 0))::DOUBLE
         / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER clamped, 0))::DOUBLE AS level FROM weighted
  WINDOW clamped AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets)
SELECT d.doc_id, d.size, p.source_size, p.target,
       p.whole * d.size + greatest(0, least(d.size, floor(p.target - p.whole * p.source_size + 0.5)::BIGINT
         - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT))::BIGINT AS taken
FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
"""

_CI = secrets.KEYWORDS
_OTHER = secrets.OTHER_KEYWORDS


def _span_sql(pattern: str, kind: str, rank: int, keep: str, value: str) -> str:
    """Spans of one pattern: positions are running lengths of the pieces between matches and the matches."""
    pattern = pattern.replace("'", "''")
    value = value.replace("PATTERN", pattern)
    return f"""
  SELECT row, {rank} AS rank, '{kind}' AS kind, s - length(hit) AS s, s AS e, {value} AS secret FROM (
    SELECT row, hit, (sum(length(gap) + length(hit)) OVER (PARTITION BY row ORDER BY i))::BIGINT AS s FROM (
      SELECT row, unnest(regexp_extract_all(text, '{pattern}')) AS hit, unnest(regexp_split_to_array(text, '{pattern}')[:-2]) AS gap,
             unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS i FROM docs WHERE regexp_matches(text, '{pattern}'))) WHERE {keep.replace("SECRET", value)}"""


def _assign_sql(words: str, least: int) -> str:
    return _span_sql(rf"""(?:{words})["']?\x20*[:=]\x20*["']?(?:{secrets.VALUE})""", "assign", 0, f"length(SECRET) >= {least}", rf"""regexp_extract(hit, '({words})["'']?\x20*[:=]\x20*["'']?({secrets.VALUE})', 2)""")


OP2_SQL = rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce('r' || doc_id, 'null') AS repo, coalesce('o' || source, 'null') AS owner, coalesce(text, '') AS text FROM documents),
base AS ({_assign_sql(_CI, 12)} UNION ALL {_span_sql(secrets.ACCESS, "access", 1, "length(hit) >= 18", "hit")}
  UNION ALL {_span_sql(secrets.HEX, "hex", 2, "true", "hit")}),
other AS ({_assign_sql(_OTHER, 8)}),
opaque AS ({_span_sql(secrets.OPAQUE, "hex", 2, "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]')", "hit")}),
further AS (
  SELECT * FROM (SELECT * FROM other UNION ALL
    SELECT * FROM opaque p WHERE NOT EXISTS (SELECT 1 FROM other o WHERE o.row = p.row AND o.s < p.e AND p.s < o.e)) f
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = f.row AND b.s < f.e AND f.s < b.e)),
every AS (SELECT e.*, d.repo, d.owner FROM (SELECT *, true AS is_base FROM base UNION ALL SELECT *, false FROM further) e JOIN docs d USING (row)),
frequency AS (SELECT secret, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM every GROUP BY secret),
judged AS (SELECT e.*, f.owners, f.repos, f.owners > 2 OR f.repos > 20 AS example FROM every e JOIN frequency f USING (secret)),
per_doc AS (
  SELECT row, count_if(is_base AND kind = 'assign') AS n_assign, count_if(is_base AND kind = 'access') AS n_access, count_if(is_base AND kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (is_base) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (is_base OR NOT example) AS spans,
         count_if(is_base AND example) AS n_example, count_if(is_base AND NOT example) AS n_live, max(owners) AS most_owners, max(repos) AS most_repos
  FROM judged GROUP BY row)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_example, 0)::BIGINT AS n_example,
       coalesce(n_live, 0)::BIGINT AS n_live, coalesce(most_owners, 0)::BIGINT AS most_owners, coalesce(most_repos, 0)::BIGINT AS most_repos
FROM docs d LEFT JOIN per_doc USING (row)
"""

OP8_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

OP9_SQL = """
WITH d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 9))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS bytes FROM documents),
chain AS (SELECT doc_id, h, bytes, depth, h >> (36 - depth) AS prefix FROM d, range(25) r(depth)),
sums AS (SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes FROM chain GROUP BY depth, prefix HAVING sum(bytes) <= 16777216),
leaf AS (SELECT c.doc_id, c.h, c.bytes, min(c.depth) AS depth, arg_min(s.shard_bytes, c.depth) AS shard_bytes FROM chain c JOIN sums s USING (depth, prefix) GROUP BY c.doc_id, c.h, c.bytes)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (36 - depth)), depth::INT, '0') END AS shard, depth::INT AS depth, bytes, shard_bytes, false AS oversize FROM leaf
"""

OP10_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT row, vec_id, len(c) AS n, unnest(c) AS x, unnest(range(len(c))) AS i FROM v),
s AS (
  SELECT q.row AS query_row, q.vec_id AS query_id, e.row, e.vec_id, sum(q.x * e.x)::BIGINT AS score
  FROM e q JOIN e ON q.i = e.i AND q.n = e.n AND q.row <> e.row WHERE q.vec_id % 100 = 0 GROUP BY ALL
  UNION ALL SELECT q.row, q.vec_id, e.row, e.vec_id, 0 FROM v q JOIN v e ON len(q.c) = 0 AND len(e.c) = 0 AND q.row <> e.row WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""



def _leaf_sql(text: str) -> str:
    columns = [*(c for c in merkle.FIELDS if c != "text"), text]
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in columns) + ")"


OP11_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce('+' || source, '') AS key, {_leaf_sql("text")} AS leaf, {_leaf_sql("altered")} AS given FROM (
    SELECT *, CASE WHEN list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS altered FROM documents)),
placed AS MATERIALIZED (SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
tree AS (SELECT key, 0 AS lvl, pos, leaf AS node FROM placed
  UNION ALL SELECT key, lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM tree) WHERE n > 1 GROUP BY key, lvl, pos // 3),
subroots AS MATERIALIZED (SELECT key, row_number() OVER (ORDER BY key COLLATE "binary") - 1 AS place, arg_max(node, lvl) AS subroot FROM tree GROUP BY key),
crown AS (SELECT 'crown' AS key, 0 AS lvl, place AS pos, subroot AS node FROM subroots
  UNION ALL SELECT key, lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM crown) WHERE n > 1 GROUP BY key, lvl, pos // 3),
nodes AS MATERIALIZED (SELECT *, max(lvl) OVER (PARTITION BY key) AS top FROM (SELECT * FROM tree UNION ALL SELECT * FROM crown)),
steps AS MATERIALIZED (SELECT a.key, a.lvl, a.pos, (a.pos % 3) || coalesce(string_agg(b.node, '' ORDER BY b.pos), '') AS step
  FROM nodes a LEFT JOIN nodes b ON b.key = a.key AND b.lvl = a.lvl AND b.pos // 3 = a.pos // 3 AND b.pos <> a.pos WHERE a.lvl < a.top GROUP BY a.key, a.lvl, a.pos),
proofs AS (SELECT row, list(step ORDER BY crown, lvl) AS proof FROM (
    SELECT row, false AS crown, lvl, step FROM placed p JOIN steps s ON s.key = p.key AND s.pos = p.pos // (3 ** s.lvl)::BIGINT
    UNION ALL SELECT row, true, lvl, step FROM placed p JOIN subroots USING (key) JOIN steps s ON s.key = 'crown' AND s.pos = place // (3 ** s.lvl)::BIGINT) GROUP BY row),
folded AS (SELECT p.doc_id, p.leaf, subroot, (SELECT node FROM nodes WHERE key = 'crown' AND lvl = top) AS root, sha256(array_to_string(list_transform(coalesce(proof, []), lambda s: substr(s, 2)), '')) AS proof_sha256,
    list_reduce(list_prepend(p.given, coalesce(proof, [])), lambda n, s: sha256(substr(s, 2, 64 * s[1]::INT) || n || substr(s, 2 + 64 * s[1]::INT))) AS folded_root
  FROM placed p JOIN subroots USING (key) LEFT JOIN proofs USING (row))
SELECT *, folded_root = root AS verified FROM folded
"""

OP13_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM words, range(1, {phrases.LONGEST + 1}) s(size)),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*)::BIGINT AS n FROM grams GROUP BY ALL HAVING count(*) >= {phrases.LEAST}),
candidates AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (SELECT c.lang, c.phrase, c.size, c.a, k, x.n AS l, y.n AS r, ((1000000::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[:k], ' ') AND x.size = k JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ') AND y.size = c.size - k),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
holders AS (SELECT lang, part, max(a) AS held FROM (SELECT lang, a, unnest([array_to_string(w[:-2], ' '), array_to_string(w[2:], ' ')]) AS part FROM candidates WHERE size = 3) GROUP BY ALL),
ranked AS (SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, phrase COLLATE "binary") AS rank FROM lowest l LEFT JOIN holders h ON h.lang = l.lang AND h.part = l.phrase
  WHERE held IS NULL OR 100 * held < {phrases.SUBSUMED} * a),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {phrases.BEST}
"""

ORACLE_SQL = {"op1_mixing": OP1_SQL, "op2_secrets": OP2_SQL, "op8_exact_dedup": OP8_SQL, "op9_sharding": OP9_SQL, "op10_topk": OP10_SQL, "op11_merkle": OP11_SQL, "op13_collocations": OP13_SQL}
