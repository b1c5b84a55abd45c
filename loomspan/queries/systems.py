"""Queries over the closed loop, the stream, recorded replies and repository snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.operators import snapshots as A
from loomspan.operators import cassette as C
from loomspan.operators import history as H
from loomspan.operators import quest as Q
from loomspan.plans.storage import materialize, shared_root
from loomspan.queries import learning
from loomspan.queries.learning import _SESSION_SQL, attempts
from loomspan.streaming import replay as R

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _story() -> Q.Story:
    """Twelve beats over a chain of items, one choice check each, every fourth beat without a check."""
    items = [f"k{i:02d}" for i in range(12)]
    beats = [{"id": f"b{i:02d}", "teaches": [items[i]], "requires": [items[i - 1]] if i % 3 else [], "checks": [] if i % 4 == 3 else [f"c{i:02d}"], "difficulty": i % 4 + 1} for i in range(12)]
    checks = [{"id": f"c{i:02d}", "kind": "choice", "item_id": items[i], "max_score": 1, "payload": {"answer": "right"}} for i in range(12)]
    return Q.Story.of(beats, checks, items, [(a, b) for a, b in zip(items, items[1:], strict=False)])


def _attempt_sql(ok: str, when: str) -> dict[str, str]:
    """A learner's columns after one attempt at the beat's check, where one is made."""
    after = lambda before: learning.TRACE.replace("acc", before).replace("WHEN v THEN", f"WHEN {ok} THEN")
    recent = f"list_append(recent, ({ok})::INT)[-10:]"
    new = {
        "pos": "pos + 1", "attempts": "attempts + 1", "passed": f"passed + ({ok})::INT", "xp": f"xp + 10 * ({ok})::INT", "recent": recent,
        "m": f"list_transform(range(12), lambda i: CASE WHEN i = beat THEN {after('m[i + 1]')} ELSE m[i + 1] END)",
        "in_band": f"in_band + (list_avg({recent}) BETWEEN 0.7::DOUBLE AND 0.85::DOUBLE)::INT",
        "streak": f"CASE WHEN {ok} THEN streak + 1 ELSE 0 END", "streak_max": f"greatest(streak_max, CASE WHEN {ok} THEN streak + 1 ELSE 0 END)",
        "statements": f"statements + 2 + (m[beat + 1] < 0.95::DOUBLE AND {after('m[beat + 1]')} >= 0.95::DOUBLE)::INT",
    }
    return {c: f"CASE WHEN {when} THEN {e} ELSE {c} END AS {c}" for c, e in new.items()}


_NUMBERS = ("pos", "picks", "attempts", "passed", "xp", "streak", "streak_max", "in_band", "statements", "retries_used")
_KEPT = ", ".join((*_NUMBERS, "visited", "m", "recent"))
_FIRST = _attempt_sql("r1", "tried") | {"statements": "statements + seen + CASE WHEN tried THEN 2 + (m[beat + 1] < 0.95::DOUBLE AND " + learning.TRACE.replace("acc", "m[beat + 1]").replace("WHEN v THEN", "WHEN r1 THEN") + " >= 0.95::DOUBLE)::INT ELSE 0 END AS statements"}
_AGAIN = _attempt_sql("r2", "retried")
#: A pick a step: the best ready beat, its first and, after a failure, its second answer; lists hold beats, mastery and the last ten outcomes.
QUEST_SQL = f"""WITH RECURSIVE {learning.ATTEMPTS},
answers AS (SELECT actor, list(ok ORDER BY step) AS a FROM attempts GROUP BY actor),
quest AS (
  SELECT actor, {", ".join(f"0::BIGINT AS {c}" for c in _NUMBERS)}, []::BIGINT[] AS visited, list_transform(range(12), lambda i: 0.0::DOUBLE) AS m, []::INT[] AS recent, NULL::VARCHAR AS reason FROM answers
  UNION ALL
  SELECT actor, {", ".join(_AGAIN.get(c, c) if c != "retries_used" else "retries_used + retried::INT AS retries_used" for c in _KEPT.split(", "))},
         CASE WHEN reason IS NULL AND tried AND NOT r1 AND r2 IS NULL THEN 'responses_exhausted' ELSE reason END AS reason
  FROM (SELECT *, coalesce(tried AND NOT r1 AND r2 IS NOT NULL, false) AS retried FROM (
    SELECT actor, {", ".join(_FIRST.get(c, c) for c in _KEPT.split(", ") if c not in ("picks", "visited"))}, picks + seen AS picks, CASE WHEN seen = 1 THEN list_append(visited, beat) ELSE visited END AS visited,
           beat, r1, a[pos + 2] AS r2, tried, CASE WHEN beat IS NULL AND len(visited) = 12 THEN 'quest_complete' WHEN beat IS NULL THEN 'gated' WHEN seen = 0 THEN 'responses_exhausted' END AS reason
    FROM (SELECT *, a[pos + 1] AS r1, coalesce(beat % 4 <> 3 AND a[pos + 1] IS NOT NULL, false) AS tried, coalesce(beat % 4 = 3 OR a[pos + 1] IS NOT NULL, false)::INT * (beat IS NOT NULL)::INT AS seen FROM (
      SELECT *, CASE WHEN list_max(scores) IS NOT NULL THEN list_position(scores, list_max(scores)) - 1 END AS beat FROM (
        SELECT q.*, a, list_transform(range(12), lambda i: CASE WHEN NOT list_contains(visited, i) AND (i % 3 = 0 OR m[i] >= 0.95::DOUBLE OR list_contains(visited, i - 1)) THEN
            round_even((CASE WHEN m[i + 1] < 0.95::DOUBLE AND (i = 0 OR m[i] >= 0.95::DOUBLE) THEN 2.0 ELSE 0.0 END)::DOUBLE + 1.0::DOUBLE - m[i + 1]
              + (CASE WHEN coalesce(list_avg(recent), 1.0) > 0.85::DOUBLE THEN 0.25 WHEN coalesce(list_avg(recent), 1.0) < 0.7::DOUBLE THEN -0.25 ELSE 0.0 END)::DOUBLE * (i % 4 + 1), 9) END) AS scores
        FROM quest q JOIN answers USING (actor) WHERE reason IS NULL))))))
SELECT actor::VARCHAR AS actor, reason, picks, array_to_string(list_transform(visited, lambda i: 'b' || lpad(i::VARCHAR, 2, '0')), ',') AS visited, attempts, passed, xp, streak_max,
       CASE WHEN attempts > 0 THEN round_even(in_band / attempts::DOUBLE, 4) ELSE 1.0 END AS flow_in_band_ratio, statements, retries_used FROM quest WHERE reason IS NOT NULL"""


@query(QUEST_SQL)
def q47_quest(spark, sf_dir):
    a = attempts(spark, sf_dir)
    answers = a.select(F.col("actor").cast("string").alias("actor"), F.col("step").alias("pos"), F.when(F.col("ok"), "right").otherwise("wrong").alias("response"), F.lit(None).cast("string").alias("state"))
    return Q.quests(answers, _story()).drop("state", "transcript").withColumn("visited", F.array_join("visited", ","))


_STREAM_SQL = _SESSION_SQL.replace("SELECT actor, beats_visited, attempts", "SELECT actor::VARCHAR AS actor, beats_visited, attempts").replace(" mastery, flow_in_band_ratio", " flow_in_band_ratio")


def _streamed(e):
    """events as a stream's or a batch's attempts, ordered by time and id."""
    k = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("long") % 8).cast("string"))
    rows = e.select(
        F.col("user_id").cast("string").alias("actor"), F.struct("ts", "event_id").alias("o"), F.col("event_type").alias("beat"), F.col("event_type").alias("check"), k.alias("item"),
        (F.least("value", F.lit(50.0)) / 50.0).alias("score"), F.lit(1.0).alias("max_score"), ((F.col("event_type") != "error") & (F.col("value") < 20)).alias("ok"),
    )
    return rows.withColumn("ordinal", F.concat(F.date_format("o.ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lpad(F.col("o.event_id").cast("string"), 20, "0"))).drop("o")


def _live_events(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # as a pattern: a stream reads folders or patterns


def _session_rows(s):
    summary = "beats_visited array<string>, attempts long, passed long, xp long, level long, streak_max long, flow_in_band_ratio double, statements long, skipped long, retries_used long"
    out = s.select("actor", F.from_json("session", summary).alias("s")).select("actor", "s.*")
    return out.withColumn("beats_visited", F.array_join("beats_visited", ","))


@query(_STREAM_SQL)
def q48_stream_session(spark, sf_dir):
    return _session_rows(R.replay_available(spark, _streamed(_live_events(spark, sf_dir))))


def _halves(spark, sf_dir):
    """events, and the time that parts them in halves."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e, F.lit(e.agg(F.percentile_approx("ts", 0.5)).first()[0])


@query(_STREAM_SQL)
def q70_resumed_session(spark, sf_dir):
    """The first half of the events in batch; the learners saved after it go on with the rest as a stream."""
    e, middle = _halves(spark, sf_dir)
    states = materialize(R.learner_states(_streamed(e.filter(F.col("ts") < middle))))
    rest = _live_events(spark, sf_dir).filter(F.col("ts") >= middle)
    return _session_rows(R.replay_available(spark, _streamed(rest), states=states))


@query(learning.ORACLE_SQL["q67_statement_store"])
def q71_live_statements(spark, sf_dir):
    """Statements as the stream says them, in two runs on one folder: the second goes on where the first was cut."""
    e, middle = _halves(spark, sf_dir)
    folder = f"{shared_root(spark)}/loomspan/{uuid.uuid4().hex}"
    for part in (e.filter(F.col("ts") < middle), e.filter(F.col("ts") >= middle)):
        part.write.mode("append").parquet(f"{folder}/events")
        R.follow(spark, _streamed(spark.readStream.schema(e.schema).parquet(f"{folder}/events")), f"{folder}/live")
    said = R.live_statements(spark, f"{folder}/live")
    return said.select(F.col("actor").cast("long").alias("actor"), F.col("step").alias("timestamp"), "verb", "object", F.bround("score", 6).alias("score"))


@query("""WITH cassette AS (SELECT * FROM (VALUES ('view', 0, 3), ('view', 1, 5), ('click', 0, 2), ('purchase', 0, 11), ('purchase', 1, 7), ('purchase', 2, 1)) t(role, ordinal, tokens)),
calls AS (SELECT user_id AS session, event_id AS pos, event_type AS role, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS nth FROM events),
met AS (SELECT c.session, c.pos, c.role, k.ordinal, k.tokens FROM calls c JOIN cassette k ON k.role = c.role AND k.ordinal = c.nth % (SELECT count(*) FROM cassette x WHERE x.role = c.role))
SELECT session, pos, role, ordinal::BIGINT AS ordinal, tokens::BIGINT AS tokens, sum(tokens) OVER w::BIGINT AS spent, sum(tokens) OVER w <= 150 AS allowed FROM met WINDOW w AS (PARTITION BY session ORDER BY pos)""".replace("sum(tokens) OVER w::BIGINT", "(sum(tokens) OVER w)::BIGINT"))
def q49_budget_calls(spark, sf_dir):
    rows = [("view", 0, 3), ("view", 1, 5), ("click", 0, 2), ("purchase", 0, 11), ("purchase", 1, 7), ("purchase", 2, 1)]
    tape = spark.createDataFrame(rows, "role string, ordinal long, tokens long")
    calls = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), F.col("event_type").alias("role"))
    return C.replay_calls(calls, tape, 150)


_PAGES = r"files AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, html FROM pages)"


def _files(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return p.select("page_id", path.alias("path"), "html")


@query(f"""WITH {_PAGES}, parts AS (SELECT string_split(path, '/') AS p FROM files), above AS (SELECT array_to_string(p[1:n], '/') AS dir, array_to_string(p[1:len(p) - 1], '/') AS own FROM (SELECT p, unnest(range(len(p))) AS n FROM parts))
SELECT dir AS path, CASE WHEN dir = '' THEN '' ELSE string_split(dir, '/')[-1] END AS name, CASE WHEN dir <> '' THEN array_to_string(string_split(dir, '/')[1:-2], '/') END AS parent,
 CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END::INT AS depth, count_if(dir = own) AS files FROM above GROUP BY dir""")
def q50_dir_tree(spark, sf_dir):
    return A.directories(_files(spark, sf_dir))


@query(r"""SELECT page_id, len(list_filter(string_split(coalesce(html, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\r]')))::BIGINT AS loc,
 coalesce(len(regexp_extract_all(html, '\b(?:TODO|FIXME|HACK|XXX)\b')), 0)::BIGINT AS markers FROM pages""")
def q51_loc_todo(spark, sf_dir):
    return _files(spark, sf_dir).select("page_id", A.loc(F.col("html")).alias("loc"), A.markers(F.col("html")).alias("markers"))


@query(f"""WITH {_PAGES}, named AS (SELECT path, min(page_id) AS n FROM files GROUP BY path), asked AS (SELECT page_id, path AS src, page_id // 2 + length(path) % 7 AS n, page_id % 3 = 0 AS weak FROM files)
SELECT a.src, f.path AS dst, bool_and(a.weak) AS weak FROM asked a JOIN named f ON f.n = a.n WHERE a.src <> f.path GROUP BY 1, 2""")
def q52_import_edges(spark, sf_dir):
    files = _files(spark, sf_dir).select("page_id", "path")
    named = files.groupBy("path").agg(F.min("page_id").alias("n"))
    asked = files.select(F.col("path").alias("src"), F.expr("page_id div 2 + length(path) % 7").alias("n"), (F.col("page_id") % 3 == 0).alias("weak"))
    return A.import_edges(asked.join(named.withColumnRenamed("path", "spec"), "n").select("src", "spec", "weak"), named)


@query(f"""WITH {_PAGES}, l AS (SELECT regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(list_filter(string_split(coalesce(html, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\r]'))) AS loc FROM files)
SELECT coalesce(nullif(lang, ''), 'other') AS language, count(*) AS files, sum(loc)::BIGINT AS loc FROM l GROUP BY 1""")
def q53_lang_stats(spark, sf_dir):
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    return A.language_stats(_files(spark, sf_dir).select(F.when(lang != "", lang).alias("language"), A.loc(F.col("html")).alias("loc")))


def _defs(spark, sf_dir):
    """A user's events as definitions: ranges from the event's place over as many lines as its value."""
    a = attempts(spark, sf_dir).withColumn("value", F.col("score") * 50)
    return a.select(F.col("actor").alias("file"), F.col("step").alias("idx"), F.col("step").alias("start"), (F.col("step") + F.floor("value")).alias("end"), F.col("item").alias("name"))


_DEFS = """numbered AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, floor(least(value, 50.0::DOUBLE) / 50.0::DOUBLE * 50)::BIGINT AS span, 'k' || (json_extract_string(props, '$.k')::BIGINT % 8) AS name FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY span DESC, idx) AS rn FROM numbered), defs AS (SELECT file, idx, idx AS s, idx + span AS e, span, name FROM ranked WHERE rn <= 300)"""


@query(f"""WITH {_DEFS}, over_ AS (SELECT a.file, a.idx, arg_min(b.idx, (b.span, b.idx)) AS parent FROM defs a JOIN defs b ON a.file = b.file AND b.s <= a.s AND b.e >= a.e AND b.span > a.span GROUP BY 1, 2)
SELECT d.file, d.idx, parent FROM defs d LEFT JOIN over_ USING (file, idx)""")
def q54_containment(spark, sf_dir):
    return A.containment(_defs(spark, sf_dir))


@query(f"""WITH {_DEFS}, refs AS (SELECT file, idx AS line, 'k' || (idx * 3 % 11) AS name FROM defs),
callers AS (SELECT r.file, r.line, r.name, arg_min(d.idx, (d.span, d.idx)) AS src_idx FROM refs r JOIN defs d ON d.file = r.file AND r.line BETWEEN d.s AND d.e GROUP BY 1, 2, 3),
named AS (SELECT file, name, min(idx) AS idx FROM defs GROUP BY 1, 2),
found AS (SELECT c.file, c.line, c.name, c.src_idx, p.rank, n.file AS dst_file, n.idx AS dst_idx FROM callers c JOIN (SELECT file, file AS other, 0 AS rank FROM (SELECT DISTINCT file FROM callers) UNION ALL SELECT DISTINCT file, file + 1, 1 FROM defs) p ON p.file = c.file JOIN named n ON n.file = p.other AND n.name = c.name),
best AS (SELECT file, line, name, src_idx, arg_min(dst_file, rank) AS dst_file, arg_min(dst_idx, rank) AS dst_idx FROM found GROUP BY 1, 2, 3, 4)
SELECT DISTINCT file AS src_file, src_idx, dst_file, dst_idx FROM best WHERE file <> dst_file OR src_idx <> dst_idx""")
def q55_call_edges(spark, sf_dir):
    d = _defs(spark, sf_dir)
    refs = A.kept_symbols(d).select("file", F.col("idx").alias("line"), F.concat(F.lit("k"), (F.col("idx") * 3 % 11).cast("string")).alias("name"))
    near = d.select("file").distinct().select("file", (F.col("file") + 1).alias("neighbour"), F.lit(0).alias("rank"))
    return A.call_edges(d, refs, near)


@query("""WITH r AS (SELECT o_custkey % 25 AS g, o_orderkey, o_totalprice / 1000 AS r FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY r) - 1 AS n, count(*) OVER (PARTITION BY g) AS size FROM r),
soft AS (SELECT g, greatest(25.0::DOUBLE, max(r) FILTER (n = floor((size - 1) * 0.75))) AS soft FROM n GROUP BY g)
SELECT o_orderkey, round_even(soft, 6) AS soft, round_even(CASE WHEN r > 0 THEN least(1.0::DOUBLE, soft / r) ELSE 1.0::DOUBLE END, 6) AS scale FROM r JOIN soft USING (g)""")
def q56_pctl_clamp(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_custkey") % 25).alias("g"), (F.col("o_totalprice") / 1000).alias("r"))
    return A.radius_clamp(o, "g", "r").select("o_orderkey", F.bround("soft", 6).alias("soft"), F.bround("scale", 6).alias("scale"))


@query(f"""WITH arcs AS (SELECT DISTINCT l_orderkey // 8 AS repo, 'f' || (l_partkey % 24) AS src, 'f' || ((l_partkey * 5 + l_linenumber) % 24) AS dst FROM lineitem),
paths AS (WITH RECURSIVE p(repo, src, dst) AS (SELECT * FROM arcs UNION SELECT p.repo, p.src, a.dst FROM p JOIN arcs a ON a.repo = p.repo AND a.src = p.dst) SELECT * FROM p)
SELECT a.repo::VARCHAR AS repo, a.src AS path, min(a.dst) AS component FROM paths a JOIN paths b ON b.repo = a.repo AND b.src = a.dst AND b.dst = a.src GROUP BY 1, 2 HAVING count(DISTINCT a.dst) > 1""")
def q61_cycles(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    arcs = l.select(F.expr("l_orderkey div 8").alias("repo"), F.concat(F.lit("f"), F.col("l_partkey") % 24).alias("src"), F.concat(F.lit("f"), (F.col("l_partkey") * 5 + F.col("l_linenumber")) % 24).alias("dst"))
    return A.cycles(arcs.distinct(), "repo")


@query(r"""SELECT page_id, regexp_matches(path, '\.(min|bundle)\.') OR length(html) / greatest(len(list_filter(string_split(coalesce(html, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\r]'))), 1) > 250 AS minified,
 md5(trim(regexp_replace(regexp_replace(spec, '^["''<]', ''), '["''>]$', ''))) AS spec_md5, md5(CASE WHEN length(html) > 400 THEN substring(html, 1, 400) || chr(10) || '… (truncated)' ELSE html END) AS source_md5,
 md5(replace(html, '<', '\u003c')) AS script_md5, md5(replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;')) AS html_md5,
 CASE page_id % 3 WHEN 0 THEN '—' WHEN 1 THEN 'no time' ELSE '2024-03-0' || (page_id % 9 + 1) || ' 0' || (page_id % 7 + 2) || ':30' END AS changed
FROM (SELECT page_id, html, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || CASE WHEN page_id % 10 = 0 THEN '.min.js' ELSE '' END AS path, '" ' || url || ' >' AS spec FROM pages)""")
def q62_page_texts(spark, sf_dir):
    """Minified files, cleaned imports, clipped sources, escapes and short dates of every page."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.concat(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), F.when(F.col("page_id") % 10 == 0, ".min.js").otherwise(""))
    spec = F.concat(F.lit('" '), "url", F.lit(" >"))
    html, n = F.col("html"), F.col("page_id")
    iso = F.when(n % 3 == 1, "no time").when(n % 3 == 2, F.concat(F.lit("2024-03-0"), n % 9 + 1, F.lit("T0"), n % 7 + 3, F.lit(":30:15+01:00")))
    return p.select(
        "page_id", A.is_minified(path, html).alias("minified"), F.md5(A.clean_import(spec)).alias("spec_md5"), F.md5(A.clipped_source(html, 400)).alias("source_md5"),
        F.md5(A.script_json(html)).alias("script_md5"), F.md5(A.html_escape(html)).alias("html_md5"), A.short_date(iso).alias("changed"),
    )


_PACKAGES = """files AS (SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN 'main/' ELSE 'src/' END || p || '.java' AS path FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', '') AS p FROM pages) WHERE p <> ''),
imports AS (SELECT DISTINCT 'src/' || p || '.java' AS src, replace(CASE WHEN page_id % 5 = 0 THEN regexp_replace(q, '/?[^/]*$', '') || '/*' ELSE q END, '/', '.') AS name FROM
  (SELECT a.page_id, regexp_replace(regexp_replace(a.url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', '') AS p, regexp_replace(regexp_replace(b.url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', '') AS q FROM pages a JOIN pages b ON b.page_id = a.page_id // 2) WHERE p <> '' AND q <> '')"""


@query(f"""WITH {_PACKAGES}, roots AS (SELECT * FROM (VALUES (0, 'main/'), (1, 'src/')) t(rank, root)),
asked AS (SELECT src, name, rank, root || replace(name, '.', '/') AS place FROM imports CROSS JOIN roots),
exact AS (SELECT src, name, arg_min(path, rank) AS dst FROM asked JOIN files ON regexp_replace(path, '[.]java$', '') = place GROUP BY 1, 2),
listed AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS place, row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY path) AS n FROM files),
star AS (SELECT a.src, a.name, a.rank, l.path AS dst, min(a.rank) OVER (PARTITION BY a.src, a.name) AS best FROM asked a JOIN listed l ON l.n <= 40 AND l.place = regexp_replace(a.place, '/[*]$', '') WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.src = a.src AND e.name = a.name))
SELECT src, dst, bool_and(weak) AS weak FROM (SELECT src, dst, false AS weak FROM exact UNION ALL SELECT src, dst, true FROM star WHERE rank = best) WHERE src <> dst GROUP BY 1, 2""")
def q63_package_imports(spark, sf_dir):
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, "^[a-z]+://[^/]*/?", ""), "[?#].*$", "")
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", clean("url").alias("p"))
    root = F.when(F.col("page_id") % 3 == 0, "main/").otherwise("src/")
    files = p.filter("p <> ''").select(F.concat(root, "p", F.lit(".java")).alias("path")).distinct()
    pairs = p.withColumn("half", F.expr("page_id div 2")).join(p.select(F.col("page_id").alias("half"), F.col("p").alias("q")), "half").filter("p <> '' and q <> ''")
    name = F.when(F.col("page_id") % 5 == 0, F.concat(F.regexp_replace("q", "/?[^/]*$", ""), F.lit("/*"))).otherwise(F.col("q"))
    imports = pairs.select(F.concat(F.lit("src/"), "p", F.lit(".java")).alias("src"), F.replace(name, F.lit("/"), F.lit(".")).alias("name")).distinct()
    return A.resolve_packages(imports, files, ("main/", "src/"))


@query("""SELECT 'f' || (l_partkey % 500) AS path, count_if(l_returnflag = 'A') AS symbols, count_if(l_returnflag = 'N') AS imports, count_if(l_returnflag = 'R') AS complexity FROM lineitem GROUP BY 1""")
def q64_capture_counts(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    kind = F.when(F.col("l_returnflag") == "A", "def.function").when(F.col("l_returnflag") == "N", "import.module").otherwise("cx")
    return A.capture_counts(l.select(F.concat(F.lit("f"), F.col("l_partkey") % 500).alias("path"), F.when(F.col("l_returnflag").isin("A", "N", "R"), kind).otherwise("other").alias("name")))


@query("""SELECT l_partkey::VARCHAR AS path, count(DISTINCT l_orderkey) AS commits, count(DISTINCT o_custkey) AS authors, sum(l_linenumber)::BIGINT AS added, sum(7 - l_linenumber)::BIGINT AS removed, min(o_orderdate)::VARCHAR AS first, max(o_orderdate)::VARCHAR AS last
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def q65_churn(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    commits = rows.select(F.col("l_partkey").cast("string").alias("path"), F.col("l_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("at"), F.col("l_linenumber").cast("long").alias("added"), (7 - F.col("l_linenumber")).cast("long").alias("removed"))
    return A.churn(commits).withColumn("first", F.col("first").cast("string")).withColumn("last", F.col("last").cast("string"))


@query("""WITH rows AS (SELECT l_suppkey % 20 AS repo, l_partkey::VARCHAR AS path, o_custkey AS author, o_orderdate::DATE AS day, 7 AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
dated AS (SELECT *, max(day) OVER (PARTITION BY repo) - day AS days FROM rows), people AS (SELECT repo, path, author, sum(lines) AS lines FROM rows GROUP BY 1, 2, 3),
owners AS (SELECT repo, path, author AS owner, lines / sum(lines) OVER (PARTITION BY repo, path) AS share, row_number() OVER (PARTITION BY repo, path ORDER BY lines DESC, author) AS n FROM people),
files AS (SELECT repo, path, round_even(sum(lines * pow(2.0::DOUBLE, -days / 90.0::DOUBLE)), 3) AS activity, min(days) AS age FROM dated GROUP BY 1, 2)
SELECT repo, path, activity, row_number() OVER (PARTITION BY repo ORDER BY activity DESC, path) AS hotspot, age, owner, round_even(share, 9) AS share FROM files JOIN owners USING (repo, path) WHERE n = 1""")
def q73_lenses(spark, sf_dir):
    """Hotspots, freshness and owners of files over all commits."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    commits = rows.select(
        (F.col("l_suppkey") % 20).alias("repo"), F.col("l_partkey").cast("string").alias("path"), F.col("l_orderkey").alias("commit"), F.col("o_custkey").alias("author"),
        F.col("o_orderdate").alias("at"), F.col("l_linenumber").cast("long").alias("added"), (7 - F.col("l_linenumber")).cast("long").alias("removed"),
    )
    return A.lenses(commits).withColumn("share", F.bround("share", 9))


#: A repository's commits are the orders with a line of its suppliers; every third commit of a part's file renames it.
_TOUCHED = """touched AS (SELECT l_suppkey % 20 AS repo, l_partkey AS part, l_orderkey AS o, o_custkey AS author, o_orderdate::DATE AS day, sum(l_linenumber)::BIGINT AS added, sum(7 - l_linenumber)::BIGINT AS removed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
named AS (SELECT *, row_number() OVER (PARTITION BY repo, part ORDER BY day, o) - 1 AS n FROM touched)"""


#: Lines of the log that one task makes; its sorts and groupings hold them several times, as rows and as text.
_LOG_ROWS = 100_000


def _log(spark, sf_dir):
    """(repo, place, entry): the log's text of every commit, renames written with and without braces.

    Each shuffle is dealt by the number of lines: by their packed bytes a task would get more and more of them.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    tasks = max(1, -(-read("lineitem").count() // _LOG_ROWS))
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").repartition(tasks, "l_orderkey")
    heads = read("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day")).repartition(tasks, "o_orderkey")
    rows = lines.join(heads.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("repo", F.col("l_suppkey") % 20)
    rows = rows.select("repo", F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("o"), "o_custkey", "day", "l_linenumber").repartition(tasks, "repo", "part")  # once for sums and places
    touched = rows.groupBy("repo", "part", "o", "o_custkey", "day").agg(F.sum("l_linenumber").alias("added"), F.sum(7 - F.col("l_linenumber")).alias("removed"))
    n = F.row_number().over(W.partitionBy("repo", "part").orderBy("day", "o")) - 1
    name = lambda at: F.concat(F.lit("f"), "part", F.when(F.floor(at / 3) % 2 == 0, ".a").otherwise(".b"))
    folder = F.concat(F.lit("src/d"), F.col("part") % 7, F.lit("/"))
    now, before = name(F.col("n")), name(F.col("n") - 1)
    braced = F.concat(folder, F.lit("{"), before, F.lit(" => "), now, F.lit("}"))
    moved = F.when(F.col("part") % 2 == 0, braced).otherwise(F.concat(folder, before, F.lit(" => "), folder, now))
    path = F.when((F.col("n") > 0) & (F.col("n") % 3 == 0), moved).otherwise(F.concat(folder, now))
    lines = touched.withColumn("n", n).withColumn("line", F.concat_ws("\t", "added", "removed", path)).select("repo", "o", "o_custkey", "day", "line")
    entries = lines.repartition(tasks, "repo", "o").groupBy("repo", "o", "o_custkey", "day").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    head = F.concat_ws("\t", F.lit("commit"), "o", "o_custkey", F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss"))
    return entries.select("repo", (F.shiftleft(F.unix_date("day").cast("long"), 44) + F.col("o")).alias("place"), F.concat(head, F.lit("\n\n"), F.array_join("lines", "\n")).alias("entry"))


@query(f"""WITH {_TOUCHED}
SELECT repo, 'src/d' || (part % 7) || '/f' || part || CASE WHEN max(n) // 3 % 2 = 0 THEN '.a' ELSE '.b' END AS path, count(*) AS commits, count(DISTINCT author) AS authors, sum(added)::BIGINT AS added,
 sum(removed)::BIGINT AS removed, min(day)::VARCHAR AS first, max(day)::VARCHAR AS last FROM named GROUP BY repo, part""")
def q74_followed_churn(spark, sf_dir):
    """Churn of files that were renamed back and forth, from the log's text: a file keeps what it counted under all its names."""
    followed = H.follow_renames(H.changes(_log(spark, sf_dir)))
    counts = A.churn(followed.withColumn("at", F.to_date("at")), "repo")
    return counts.withColumn("first", F.col("first").cast("string")).withColumn("last", F.col("last").cast("string"))


@query(f"""WITH {_TOUCHED}, commits AS (SELECT repo, o, author, day, count(*) AS files, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed FROM named GROUP BY ALL)
SELECT repo, o::VARCHAR AS commit, author::VARCHAR AS author, day::VARCHAR AS day, files, added, removed FROM commits QUALIFY row_number() OVER (PARTITION BY repo ORDER BY day DESC, o DESC) <= 50""")
def q75_timeline(spark, sf_dir):
    """The 50 latest commits of each repository, from the log's text."""
    rows = H.timeline(H.changes(H.recent(_log(spark, sf_dir), 50)))
    return rows.select("repo", "commit", "author", F.to_date("at").cast("string").alias("day"), "files", "added", "removed")


@query("""SELECT n_regionkey AS region, '{' || string_agg('"' || n_nationkey || '":"' || n_name || '"', ',' ORDER BY n_nationkey::VARCHAR) || '}' AS object FROM nation GROUP BY 1""")
def q66_as_object(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return A.as_object(n, "n_regionkey", "n_nationkey", "n_name").withColumnRenamed("n_regionkey", "region")
