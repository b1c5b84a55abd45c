"""Queries over learners' attempts, derived from events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions import learner as L
from loomspan.operators import learning as O
from loomspan.plans.storage import materialize, shared_root
from loomspan.sources import readers, writers

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as attempts: a user's events in order, their type as beat and check, props.k by 8 as item."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    step = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    k = F.get_json_object("props", "$.k").cast("long") % 8
    return e.select(
        F.col("user_id").alias("actor"),
        step.cast("long").alias("step"),
        F.col("event_type").alias("beat"),
        F.col("event_type").alias("check"),
        F.concat(F.lit("k"), k.cast("string")).alias("item"),
        ((F.col("event_type") != "error") & (F.col("value") < 20)).alias("ok"),
        (F.least("value", F.lit(50.0)) / 50.0).alias("score"),
        F.lit(1).alias("max_score"),
    )


ATTEMPTS = """attempts AS (SELECT user_id AS actor, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
  event_type AS beat, 'k' || (json_extract_string(props, '$.k')::BIGINT % 8) AS item, event_type <> 'error' AND value < 20 AS ok,
  least(value, 50.0::DOUBLE) / 50.0::DOUBLE AS score FROM events)"""
RUNS = f"""{ATTEMPTS},
flagged AS (SELECT *, CASE WHEN lag(beat) OVER (PARTITION BY actor ORDER BY step) = beat THEN 0 ELSE 1 END AS new_run FROM attempts),
numbered AS (SELECT *, sum(new_run) OVER (PARTITION BY actor ORDER BY step) AS run FROM flagged),
placed AS (SELECT *, row_number() OVER (PARTITION BY actor, run ORDER BY step) AS run_pos, first_value(ok) OVER (PARTITION BY actor, run ORDER BY step) AS first_ok FROM numbered),
marked AS (SELECT *, run_pos > 1 AND NOT first_ok AS is_retry, run_pos > 2 AND NOT first_ok AS skipped FROM placed),
graded AS (SELECT actor, beat, item, ok, score, row_number() OVER (PARTITION BY actor ORDER BY step) - 1 AS step FROM marked WHERE NOT skipped)"""
LEARNED = "(acc + (1.0::DOUBLE - acc) * 0.1::DOUBLE)"
TRACE = f"""CASE WHEN v THEN {LEARNED} * 0.9::DOUBLE / ({LEARNED} * 0.9::DOUBLE + (1.0::DOUBLE - {LEARNED}) * 0.2::DOUBLE)
  ELSE {LEARNED} * 0.1::DOUBLE / ({LEARNED} * 0.1::DOUBLE + (1.0::DOUBLE - {LEARNED}) * 0.8::DOUBLE) END"""


def _fold(source: str) -> str:
    """Knowledge tracing in SQL: outcomes as 1 and 0 folded over a list."""
    body = TRACE.replace("WHEN v THEN", "WHEN v > 0.5 THEN")
    return f"""SELECT actor, item, count(*) AS attempts,
      list_reduce(list_prepend(0.0::DOUBLE, list(ok::INT::DOUBLE ORDER BY step)), lambda acc, v: {body}) AS p FROM {source} GROUP BY actor, item"""


MASTERY_STEPS = f"""histories AS (SELECT actor, item, list(ok::INT::DOUBLE ORDER BY step) AS oks, list(step ORDER BY step) AS steps FROM graded GROUP BY actor, item),
places AS (SELECT actor, item, oks, steps, unnest(range(1, len(steps) + 1)) AS i FROM histories),
traced AS (SELECT actor, item, steps[i] AS step, list_reduce(list_prepend(0.0::DOUBLE, oks[:i]), lambda acc, v: {TRACE.replace("WHEN v THEN", "WHEN v > 0.5 THEN")}) AS p FROM places),
crossing AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY actor, item ORDER BY step), 0.0) AS before FROM traced)"""


@query(f"WITH {ATTEMPTS}, m AS ({_fold('attempts')}) SELECT actor, item, attempts, round_even(p, 6) AS p, p >= 0.95 AS mastered FROM m")
def q35_bkt(spark, sf_dir):
    m = O.mastery(attempts(spark, sf_dir))
    return m.select("actor", "item", "attempts", F.bround("p", 6).alias("p"), (F.col("p") >= L.MASTERED).alias("mastered"))


@query(f"WITH {RUNS}, {MASTERY_STEPS} SELECT actor, item, step, round_even(p, 6) AS p FROM crossing WHERE p >= 0.95 AND before < 0.95")
def q36_mastery_cross(spark, sf_dir):
    steps = O.mastery_steps(O.graded_attempts(attempts(spark, sf_dir)))
    return steps.filter((F.col("p") >= L.MASTERED) & (F.col("before") < L.MASTERED)).select("actor", "item", "step", F.bround("p", 6).alias("p"))


@query(f"""WITH {ATTEMPTS}, r AS (SELECT actor, avg(ok::INT) OVER (PARTITION BY actor ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rate FROM attempts)
SELECT actor, count(*) AS steps, round_even(avg((rate BETWEEN 0.7::DOUBLE AND 0.85::DOUBLE)::INT), 4) AS flow_in_band_ratio, round_even(min(rate), 6) AS lowest_rate FROM r GROUP BY actor""")
def q37_flow(spark, sf_dir):
    rated = O.flow(attempts(spark, sf_dir))
    return rated.groupBy("actor").agg(F.count("*").alias("steps"), F.bround(F.avg(F.col("in_band").cast("int")), 4).alias("flow_in_band_ratio"), F.bround(F.min("rate"), 6).alias("lowest_rate"))


_DSR = f"""{ATTEMPTS}, s AS (SELECT actor, item, max(step) AS last_review,
  list_reduce(list_prepend(1.0::DOUBLE, list(score ORDER BY step)), lambda acc, v: CASE WHEN v >= 0.6::DOUBLE THEN acc * (1.0::DOUBLE + v) ELSE greatest(1.0::DOUBLE, acc * v) END) AS stability
  FROM attempts GROUP BY actor, item)"""


@query(f"WITH {_DSR} SELECT actor, item, last_review, round_even(ln(stability), 6) AS log_stability, greatest(1, round_even(least(stability, 1e9::DOUBLE), 0)::BIGINT) AS interval_steps FROM s")
def q38_dsr(spark, sf_dir):
    s = O.review_schedule(attempts(spark, sf_dir))
    steps = L.interval(F.least("stability", F.lit(1e9)))
    return s.select("actor", "item", "last_review", F.bround(F.log("stability"), 6).alias("log_stability"), steps.alias("interval_steps"))


@query(f"""WITH {_DSR}, clock AS (SELECT actor, max(step) + 1 AS now FROM attempts GROUP BY actor)
SELECT actor, item, now - last_review AS waited FROM s JOIN clock USING (actor) WHERE now - last_review >= greatest(1, round_even(least(stability, 1e9::DOUBLE), 0)::BIGINT)""")
def q39_due(spark, sf_dir):
    a = attempts(spark, sf_dir)
    clock = a.groupBy("actor").agg((F.max("step") + 1).alias("now"))
    s = O.review_schedule(a).join(clock, "actor").withColumn("waited", F.col("now") - F.col("last_review"))
    return s.filter(F.col("waited") >= L.interval(F.least("stability", F.lit(1e9)))).select("actor", "item", "waited")


_STREAK = """islands AS (SELECT actor, ok, row_number() OVER (PARTITION BY actor ORDER BY step) - row_number() OVER (PARTITION BY actor, ok ORDER BY step) AS island FROM {source}),
streaks AS (SELECT actor, coalesce(max(n) FILTER (ok), 0) AS streak_max FROM (SELECT actor, ok, island, count(*) AS n FROM islands GROUP BY ALL) GROUP BY actor)"""


@query(f"WITH {ATTEMPTS}, {_STREAK.format(source='attempts')} SELECT * FROM streaks")
def q40_streaks(spark, sf_dir):
    return O.streaks(attempts(spark, sf_dir))


@query(f"""WITH {ATTEMPTS}, x AS (SELECT actor, sum(round_even(score * 10, 0)::BIGINT)::BIGINT AS xp FROM attempts GROUP BY actor) SELECT actor, xp, 1 + xp // 100 AS level FROM x""")
def q41_xp_level(spark, sf_dir):
    x = attempts(spark, sf_dir).groupBy("actor").agg(F.sum(L.xp(F.col("score"))).alias("xp"))
    return x.select("actor", "xp", L.level(F.col("xp")).alias("level"))


@query(f"WITH {RUNS} SELECT actor, max(run)::BIGINT AS runs, count_if(skipped) AS skipped, count_if(is_retry AND NOT skipped) AS retries_used, count_if(NOT skipped) AS graded FROM marked GROUP BY actor")
def q42_runs_retries(spark, sf_dir):
    m = O.mark_runs(attempts(spark, sf_dir))
    return m.groupBy("actor").agg(F.max("run").alias("runs"), F.count_if("skipped").alias("skipped"), F.count_if(F.col("is_retry") & ~F.col("skipped")).alias("retries_used"), F.count_if(~F.col("skipped")).alias("graded"))


_STATEMENTS = f"""{RUNS}, {MASTERY_STEPS},
visited AS (SELECT *, row_number() OVER (PARTITION BY actor, beat ORDER BY step) = 1 AS first_visit FROM graded),
said AS (SELECT actor, step, 'experienced' AS verb, beat AS object, NULL::DOUBLE AS score FROM visited WHERE first_visit
  UNION ALL SELECT actor, step, 'attempted', beat, score FROM visited
  UNION ALL SELECT actor, step, CASE WHEN ok THEN 'passed' ELSE 'failed' END, beat, score FROM visited
  UNION ALL SELECT actor, step, 'mastered', item, NULL FROM crossing WHERE p >= 0.95 AND before < 0.95)"""


@query(f"WITH {_STATEMENTS} SELECT actor, step, verb, object, round_even(score, 6) AS score FROM said")
def q43_xapi(spark, sf_dir):
    return O.statements(O.graded_attempts(attempts(spark, sf_dir))).select("actor", "step", "verb", "object", F.bround("score", 6).alias("score"))


@query(f"""WITH {RUNS}, v AS (SELECT actor, beat, min(step) AS visited_at FROM graded GROUP BY actor, beat)
SELECT actor, beat, visited_at, row_number() OVER (PARTITION BY actor ORDER BY visited_at) AS ordinal FROM v""")
def q44_first_visits(spark, sf_dir):
    return O.first_visits(O.graded_attempts(attempts(spark, sf_dir))).withColumn("ordinal", F.col("ordinal").cast("long"))


_SESSION_SQL = f"""WITH {_STATEMENTS}, {_STREAK.format(source='graded')},
counts AS (SELECT actor, count(*) AS attempts, count_if(ok) AS passed, sum(round_even(score * 10, 0)::BIGINT)::BIGINT AS xp FROM graded GROUP BY actor),
rated AS (SELECT actor, avg(ok::INT) OVER (PARTITION BY actor ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rate FROM graded),
band AS (SELECT actor, round_even(avg((rate BETWEEN 0.7::DOUBLE AND 0.85::DOUBLE)::INT), 4) AS flow_in_band_ratio FROM rated GROUP BY actor),
total AS (SELECT actor, count(*) AS statements FROM said GROUP BY actor),
skips AS (SELECT actor, count_if(skipped) AS skipped, count_if(is_retry AND NOT skipped) AS retries_used FROM marked GROUP BY actor),
visits AS (SELECT actor, string_agg(beat, ',' ORDER BY visited_at) AS beats_visited FROM (SELECT actor, beat, min(step) AS visited_at FROM graded GROUP BY actor, beat) GROUP BY actor),
known AS (SELECT actor, string_agg(item || '=' || printf('%.6f', round_even(p, 6)), ',' ORDER BY item) AS mastery FROM ({_fold('graded')}) GROUP BY actor)
SELECT actor, beats_visited, attempts, passed, xp, 1 + xp // 100 AS level, streak_max, mastery, flow_in_band_ratio, statements, skipped, retries_used
FROM counts JOIN band USING (actor) JOIN streaks USING (actor) JOIN total USING (actor) JOIN skips USING (actor) JOIN visits USING (actor) JOIN known USING (actor)"""


def _as_text(s: DataFrame) -> DataFrame:
    pairs = F.transform(F.map_entries("mastery"), lambda e: F.format_string("%s=%.6f", e["key"], e["value"]))
    return s.withColumn("mastery", F.array_join(pairs, ",")).withColumn("beats_visited", F.array_join("beats_visited", ","))


@query(_SESSION_SQL)
def q45_session(spark, sf_dir):
    return _as_text(O.sessions(attempts(spark, sf_dir)))


def _learners(spark, sf_dir):
    """Learners after all their attempts: visited beats, mastery, the fringe k0..k3, and the rate of the last ten."""
    a = attempts(spark, sf_dir)
    m = O.mastery(a).groupBy("actor").agg(F.map_from_entries(F.collect_list(F.struct("item", "p"))).alias("mastery"))
    v = a.groupBy("actor").agg(F.collect_set(F.when(F.col("ok"), F.concat(F.lit("b"), F.substring("item", 2, 1)))).alias("visited"))
    r = O.flow(a).groupBy("actor").agg(F.max_by("rate", "step").alias("rate"))
    return m.join(v, "actor").join(r, "actor").withColumn("fringe", F.array(*map(F.lit, ("k0", "k1", "k2", "k3"))))


def _beats(spark):
    """Sixteen beats: b0..b7 teach k0..k7 and are open, c0..c7 teach the same after the item before."""
    rows = [(f"b{i}", [f"k{i}"], [], i % 4 + 1) for i in range(8)] + [(f"c{i}", [f"k{i}", f"k{(i + 3) % 8}"], [f"k{(i + 1) % 8}"], 4 - i % 4) for i in range(8)]
    return spark.createDataFrame(rows, "id string, teaches array<string>, requires array<string>, difficulty int")


@query(f"""WITH {ATTEMPTS}, m AS ({_fold('attempts')}),
rates AS (SELECT actor, arg_max(rate, step) AS rate FROM (SELECT actor, step, avg(ok::INT) OVER (PARTITION BY actor ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rate FROM attempts) GROUP BY actor),
visited AS (SELECT DISTINCT actor, 'b' || substr(item, 2, 1) AS beat FROM attempts WHERE ok),
known AS (SELECT actor, item FROM m WHERE p >= 0.95 UNION SELECT actor, 'k' || substr(beat, 2, 1) FROM visited),
beats AS (SELECT 'b' || i AS beat, ['k' || i] AS teaches, NULL AS need, i % 4 + 1 AS difficulty FROM range(8) t(i)
  UNION ALL SELECT 'c' || i, ['k' || i, 'k' || ((i + 3) % 8)], 'k' || ((i + 1) % 8), 4 - i % 4 FROM range(8) t(i)),
ready AS (SELECT r.actor, r.rate, b.* FROM rates r CROSS JOIN beats b WHERE NOT EXISTS (SELECT 1 FROM visited v WHERE v.actor = r.actor AND v.beat = b.beat)
  AND (b.need IS NULL OR EXISTS (SELECT 1 FROM known k WHERE k.actor = r.actor AND k.item = b.need))),
taught AS (SELECT actor, rate, beat, difficulty, len(teaches) AS n, unnest(teaches) AS item FROM ready),
scored AS (SELECT t.actor, t.beat, round_even((CASE WHEN bool_or(t.item IN ('k0','k1','k2','k3')) THEN 2.0 ELSE 0.0 END)::DOUBLE + (1.0::DOUBLE - sum(coalesce(m.p, 0.0::DOUBLE)) / any_value(n))
  + CASE WHEN any_value(rate) > 0.85::DOUBLE THEN 0.25::DOUBLE * any_value(difficulty) WHEN any_value(rate) < 0.7::DOUBLE THEN -0.25::DOUBLE * any_value(difficulty) ELSE 0.0::DOUBLE END, 9) AS score
  FROM taught t LEFT JOIN m ON m.actor = t.actor AND m.item = t.item GROUP BY t.actor, t.beat),
best AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY score DESC, beat) AS rn FROM scored)
SELECT actor, beat, round_even(score, 6) AS score FROM best WHERE rn = 1""")
def q46_next_beat(spark, sf_dir):
    return O.next_beats(_beats(spark), _learners(spark, sf_dir)).withColumn("score", F.bround("score", 6))


@query(f"""WITH {ATTEMPTS}, n AS (SELECT actor, count(*) AS picks, count(DISTINCT item) AS visited, bool_or(NOT ok) AS exhausted FROM attempts GROUP BY actor)
SELECT CASE WHEN picks >= 70 THEN 'max_steps' WHEN exhausted AND visited < 8 THEN 'responses_exhausted' WHEN visited = 8 THEN 'quest_complete' ELSE 'gated' END AS reason, count(*) AS learners FROM n GROUP BY 1""")
def q57_completion_class(spark, sf_dir):
    n = attempts(spark, sf_dir).groupBy("actor").agg(F.count("*").alias("picks"), F.countDistinct("item").alias("visited"), F.max(~F.col("ok")).alias("exhausted"))
    n = n.withColumn("exhausted", F.col("exhausted") & (F.col("visited") < 8))
    return O.completion(n, n_beats=8, max_steps=70).groupBy("reason").agg(F.count("*").alias("learners"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, (l_quantity * p_retailprice)::DOUBLE AS answer, l_extendedprice AS response FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, answer IS NOT NULL AND abs(response - answer) <= 20000.0 AS within_wide, abs(response - answer) <= CASE WHEN abs(answer) * 1e-6 <> 0 THEN abs(answer) * 1e-6::DOUBLE ELSE 1e-9 END AS within_default FROM l""")
def q33_grade_numeric(spark, sf_dir):
    l, p = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    rows = l.join(p, l["l_partkey"] == p["p_partkey"]).withColumn("answer", F.col("l_quantity") * F.col("p_retailprice"))
    given = F.col("l_extendedprice")
    return rows.select("l_orderkey", "l_linenumber", L.grade_numeric(F.col("answer"), given, F.lit(20000.0)).alias("within_wide"), L.grade_numeric(F.col("answer"), given).alias("within_default"))


@query("""SELECT o_orderkey, coalesce(left(o_orderpriority, 1) = (o_custkey % 5 + 1)::VARCHAR, false) AS success, CASE WHEN left(o_orderpriority, 1) = (o_custkey % 5 + 1)::VARCHAR THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM orders""")
def q32_grade_choice(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    answer, response = F.substring("o_orderpriority", 1, 1), (F.col("o_custkey") % 5 + 1).cast("string")
    g = L.grade(F.lit("choice"), answer.cast("variant"), response.cast("variant"), F.lit(None).cast("double"), F.lit(2))
    return o.select("o_orderkey", g.alias("g")).select("o_orderkey", "g.success", "g.score")


@query("""WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey) AS b FROM lineitem),
n AS (SELECT l_orderkey, count(*) AS n FROM r GROUP BY 1),
inv AS (SELECT x.l_orderkey, count(*) AS k FROM r x JOIN r y ON x.l_orderkey = y.l_orderkey AND x.a < y.a AND x.b > y.b GROUP BY 1)
SELECT n.l_orderkey, round_even(CASE WHEN n < 2 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - coalesce(k, 0) / (n * (n - 1) / 2.0::DOUBLE) END, 6) AS fraction FROM n LEFT JOIN inv USING (l_orderkey)""")
def q34_grade_ordering(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line = F.struct("l_linenumber", "l_partkey", "l_extendedprice")
    lines = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("a"), F.array_sort(F.collect_list(F.struct("l_extendedprice", "l_linenumber", "l_partkey"))).alias("b"))
    name = lambda xs: F.transform(xs, lambda x: F.concat_ws("/", x["l_linenumber"], x["l_partkey"], x["l_extendedprice"]))
    return lines.select("l_orderkey", F.bround(L.ordering_fraction(name(F.col("a")), name(F.col("b"))), 6).alias("fraction"))


@query(f"WITH {_STATEMENTS} SELECT actor, step AS timestamp, verb, object, round_even(score, 6) AS score FROM said")
def q67_statement_store(spark, sf_dir):
    """The log written to a store of JSON lines in two appends, checked line by line and read again."""
    said = materialize(O.statements(O.graded_attempts(attempts(spark, sf_dir))))
    store = f"{shared_root(spark)}/loomspan/{uuid.uuid4().hex}"
    for part in (0, 1):
        writers.append_statements(said.filter(F.pmod(F.col("actor"), F.lit(2)) == part), store)
    if readers.count_statements(spark, store) != said.count():
        raise RuntimeError("the store lost statements")
    kind = "actor long, verb string, object string, result struct<score: double, success: boolean, p: double>, timestamp long"
    rows = spark.read.schema(kind).json(store)
    return rows.select("actor", "timestamp", "verb", "object", F.bround("result.score", 6).alias("score"))


_LINES = """lines AS (SELECT o_orderkey AS pos, ' b' || (o_custkey % 9) || ' | c' || (o_orderkey % 7) || '|' || CASE o_orderkey % 3 WHEN 0 THEN (o_custkey % 100)::VARCHAR WHEN 1 THEN ' text|with bars ' ELSE '[1,2]' END AS value FROM orders)"""


@query(f"""WITH {_LINES} SELECT pos, trim(split_part(value, '|', 1)) AS beat, trim(split_part(value, '|', 2)) AS check, trim(substring(value, length(split_part(value, '|', 1)) + length(split_part(value, '|', 2)) + 3)) AS response FROM lines""")
def q68_attempt_lines(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    answer = F.when(key % 3 == 0, (customer % 100).cast("string")).when(key % 3 == 1, " text|with bars ").otherwise("[1,2]")
    lines = o.select(key.alias("pos"), F.concat(F.lit(" b"), customer % 9, F.lit(" | c"), key % 7, F.lit("|"), answer).alias("value"))
    parsed = readers.parse_attempts(lines)
    return parsed.select("pos", "beat", "check", F.col("response").cast("string").alias("response"))


@query("""WITH beats AS (SELECT 'b' || n AS id, ['c' || n, 'c' || (n + 1)] AS checks FROM range(8) t(n)), checks AS (SELECT 'c' || n AS id FROM range(6) t(n)),
tried AS (SELECT o_orderkey AS pos, 'b' || (o_custkey % 9) AS beat, 'c' || (o_orderkey % 7) AS ref FROM orders)
SELECT pos, beat, ref AS "check", CASE WHEN b.id IS NULL OR c.id IS NULL THEN 'unknown beat/check' ELSE 'check not on beat' END AS reason FROM tried LEFT JOIN beats b ON b.id = beat LEFT JOIN checks c ON c.id = ref
WHERE b.id IS NULL OR c.id IS NULL OR NOT list_contains(b.checks, ref)""")
def q69_check_attempts(spark, sf_dir):
    beats = spark.createDataFrame([(f"b{n}", [f"c{n}", f"c{n + 1}"]) for n in range(8)], "id string, checks array<string>")
    checks = spark.createDataFrame([(f"c{n}",) for n in range(6)], "id string")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    tried = o.select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("b"), F.col("o_custkey") % 9).alias("beat"), F.concat(F.lit("c"), F.col("o_orderkey") % 7).alias("check"))
    return O.check_attempts(tried, beats, checks).select("pos", "beat", "check", "reason")
