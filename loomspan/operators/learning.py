"""Replay of ordered attempts as windows and folds: runs and retries, statements, mastery, flow, streaks, sessions.

An attempts table holds (actor, step, beat, check, item, ok, score, max_score); step orders an actor's attempts. All
windows are keyed by actor, so learners spread over the cluster and no state crosses them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions import learner as L
from loomspan.plans.storage import broadcast_if_small, materialize


def _by_actor():
    return W.partitionBy("actor").orderBy("step")


def check_attempts(attempts: DataFrame, beats: DataFrame, checks: DataFrame) -> DataFrame:
    """Attempts whose beat or check is unknown, or whose check is not on the beat, with the reason."""
    b = beats.select(F.col("id").alias("beat"), F.col("checks").alias("__on"), F.lit(True).alias("__b"))
    c = checks.select(F.col("id").alias("check"), F.lit(True).alias("__c"))
    joined = attempts.join(b, "beat", "left").join(c, "check", "left")
    reason = F.when(F.col("__b").isNull() | F.col("__c").isNull(), "unknown beat/check").when(~F.array_contains("__on", F.col("check")), "check not on beat")
    return joined.withColumn("reason", reason).filter("reason is not null").drop("__on", "__b", "__c")


def mark_runs(attempts: DataFrame, max_retries: int = 1) -> DataFrame:
    """Adds run, run_pos, is_retry and skipped. A run is consecutive attempts at one check of one beat, skipped ones
    included; only in runs whose first attempt failed are later ones retries, and those past max_retries skipped."""
    w = _by_actor()
    same = F.lag("beat").over(w).eqNullSafe(F.col("beat")) & F.lag("check").over(w).eqNullSafe(F.col("check")) & F.lag("step").over(w).isNotNull()
    runs = attempts.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("__new").over(w)).drop("__new")
    within = W.partitionBy("actor", "run").orderBy("step")
    runs = runs.withColumn("run_pos", F.row_number().over(within)).withColumn("is_retry", (F.col("run_pos") > 1) & ~F.first("ok").over(within))
    return runs.withColumn("skipped", F.col("is_retry") & (F.col("run_pos") - 1 > max_retries))


def graded_attempts(attempts: DataFrame, max_retries: int = 1) -> DataFrame:
    """Attempts that count, with their logical step after skips."""
    return _counted(mark_runs(attempts, max_retries))


def _counted(marked: DataFrame) -> DataFrame:
    return marked.filter(~F.col("skipped")).withColumn("step", (F.row_number().over(_by_actor()) - 1).cast("long"))


def _history(attempts: DataFrame, *columns: str) -> DataFrame:
    """Ordered history of each actor and item; one learner's attempts at one item bound its length."""
    return attempts.groupBy("actor", "item").agg(F.array_sort(F.collect_list(F.struct("step", *columns))).alias("h"))


def mastery_steps(attempts: DataFrame) -> DataFrame:
    """(actor, item, step, p, before): mastery after and before each attempt."""
    h = _history(attempts, "ok").withColumn("p", L.trace_history(F.col("h.ok")))
    rows = h.select("actor", "item", F.explode(F.arrays_zip(F.col("h.step").alias("step"), F.col("p").alias("p"))).alias("r"))
    rows = rows.select("actor", "item", "r.step", "r.p")
    return rows.withColumn("before", F.coalesce(F.lag("p").over(W.partitionBy("actor", "item").orderBy("step")), F.lit(L.P_INIT)))


def mastery(attempts: DataFrame) -> DataFrame:
    return _history(attempts, "ok").select("actor", "item", F.size("h").cast("long").alias("attempts"), L.trace_last(F.col("h.ok")).alias("p"))


def review_schedule(attempts: DataFrame) -> DataFrame:
    """(actor, item, stability, last_review, interval) after all reviews; grades are score fractions."""
    graded = attempts.withColumn("grade", L.fraction(F.col("score"), F.col("max_score")))
    s = _history(graded, "grade").select("actor", "item", L.stability(F.col("h.grade")).alias("stability"), F.element_at("h.step", -1).alias("last_review"))
    return s.withColumn("interval", L.interval(F.col("stability")))


def flow(attempts: DataFrame) -> DataFrame:
    """Adds rate (mean of the last ten outcomes, the row's own included) and in_band."""
    last_ten = _by_actor().rowsBetween(1 - L.FLOW_WINDOW, 0)
    rated = attempts.withColumn("rate", F.avg(F.col("ok").cast("int")).over(last_ten))
    return rated.withColumn("in_band", F.col("rate").between(L.FLOW_LOW, L.FLOW_HIGH))


def streaks(attempts: DataFrame) -> DataFrame:
    """(actor, streak_max): longest run of passes, by gaps and islands."""
    island = F.row_number().over(_by_actor()) - F.row_number().over(W.partitionBy("actor", "ok").orderBy("step"))
    lengths = attempts.withColumn("island", island).groupBy("actor", "ok", "island").agg(F.count("*").alias("n"))
    return lengths.groupBy("actor").agg(F.coalesce(F.max(F.when(F.col("ok"), F.col("n"))), F.lit(0)).cast("long").alias("streak_max"))


def statements(graded: DataFrame) -> DataFrame:
    """The telemetry log: (actor, step, seq, verb, object, score, success, p)."""
    first = F.row_number().over(W.partitionBy("actor", "beat").orderBy("step")) == 1
    rows = graded.withColumn("__first", first).join(mastery_steps(graded), ["actor", "item", "step"])
    none, flag = F.lit(None).cast("double"), F.lit(None).cast("boolean")

    def statement(verb, thing: str, score, success, p, when):
        made = F.struct(F.lit(verb).alias("verb") if isinstance(verb, str) else verb.alias("verb"), F.col(thing).alias("object"), score.alias("score"), success.alias("success"), p.alias("p"))
        return F.when(when, made)

    always, score, ok = F.lit(True), F.col("score").cast("double"), F.col("ok")
    made = F.array(
        statement("experienced", "beat", none, flag, none, F.col("__first")),
        statement("attempted", "check", score, ok, none, always),
        statement(F.when(ok, "passed").otherwise("failed"), "check", score, ok, none, always),
        statement("mastered", "item", none, flag, F.col("p"), (F.col("p") >= L.MASTERED) & (F.col("before") < L.MASTERED)),
    )
    return rows.select("actor", "step", F.posexplode(F.filter(made, lambda s: s.isNotNull())).alias("seq", "s")).select("actor", "step", "seq", "s.*")


def first_visits(graded: DataFrame) -> DataFrame:
    """(actor, beat, visited_at, ordinal) in the order of first visits."""
    seen = graded.groupBy("actor", "beat").agg(F.min("step").alias("visited_at"))
    return seen.withColumn("ordinal", F.row_number().over(W.partitionBy("actor").orderBy("visited_at")))


def sessions(attempts: DataFrame, max_retries: int = 1) -> DataFrame:
    """One row per actor: the whole replay's aggregate."""
    marked = materialize(mark_runs(attempts, max_retries))  # written once, read by every part below
    skipped = marked.groupBy("actor").agg(F.count_if("skipped").alias("skipped"), F.count_if(F.col("is_retry") & ~F.col("skipped")).alias("retries_used"))
    graded = _counted(marked)
    counts = graded.groupBy("actor").agg(
        F.count("*").alias("attempts"), F.count_if("ok").alias("passed"), F.sum(L.xp(F.col("score"))).alias("xp")
    )
    band = flow(graded).groupBy("actor").agg(F.bround(F.avg(F.col("in_band").cast("int")), 4).alias("flow_in_band_ratio"))
    said = statements(graded).groupBy("actor").agg(F.count("*").alias("statements"))
    visits = first_visits(graded).groupBy("actor").agg(F.array_sort(F.collect_list(F.struct("ordinal", "beat"))).alias("v"))
    known = mastery(graded).groupBy("actor").agg(F.array_sort(F.collect_list(F.struct("item", F.bround("p", 6).alias("p")))).alias("m"))
    out = counts
    for part in (band, streaks(graded), said, skipped, visits, known):
        out = out.join(part, "actor")
    return out.select(
        "actor", F.col("v.beat").alias("beats_visited"), "attempts", "passed", "xp", L.level(F.col("xp")).alias("level"), "streak_max",
        F.map_from_entries("m").alias("mastery"), "flow_in_band_ratio", "statements", "skipped", "retries_used",
    )


def _adjust(rate: Column, difficulty: Column) -> Column:
    """What a beat's difficulty adds above the flow band, and takes below it."""
    hard = F.coalesce(difficulty, F.lit(2)) * 0.25
    return F.when(rate > L.FLOW_HIGH, hard).when(rate < L.FLOW_LOW, -hard).otherwise(0.0)


def _open_beats(free: DataFrame, learners: DataFrame) -> DataFrame:
    """(actor, beat): of the beats open to everyone (beat, teaches, difficulty), those that may be a learner's best.

    A beat that teaches nothing of a learner's mastery or fringe scores by its difficulty and by which side of the flow
    band the learner is on. So such beats have one order for each side, and only the first of it that is left counts:
    its place is the least that no visited or touched beat of the learner takes. Touched beats are met by their items.
    """
    side = F.when(F.col("rate") > L.FLOW_HIGH, 1).when(F.col("rate") < L.FLOW_LOW, -1).otherwise(0)
    sides = free.select("beat", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("side"), "difficulty")
    rate = F.when(F.col("side") > 0, 1.0).when(F.col("side") < 0, 0.0).otherwise((L.FLOW_HIGH + L.FLOW_LOW) / 2)
    best_first = W.partitionBy("side").orderBy(F.desc(F.bround(1.0 + _adjust(rate, F.col("difficulty")), 9)), "beat")  # a row for each beat of the story
    order = materialize(sides.select("side", "beat", (F.row_number().over(best_first) - 1).cast("long").alias("place")))
    items = learners.select("actor", F.explode(F.array_union(F.map_keys("mastery"), F.coalesce("fringe", F.array().cast("array<string>")))).alias("item"))
    touched = items.join(free.select("beat", F.explode("teaches").alias("item")), "item").select("actor", "beat")
    seen = learners.select("actor", F.explode("visited").alias("beat"))
    own = learners.select("actor", side.alias("side"))
    order = broadcast_if_small(order, 64)
    taken = touched.unionByName(seen).distinct().join(own, "actor").join(order, ["side", "beat"])
    taken = taken.withColumn("n", F.row_number().over(W.partitionBy("actor").orderBy("place")) - 1)
    first = own.join(taken.groupBy("actor").agg(F.count_if(F.col("place") == F.col("n")).alias("place")), "actor", "left")
    return first.withColumn("place", F.coalesce("place", F.lit(0))).join(order, ["side", "place"]).select("actor", "beat").unionByName(touched)


def next_beats(beats: DataFrame, learners: DataFrame) -> DataFrame:
    """One recommendation per learner: (actor, beat, score).

    learners hold (actor, visited array, mastery map, fringe array, rate double), one row each. A beat is ready if each
    item it requires is mastered or taught by a visited beat; ties go to the smallest id. Candidates join on the items
    that make them ready or that they teach, beats open to everyone come by a common order, and the best is a
    pre-aggregated maximum: neither are learners paired with all beats, nor is a list of candidates collected.
    """
    learners = materialize(learners.select("actor", "visited", "mastery", "fringe", "rate"))  # read by every part below
    taught = learners.select("actor", F.explode("visited").alias("beat")).join(beats.select(F.col("id").alias("beat"), F.explode("teaches").alias("item")), "beat")
    known = taught.select("actor", "item").unionByName(
        learners.select("actor", F.explode(F.map_keys(F.map_filter("mastery", lambda _, p: p >= L.MASTERED))).alias("item"))
    ).distinct()
    needs = beats.select(F.col("id").alias("beat"), F.explode(F.array_distinct("requires")).alias("item"))
    met = known.join(needs, "item").groupBy("actor", "beat").agg(F.count("*").alias("met"))
    wanted = beats.withColumn("need", F.size(F.array_distinct("requires"))).withColumnRenamed("id", "beat")
    free = _open_beats(wanted.filter("need = 0").select("beat", "teaches", "difficulty"), learners)
    ready = met.join(wanted.select("beat", "need"), "beat").filter("met = need").select("actor", "beat").unionByName(free)
    rows = ready.join(learners, "actor").join(wanted.select("beat", "teaches", "difficulty"), "beat").filter(~F.array_contains("visited", F.col("beat")))
    teaches = F.size("teaches")
    average = F.when(teaches > 0, F.aggregate("teaches", F.lit(0.0), lambda s, i: s + F.coalesce(F.element_at("mastery", i), F.lit(0.0))) / teaches).otherwise(0.0)
    score = F.when(F.arrays_overlap("teaches", "fringe"), 2.0).otherwise(0.0) + (1.0 - average) + _adjust(F.col("rate"), F.col("difficulty"))
    rows = rows.withColumn("score", F.bround(score, 9))
    return rows.groupBy("actor").agg(F.min(F.struct((-F.col("score")).alias("s"), "beat")).alias("b")).select("actor", "b.beat", (-F.col("b.s")).alias("score"))


def completion(learners: DataFrame, n_beats: int, max_steps: int = 1000) -> DataFrame:
    """(actor, reason): why a quest ended, from (actor, picks, visited, exhausted)."""
    reason = (
        F.when(F.col("picks") >= max_steps, "max_steps")
        .when(F.col("exhausted"), "responses_exhausted")
        .when(F.col("visited") == n_beats, "quest_complete")
        .otherwise("gated")
    )
    return learners.select("actor", reason.alias("reason"))
