import random
import time

import pytest
from pyspark.sql import functions as F
from samples import EDGES, ITEMS, graph, script, story

from loomspan.functions import learner as L
from loomspan.functions.replay import Learner, grade, half_even, ordering_fraction
from loomspan.operators import learning as O
from loomspan.operators.quest import Story, quests, run_quest
from loomspan.plans import pipelines as P

ATTEMPTS = "actor string, step long, beat string, check string, item string, ok boolean, score double, max_score int"


def test_knowledge_tracing(spark):
    row = spark.range(1).select(L.trace_history(F.array(F.lit(True), F.lit(True), F.lit(False))).alias("p")).first()
    assert row.p == pytest.approx([1 / 3, 0.75, 0.0775 / 0.2575])
    learner = Learner()
    for ok in (True, True, True, True):
        learner.attempt("b", "c", "i", 1, 1, ok)
    assert learner.mastery["i"] >= L.MASTERED and learner.statements == 1 + 2 * 4 + 1


def test_flow_ratio(spark):
    rows = [("a", n, "b", f"c{n}", "i", ok, 1.0, 1) for n, ok in enumerate([True, True, True, False, True, True, True])]
    flow = O.flow(spark.createDataFrame(rows, ATTEMPTS))
    assert flow.agg(F.avg(F.col("in_band").cast("int"))).first()[0] == pytest.approx(3 / 7)
    assert Learner().rate() == 1.0 and Learner().summary()["flow_in_band_ratio"] == 1.0


@pytest.mark.parametrize(("grades", "want"), [([1.0], 2.0), ([1.0, 0.0], 1.0), ([0.5], 1.0), ([0.8], 1.8)])
def test_review_stability(spark, grades, want):
    assert spark.range(1).select(L.stability(F.array(*map(F.lit, grades))).alias("s")).first().s == pytest.approx(want)


def test_review_is_due():
    learner = Learner()
    assert learner.due("i", 0)
    learner.attempt("b", "c", "i", 1, 1, True)
    assert not learner.due("i", 1) and learner.due("i", 2)


ORDERINGS = [
    (["x", "y", "z"], ["x", "z", "y"], 2 / 3), (["a", "a", "b"], ["a", "b", "a"], 2 / 3), (["a", "a", "b"], ["b", "a", "a"], 1 / 3),
    (["x"], ["x"], 1.0), ([], [], 1.0), (["x", "y"], ["x"], 0.0), (["x", "y"], ["x", "w"], 0.0), (["1", "2"], [2, 1], 0.0),
]


@pytest.mark.parametrize(("answer", "response", "want"), ORDERINGS)
def test_ordering(spark, answer, response, want):
    assert ordering_fraction(answer, response) == pytest.approx(want)
    df = spark.createDataFrame([(list(map(str, answer)), list(map(str, response)))], "a array<string>, r array<string>")
    assert df.select(L.ordering_fraction(F.col("a"), F.col("r")).alias("f")).first().f == pytest.approx(want)


def test_grading_by_column_equals_grading_by_row(spark):
    rows = [("choice", '"Mean"', '"Mean"', None), ("choice", '"Mean"', '"Range"', None), ("choice", "1", "1", None), ("numeric", "2.0", "2.05", 0.1), ("numeric", "2.0", "2.5", 0.1), ("numeric", "0", "0.000000001", None), ("ordering", '["x","y","z"]', '["x","z","y"]', None)]
    df = spark.createDataFrame(rows, "kind string, a string, r string, t double")
    got = df.select("kind", "a", "r", "t", L.grade(F.col("kind"), F.parse_json("a"), F.parse_json("r"), F.col("t"), F.lit(2)).alias("g")).collect()
    import json

    for r in got:
        score, _, ok = grade({"kind": r.kind, "max_score": 2, "payload": {"answer": json.loads(r.a), "tolerance": r.t}}, json.loads(r.r))
        assert (r.g.score, r.g.success) == (pytest.approx(score), ok)
    with pytest.raises(ValueError, match="unknown check kind"):
        grade({"kind": "essay"}, 1)


def _attempt_rows(n=400, seed=5):
    rng = random.Random(seed)
    rows, clock = [], {}
    for _ in range(n):
        a = f"a{rng.randrange(4)}"
        clock[a] = clock.get(a, -1) + 1
        b = f"b{rng.randrange(3)}"
        ok = rng.random() < 0.6
        rows.append((a, clock[a], b, b, f"i{rng.randrange(3)}", ok, 1.0 if ok else rng.choice([0.0, 0.25, 0.5]), 1))
    return rows


def test_windows_equal_the_sequential_replay(spark):
    rows = _attempt_rows()
    got = {r.actor: r for r in O.sessions(spark.createDataFrame(rows, ATTEMPTS)).collect()}
    for actor in {r[0] for r in rows}:
        learner = Learner()
        for _, _, beat, check, item, ok, score, best in (r for r in rows if r[0] == actor):
            learner.attempt(beat, check, item, score, best, ok)
        want = learner.summary()
        have = got[actor].asDict()
        assert have.pop("actor") == actor
        assert have == {k: pytest.approx(v) for k, v in want.items()}


def test_scripted_session():
    s = P.play_attempts(story(), script()).summary()
    assert s["beats_visited"] == ["q1", "q2", "q5", "q3", "q7"]
    assert (s["attempts"], s["passed"], s["xp"], s["streak_max"], s["statements"]) == (7, 6, 67, 3, 19)
    assert s["flow_in_band_ratio"] == round(3 / 7, 4)
    assert s["mastery"]["central-tendency"] == 0.75 and s["mastery"]["median"] == pytest.approx(0.3628, abs=5e-5)


def test_retry_cap():
    rows = [{"beat_id": "q1", "check_id": "q1-check", "response": r} for r in ("Nope", "Nope", "Mean")]
    s = P.play_attempts(story(), rows).summary()
    assert (s["attempts"], s["passed"], s["skipped"], s["retries_used"], s["statements"]) == (2, 0, 1, 1, 5)


def test_unknown_attempts_are_refused(spark):
    with pytest.raises(ValueError, match="unknown"):
        P.play_attempts(story(), [{"beat_id": "zz", "check_id": "q1-check", "response": 1}])
    with pytest.raises(ValueError, match="not on the beat"):
        P.play_attempts(story(), [{"beat_id": "q2", "check_id": "q1-check", "response": 1}])
    beats = spark.createDataFrame([("q1", ["c1"])], "id string, checks array<string>")
    checks = spark.createDataFrame([("c1",), ("c2",)], "id string")
    tries = spark.createDataFrame([("q1", "c1"), ("q1", "c2"), ("q9", "c1")], "beat string, check string")
    assert sorted(r.reason for r in O.check_attempts(tries, beats, checks).collect()) == ["check not on beat", "unknown beat/check"]


def test_resume_equals_the_whole_run():
    whole = P.play_attempts(story(), script())
    for cut in range(len(script())):
        half = P.play_attempts(story(), script()[:cut])
        assert P.play_attempts(story(), script()[cut:], Learner.loads(half.dumps())) == whole


RESPONSES = ["Mean", 5.0, ["sort", "pick", "count"], ["sort", "count", "pick"], "Spread", 2.05]


def test_adaptive_quest():
    session, learner = P.play_quest(story(), graph(), RESPONSES)
    assert session["beats_visited"] == [f"q{n}" for n in range(1, 9)]
    assert (session["attempts"], session["passed"], session["xp"], session["statements"], session["flow_in_band_ratio"]) == (6, 5, 57, 20, 0.5)
    assert session["completion"] == {"reason": "quest_complete", "picks": 8, "visited": 8}
    assert session["transcript"][2]["score"] == 0.6667
    assert P.play_quest(story(), graph(), RESPONSES[:2])[0]["completion"]["reason"] == "responses_exhausted"
    assert P.play_quest(story(), graph(), RESPONSES, max_steps=3)[0]["completion"] == {"reason": "max_steps", "picks": 3, "visited": 3}


def test_quest_of_many_learners(spark):
    import json

    s = Story.of(story()["beats"], story()["checks"], ITEMS, EDGES)
    rows = [(a, n, json.dumps(r), None) for a in ("x", "y") for n, r in enumerate(RESPONSES)] + [("z", 0, "Mean", None)]
    got = {r.actor: r for r in quests(spark.createDataFrame(rows, "actor string, pos long, response string, state string"), s).collect()}
    assert got["x"].reason == got["y"].reason == "quest_complete" and got["z"].reason == "responses_exhausted"
    learner = Learner.loads(got["z"].state)
    assert run_quest(s, learner, RESPONSES[1:])[0] == "quest_complete" and learner.summary()["xp"] == 57


def test_next_beat(spark):
    beats = spark.createDataFrame([("b1", ["i1"], [], 1), ("b2", ["i2"], ["i1"], 3), ("b3", ["i3"], ["i9"], 1)], "id string, teaches array<string>, requires array<string>, difficulty int")
    learners = spark.createDataFrame([("new", [], {"i0": 0.0}, ["i1"], 1.0), ("on", ["b1"], {"i1": 0.4}, [], 0.5), ("end", ["b1", "b2"], {"i1": 0.4}, [], 0.8)], "actor string, visited array<string>, mastery map<string,double>, fringe array<string>, rate double")
    assert {r.actor: (r.beat, r.score) for r in O.next_beats(beats, learners).collect()} == {"new": ("b1", 3.25), "on": ("b2", 0.25)}


def test_next_beats_against_all_pairs(spark):
    """Open and closed beats, untouched by most learners, against a score of every beat for every learner."""
    rng = random.Random(9)
    items = [f"i{n:02d}" for n in range(30)]
    beats = [(f"b{n:02d}", rng.sample(items, rng.randrange(3)), [] if n % 3 else rng.sample(items, rng.randrange(3)), rng.choice([None, 1, 2, 3, 4])) for n in range(40)]
    learners = []
    for n in range(60):
        mastery = {i: rng.choice([0.0, 0.4, 0.97, 1.0]) for i in rng.sample(items, rng.randrange(6))}
        visited = [b[0] for b in rng.sample(beats, rng.choice([0, 3, 20, 39, 40]))]
        learners.append((f"a{n:02d}", visited, mastery, rng.sample(items, rng.randrange(3)), rng.choice([0.2, 0.7, 0.8, 0.85, 1.0, None])))

    def best(visited, mastery, fringe, rate):
        known = {i for i, p in mastery.items() if p >= 0.95} | {i for b in beats if b[0] in visited for i in b[1]}
        scored = []
        for name, teaches, requires, difficulty in beats:
            if name not in visited and known.issuperset(requires):
                average = sum(mastery.get(i, 0.0) for i in teaches) / len(teaches) if teaches else 0.0
                sign = 0 if rate is None else (rate > 0.85) - (rate < 0.7)
                scored.append((-round(2.0 * bool(set(teaches) & set(fringe)) + 1.0 - average + sign * 0.25 * (difficulty or 2), 9), name))
        return min(scored, default=None)

    b = spark.createDataFrame(beats, "id string, teaches array<string>, requires array<string>, difficulty int")
    a = spark.createDataFrame(learners, "actor string, visited array<string>, mastery map<string,double>, fringe array<string>, rate double")
    got = {r.actor: (-r.score, r.beat) for r in O.next_beats(b, a).collect()}
    want = {name: best(*rest) for name, *rest in learners}
    assert got == {name: x for name, x in want.items() if x} and any(x is None for x in want.values())


def test_half_even():
    assert [half_even(x) for x in (0.5, 1.5, 2.5)] == [0, 2, 2] and half_even(2.675, 2) == 2.68


def test_long_orderings(spark):
    """Ten thousand values, distinct or repeated, take the time of a few sorts; short ones equal a count of all pairs."""
    rng = random.Random(4)
    rows = []
    for n, kinds in ((10_000, 10**9), (10_000, 300), (1, 5), (2, 9), (3, 2), (7, 3), (33, 40), (64, 5)):
        answer = [f"v{rng.randrange(kinds)}" for _ in range(n)]
        rows.append((answer, rng.sample(answer, n)))
    rows += [(rows[0][0], rows[0][0]), (rows[0][0], rows[0][0][::-1]), ([], []), (["a", None], [None, "a"]), (["a"], ["b"]), (["a", "b"], ["a"])]
    began = time.time()
    got = [r[0] for r in spark.createDataFrame(rows, "a array<string>, r array<string>").coalesce(1).select(L.ordering_fraction(F.col("a"), F.col("r"))).collect()]
    assert time.time() - began < 60
    assert got == pytest.approx([ordering_fraction(*r) if None not in r[0] else 0.0 for r in rows])
    for (a, r), fraction in zip(rows, got, strict=True):
        if 2 <= len(a) < 100 and sorted(a, key=str) == sorted(r, key=str) and len(set(a)) == len(a):
            assert fraction == pytest.approx(1 - sum(r.index(x) > r.index(y) for i, x in enumerate(a) for y in a[i + 1 :]) / (len(a) * (len(a) - 1) / 2))
    assert got[8:10] == [1.0, 0.0]
