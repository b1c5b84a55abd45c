import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from samples import chapters, graph, script, story

from loomspan.functions.replay import Learner
from loomspan.operators import snapshots as A
from loomspan.operators import cassette as C
from loomspan.operators import learning as O
from loomspan.plans import pipelines as P
from loomspan.sources import readers, writers
from loomspan.streaming import replay
from loomspan.streaming.replay import replay_available

CHAPTER = "# Averages\n\nThe Mean is the sum over the count. The Median is the middle.\n\nStandard Deviation describes the Spread.\n"
NO_JSON = {"text": "no JSON", "tokens": 1}
TAPE = {"EXTRACT": [NO_JSON], "ANALYZE": [NO_JSON, {"text": '{"edges": [{"prereq": "mean", "item": "Median"}, {"prereq": "median", "item": "spread", "confidence": 0.5}]}', "tokens": 30}]}


def test_text_to_graph(spark, tmp_path):
    path = tmp_path / "one.md"
    path.write_text(CHAPTER)
    counts = P.break_file(spark, str(path), str(tmp_path / "out"), model=C.Cassette(TAPE))
    assert (counts["blocks"], counts["edges"], counts["items_accepted"]) == (3, 2, counts["items"])
    document = json.loads((tmp_path / "out/graph_v1.json").read_text())
    assert ["mean", "median"] in document["surmise"] and [] in document["states"]
    spans = {i["id"]: i["provenance"]["span"] for i in document["items"]}
    assert CHAPTER[slice(*spans["mean"])].startswith("The Mean is the sum")
    again = P.break_file(spark, str(path), str(tmp_path / "again"), model=C.Cassette(TAPE))
    other = json.loads((tmp_path / "again/graph_v1.json").read_text())
    assert document["metadata"].pop("sources") == other["metadata"].pop("sources") == [str(path)]
    assert all(m.pop("changes")[0].endswith("items") for m in (document["metadata"], other["metadata"]))
    assert again == counts and other == document
    assert P.break_file(spark, str(path), str(tmp_path / "low"), model=C.Cassette(TAPE), budget=5)["edges"] == 0
    with pytest.raises(ValueError, match="max_items"):
        P.break_file(spark, str(path), str(tmp_path), max_items=0)


def test_whole_chain(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / f"{name}.md").write_text(CHAPTER)
    session = P.full_chain(spark, [str(tmp_path / "one.md"), str(tmp_path / "two.md")], ["Mean"] * 40, str(tmp_path / "out"))
    assert session["completion"]["reason"] in ("quest_complete", "gated") and session["attempts"] > 0
    assert {"book.json", "beats.json", "session.json", "state.json", "report.md"} <= {p.name for p in (tmp_path / "out").iterdir()}


def test_book_quest(spark, tmp_path):
    session = P.book_quest(spark, chapters(), ["Alpha", "Shared", "Beta", "Shared", "wrong", "Gamma"], str(tmp_path))
    assert session["completion"] == {"reason": "quest_complete", "picks": 5, "visited": 5}
    assert (session["attempts"], session["passed"], session["xp"]) == (6, 5, 50)
    with pytest.raises(ValueError, match="without items"):
        P.book_quest(spark, {"e": {"items": [], "surmise": [], "metadata": {}}}, [], str(tmp_path))


def test_command_line(spark, tmp_path, capsys):
    from loomspan.__main__ import main

    (tmp_path / "beats.json").write_text(json.dumps(story()))
    (tmp_path / "graph.json").write_text(json.dumps(graph()))
    (tmp_path / "script.json").write_text(json.dumps({"attempts": script()}))
    (tmp_path / "lines.txt").write_text('Mean\n5.0\n\n["sort", "pick", "count"]\n["sort", "count", "pick"]\nSpread\n2.05\n')
    at = lambda n: str(tmp_path / n)
    assert main(["learn", at("beats.json"), at("script.json"), "--out", at("o")]) == 0
    assert "ATTEMPTS=7 PASSED=6 XP=67" in capsys.readouterr().out
    assert main(["quest", at("beats.json"), at("graph.json"), "--responses", at("lines.txt"), "--out", at("o"), "--save", at("state.json")]) == 0
    assert "REASON=quest_complete VISITED=8 XP=57" in capsys.readouterr().out
    assert writers.load_state(at("state.json")).xp == 57
    assert main(["export", at("o/xapi.jsonl"), "--out", at("copy")]) == 0
    assert "STATEMENTS=20" in capsys.readouterr().out
    broken = story()
    broken["beats"][0]["choices"] = [{"label": "On", "to": "nowhere"}]
    (tmp_path / "broken.json").write_text(json.dumps(broken))
    assert main(["learn", at("broken.json"), at("script.json"), "--out", at("p")]) == 2
    assert "invalid story" in capsys.readouterr().err and not (tmp_path / "p").exists()
    assert main(["break", at("beats.json"), "--out", at("q"), "--model", "remote"]) == 2
    assert main(["learn", at("nothing.json"), at("script.json"), "--out", at("o")]) == 2


def test_statements_of_runs(spark, tmp_path):
    """19, 5 and 20 statements; a run in two parts leaves the same store, byte for byte, as one run."""
    P.play(spark, story(), script(), str(tmp_path / "one"))
    whole = (tmp_path / "one/xapi.jsonl").read_text()
    assert len(whole.splitlines()) == json.loads((tmp_path / "one/session.json").read_text())["statements"] == 19
    first = P.play(spark, story(), script()[:2], str(tmp_path / "two"), save=str(tmp_path / "state.json"))
    P.play(spark, story(), script()[2:], str(tmp_path / "two"), resume=str(tmp_path / "state.json"))
    assert (tmp_path / "two/xapi.jsonl").read_text() == whole and first["stored"] == first["statements"] < 19
    assert (tmp_path / "two/report.md").read_text().count("# Session") == 2
    lines = [json.loads(x) for x in whole.splitlines()]
    assert lines[0] == {"actor": "learner", "object": "q1", "result": {}, "timestamp": 0, "verb": "experienced"}
    assert [x["verb"] for x in lines[1:3]] == ["attempted", "passed"] and lines[1]["result"]["success"] is True
    rows = spark.createDataFrame([(a["beat_id"], a["check_id"], n) for n, a in enumerate(script())], "beat string, check string, step long")
    assert rows.count() == 7


def test_pages_stay_in_the_provenance(spark):
    texts = spark.createDataFrame([("d", 1, "The Mean is the sum.\n\nThe Mode is common."), ("d", 2, "The Median is the middle.")], "doc_id string, page int, text string")
    b = P.break_texts(spark, texts)
    assert [(r.chunk_id, r.page, r.start) for r in b.blocks.orderBy("chunk_id").collect()] == [("c001", 1, 0), ("c002", 1, 22), ("c003", 2, 0)]
    assert {r.id: r.provenance.page for r in b.items.collect()}["median"] == 2


def test_merged_metadata(spark):
    made = chapters()
    made["a"]["metadata"] = {"sources": ["a.md"], "changes": ["x"]}
    made["b"]["metadata"] = {"sources": ["b.md"]}
    merged, _ = P.merge_documents(spark, made)
    assert merged["metadata"]["sources"] == ["a.md", "b.md"] and merged["metadata"]["chapters"] == ["a", "b"]
    assert merged["metadata"]["changes"][0] == "x" and merged["metadata"]["changes"][1].endswith("merged 2 chapters")


def test_remote_model(monkeypatch):
    import http.server
    import threading

    answers, asked = [], []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.headers["x-goog-api-key"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            code, body = answers.pop(0)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    pauses = []
    model = C.RemoteModel("k", "m", f"http://127.0.0.1:{server.server_port}/{{model}}", pauses.append)
    good = {"candidates": [{"content": {"parts": [{"text": "hello"}]}}], "usageMetadata": {"totalTokenCount": 7}}
    answers += [(503, {}), (429, {}), (200, good)]
    assert model.complete("R", "p", 20) == {"text": "hello", "tokens": 7} and pauses == [2, 4] and model.total_tokens == 7
    assert asked[0][0] == "k" and asked[0][1]["contents"][0]["parts"][0]["text"] == "[ROLE R]\np"
    answers += [(200, good)]
    with pytest.raises(C.BudgetExhausted):
        model.complete("R", "p", 10)
    with pytest.raises(C.BudgetExhausted):
        model.complete("R", "p", 7)
    answers += [(400, {})]
    with pytest.raises(Exception, match="400"):
        model.complete("R", "p")
    answers += [(500, {})] * 3
    with pytest.raises(Exception, match="500"):
        model.complete("R", "p")
    answers += [(200, {})]
    assert model.complete("R", "p") == {"text": "", "tokens": 0} and not answers
    server.shutdown()
    monkeypatch.delenv(C.KEY_VARIABLE, raising=False)
    with pytest.raises(ValueError, match=C.KEY_VARIABLE):
        C.RemoteModel.configured()
    with pytest.raises(RuntimeError, match="no key"):
        C.RemoteModel().complete("R", "p")


def test_default_cassette(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv(C.CASSETTE_VARIABLE, raising=False)
    assert C.default_model() is None
    (tmp_path / "cassette.json").write_text(json.dumps({"A": [{"text": "x", "tokens": 1}]}))
    assert C.default_model().complete("A", "?")["text"] == "x"
    monkeypatch.setenv(C.CASSETTE_VARIABLE, str(tmp_path / "none.json"))
    assert C.default_cassette() == str(tmp_path / "none.json") and C.default_model() is None


def test_live_replay_in_pieces(spark, tmp_path):
    rows = [(f"a{n % 3}", n, f"b{n % 2}", f"b{n % 2}", f"i{n % 4}", float(n % 5 > 1), 1.0, n % 5 > 1) for n in range(60)]
    kind = "actor string, ordinal long, beat string, check string, item string, score double, max_score double, ok boolean"
    folder = str(tmp_path / "in")
    for cut in (rows[:25], rows[25:]):
        spark.createDataFrame(cut, kind).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(kind).parquet(folder)
        got = {r.actor: json.loads(r.session) for r in replay_available(spark, stream, checkpoint=f"file://{tmp_path}/live").collect()}
    batch = spark.createDataFrame(rows, kind).withColumn("step", F.col("ordinal"))
    want = {r.actor: r.asDict() for r in O.sessions(batch).collect()}
    for actor, session in got.items():
        assert session == {k: v if not isinstance(v, float) else pytest.approx(v) for k, v in want[actor].items() if k != "actor"}


def attempt_rows(n=90, learners=3):
    return [(f"a{k % learners}", k, f"b{k * k % 7}", f"c{k * k % 7}", f"i{k % 4}", float(k % 5 > 1), 1.0, k % 5 > 1) for k in range(n)]


ATTEMPT = "actor string, ordinal long, beat string, check string, item string, score double, max_score double, ok boolean"


def told(rows, since=0):
    """What plain learners say from their statement number since on."""
    out, learners = [], {}
    for actor, _, beat, check, item, score, best, ok in rows:
        learner = learners.setdefault(actor, Learner())
        learner.told = learner.told if learner.told is not None else []
        learner.attempt(beat, check, item, score, best, ok)
    for actor, learner in learners.items():
        out += [(actor, n, t["timestamp"], t["verb"], t["object"]) for n, t in enumerate(learner.told)]
    return sorted(out)


def test_live_statements_are_there_once_after_any_cut(spark, tmp_path):
    """Two runs on one folder, and the last batch once more as if its commit had been lost with the driver."""
    rows, folder, live = attempt_rows(), str(tmp_path / "in"), f"file://{tmp_path}/live"
    for cut in (rows[:40], rows[40:]):
        spark.createDataFrame(cut, ATTEMPT).coalesce(1).write.mode("append").parquet(folder)
        replay.follow(spark, spark.readStream.schema(ATTEMPT).parquet(folder), live)
    said = lambda: sorted((r.actor, r.seq, r.step, r.verb, r.object) for r in replay.live_statements(spark, live).collect())
    assert said() == told(rows)
    commits = tmp_path / "live" / "checkpoint" / "commits"
    last = max((f for f in commits.iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    for f in commits.glob(f"*{last.name}*"):
        f.unlink()
    replay.follow(spark, spark.readStream.schema(ATTEMPT).parquet(folder), live)
    assert said() == told(rows)


def test_live_replay_from_saved_learners(spark, tmp_path):
    """Learners saved as files go on in a stream as if they had never stopped; idle and new ones are there too."""
    rows = attempt_rows()
    first, rest = rows[:50], [r for r in rows[50:] if r[0] != "a2"] + [(f"new{r[0]}", *r[1:]) for r in rows[50:60]]
    learners = {}
    for actor, _, *attempt in first:
        learners.setdefault(actor, Learner()).attempt(*attempt)
    for actor, learner in learners.items():
        writers.save_state(learner, str(tmp_path / "states" / f"{actor}.json"))
    states = readers.read_states(spark, str(tmp_path / "states"))
    assert {r.actor: Learner.loads(r.state) for r in states.collect()} == learners
    batch = spark.createDataFrame(first, ATTEMPT)
    assert {r.actor: r.state for r in replay.learner_states(batch).collect()} == {a: x.dumps() for a, x in learners.items()}
    spark.createDataFrame(rest, ATTEMPT).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ATTEMPT).parquet(str(tmp_path / "in"))
    got = {r.actor: json.loads(r.session) for r in replay_available(spark, stream, checkpoint=f"file://{tmp_path}/live", states=states).collect()}
    for actor, _, *attempt in rest:
        learners.setdefault(actor, Learner()).attempt(*attempt)
    assert got == {a: x.summary() for a, x in learners.items()}
    latest = {r.actor: r.state for r in replay.live_states(spark, f"file://{tmp_path}/live").collect()}
    assert latest == {a: x.dumps() for a, x in learners.items() if a != "a2"}
    (tmp_path / "states" / "bad.json").write_text('{"xp": 1}')
    with pytest.raises(Exception, match="not a learner state"):
        readers.read_states(spark, str(tmp_path / "states")).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "beats.json").write_text(json.dumps({"beats": story()["beats"]}))
    row = readers.read_story(spark, str(tmp_path / "beats.json")).first()
    assert len(row.beats) == 8 and row.checks == []
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError, match="needs"):
        readers.read_graph(spark, str(tmp_path / "bad.json"))
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_texts(spark, "x.docx")
    with pytest.raises(FileNotFoundError):
        readers.read_texts(spark, str(tmp_path / "none.md"))
    lines = readers.read_lines(spark, ["q1|q1-check|Mean", "", "q2|q2-check|[1|2]", "q3|c|5.0"])
    got = readers.parse_attempts(lines).selectExpr("beat", "check", "cast(response as string) r").orderBy("beat").collect()
    assert [tuple(r) for r in got] == [("q1", "q1-check", "Mean"), ("q2", "q2-check", "[1|2]"), ("q3", "c", "5")]
    with pytest.raises(Exception, match="not an attempt"):
        readers.parse_attempts(readers.read_lines(spark, ["only|two"])).collect()


def test_statement_store(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", 0, "b", "b", "i", True, 1.0, 1)], "actor string, step long, beat string, check string, item string, ok boolean, score double, max_score int")
    writers.append_statements(O.statements(rows), store)
    writers.append_statements(O.statements(rows), store)
    assert readers.count_statements(spark, store) == 6 and readers.check_statements(spark, store).isEmpty()
    assert writers.export_statements(spark, store, str(tmp_path / "copy")) == 6
    (tmp_path / "bad.jsonl").write_text('{"actor":"a","verb":"v","object":"o"}\nnot json\n{"actor":"a"}\n')
    with pytest.raises(ValueError, match="statement 1: no JSON"):
        writers.export_statements(spark, str(tmp_path / "bad.jsonl"), str(tmp_path / "copy2"))


def test_states_are_checked(tmp_path):
    path = str(tmp_path / "s.json")
    writers.save_state(Learner(xp=5), path)
    assert writers.load_state(path) == Learner(xp=5)
    data = json.loads((tmp_path / "s.json").read_text()) | {"xp": "five"}
    (tmp_path / "s.json").write_text(json.dumps(data))
    with pytest.raises(ValueError, match="xp"):
        writers.load_state(path)


def test_recorded_replies(spark):
    tape = C.Cassette({"A": [{"text": "x", "tokens": 2}, {"text": "y", "tokens": 3}]})
    assert [tape.complete("A", "?")["text"] for _ in range(3)] == ["x", "y", "x"] and tape.total_tokens == 7
    with pytest.raises(C.BudgetExhausted):
        tape.complete("A", "?", budget=8)
    assert tape.total_tokens == 7
    with pytest.raises(C.CassetteExhausted):
        tape.complete("B", "?")
    calls = spark.createDataFrame([("s", n, "A") for n in range(4)], "session string, pos int, role string")
    got = C.replay_calls(calls, spark.createDataFrame([("A", 0, 2), ("A", 1, 3)], "role string, ordinal long, tokens long"), 7).orderBy("pos").collect()
    assert [(r.ordinal, r.spent, r.allowed) for r in got] == [(0, 2, True), (1, 5, True), (0, 7, True), (1, 10, False)]


def test_snapshot_operators(spark):
    files = spark.createDataFrame([("src/a/X.java",), ("src/a/Y.java",), ("src/b/Z.java",)], "path string")
    dirs = {r.path: (r.parent, r.files) for r in A.directories(files).collect()}
    assert dirs == {"": (None, 0), "src": ("", 0), "src/a": ("src", 2), "src/b": ("src", 1)}
    imports = spark.createDataFrame([("src/b/Z.java", "a.X"), ("src/b/Z.java", "a.*"), ("src/a/X.java", "a.X")], "src string, name string")
    got = {(r.src, r.dst, r.weak) for r in A.resolve_packages(imports, files, ("main/", "src/")).collect()}
    assert got == {("src/b/Z.java", "src/a/X.java", False), ("src/b/Z.java", "src/a/Y.java", True)}
    text = spark.createDataFrame([("a\n \n\tb // TODO x\nFIXMEs",)], "t string")
    assert tuple(text.select(A.loc(F.col("t")), A.markers(F.col("t"))).first()) == (3, 1)
    defs = spark.createDataFrame([("f", 0, 1, 20, "A"), ("f", 1, 2, 9, "m"), ("f", 2, 3, 5, "n"), ("g", 0, 1, 9, "q")], "file string, idx long, start long, end long, name string")
    assert {(r.file, r.idx): r.parent for r in A.containment(defs).collect()} == {("f", 0): None, ("f", 1): 0, ("f", 2): 1, ("g", 0): None}
    refs = spark.createDataFrame([("f", 4, "m"), ("f", 4, "q"), ("f", 4, "n"), ("f", 99, "m")], "file string, line long, name string")
    near = spark.createDataFrame([("f", "g", 0)], "file string, neighbour string, rank long")
    assert {tuple(r) for r in A.call_edges(defs, refs, near).collect()} == {("f", 2, "f", 1), ("f", 2, "g", 0)}
    ring = spark.createDataFrame([("a", "b", False), ("b", "a", False), ("b", "c", False)], "src string, dst string, weak boolean")
    assert {(r.path, r.component) for r in A.cycles(ring).collect()} == {("a", "a"), ("b", "a")}
    long = {f"n{i:05d}": [f"n{(i + 1) % 5000:05d}"] for i in range(5000)}
    assert [len(c) for c in A.components_of(long)] == [5000]
    r = spark.createDataFrame([("g", float(x)) for x in (10, 40, 50, 100, 200)], "g string, r double")
    assert {(x.r, round(x.scale, 3)) for x in A.radius_clamp(r, "g", "r").collect()} == {(10, 1), (40, 1), (50, 1), (100, 1), (200, 0.5)}


def test_folders_are_scanned(spark, tmp_path):
    for name in ("a/x.py", "a/b/y.py", "z.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n")
    names = ["a/b/y.py", "a/x.py", "b c+d%é.py", "z.py"]
    (tmp_path / names[2]).write_text(f"# {names[2]}\n")
    assert sorted(tuple(r) for r in A.scan(spark, str(tmp_path)).collect()) == [(n, f"# {n}\n") for n in names]
    for n in range(1, 5):
        kept = A.scan(spark, f"file://{tmp_path}", n)
        assert sorted(r.path for r in kept.collect()) == names[:n]
        leaf = kept._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        assert leaf.metrics().apply("numFiles").value() == n  # no other file is opened
        plan = kept._jdf.queryExecution().toString()
        assert "Sort" not in plan and "Exchange" not in plan  # contents are never sorted
    (tmp_path / "none").mkdir()
    assert A.scan(spark, str(tmp_path / "none")).collect() == []
    assert A.churn(spark.createDataFrame([], "path string, commit string, author string, at date, added long, removed long")).collect() == []


def test_nesting_against_all_pairs(spark):
    """Ranges that nest, cross, meet at an end, or are equal."""
    rng = random.Random(4)
    defs = [(f"f{f}", i, a, a + rng.randrange(12), rng.choice("mn")) for f in range(30) for i, a in enumerate(rng.randrange(30) for _ in range(rng.randrange(1, 25)))]
    refs = [(f"f{f}", line, "m") for f in range(30) for line in range(0, 45, 3)]
    d = spark.createDataFrame(defs, "file string, idx long, start long, end long, name string")

    def least(file, a, b, above):
        return min(((e - s, i) for f, i, s, e, _ in defs if f == file and s <= a and e >= b and e - s > above), default=(None, None))[1]

    assert {(r.file, r.idx): r.parent for r in A.containment(d).collect()} == {(f, i): least(f, s, e, e - s) for f, i, s, e, _ in defs}
    named = {}
    for f, i, _, _, name in sorted(defs, key=lambda x: -x[1]):
        if name == "m":
            named[f] = i
    want = {(f, c, f, named[f]) for f, line, _ in refs if (c := least(f, line, line, -1)) is not None and f in named and named[f] != c}
    got = A.call_edges(d, spark.createDataFrame(refs, "file string, line long, name string"), spark.createDataFrame([], "file string, neighbour string, rank long"))
    assert {tuple(r) for r in got.collect()} == want


def test_lenses(spark):
    day = lambda n: __import__("datetime").date(2024, 1, 1 + n)
    rows = [("r", "a", 1, "x", day(0), 8, 0), ("r", "a", 2, "y", day(10), 1, 3), ("r", "b", 3, "y", day(20), 5, 0), ("r", "c", 4, "z", day(20), 0, 0), ("s", "a", 5, "z", day(0), 1, 1)]
    commits = spark.createDataFrame(rows, "repo string, path string, commit long, author string, at date, added long, removed long")
    got = {(r.repo, r.path): (r.activity, r.hotspot, r.age, r.owner, round(r.share, 3)) for r in A.lenses(commits, 10).collect()}
    assert got == {("r", "a"): (4.0, 2, 10, "x", 0.667), ("r", "b"): (5.0, 1, 0, "y", 1.0), ("r", "c"): (0.0, 3, 0, "z", 0.0), ("s", "a"): (2.0, 1, 0, "z", 1.0)}
    assert A.lenses(commits.limit(0)).collect() == []


def test_model_replies_become_tables(spark):
    from loomspan.operators import drafts as D

    blocks = spark.createDataFrame([("d", "c001", 0, 0, 5), ("d", "c002", 0, 7, 9)], "doc_id string, chunk_id string, page int, start long, end long")
    reply = {"entities": [{"label": " Mean ", "type": "Term", "chunk_ids": ["c002", "zz", "c002"]}, {"label": ""}, {"label": "mean"}, {"label": "Mode"}], "relations": [{"src": "MEAN", "rel": "r", "dst": "mode", "chunk_ids": ["zz"]}, {"src": "mean", "rel": "r", "dst": "Mode"}, {"src": "mean", "dst": "mean"}]}
    replies = spark.createDataFrame([("d", json.dumps(reply)), ("e", "[1]"), ("f", "no")], "doc_id string, text string")
    assert sorted((r.id, r.label, r.type, r.chunk_ids) for r in D.entities(replies, blocks).collect()) == [("mean", "Mean", "term", ["c002"]), ("mean-2", "mean", "concept", ["c001"]), ("mode", "Mode", "concept", ["c001"])]
    assert [(r.src, r.rel, r.dst, r.chunk_ids) for r in D.relations(replies, blocks).collect()] == [("mean", "r", "mode", ["c001"])]
    made = {"items": [{"label": "Mean", "bloom": "APPLY", "dok": 7, "provenance": {"chunk_id": "c002"}, "atomicity": {"atomic": False}}, {"id": "x y", "label": "Mean"}], "competences": [{"label": "Sum up"}, {"label": "sum-up", "type": "b"}]}
    replies = spark.createDataFrame([("d", "```json\n" + json.dumps(made) + "\n```")], "doc_id string, text string")
    assert sorted((r.id, r.bloom, r.dok, r.chunk_id, r.atomic) for r in D.items(replies, blocks).collect()) == [("mean", "apply", 1, "c002", False), ("x-y", "understand", 1, "c001", True)]
    assert [tuple(r) for r in D.competences(replies).collect()] == [("d", "sum-up", "Sum up", "cognitive")]


def test_drafted_story(spark):
    document, _ = P.merge_documents(spark, chapters())
    draft = {
        "beats": [
            {"id": "b1", "title": "One", "teaches": ["a:alpha", "zz"], "choices": [{"label": "on", "to": "b2"}, {"label": "off", "to": "nowhere"}], "checks": ["k1", "k9"]},
            {"id": "b1", "teaches": ["a:alpha"]}, {"id": "b0", "teaches": ["zz"]}, {"id": "b2", "provenance": {"item_id": "b:gamma"}},
        ],
        "checks": [{"id": "k1", "item_id": "a:alpha", "payload": {"answer": "Alpha"}}, {"id": "k2", "item_id": "zz"}, {"id": "k3", "kind": "essay", "item_id": "a:alpha"}],
    }
    tape = C.Cassette({"STORY": [{"text": json.dumps(draft), "tokens": 5}, {"text": "no JSON", "tokens": 5}]})
    made = P.author_story(spark, document, tape)
    by_id = {b["id"]: b for b in made["beats"]}
    assert set(by_id) == {"b1", "b2", "a:s1-beat", "b:s2-beat"}
    assert by_id["b1"]["choices"] == [{"label": "on", "to": "b2"}] and by_id["b1"]["checks"] == ["k1"] and by_id["b1"]["teaches"] == ["a:alpha"]
    assert made["metadata"]["pruned"] == "6" and made["metadata"]["drafted"] == "1" and P.story_issues(spark, made) == []
    stopped = P.author_story(spark, document, C.Cassette({"STORY": [{"text": json.dumps(draft), "tokens": 5}]}), budget=5)
    assert stopped["metadata"]["stopped_on_budget"] == "True" and {b["id"] for b in stopped["beats"]} == {"b1", "b2"}


def test_model_items_and_edges(spark, tmp_path):
    path = tmp_path / "one.md"
    path.write_text(CHAPTER)
    items = [{"label": "Mean", "description": "Define the Mean of a sample.", "tags": ["t"]}, {"label": "Median", "description": "Explain the Median of a sample."}, {"label": "Mode", "description": "Nothing at all."}]
    tape = {"EXTRACT": [{"text": json.dumps({"entities": [{"label": "Mean"}, {"label": "Median"}], "relations": []}), "tokens": 3}], "ANALYZE": [{"text": json.dumps({"items": items, "competences": [{"label": "Sum up"}]}), "tokens": 4}, {"text": '{"edges": [{"prereq": "Mean", "item": "median"}, {"prereq": "median", "item": "mean", "confidence": 0.1}]}', "tokens": 2}]}
    model = C.Cassette(tape)
    counts = P.break_file(spark, str(path), str(tmp_path / "out"), model=model)
    assert (counts["entities"], counts["items"], counts["items_dropped"], counts["competences"], counts["edges"], counts["states"], model.total_tokens) == (2, 2, 1, 1, 1, 3, 9)
    low = P.break_file(spark, str(path), str(tmp_path / "low"), model=C.Cassette(tape), budget=5)
    assert low["entities"] == 2 and low["edges"] == 0 and low["items"] == 2  # items and edges were refused, rules stand in


def test_a_learner_s_state_is_read_once_and_written_once_a_batch():
    """Each call to the store is a round trip: their number does not follow items, beats or attempts."""
    calls = []

    class Value:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def update(self, value):
            calls.append("update")
            self.value = value

    class Map:
        def __init__(self):
            self.values = {}

        def iterator(self):
            calls.append("iterator")
            return iter(self.values.items())

        def updateValue(self, key, value):
            calls.append("updateValue")
            self.values[key] = value

    class Handle:
        def getValueState(self, *_):
            return Value()

        def getMapState(self, *_):
            return Map()

    rows = [{"actor": "a", "ordinal": f"{n:03d}", "beat": f"b{n % 5}", "check": "c", "item": f"k{n % 7}", "score": n % 3 / 2, "max_score": 1.0, "ok": n % 3 > 0} for n in range(40)]
    processor, learner = replay.Replay(), Learner()
    processor.init(Handle())
    for part in (rows[:25], rows[:24:-1]):  # the second batch comes in another order
        last = list(processor.handleInputRows(("a",), iter([pd.DataFrame(part)]), None))[-1].iloc[-1]
        for r in sorted(part, key=lambda r: r["ordinal"]):
            learner.attempt(r["beat"], r["check"], r["item"], r["score"], r["max_score"], r["ok"])
        assert last["state"] == learner.dumps() and json.loads(last["session"]) == learner.summary()
    assert calls == ["get", "update"] * 2
