import itertools
import random

import pytest
from samples import chapters, story

from loomspan.operators import cores
from loomspan.operators import graph as G
from loomspan.operators import snapshots as A
from loomspan.operators import story as S
from loomspan.operators.components import connected_components
from loomspan.plans import pipelines as P


def _tables(spark, ids, edges, graph="g"):
    return spark.createDataFrame([(graph, i) for i in ids], "graph string, id string"), spark.createDataFrame([(graph, a, b) for a, b in edges], "graph string, prereq string, item string")


def _states(ids, edges, cap=G.STATE_CAP):
    needs = {i: {a for a, b in edges if b == i} for i in ids}
    return G.list_states(list(ids), needs, cap)


def test_states_of_small_graphs():
    assert _states("abc", [("a", "b"), ("b", "c")])[0] == [[], ["a"], ["a", "b"], ["a", "b", "c"]]
    assert len(_states("abc", [])[0]) == 8
    assert len(_states("abcd", [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])[0]) == 6
    states, over = _states("abcde", [], 10)
    assert len(states) == 10 and over
    chain = [f"n{i:04d}" for i in range(1501)]
    states, over = _states(chain, list(zip(chain, chain[1:])))
    assert len(states) == 1502 and not over
    assert _states("a", [], 0) == ([], True)


def test_states_against_all_subsets():
    rng = random.Random(2)
    for _ in range(30):
        ids = "abcdefg"[: rng.randrange(1, 8)]
        edges = [(a, b) for a, b in itertools.combinations(ids, 2) if rng.random() < 0.3]
        needs = {i: {a for a, b in edges if b == i} for i in ids}
        closed = {c for n in range(len(ids) + 1) for c in itertools.combinations(ids, n) if all(needs[i] <= set(c) for i in c)}
        got = _states(ids, edges)[0]
        assert len(got) == len(closed) and {tuple(s) for s in got} == closed


def test_fringe_hasse_and_validation(spark):
    items, edges = _tables(spark, "abc", [("a", "b"), ("b", "c"), ("a", "c")])
    states = spark.createDataFrame([("g", 1, ["a"]), ("g", 2, []), ("g", 3, ["b", "c"])], "graph string, n int, state array<string>")
    assert {(r.n, r.id) for r in G.fringe(states, items, edges, "n").collect()} == {(1, "b"), (2, "a"), (3, "a")}
    assert {(r.prereq, r.item) for r in G.hasse(edges).collect()} == {("a", "b"), ("b", "c")}
    assert {(r.n, r.missing, r.valid) for r in G.validate_states(states, edges, "n").collect()} == {(1, 0, True), (2, 0, True), (3, 2, False)}
    assert {(r.id, r.depth) for r in G.depth(items, edges).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_depth_needs_an_acyclic_graph(spark):
    with pytest.raises(Exception, match="cycle"):
        G.depth(*_tables(spark, "abcd", [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")])).collect()
    assert {r.depth for r in G.depth(*_tables(spark, "ab", [])).collect()} == {0}


def test_closure_of_a_long_chain(spark):
    ids = [f"n{i:02d}" for i in range(40)]
    _, edges = _tables(spark, ids, list(zip(ids, ids[1:])))
    assert G.closure(edges).count() == 40 * 39 // 2


def test_partitions(spark):
    items = spark.createDataFrame([("g", "a", ["t1"]), ("g", "b", ["t1", "a"]), ("g", "c", ["t2"]), ("g", "d", None)], "graph string, id string, tags array<string>")
    edges = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c")], "graph string, prereq string, item string")
    tagged, inner = G.partition_by_tag(items, edges)
    assert {(r.id, r.part) for r in tagged.collect()} == {("a", "t1"), ("b", "t1"), ("c", "t2"), ("d", "_untagged")}
    assert [(r.prereq, r.item) for r in inner.collect()] == [("a", "b")]
    assert {(r.id, r.cluster) for r in S.clusters(items).collect()} == {("a", "t1"), ("b", "a"), ("c", "t2"), ("d", "general")}


def test_overflowing_graphs_are_listed_by_tag(spark):
    rows = [("g", f"{t}{i:03d}", [t]) for t in ("t1", "t2") for i in range(20)]
    items = spark.createDataFrame(rows, "graph string, id string, tags array<string>")
    edges = spark.createDataFrame([("g", a[1], b[1]) for a, b in zip(rows, rows[1:]) if a[2] == b[2]], "graph string, prereq string, item string")
    assert G.ideals(items, edges, 100).filter("overflow").count() == 100
    assert {(r.part, r["count"]) for r in G.spaces(items, edges, 100).groupBy("part").count().collect()} == {("t1", 21), ("t2", 21)}


def test_cycles_break_at_the_weakest_edge():
    kept, dropped = G.acyclic({("a", "b"): 0.9, ("b", "c"): 0.9, ("c", "a"): 0.1})
    assert dropped == [("c", "a")] and kept == [("a", "b"), ("b", "c")]
    assert G.acyclic({("b", "c"): 0.5, ("c", "a"): 0.5, ("a", "b"): 0.5})[1] == [("a", "b")]
    assert G.acyclic({("a", "a"): 1.0}) == ([], [])


def test_random_graphs_become_acyclic(spark):
    rng = random.Random(7)
    rows = []
    for g in range(40):
        n = rng.randrange(2, 9)
        for _ in range(rng.randrange(1, 20)):
            rows.append((f"g{g}", f"v{rng.randrange(n)}", f"v{rng.randrange(n)}", rng.random()))
    got = G.enforce_dag(spark.createDataFrame(rows, "graph string, prereq string, item string, confidence double")).filter("kept").collect()
    for g in {r[0] for r in rows}:
        edges = {(r.prereq, r.item) for r in got if r.graph == g}
        assert edges <= {(p, i) for x, p, i, _ in rows if x == g}
        ids = sorted({v for e in edges for v in e})
        order = G.topological(ids, {i: {p for p, x in edges if x == i} for i in ids})
        assert all(order.index(p) < order.index(i) for p, i in edges)


def test_topological_order(spark):
    items, edges = _tables(spark, "abcd", [("c", "a"), ("b", "d")])
    assert [r.id for r in G.topo_order(items, edges).orderBy("rank").collect()] == ["b", "c", "a", "d"]
    assert G.topological(["a", "b", "c"], {"a": {"b"}, "b": {"a"}, "c": set()}) == ["c", "a", "b"]


def test_edges_by_label(spark):
    items = spark.createDataFrame([("g", "a", "Alpha", 1), ("g", "b", "Beta", 2), ("g", "c", "BETA", 3)], "graph string, id string, label string, pos int")
    asked = spark.createDataFrame([("g", "a", " beta", 3.0), ("g", "a", "c", 0.5), ("g", "a", "alpha", 1.0), ("g", "zz", "b", 1.0)], "graph string, prereq string, item string, confidence double")
    assert [tuple(r) for r in G.resolve_edges(items, asked).select("prereq", "item", "confidence").collect()] == [("a", "c", 1.0)]


def test_merge(spark):
    document, counts = P.merge_documents(spark, chapters())
    assert [i["id"] for i in document["items"]] == ["a:alpha", "a:beta", "a:s1", "b:gamma", "b:s2"]
    assert (counts["edges"], counts["states"], document["fringe_cache"][""]) == (3, 12, ["a:alpha", "b:s2"])
    items, edges = P.graph_tables(spark, {"x": {"items": [{"id": "a"}], "surmise": [["a", "zz"]]}})
    with pytest.raises(Exception, match="unknown item"):
        G.merge(items, edges)[1].collect()


def test_story_of_a_graph(spark):
    made = P.author_story(spark, P.merge_documents(spark, chapters())[0])
    assert [b["id"] for b in made["beats"]] == ["a:alpha-beat", "a:beta-beat", "b:gamma-beat", "a:s1-beat", "b:s2-beat"]
    by_id = {b["id"]: b for b in made["beats"]}
    assert by_id["a:s1-beat"]["requires"] == ["a:beta"] and by_id["a:alpha-beat"]["choices"] == [{"label": "Continue", "to": "a:beta-beat"}]
    checks = {c["id"]: c["payload"] for c in made["checks"]}
    assert checks["b:gamma-check"] == {"options": ["Gamma", "Alpha", "Beta", "Shared"], "answer": "Gamma"}
    assert P.story_issues(spark, made) == []


def test_validation_names_all_issues(spark):
    s = story()
    assert P.story_issues(spark, s) == []
    s["beats"][0]["choices"] = [{"label": "?", "to": "nowhere"}]
    s["beats"][1]["checks"] = ["no-check"]
    s["beats"].append(dict(s["beats"][7]))
    s["beats"][2]["choices"] = [{"label": "back", "to": "q2"}]
    s["checks"][0]["kind"] = "essay"
    assert {i for i, _ in P.story_issues(spark, s)} == {"dangling choice", "unknown check", "duplicate beat id", "unknown kind", "unreachable"}


def test_grounding(spark):
    items = spark.createDataFrame([("a",), ("b",)], "id string")
    drafts = spark.createDataFrame([("k", 1, "x", ["a", "zz"], None), ("k", 2, "x", ["b"], "b"), ("k", 3, "y", ["zz"], None), ("k", 4, "z", [], "a")], "cluster string, pos int, id string, teaches array<string>, item string")
    got = {r.pos: (r.teaches, r.anchor, r.status) for r in S.ground(drafts, items).collect()}
    assert got == {1: (["a"], "a", "kept"), 2: (["b"], "b", "duplicate id"), 3: ([], None, "unknown item"), 4: ([], "a", "kept")}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)]
    root = {v: v for p in pairs for v in p}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {v: find(v) for p in pairs if p[0] != p[1] for v in p}


@pytest.mark.parametrize(("cap", "opened"), [(50_000, 20), (150, 5), (1, 1)])
def test_states_of_one_graph_from_many_tasks(spark, monkeypatch, cap, opened):
    """Whatever is dealt out, the states are those of one walk in its order, the cap included."""
    tops = G._tops  # tasks read the module from disk, so the number of nodes travels with the function

    def few(batches, inner=tops, n=opened):
        G.OPENED = n
        return inner(batches)

    monkeypatch.setattr(G, "_tops", few)
    ids = [f"i{k:02d}" for k in range(14)]
    pairs = [(ids[a], ids[b]) for a, b in ((0, 3), (1, 3), (2, 4), (3, 5), (4, 6), (5, 9), (7, 8), (8, 10), (6, 11), (1, 12), (12, 13))]
    items = spark.createDataFrame([("g", i) for i in ids] + [("h", "only")], "graph string, id string")
    edges = spark.createDataFrame([("g", p, i) for p, i in pairs], "graph string, prereq string, item string")
    needs = {i: {p for p, x in pairs if x == i} for i in ids}
    want, over = G.list_states(ids, needs, cap)
    got = G.ideals(items, edges, cap)
    rows = sorted((r.ordinal, r.state, r.overflow) for r in got.filter("graph = 'g'").collect())
    assert rows == [(k, s, over) for k, s in enumerate(want)]
    assert len(want) == min(cap, 340) and over == (cap <= 340)
    if cap == 50_000:
        assert got.filter("graph = 'h'").count() == 2


def _first_cycle(arcs):
    """By recursion: the first node of the path that a depth-first walk in sorted order comes back to."""
    done = set()

    def visit(node, path):
        if node in path:
            ring = [*path[path.index(node) :], node]
            return list(zip(ring, ring[1:]))
        if node in done:
            return []
        for nxt in sorted(i for p, i in arcs if p == node):
            if ring := visit(nxt, [*path, node]):
                return ring
        done.add(node)
        return []

    return next((ring for root in sorted({v for e in arcs for v in e}) if (ring := visit(root, []))), [])


def _random_graphs(seed, n_graphs, most_nodes, most_edges):
    rng = random.Random(seed)
    for _ in range(n_graphs):
        n = rng.randrange(2, most_nodes)
        yield {(f"v{rng.randrange(n):02d}", f"v{rng.randrange(n):02d}"): rng.randrange(6) / 5 for _ in range(rng.randrange(1, most_edges))}


def _broken(given):
    left, dropped = {e for e in given if e[0] != e[1]}, []
    while ring := _first_cycle(left):
        dropped.append(min(ring, key=lambda e: (given[e], *e)))
        left.remove(dropped[-1])
    return dropped


def test_cycles_are_met_in_the_order_of_a_depth_first_walk():
    for given in _random_graphs(5, 300, 12, 40):
        following = {v: [i for p, i in given if p == v] for e in given for v in e}
        assert G.find_cycle(following) == _first_cycle(set(given))
        assert G.acyclic(given)[1] == _broken(given)
    assert G.find_cycle({"a": ["zz"]}) == []


@pytest.mark.parametrize("whole", [200_000, 0])
def test_graphs_are_broken_alike_whole_and_in_parts(spark, monkeypatch, whole):
    monkeypatch.setattr(cores, "WHOLE", whole)
    graphs = {f"g{n}": g for n, g in enumerate(_random_graphs(9, 25, 16, 40))}
    rows = [(g, p, i, c) for g, given in graphs.items() for (p, i), c in given.items()]
    got = G.enforce_dag(spark.createDataFrame(rows, "graph string, prereq string, item string, confidence double")).collect()
    assert len(got) == len(rows)
    for g, given in graphs.items():
        loops = {e for e in given if e[0] == e[1]}
        assert {(r.prereq, r.item) for r in got if r.graph == g and not r.kept} == loops | set(_broken(given))


def test_only_the_core_of_a_large_graph_is_left(spark, monkeypatch):
    """A tree of 60 000 edges with one ring of five on top: trimming leaves the ring, whatever hangs below it."""
    monkeypatch.setattr(cores, "WHOLE", 50_000)
    n = 60_000
    k = spark.range(2, n + 1).selectExpr("'g' AS graph", "concat('p', (id + 6) div 8) AS src", "concat('p', id) AS dst")
    ring = spark.createDataFrame([("g", a, b) for a, b in (("p1", "r1"), ("r1", "r2"), ("r2", "r3"), ("r3", "r4"), ("r4", "p1"))], k.schema)
    parts = cores.cyclic_parts(k.unionByName(ring), both_ways=False)
    assert {(r.src, r.dst) for r in parts.collect()} == {("p1", "r1"), ("r1", "r2"), ("r2", "r3"), ("r3", "r4"), ("r4", "p1")}
    found = A.cycles(k.unionByName(ring).drop("graph")).collect()
    assert {(r.path, r.component) for r in found} == {(v, "p1") for v in ("p1", "r1", "r2", "r3", "r4")}


@pytest.mark.parametrize("whole", [200_000, 0])
def test_import_cycles_are_found_alike_whole_and_in_parts(spark, monkeypatch, whole):
    monkeypatch.setattr(cores, "WHOLE", whole)
    graphs = {f"g{n}": set(g) for n, g in enumerate(_random_graphs(11, 20, 16, 26))}
    want = set()
    for g, arcs in graphs.items():
        reach = dict.fromkeys({v for e in arcs for v in e})
        for v in reach:
            seen, todo = set(), [v]
            while todo:
                now = todo.pop()
                fresh = {i for p, i in arcs if p == now} - seen
                seen |= fresh
                todo += fresh
            reach[v] = seen
        for v in reach:
            same = {w for w in reach[v] if v in reach[w]} | {v}
            want |= {(g, v, min(same))} if len(same) > 1 else set()
    edges = spark.createDataFrame([(g, *e) for g, arcs in graphs.items() for e in arcs], "repo string, src string, dst string")
    assert {tuple(r) for r in A.cycles(edges, "repo").collect()} == want


def test_reduction_against_a_search_for_each_edge(spark):
    graphs = {f"g{n}": set(g) for n, g in enumerate(_random_graphs(13, 30, 14, 36))}
    for n in range(30):  # without cycles
        rng = random.Random(n)
        graphs[f"d{n}"] = {(f"v{a:02d}", f"v{b:02d}") for a, b in itertools.combinations(rng.sample(range(14), 14), 2) if rng.random() < 0.25}
    want = set()
    for g, arcs in graphs.items():
        for p, i in arcs:
            seen, todo, met = {p}, [p], False
            while todo:
                now = todo.pop()
                for nxt in {b for a, b in arcs if a == now and (a, b) != (p, i)} - seen:
                    met |= nxt == i
                    seen.add(nxt)
                    todo.append(nxt)
            if not met:
                want.add((g, p, i))
    edges = spark.createDataFrame([(g, *e) for g, arcs in graphs.items() for e in arcs], "graph string, prereq string, item string")
    assert {tuple(r) for r in G.hasse(edges).collect()} == want


def test_reduction_of_a_long_chain_writes_rows_linear_in_its_edges(spark, monkeypatch):
    n = 10_000
    chain = spark.range(n - 1).selectExpr("'g' AS graph", "concat('n', id) AS prereq", "concat('n', id + 1) AS item")
    jumps = spark.range(0, n - 600, 100).selectExpr("'g' AS graph", "concat('n', id) AS prereq", "concat('n', id + 500) AS item")
    written, write = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda *parts: written.append(write(*parts)) or written[-1])
    assert G.hasse(chain).count() == n - 1
    got = G.hasse(chain.unionByName(jumps))
    assert got.exceptAll(chain).isEmpty() and got.count() == n - 1
    assert sum(t.count() for t in written) < 5 * n


def test_large_graphs_without_long_paths_are_reduced_without_a_walk(spark, monkeypatch):
    graphs = {f"g{n}": set(g) for n, g in enumerate(_random_graphs(29, 12, 14, 36))}
    for n in range(12):  # without cycles
        rng = random.Random(n)
        graphs[f"d{n}"] = {(f"v{a:02d}", f"v{b:02d}") for a, b in itertools.combinations(rng.sample(range(14), 14), 2) if rng.random() < 0.3}
    graphs["tree"] = {(f"p{k}", f"p{c}") for k in range(1, 600) for c in (2 * k, 2 * k + 1, 4 * k) if c < 600} | {("p3", "p3")}
    edges = spark.createDataFrame([(g, *e) for g, arcs in graphs.items() for e in arcs], "graph string, prereq string, item string")
    want = {tuple(r) for r in G.hasse(edges).collect()}  # every graph is walked
    walked, spans = set(), G._span_rows
    monkeypatch.setattr(cores, "WHOLE", 12)
    monkeypatch.setattr(G, "_span_rows", lambda own: walked.update(r.graph for r in own.select("graph").distinct().collect()) or spans(own))
    assert {tuple(r) for r in G.hasse(edges).collect()} == want
    assert "tree" not in walked and not any(g.startswith("d") and len(graphs[g]) > 12 for g in walked) and any(g.startswith("g") for g in walked)
    assert {(a, b) for g, a, b in want if g == "tree"} == {(a, b) for a, b in graphs["tree"] if int(b[1:]) != 4 * int(a[1:])}


def test_resolved_items_are_merged_whatever_their_packed_size(spark):
    items = spark.createDataFrame([("g", "a", "Alpha", 1), ("g", "b", "Beta", 2)], "graph string, id string, label string, pos int")
    proposals = spark.createDataFrame([("g", " alpha", "b", 0.5)], "graph string, prereq string, item string, confidence double")
    edges = G.resolve_edges(items, proposals)
    assert [tuple(r) for r in edges.collect()] == [("g", "a", "b", 0.5)]
    assert "Broadcast" not in edges._jdf.queryExecution().toString()


def test_rows_per_item_are_merged_in_orders_and_chains(spark):
    """Tables of known small size, which Spark would broadcast; only a graph's few first labels may be."""
    items = spark.range(12).selectExpr("CAST(id div 6 AS string) AS graph", "concat('n', id) AS id", "concat('N', id) AS label", "array(CAST(id % 2 AS string)) AS tags", "1 AS dok")
    edges = spark.range(10).selectExpr("CAST(id div 6 AS string) AS graph", "concat('n', id) AS prereq", "concat('n', id + 2) AS item")
    joins = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")
    assert joins(G.known_edges(items, edges)) == 0
    got = S.chains(items, edges)
    assert joins(got) <= 1
    assert [(r.beat, r.next, r.requires) for r in got.filter("graph = '0' AND cluster = '0'").orderBy("rank").collect()] == [("n0-beat", "n2-beat", []), ("n2-beat", "n4-beat", ["n0"]), ("n4-beat", None, ["n2"])]


def test_closure_against_walks_and_each_pair_written_once(spark, monkeypatch):
    """Rings, self-edges and short cuts: every pair is written in the round that finds it, and in no other."""
    graphs = {f"g{n}": set(g) for n, g in enumerate(_random_graphs(5, 12, 12, 20))} | {"ring": {("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")}}
    graphs["chain"] = {(f"c{i:02d}", f"c{i + 1:02d}") for i in range(37)} | {(f"c{i:02d}", f"c{i + 5:02d}") for i in range(0, 30, 7)}
    want = set()
    for g, arcs in graphs.items():
        for start in {a for a, _ in arcs}:
            met, todo = set(), [start]
            while todo:
                now = todo.pop()
                fresh = {b for a, b in arcs if a == now} - met
                met |= fresh
                todo += fresh
            want |= {(g, start, i) for i in met}
    edges = spark.createDataFrame([(g, *e) for g, arcs in graphs.items() for e in arcs], "graph string, prereq string, item string")
    written, write = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda *parts: written.append(write(*parts)) or written[-1])
    got = [tuple(r) for r in G.closure(edges).collect()]
    assert len(got) == len(want) and set(got) == want
    assert sum(t.count() for t in written) == len(want)
