"""Prerequisite graphs: adjacency, closure, reduction, fringes, states, partitions, cycles, orders, merging.

Graph tables hold items (graph, id, …) and edges (graph, prereq, item, …); many graphs are worked on at once. What is
relational runs as joins; enumerating states, breaking cycles and ordering, whose results depend on a sequence of
choices, run as grouped maps over one graph at a time (graphs are documents of at most some thousand items).
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.operators import cores
from loomspan.operators.cores import cyclic_parts
from loomspan.operators.groups import map_groups
from loomspan.plans.storage import broadcast_if_small, dealt, materialize

#: Most states that are listed for one graph.
STATE_CAP = 50_000


def known_edges(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the items, which are merged: packed they look small enough to broadcast, in memory they are not."""
    ids = items.select("graph", "id").hint("merge")
    both = edges.join(ids.withColumnRenamed("id", "prereq"), ["graph", "prereq"], "left_semi")
    return both.join(ids.withColumnRenamed("id", "item"), ["graph", "item"], "left_semi")


def unknown_edges(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no item: an error where graphs are merged or played."""
    return edges.join(known_edges(items, edges), ["graph", "prereq", "item"], "left_anti")


def adjacency(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, id, prereqs): each item's sorted prerequisites, empty where it has none."""
    sets = known_edges(items, edges).groupBy("graph", F.col("item").alias("id")).agg(F.array_sort(F.collect_set("prereq")).alias("prereqs"))
    return items.select("graph", "id").join(sets, ["graph", "id"], "left").withColumn("prereqs", F.coalesce("prereqs", F.array().cast(sets.schema["prereqs"].dataType)))


def normalise_edges(proposals: DataFrame) -> DataFrame:
    """Self-edges go, confidence is clamped to 0..1, of equal pairs the largest confidence stays."""
    clamped = proposals.filter("prereq <> item").withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0)))))
    return clamped.groupBy("graph", "prereq", "item").agg(F.max("confidence").alias("confidence"))


def resolve_edges(items: DataFrame, proposals: DataFrame) -> DataFrame:
    """Edge ends given as id or as label (any case, the last item of a label wins), normalised.

    Items are as many as proposals may be, and their packed size says little of them: they are merged, never broadcast.
    """
    by_label = items.groupBy("graph", F.lower(F.trim("label")).alias("key")).agg(F.max_by("id", "pos").alias("by_label"))
    out = proposals
    for end in ("prereq", "item"):
        ids = items.select("graph", F.col("id").alias(end), F.col("id").alias("by_id"))
        out = out.join(ids.hint("merge"), ["graph", end], "left").withColumn("key", F.lower(F.trim(end))).join(by_label.hint("merge"), ["graph", "key"], "left")
        out = out.withColumn(end, F.coalesce("by_id", "by_label")).drop("by_id", "by_label", "key").filter(F.col(end).isNotNull())
    return normalise_edges(out)


def closure(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(graph, prereq, item) for every path: path lengths double each round until nothing is new.

    After a round all pairs of a shortest path up to 2^n are known, with its length. The next are those of length 2^n,
    continued by any pair: where a longer shortest path goes on after 2^n steps is such a pair's end, so no other joins
    are made. Each round writes its new pairs only.
    """
    found = [materialize(edges.select("graph", "prereq", "item", F.lit(1).cast("long").alias("n")).distinct())]
    for r in range(max_rounds):
        pairs = reduce(DataFrame.unionByName, found)
        half = found[-1].filter(F.col("n") == 1 << r).select("graph", "prereq", F.col("item").alias("mid"), "n")
        rest = pairs.select("graph", F.col("prereq").alias("mid"), "item", F.col("n").alias("more"))
        longer = half.join(rest, ["graph", "mid"]).groupBy("graph", "prereq", "item").agg(F.min(F.col("n") + F.col("more")).alias("n"))
        new = materialize(longer.join(pairs, ["graph", "prereq", "item"], "left_anti"))
        if new.isEmpty():
            return pairs.drop("n")
        found.append(new)
    raise RuntimeError("paths longer than 2^max_rounds")


#: Above every rank: nodes that reach a cycle may reach anything.
_ANY = 1 << 62
_SPANS = [f"{c}{i}" for i in (1, 2) for c in ("enter", "low", "rank")]


def _reach_spans(pairs: list[tuple[str, str]]) -> dict[str, tuple[int, ...]]:
    """For each node (enter, low, rank) of a depth-first walk along ascending and one along descending successors.

    A node's rank is its place in the order of leaving, low the least rank it reaches, enter the rank given next when
    the walk came to it. What a node reaches has a rank from low to its own in both walks; what has one from
    enter to its own in either is reached for sure. Nodes that reach a cycle exclude nothing and are sure of nothing.
    """
    settled = Rings(pairs).dead
    ahead: dict[str, list[str]] = {v: [] for p in pairs for v in p}
    later = set()
    for p, i in sorted(pairs):
        ahead[p].append(i)
        later.add(i)
    out = {v: () if v in settled else (_ANY + 1, -1, _ANY) * 2 for v in ahead}
    for _ in range(2):
        spans: dict[str, list[int]] = {}
        rank = 0
        for root in sorted((v for v in ahead if v in settled), key=lambda v: v in later):
            path = [] if root in spans else [(root, iter(ahead[root]))]
            if path:
                spans[root] = [rank, _ANY, -1]
            while path:
                node, rest = path[-1]
                own = spans[node]
                for child in rest:
                    if child not in spans:
                        spans[child] = [rank, _ANY, -1]
                        path.append((child, iter(ahead[child])))
                        break
                    own[1] = min(own[1], spans[child][1])
                else:
                    path.pop()
                    own[1], own[2] = min(own[1], rank), rank
                    rank += 1
                    if path:
                        over = spans[path[-1][0]]
                        over[1] = min(over[1], own[1])
        for v, span in spans.items():
            out[v] += tuple(span)
        for following in ahead.values():
            following.reverse()
    return out


def _span_rows(own: DataFrame) -> DataFrame:
    """The labels of all nodes of graphs that are walked, each in one task."""
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        spans = _reach_spans(list(zip(frame["prereq"], frame["item"], strict=True)))
        out = pd.DataFrame(list(spans.values()), columns=_SPANS)
        out.insert(0, "id", list(spans))
        out.insert(0, "graph", frame["graph"].iloc[0])
        return out

    schema = f"graph {kinds['graph']}, id {kinds['item']}, " + ", ".join(f"{c} long" for c in _SPANS)
    spans = own.groupBy("graph").applyInPandas(label, schema)
    return spans.select("*", F.col("rank1").alias("goal1"), F.col("rank2").alias("goal2"), F.lit(-1).cast("long").alias("below"))


def reach_labels(own: DataFrame, graphs: DataFrame) -> DataFrame:
    """(graph, id, spans, goals, below) of the nodes of graphs: what tells that a node cannot reach another, or surely does.

    Small graphs are walked for spans. Large ones (cores.WHOLE edges) are taken apart by joins: what a node reaches is
    of lesser height and has no bit that the node's own lack. Only where that leaves edges (cycles, long paths) are they walked.
    """
    own = own.select("graph", "prereq", "item").join(broadcast_if_small(graphs, 64), "graph", "left_semi")
    large = materialize(own.groupBy("graph").agg(F.count("*").alias("n")).filter(F.col("n") > cores.WHOLE).select("graph"))
    if large.isEmpty():
        return _span_rows(own)
    arcs = own.join(F.broadcast(large), "graph", "left_semi").filter("prereq <> item")
    levels, rest = cores.heights(arcs.select("graph", F.col("prereq").alias("src"), F.col("item").alias("dst")))
    n = lambda c: F.lit(c).cast("long") if isinstance(c, int) else F.col(c).cast("long")
    values = {"enter1": n(_ANY + 1), "low1": n(-1), "rank1": n("height"), "enter2": n(_ANY + 1), "low2": n(-1), "rank2": n(_ANY), "goal1": n("height") + 1, "goal2": n(0)}
    levelled = levels.select("graph", F.col("node").alias("id"), *(c.alias(k) for k, c in values.items()), "below")
    apart = large.join(F.broadcast(rest), "graph", "left_anti")
    return _span_rows(own.join(F.broadcast(apart), "graph", "left_anti")).unionByName(levelled)


def hasse(edges: DataFrame) -> DataFrame:
    """Edges without those that another path replaces.

    Only an edge from a node of several successors to one of several prerequisites can be replaced. From such edges a
    search goes on, all at once, a join a round, into nodes whose labels do not exclude the edge's item, until they are
    sure of it. No other pairs are made, so a chain or a tree costs rows linear in its edges.
    """
    own = materialize(edges.select("graph", "prereq", "item").distinct())
    forks = own.groupBy("graph", "prereq").count().filter("count > 1")
    meets = own.groupBy("graph", "item").count().filter("count > 1")
    asked = materialize(own.filter("prereq <> item").join(forks, ["graph", "prereq"], "left_semi").join(meets, ["graph", "item"], "left_semi").select("graph", "prereq", "item"))
    if asked.isEmpty():
        return own
    labels = materialize(reach_labels(own, materialize(asked.select("graph").distinct())))
    arcs = materialize(own.select("graph", F.col("prereq").alias("mid"), F.col("item").alias("nxt")).join(labels.select("graph", F.col("id").alias("nxt"), *_SPANS, "below"), ["graph", "nxt"]))
    goals = ("goal1", "goal2", "goal_below")
    goal = labels.select("graph", F.col("id").alias("item"), "goal1", "goal2", F.col("below").alias("goal_below"))
    front = asked.join(goal, ["graph", "item"]).select("graph", "prereq", "item", F.col("prereq").alias("mid"), *goals)
    edge = ["graph", "prereq", "item"]
    sure = (F.col("nxt") == F.col("item")) | F.col("goal1").between(F.col("enter1"), F.col("rank1")) | F.col("goal2").between(F.col("enter2"), F.col("rank2"))
    may = F.col("goal1").between(F.col("low1"), F.col("rank1")) & F.col("goal2").between(F.col("low2"), F.col("rank2"))
    may = may & (F.col("goal_below").bitwiseAND(F.col("below")) == F.col("goal_below"))
    seen, replaced = front, []
    while True:
        step = front.join(arcs, ["graph", "mid"]).filter("nxt <> prereq and not (mid = prereq and nxt = item)").withColumn("hit", sure).filter(F.col("hit") | may)
        step = materialize(step.select(*edge, F.col("nxt").alias("mid"), *goals, "hit").distinct())
        hits = step.filter("hit").select(*edge).distinct()
        replaced.append(hits)
        further = step.filter("not hit").drop("hit").join(hits, edge, "left_anti")
        front = materialize(further.join(seen, [*edge, "mid"], "left_anti").select(*front.columns))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    for hits in replaced:
        own = own.join(hits, edge, "left_anti")
    return own.select(*edge)


def fringe(states: DataFrame, items: DataFrame, edges: DataFrame, *keys: str) -> DataFrame:
    """(graph, *keys, id): items outside a state whose prerequisites all lie in it.

    states: (graph, *keys, state array), a row for each key. Candidates are what a state's members lead to, their met
    prerequisites counted map-side, and the graph's items without any; states meet no other items.
    """
    needs = known_edges(items, edges).select("graph", "prereq", F.col("item").alias("id")).distinct()
    wanted = needs.groupBy("graph", "id").agg(F.count("*").alias("need"))
    members = states.select("graph", *keys, F.explode(F.array_distinct("state")).alias("prereq"))
    met = members.join(needs, ["graph", "prereq"]).groupBy("graph", *keys, "id").agg(F.count("*").alias("met"))
    ready = met.join(wanted, ["graph", "id"]).filter("met = need").select("graph", *keys, "id")
    ready = ready.join(members.withColumnRenamed("prereq", "id"), ["graph", *keys, "id"], "left_anti")
    free = items.select("graph", "id").join(wanted, ["graph", "id"], "left_anti")
    open_ = states.select("graph", *keys, "state").join(free, "graph").filter(~F.array_contains("state", F.col("id")))
    return ready.unionByName(open_.select("graph", *keys, "id"))


def validate_states(states: DataFrame, edges: DataFrame, *keys: str) -> DataFrame:
    """(graph, *keys, missing, valid): members of a state that lack a prerequisite."""
    members = states.select("graph", *keys, F.explode("state").alias("item"), "state").join(edges.select("graph", "prereq", "item").distinct(), ["graph", "item"])
    gaps = members.filter(~F.array_contains("state", F.col("prereq"))).groupBy("graph", *keys).agg(F.count("*").alias("missing"))
    return states.select("graph", *keys).join(gaps, ["graph", *keys], "left").withColumn("missing", F.coalesce("missing", F.lit(0)).cast("long")).withColumn("valid", F.col("missing") == 0)


#: A node of the walk: the choices taken so far by number, the state, and what it may still add.
Node = tuple[tuple[int, ...], frozenset, list[str]]


class Walk:
    """The tree of a graph's states: a state's children add one available item, in ascending order.

    What a branch passes over it never adds again, so every downward-closed set is one node. Paths of choice numbers
    sort as a depth-first walk visits the nodes.
    """

    def __init__(self, prereqs: dict[str, set[str]]):
        self.prereqs, self.followers = prereqs, {i: [] for i in prereqs}
        for i, needs in prereqs.items():
            for p in needs:
                self.followers[p].append(i)
        self.root: Node = ((), frozenset(), sorted(i for i, needs in prereqs.items() if not needs))

    def child(self, state: frozenset, choices: list[str], at: int) -> tuple[frozenset, list[str]]:
        grown = state | {choices[at]}
        opened = [i for i in self.followers[choices[at]] if i not in grown and self.prereqs[i] <= grown]
        return grown, sorted(choices[at + 1 :] + opened)

    def below(self, state: frozenset, choices: list[str]) -> Iterator[frozenset]:
        """The states of a node's subtree in the order of the walk, without its own."""
        stack = [(state, choices, 0)]
        while stack:
            state, choices, at = stack.pop()
            if at < len(choices):
                stack.append((state, choices, at + 1))
                grown, further = self.child(state, choices, at)
                yield grown
                stack.append((grown, further, 0))

    def top(self, most: int) -> Iterator[tuple[Node, bool]]:
        """The nodes next to the root, and whether a node's subtree is left to others; most nodes are opened."""
        waiting = deque([self.root])
        for _ in range(most):
            if not waiting:
                return
            path, state, choices = waiting.popleft()
            yield (path, state, choices), False
            waiting.extend(((*path, at), *self.child(state, choices, at)) for at in range(len(choices)))
        for node in waiting:
            yield node, bool(node[2])


def list_states(items: list[str], prereqs: dict[str, set[str]], cap: int = STATE_CAP) -> tuple[list[list[str]], bool]:
    """All downward-closed sets, each once, in the order of a depth-first walk; and whether the cap was reached."""
    walk = Walk({i: prereqs[i] for i in items})
    states = [sorted(s) for s in islice(chain([frozenset()], walk.below(*walk.root[1:])), max(0, cap))]
    return states, len(states) >= cap


#: Nodes of one graph's walk that are opened before its subtrees are dealt out, and the parcels they are dealt in.
OPENED, PARCELS = 512, 64
#: Graphs whose walks one task opens.
WALKED = 2_000
_NODE = "path array<int>, state array<string>, choices array<string>"


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for graph, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            walk = Walk({d["id"]: set(d["prereqs"]) for d in doc})
            paths, states, choices, stubs = zip(*((p, sorted(s), c, stub) for (p, s, c), stub in walk.top(OPENED)), strict=True)
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([graph] * len(paths), pa.string()), pa.array(paths, pa.list_(pa.int32())), pa.array(states, strings), pa.array(choices, strings), pa.array(stubs)], names=["graph", "path", "state", "choices", "stub"])


def _count_below(cap: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for graph, stubs, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                walk = Walk({d["id"]: set(d["prereqs"]) for d in doc})
                sizes = [1 + sum(1 for _ in islice(walk.below(frozenset(s["state"]), s["choices"]), cap)) for s in stubs]
                yield pa.RecordBatch.from_arrays([pa.array([graph] * len(stubs), pa.string()), pa.array([s["path"] for s in stubs], pa.list_(pa.int32())), pa.array(sizes, pa.int64())], names=["graph", "path", "n"])

    return count


def _list_below(cap: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for graph, stubs, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                walk = Walk({d["id"]: set(d["prereqs"]) for d in doc})
                for s in stubs:
                    states = [sorted(x) for x in islice(walk.below(frozenset(s["state"]), s["choices"]), min(s["n"], cap - s["first"]) - 1)]
                    ordinals = range(s["first"] + 1, s["first"] + 1 + len(states))
                    yield pa.RecordBatch.from_arrays([pa.array([graph] * len(states), pa.string()), pa.array(ordinals, pa.int64()), pa.array(states, pa.list_(pa.string())), pa.array([s["overflow"]] * len(states), pa.bool_())], names=["graph", "ordinal", "state", "overflow"])

    return rows


def ideals(items: DataFrame, edges: DataFrame, cap: int = STATE_CAP) -> DataFrame:
    """(graph, ordinal, state, overflow): knowledge states of each graph, at most cap of them, in walk order.

    A small graph is walked where its document is. Of a larger one the top of the walk is opened there, and the subtrees
    below it are dealt out: tasks count them, sums along the walk give each its place, and tasks list those before
    the cap, so one graph's states come from many tasks in the order of one walk.
    """
    each = adjacency(items, edges).groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("id", "prereqs"))).alias("doc"))
    docs = materialize(each.select(F.col("graph").cast("string").alias("graph"), F.transform("doc", lambda d: F.struct(d["id"].cast("string").alias("id"), d["prereqs"].cast("array<string>").alias("prereqs"))).alias("doc")))
    top = materialize(dealt(docs, "graph", most=WALKED).mapInArrow(_tops, f"graph string, {_NODE}, stub boolean"))

    def parcels(nodes: DataFrame, *more: str) -> DataFrame:
        parcel = F.pmod(F.xxhash64("path"), F.lit(PARCELS))
        grouped = nodes.withColumn("parcel", parcel).groupBy("graph", "parcel").agg(F.collect_list(F.struct("path", "state", "choices", *more)).alias("stubs"))
        return grouped.join(docs, "graph").repartition("graph", "parcel").select("graph", "stubs", "doc")

    sizes = top.withColumn("n", F.lit(1).cast("long"))
    deep = not top.filter("stub").isEmpty()
    if deep:
        counted = materialize(parcels(top.filter("stub")).mapInArrow(_count_below(max(0, cap)), "graph string, path array<int>, n long"))
        sizes = sizes.drop("n").join(counted, ["graph", "path"], "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
    walk = W.partitionBy("graph").orderBy("path")
    before = F.coalesce(F.sum("n").over(walk.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = sizes.withColumn("first", before).withColumn("overflow", F.sum("n").over(W.partitionBy("graph")) >= cap).filter(F.col("first") < cap)
    own = placed.select("graph", F.col("first").alias("ordinal"), "state", "overflow")
    if not deep:
        return own
    placed = materialize(placed)
    inside = parcels(placed.filter("stub and n > 1"), "n", "first", "overflow").mapInArrow(_list_below(cap), "graph string, ordinal long, state array<string>, overflow boolean")
    return placed.select(*own.columns[:1], F.col("first").alias("ordinal"), "state", "overflow").unionByName(inside)


def partition_by_tag(items: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with the tag they list first (_untagged without), and the edges that stay within one tag."""
    tagged = items.withColumn("part", F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit("_untagged")))
    owner = tagged.select("graph", "id", "part")
    inner = edges.join(owner.withColumnRenamed("id", "prereq"), ["graph", "prereq"]).join(owner.select("graph", F.col("id").alias("item"), F.col("part").alias("__other")), ["graph", "item"])
    return tagged, inner.filter("part = __other").drop("__other")


def spaces(items: DataFrame, edges: DataFrame, cap: int = STATE_CAP) -> DataFrame:
    """States of each graph; graphs that overflow are listed again by tag, each part with its inner edges."""
    whole = materialize(ideals(items, edges, cap))
    over = whole.filter("overflow").select("graph").distinct()
    fine = whole.join(over, "graph", "left_anti").withColumn("part", F.lit(None).cast("string"))
    tagged, inner = partition_by_tag(items.join(over, "graph", "left_semi"), edges)
    name = F.concat_ws("\u0001", "graph", "part")
    parts = ideals(tagged.withColumn("graph", name), inner.withColumn("graph", name), cap)
    split = F.split("graph", "\u0001", 2)
    return fine.unionByName(parts.withColumn("part", split[1]).withColumn("graph", split[0]))


class Rings:
    """The cycles that a depth-first walk from sorted roots along sorted neighbours meets, as edges are taken away.

    Nodes that reach no cycle are dead, and the walk only ever turns back from those. So of the rest it starts at the
    smallest and goes to the smallest successor until it comes to a node of its path. When an edge of that ring goes,
    the path up to the edge stays as it is, unless nodes of it die.
    """

    def __init__(self, pairs: list[tuple[str, str]]):
        self.gone: set[tuple[str, str]] = set()
        self.dead: set[str] = set()
        self.ahead: dict[str, list[str]] = {v: [] for p in pairs for v in p}
        self.behind: dict[str, list[str]] = {v: [] for v in self.ahead}
        for p, i in sorted(set(pairs), reverse=True):
            self.ahead[p].append(i)
            self.behind[i].append(p)
        self.ways = {v: len(following) for v, following in self.ahead.items()}
        self.roots = sorted(self.ahead, reverse=True)
        self.path: list[str] = []
        self.place: dict[str, int] = {}
        self._bury([v for v, n in self.ways.items() if not n])

    def _bury(self, ended: list[str]) -> None:
        self.dead.update(ended)
        while ended:
            now = ended.pop()
            for before in self.behind[now]:
                if before not in self.dead and (before, now) not in self.gone:
                    self.ways[before] -= 1
                    if not self.ways[before]:
                        self.dead.add(before)
                        ended.append(before)

    def _go(self, node: str) -> None:
        self.place[node] = len(self.path)
        self.path.append(node)

    def first(self) -> list[tuple[str, str]]:
        """The edges of the first ring, from where the walk enters it; [] without one."""
        if not self.path:
            while self.roots and self.roots[-1] in self.dead:
                self.roots.pop()
            if not self.roots:
                return []
            self._go(self.roots[-1])
        while True:
            node = self.path[-1]
            following = self.ahead[node]
            while following[-1] in self.dead or (node, following[-1]) in self.gone:
                following.pop()
            if following[-1] in self.place:
                ring = self.path[self.place[following[-1]] :]
                return list(zip(ring, [*ring[1:], following[-1]], strict=True))
            self._go(following[-1])

    def remove(self, edge: tuple[str, str]) -> None:
        """Take an edge of the first ring away."""
        self.gone.add(edge)
        self.ways[edge[0]] -= 1
        if not self.ways[edge[0]]:
            self._bury([edge[0]])
        stay = self.place[edge[0]] + 1
        while stay and self.path[stay - 1] in self.dead:
            stay -= 1
        for node in self.path[stay:]:
            del self.place[node]
        del self.path[stay:]


def find_cycle(following: dict[str, list[str]]) -> list[tuple[str, str]]:
    """Edges of the first cycle of a depth-first walk from sorted roots along sorted neighbours; [] without one."""
    return Rings([(p, i) for p, items in following.items() for i in items if i in following]).first()


def acyclic(edges: dict[tuple[str, str], float]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Kept and dropped edges: while there is a cycle, its edge of least (confidence, prereq, item) goes."""
    left = {e: c for e, c in edges.items() if e[0] != e[1]}
    rings, dropped = Rings(list(left)), []
    while ring := rings.first():
        dropped.append(min(ring, key=lambda e: (left[e], *e)))
        rings.remove(dropped[-1])
    return sorted(left.keys() - set(dropped)), dropped


def enforce_dag(edges: DataFrame) -> DataFrame:
    """(graph, prereq, item, confidence, kept). Of a repeated pair the last confidence counts (by pos, if given).

    A walk never finds a cycle beyond a node that reaches none, and parts that no edge joins don't meet in it. So of a
    large graph only what leads to cycles is walked, each part by a task, with the same edges dropped.
    """
    order = "pos" if "pos" in edges.columns else "confidence"
    pairs = edges.groupBy("graph", "prereq", "item").agg(F.max_by("confidence", order).alias("confidence"))
    pairs = materialize(pairs.select(F.col("graph").cast("string").alias("graph"), F.col("prereq").cast("string").alias("prereq"), F.col("item").cast("string").alias("item"), F.col("confidence").cast("double").alias("confidence")))

    def run(key: tuple, rows: list[tuple]) -> list[tuple]:
        return [(key[0], *e) for e in acyclic({(p, i): c for p, i, c in rows})[1]]

    parts = cyclic_parts(pairs.select("graph", F.col("prereq").alias("src"), F.col("item").alias("dst"), "confidence"), both_ways=False)
    dropped = map_groups(parts, ["graph", "part"], run, "g string, p string, i string")
    met = F.col("graph").eqNullSafe(F.col("g")) & (F.col("prereq") == F.col("p")) & (F.col("item") == F.col("i"))
    return pairs.join(dropped, met, "left").select("graph", "prereq", "item", "confidence", (F.col("p").isNull() & (F.col("prereq") != F.col("item"))).alias("kept"))


def topological(ids: list[str], prereqs: dict[str, set[str]]) -> list[str]:
    """The smallest order: always the smallest item that is ready; in a cycle the smallest that is left."""
    waiting = {i: len(prereqs[i]) for i in ids}
    followers: dict[str, list[str]] = {i: [] for i in ids}
    for i in ids:
        for p in prereqs[i]:
            followers[p].append(i)
    ready = [i for i in ids if not waiting[i]]
    heapq.heapify(ready)
    rest = sorted(ids)
    out: list[str] = []
    done: set[str] = set()
    at = 0
    while len(out) < len(ids):
        while ready and ready[0] in done:
            heapq.heappop(ready)
        if ready:
            now = heapq.heappop(ready)
        else:
            while rest[at] in done:
                at += 1
            now = rest[at]
        done.add(now)
        out.append(now)
        for f in followers[now]:
            waiting[f] -= 1
            if waiting[f] == 0 and f not in done:
                heapq.heappush(ready, f)
    return out


def topo_order(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, id, rank): each graph's smallest topological order."""

    def run(key: tuple, rows: list[tuple]) -> list[tuple]:
        prereqs = {i: set(p) for i, p in rows}
        return [(*key, i, rank) for rank, i in enumerate(topological(sorted(prereqs), prereqs))]

    return map_groups(adjacency(items, edges), ["graph"], run, "graph string, id string, rank long")


def depth(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, id, depth): longest path from an item without prerequisites; a cycle raises.

    One pass in topological order over each graph, graphs spread over the cluster: one job whatever the depth.
    """

    def run(key: tuple, rows: list[tuple]) -> list[tuple]:
        prereqs = {i: set(p) for i, p in rows}
        levels: dict[str, int] = {}
        for i in topological(sorted(prereqs), prereqs):
            if not prereqs[i] <= levels.keys():
                raise ValueError("the graph has a cycle")
            levels[i] = 1 + max((levels[p] for p in prereqs[i]), default=-1)
        return [(*key, *level) for level in levels.items()]

    return map_groups(adjacency(items, edges), ["graph"], run, "graph string, id string, depth int")


def merge(items: DataFrame, edges: DataFrame, name: str = "book") -> tuple[DataFrame, DataFrame]:
    """One graph from all: ids become graph:id, provenance keeps the chapter, edges are distinct.

    An edge with an unknown end is an error of the input and raises when the result is used.
    """
    label = lambda c: F.concat_ws(":", "graph", c)
    merged = items.withColumn("id", label("id")).withColumn("chapter", F.col("graph"))
    ids = items.select("graph", F.col("id"), F.lit(True).alias("known"))
    checked = edges.join(ids.select("graph", F.col("id").alias("prereq"), F.col("known").alias("k1")), ["graph", "prereq"], "left")
    checked = checked.join(ids.select("graph", F.col("id").alias("item"), F.col("known").alias("k2")), ["graph", "item"], "left")
    sure = F.when(F.col("k1") & F.col("k2"), label("prereq")).otherwise(F.raise_error(F.concat(F.lit("edge with unknown item: "), F.concat_ws(" ", "graph", "prereq", "item"))).cast("string"))
    joined = checked.select(sure.alias("prereq"), label("item").alias("item")).distinct()
    return merged.withColumn("graph", F.lit(name)), joined.withColumn("graph", F.lit(name)).select("graph", "prereq", "item")
