"""Whole runs: texts to graphs, graphs to stories, stories to sessions, and their chains."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.functions.replay import Learner, grade
from loomspan.operators import blocks as B
from loomspan.operators import drafts as D
from loomspan.operators import graph as G
from loomspan.operators import story as S
from loomspan.operators.cassette import BudgetExhausted, CassetteExhausted, TextModel
from loomspan.operators.quest import Story, run_quest
from loomspan.plans.storage import materialize
from loomspan.sources import readers, writers

# Limits of a run.
MAX_ITEMS, HARD_LIMIT, DEGRADED_ITEMS = 300, 2000, 10
EXTRACT, ANALYZE, STORY = "EXTRACT", "ANALYZE", "STORY"


def now() -> str:
    """The time of a run, for metadata only."""
    return datetime.now(UTC).isoformat(timespec="seconds")


@dataclass
class Broken:
    """A text broken into its graph: tables of one or many documents, keyed by doc_id or graph."""

    blocks: DataFrame
    entities: DataFrame
    relations: DataFrame
    items: DataFrame
    competences: DataFrame | None
    log: DataFrame
    edges: DataFrame
    degraded: list[str]


def _replies(spark: SparkSession, model: TextModel | None, role: str, prompts: DataFrame, budget: int | None, degraded: list[str], stage: str) -> DataFrame | None:
    """The model's replies (doc_id, text) to prompts (doc_id, prompt); None without a model, a reply or the budget.

    A model is asked on the driver, once per document: with a model, documents are few and prompts bounded.
    """
    if model is None:
        return None
    out = []
    for r in prompts.orderBy("doc_id").collect():
        try:
            out.append((r.doc_id, model.complete(role, r.prompt, budget)["text"]))
        except BudgetExhausted:
            degraded.append(stage)
            return None
        except CassetteExhausted:
            return None
    return spark.createDataFrame(out, f"doc_id {prompts.schema['doc_id'].dataType.simpleString()}, text string") if out else None


def _or_rules(drafted: DataFrame | None, answered: DataFrame | None, rules: DataFrame) -> DataFrame:
    """Drafted rows of the documents whose reply was an object, the rules' rows of all others."""
    if drafted is None:
        return rules
    return drafted.unionByName(rules.join(answered.select("doc_id").distinct(), "doc_id", "left_anti"), allowMissingColumns=True)


def break_texts(spark: SparkSession, texts: DataFrame, *, max_items: int = MAX_ITEMS, model: TextModel | None = None, budget: int | None = None) -> Broken:
    """Documents (doc_id, text) to blocks, entities, relations, gated items and edges, all documents at once.

    A model, if given, is asked for entities and relations, then for items, then for edges; where it gives no JSON
    object the rules stand in. Past its budget it is not asked again, and each graph keeps DEGRADED_ITEMS items.
    """
    if isinstance(max_items, bool) or not isinstance(max_items, int) or not 1 <= max_items <= HARD_LIMIT:
        raise ValueError(f"max_items must be an integer from 1 to {HARD_LIMIT}")
    degraded: list[str] = []
    blocks = materialize(B.blocks(texts, page_col="page" if "page" in texts.columns else None))
    if model is not None and blocks.isEmpty():
        model = None  # nothing to ask about
    terms = B.term_rows(blocks)
    ask = lambda role, prompts, stage: _replies(spark, model, role, prompts, budget, degraded, stage)

    extracted = ask(EXTRACT, _extract_prompts(blocks), "extract")
    ruled = B.entities(terms)
    answered = D.parsed(extracted, D.ENTITIES) if extracted is not None else None
    entities = materialize(_or_rules(D.entities(extracted, blocks) if extracted is not None else None, answered, ruled))
    relations = _or_rules(D.relations(extracted, blocks) if extracted is not None else None, answered, B.cooccurrence(terms, ruled))

    listed = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "label", "type"))).alias("e"))
    itemized = ask(ANALYZE, listed.select("doc_id", T.prompt("Turn these entities into atomic items as JSON.", F.col("e")).alias("prompt")), "itemize")
    answered = D.parsed(itemized, D.ITEMS) if itemized is not None else None
    candidates = _or_rules(D.items(itemized, blocks) if itemized is not None else None, answered, B.rule_items(entities, blocks))
    competences = D.competences(itemized) if itemized is not None else None

    gated = B.gate_items(candidates)
    children = F.when(F.col("decision") == "accepted", F.array(F.struct("id", "description"))).otherwise(F.col("children"))
    own = ("label", "bloom", "knowledge_type", "dok", "assessment_criteria", "tags", "chunk_id", "page", "start", "end")
    kept = gated.select(F.col("doc_id").cast("string").alias("graph"), F.explode(children).alias("c"), *own)
    kept = kept.select("graph", "c.id", "c.description", *own[:6], F.struct("chunk_id", "page", "start", "end").alias("provenance"))
    capped = B.cap_items(kept, "graph", min(max_items, DEGRADED_ITEMS) if degraded else max_items)
    items = materialize(capped.filter("kept").drop("kept"))
    over = capped.filter("not kept").select(F.col("graph").alias("doc_id"), "id", F.lit("dropped").alias("decision"), F.lit("over the item cap").alias("reason"))
    log = gated.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("id").cast("string").alias("id"), "decision", "reason").unionByName(over)

    pairs = items.groupBy(F.col("graph").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("id", "label"))).alias("i"))
    proposed = ask(ANALYZE, pairs.select("doc_id", T.prompt("Which items come before which? Answer as JSON.", F.col("i")).alias("prompt")), "edges")
    edges = spark.createDataFrame([], "graph string, prereq string, item string")
    if proposed is not None:
        edges = G.enforce_dag(G.resolve_edges(items.withColumn("pos", F.col("id")), D.edges(proposed))).filter("kept").select("graph", "prereq", "item")
    return Broken(blocks, entities, relations, items, competences, log, edges, degraded)


def _extract_prompts(blocks: DataFrame) -> DataFrame:
    rows = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("b"))
    return rows.select("doc_id", T.prompt("List the entities and relations of these blocks as JSON.", F.col("b")).alias("prompt"))


def break_file(spark: SparkSession, path: str, outdir: str, **options) -> dict:
    """One text file to its graph document and report; returns the counts."""
    b = break_texts(spark, readers.read_texts(spark, path), **options)
    document, counts = graph_document(b, os.path.splitext(os.path.basename(path))[0])
    document["metadata"] |= {"sources": [path], "changes": [f"{now()} broken into {counts['items']} items"]}
    writers.write_document(document, os.path.join(outdir, "graph_v1.json"))
    writers.write_report([f"# {path}", *(f"- {k}: {v}" for k, v in counts.items())], os.path.join(outdir, "report.md"))
    return counts


def graph_document(b: Broken, chapter: str) -> tuple[dict, dict]:
    """One graph as a document, its states by tag where they overflow."""
    space = materialize(G.spaces(b.items, b.edges))
    first = G.fringe(b.items.select("graph").distinct().withColumn("state", F.array().cast("array<string>")), b.items, b.edges)
    items = [json.loads(r[0]) for r in b.items.orderBy("id").select(F.to_json(F.struct("*"))).collect()]
    for i in items:
        p = i["provenance"]
        i["provenance"] = {"chunk_id": p["chunk_id"], "page": p["page"], "span": [p["start"], p["end"]]}
        i.pop("graph")
    edges = sorted([r.prereq, r.item] for r in b.edges.collect())
    states = [r.state for r in space.orderBy("part", "ordinal").select("state").collect()]
    fringe = sorted(r.id for r in first.collect())
    overflow = not space.filter("part is not null").isEmpty()
    decisions = {r.decision: r["count"] for r in b.log.groupBy("decision").count().collect()}
    skills = sorted(([r.id, r.label, r.type] for r in b.competences.collect()) if b.competences is not None else [])
    metadata = {"chapter": chapter, "version": "1", "degraded_stages": b.degraded, "overflow": overflow}
    counts = {"blocks": b.blocks.count(), "entities": b.entities.count(), "relations": b.relations.count(), "items": len(items), "competences": len(skills), "edges": len(edges), "states": len(states), "fringe": len(fringe), "overflow": overflow}
    return {"metadata": metadata, "items": items, "competences": [dict(zip(("id", "label", "type"), c, strict=True)) for c in skills], "surmise": edges, "states": states, "fringe_cache": {"": fringe}}, counts | {f"items_{k}": v for k, v in decisions.items()}


def graph_tables(spark: SparkSession, documents: dict[str, dict]) -> tuple[DataFrame, DataFrame]:
    """Item and edge tables of graph documents by name."""
    def item(g: str, i: dict) -> tuple:
        return (g, i["id"], i.get("label") or i["id"], i.get("description") or "", i.get("dok") or 1, i.get("assessment_criteria") or "", list(i.get("tags") or []), (i.get("provenance") or {}).get("chunk_id") or "c001")

    items = [item(g, i) for g, d in documents.items() for i in d["items"]]
    edges = [(g, p, i) for g, d in documents.items() for p, i in d["surmise"]]
    kind = "graph string, id string, label string, description string, dok int, assessment_criteria string, tags array<string>, chunk_id string"
    return spark.createDataFrame(items, kind), spark.createDataFrame(edges, "graph string, prereq string, item string")


def merge_documents(spark: SparkSession, documents: dict[str, dict], name: str = "book") -> tuple[dict, dict]:
    """Chapters to one graph document, with states and fringe of the whole."""
    items, edges = graph_tables(spark, documents)
    merged, joined = G.merge(items, edges, name)
    space = materialize(G.spaces(merged, joined))
    order = {g: n for n, g in enumerate(documents)}
    rows = sorted(merged.collect(), key=lambda r: (order[r.chapter], r.id))
    out = [{"id": r.id, "label": r.label, "description": r.description, "dok": r.dok, "assessment_criteria": r.assessment_criteria, "tags": r.tags, "provenance": {"chunk_id": r.chunk_id, "chapter": r.chapter}} for r in rows]
    pairs = sorted([r.prereq, r.item] for r in joined.collect())
    blank = merged.select("graph").distinct().withColumn("state", F.array().cast("array<string>"))
    fringe = sorted(r.id for r in G.fringe(blank, merged, joined).collect())
    states = [r.state for r in space.orderBy("part", "ordinal").select("state").collect()]
    overflow = not space.filter("part is not null").isEmpty()
    # lists of all chapters one after the other, and the merge as the last change
    sources, changes = ([x for d in documents.values() for x in (d.get("metadata") or {}).get(k) or []] for k in ("sources", "changes"))
    metadata = {"chapter": name, "chapters": list(documents), "version": "1", "overflow": overflow, "sources": sources, "changes": [*changes, f"{now()} merged {len(documents)} chapters"]}
    document = {"metadata": metadata, "items": out, "surmise": pairs, "states": states, "fringe_cache": {"": fringe}}
    return document, {"chapters": len(documents), "items": len(out), "edges": len(pairs), "states": len(states), "fringe": len(fringe), "overflow": overflow}


def author_story(spark: SparkSession, document: dict, model: TextModel | None = None, budget: int | None = None) -> dict:
    """A graph document to a story document.

    For each cluster a model, if given, drafts beats and checks, which are grounded in the items and pruned; clusters
    without a draft get one chain of beats with a choice check each. Past the budget no further cluster is written.
    """
    lacking = [i["id"] for i in document["items"] if any(not i.get(k) for k in ("label", "description", "assessment_criteria"))]
    if lacking:
        raise ValueError(f"items lack required fields: {', '.join(sorted(lacking)[:5])}")
    items, edges = graph_tables(spark, {"g": document})
    names = [r.cluster for r in S.clusters(items).select("cluster").distinct().orderBy("cluster").collect()]
    drafted, stopped = [], None
    for name in names if model is not None else []:
        own = S.clusters(items).filter(F.col("cluster") == name)
        ask = json.dumps({"cluster": name, "items": [[r.id, r.label, r.description] for r in own.orderBy("id").collect()]})
        try:
            drafted.append((name, model.complete(STORY, ask, budget)["text"]))
        except BudgetExhausted:
            stopped = name
            break
        except CassetteExhausted:
            break
    replies = spark.createDataFrame(drafted, "doc_id string, text string")
    good = {r.doc_id for r in D.parsed(replies, D.STORY).select("doc_id").collect()}
    ruled = [n for n in names if n not in good and (stopped is None or n < stopped)]
    c = S.chains(items, edges).filter(F.col("cluster").isin(ruled)).join(items.select("graph", F.col("id").alias("item"), "description", "assessment_criteria", "chunk_id"), ["graph", "item"])
    rows = c.orderBy("cluster", "rank").collect()
    beats = [
        {"id": r.beat, "title": f"{r.cluster.title()} Quest: {r.label}", "text": r.description, "choices": [{"label": "Continue", "to": r.next}] if r.next else [], "requires": r.requires,
         "teaches": [r.item], "checks": [r.check], "difficulty": r.dok, "provenance": {"item_id": r.item, "chunk_id": r.chunk_id}}
        for r in rows
    ]
    checks = [{"id": r.check, "kind": "choice", "prompt": r.assessment_criteria, "payload": {"options": r.options, "answer": r.label}, "item_id": r.item, "max_score": 1} for r in rows]
    pruned: dict[str, int] = {}
    if good:
        own, made, lost = D.story(replies, items)
        known = {i["id"] for i in document["items"]}
        for r in own.orderBy("cluster", "pos").collect():
            choices = [{"label": x.label or "Continue", "to": x.to} for x in r.choices]
            beats.append({"id": r.id, "title": r.title, "text": r.text, "choices": choices, "requires": [i for i in r.requires if i in known], "teaches": r.teaches, "checks": r.checks, "difficulty": r.difficulty, "provenance": {"item_id": r.anchor, "chunk_id": r.chunk_id}})
        checks += [{"id": r.id, "kind": r.kind, "prompt": r.prompt or "", "payload": json.loads(r.payload or "{}"), "item_id": r.item_id, "max_score": r.max_score} for r in made.orderBy("cluster", "id").collect()]
        pruned = {r.what: r.n for r in lost.collect()}
    metadata = {"source": document["metadata"].get("chapter", "v1"), "clusters": len(names), "drafted": len(good), "ruled": len(ruled), "stopped_on_budget": stopped is not None, "pruned": sum(pruned.values())}
    return {"beats": beats, "checks": checks, "metadata": {k: str(v) for k, v in metadata.items()}}


def story_issues(spark: SparkSession, story: dict) -> list[tuple[str, str]]:
    """Issues of one story document."""
    for b in story["beats"]:
        if missing := [k for k in S.BEAT_KEYS if k not in b]:
            return [("missing key", f"{b.get('id')}: {missing[0]}")]
    beats = spark.createDataFrame([("g", b["id"]) for b in story["beats"]], "graph string, id string")
    checks = spark.createDataFrame([("g", c["id"], c.get("kind")) for c in story["checks"]], "graph string, id string, kind string")
    choices = spark.createDataFrame([("g", b["id"], c["to"]) for b in story["beats"] for c in b["choices"]], "graph string, src string, dst string")
    refs = spark.createDataFrame([("g", b["id"], c) for b in story["beats"] for c in b["checks"]], "graph string, beat string, check string")
    return sorted((r.issue, r.subject) for r in S.validate(beats, checks, choices, refs).collect())


def play_attempts(story: dict, attempts: list[dict], learner: Learner | None = None, max_retries: int = 1) -> Learner:
    """Scripted attempts over a story, one learner; unknown beats and checks are refused before anything counts."""
    beats, checks = {b["id"]: b for b in story["beats"]}, {c["id"]: c for c in story["checks"]}
    for n, a in enumerate(attempts):
        if a["beat_id"] not in beats or a["check_id"] not in checks:
            raise ValueError(f"attempt {n}: unknown beat or check")
        if a["check_id"] not in beats[a["beat_id"]]["checks"]:
            raise ValueError(f"attempt {n}: the check is not on the beat")
    learner = learner or Learner()
    for a in attempts:
        check = checks[a["check_id"]]
        learner.attempt(a["beat_id"], check["id"], check["item_id"], *grade(check, a["response"]), max_retries)
    return learner


def play_quest(story: dict, document: dict, responses: list, learner: Learner | None = None, max_retries: int = 1, max_steps: int = 1000) -> tuple[dict, Learner]:
    """The adaptive quest of one learner; (session, state)."""
    learner = learner or Learner()
    s = Story.of(story["beats"], story["checks"], [i["id"] for i in document["items"]], [tuple(e) for e in document["surmise"]])
    reason, transcript = run_quest(s, learner, responses, max_retries, max_steps)
    return learner.summary() | {"transcript": transcript, "completion": {"reason": reason, "picks": learner.picks, "visited": len(learner.visited)}}, learner


def _sound(spark: SparkSession, story: dict) -> None:
    if issues := story_issues(spark, story):
        raise ValueError(f"invalid story: {issues[0]}")


def author(spark: SparkSession, document: dict, outdir: str, model: TextModel | None = None, budget: int | None = None) -> dict:
    """A graph document to a checked story document and its report."""
    story = author_story(spark, document, model, budget)
    _sound(spark, story)
    writers.write_document(story, os.path.join(outdir, "beats.json"))
    counts = {"beats": len(story["beats"]), "checks": len(story["checks"]), "tokens": model.total_tokens if model else 0} | story["metadata"]
    writers.write_report(["# Story", *(f"- {k}: {v}" for k, v in counts.items())], os.path.join(outdir, "report.md"))
    return story


def merge_files(spark: SparkSession, documents: dict[str, dict], outdir: str) -> dict:
    """Chapters to one graph document and its report; returns the counts."""
    document, counts = merge_documents(spark, documents)
    writers.write_document(document, os.path.join(outdir, "book.json"))
    writers.write_report([f"# Merge of {', '.join(documents)}", *(f"- {k}: {v}" for k, v in counts.items())], os.path.join(outdir, "report.md"))
    return counts


def _record(title: str, session: dict, learner: Learner, outdir: str, actor: str, resumed: bool, save: str | None) -> dict:
    """Session, statements, report and state of a run; a resumed run goes on in the store and the report."""
    session["stored"] = writers.write_told(learner.told or [], os.path.join(outdir, "xapi.jsonl"), actor, resumed)
    writers.write_document(session, os.path.join(outdir, "session.json"))
    shown = {"visited": len(session["beats_visited"])} | {k: v for k, v in session.items() if isinstance(v, (int, float))}
    if done := session.get("completion"):
        shown |= {"reason": done["reason"], "picks": done["picks"]}
    writers.write_report([f"# {title}", *(f"- {k}: {v}" for k, v in shown.items())], os.path.join(outdir, "report.md"), resumed)
    if save:
        writers.save_state(learner, save)
    return session


def _learner(resume: str | None) -> Learner:
    learner = writers.load_state(resume) if resume else Learner()
    learner.told = []
    return learner


def play(spark: SparkSession, story: dict, attempts: list[dict], outdir: str, *, actor: str = "learner", resume: str | None = None, save: str | None = None, max_retries: int = 1) -> dict:
    """Scripted attempts over a checked story, with statement store, session, report and, if wanted, state."""
    _sound(spark, story)
    learner = play_attempts(story, attempts, _learner(resume), max_retries)
    return _record("Session", learner.summary(), learner, outdir, actor, bool(resume), save)


def quest(spark: SparkSession, story: dict, document: dict, responses: list, outdir: str, *, actor: str = "learner", resume: str | None = None, save: str | None = None, **options) -> dict:
    """The adaptive quest over a checked story, with the same artefacts."""
    _sound(spark, story)
    session, learner = play_quest(story, document, responses, _learner(resume), **options)
    return _record("Quest", session, learner, outdir, actor, bool(resume), save)


def book_quest(spark: SparkSession, documents: dict[str, dict], responses: list, outdir: str, **options) -> dict:
    """Chapters to merged graph, story and quest; writes all artefacts."""
    if empty := [n for n, d in documents.items() if not d["items"]]:
        raise ValueError(f"chapter without items: {empty[0]}")
    merged, counts = merge_documents(spark, documents)
    story = author_story(spark, merged)
    for name, document in (("book.json", merged), ("beats.json", story)):
        writers.write_document(document, os.path.join(outdir, name))
    session = quest(spark, story, merged, responses, outdir, save=os.path.join(outdir, "state.json"), **options)
    writers.write_report([f"# Book of {counts['chapters']} chapters", *(f"- {k}: {v}" for k, v in counts.items()), f"- quest: {session['completion']['reason']}, {session['xp']} xp"], os.path.join(outdir, "report.md"), True)
    return session


def full_chain(spark: SparkSession, paths: list[str], responses: list, outdir: str, max_items: int = MAX_ITEMS, model: TextModel | None = None, budget: int | None = None, **options) -> dict:
    """Raw texts to a played quest."""
    documents, counts = {}, {}
    for path in paths:
        name = os.path.splitext(os.path.basename(path))[0]
        if name in documents:
            raise ValueError(f"two chapters are called {name}")
        counts[name] = break_file(spark, path, os.path.join(outdir, name), max_items=max_items, model=model, budget=budget)
        with open(os.path.join(outdir, name, "graph_v1.json"), encoding="utf-8") as f:
            documents[name] = json.load(f)
    session = book_quest(spark, documents, responses, outdir, **options)
    total = {k: sum(c[k] for c in counts.values()) for k in ("blocks", "entities", "items", "edges")}
    lines = ["# Chain", *(f"- {n}: {c['blocks']} blocks, {c['entities']} entities, {c['items']} items" for n, c in counts.items()), f"- all: {total}"]
    writers.write_report(lines, os.path.join(outdir, "report.md"), True)
    return session


def parsed(responses: list[str]) -> list:
    """Response lines as values: JSON literals, or else the raw strings; blank lines are skipped."""
    out = []
    for line in responses:
        if line.strip():
            try:
                out.append(json.loads(line))
            except ValueError:
                out.append(line.strip())
    return out


def coverage(broken: Broken) -> DataFrame:
    """Blocks, entities and items by document, with a total row: the report of a chain."""
    parts = [(broken.blocks, "doc_id", "blocks"), (broken.entities, "doc_id", "entities"), (broken.items, "graph", "items")]
    out = None
    for table, key, name in parts:
        n = table.groupBy(F.col(key).cast("string").alias("doc")).agg(F.count("*").alias(name))
        out = n if out is None else out.join(n, "doc", "left")
    return out.rollup("doc").agg(*(F.sum(name).alias(name) for _, _, name in parts))
