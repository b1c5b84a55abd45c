import re

from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import blocks as B

SAMPLE = "# Title One\n\nThe Mean is a Central Tendency measure.\n \n\nSecond Paragraph: über Émile Straße 😀 Big Data.\n\n\n\nLast one\n\n"


def test_blocks_have_exact_spans(spark):
    rows = B.blocks(spark.createDataFrame([(1, SAMPLE), (2, "\n\n"), (3, None)], "doc_id long, text string")).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == ["c001", "c002", "c003", "c004"]
    assert all(SAMPLE[r.start : r.end] == r.text for r in rows) and rows[-1].text == "Last one"


def test_pages_continue_their_numbers(spark):
    pages = spark.createDataFrame([("d", 1, "a\n\nb"), ("d", 2, "c")], "doc_id string, page int, text string")
    rows = B.blocks(pages, page_col="page").orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.page) for r in rows] == [("c001", 1), ("c002", 1), ("c003", 2)]


def test_slugs(spark):
    labels = [("g", 1, "A b"), ("g", 2, "a-B!"), ("g", 3, "¡!"), ("h", 4, "A b")]
    got = B.unique_ids(spark.createDataFrame(labels, "g string, n int, label string"), "g", "n").orderBy("n")
    assert [r.id for r in got.collect()] == ["a-b", "a-b-2", "item", "a-b"]


def test_terms_against_a_plain_version(spark):
    stop = set(T.STOP_WORDS)
    texts = [SAMPLE, "The The Mean And The Big Data Set Of One-Two X Ab", "", "IS NASA Édition B5 C-3 Or"]

    def plain(text):
        out = []
        for m in re.finditer(r"\b[A-Z][A-Za-z0-9-]*(?:\s+[A-Z][A-Za-z0-9-]*){0,2}\b", text):
            w = m[0].split()
            while w and w[0].lower() in stop:
                del w[0]
            while w and w[-1].lower() in stop:
                del w[-1]
            if len(" ".join(w)) >= 3:
                out.append(" ".join(w))
        return out

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in df.select(T.terms(F.col("t")).alias("x")).collect()] == [plain(t) for t in texts]


def test_entities_and_neighbours(spark):
    blocks = spark.createDataFrame([(1, "c001", "Mean then Median then MEAN"), (1, "c002", "Median with Mode")], "doc_id long, chunk_id string, text string")
    terms = B.term_rows(blocks)
    ents = B.entities(terms)
    assert {(r.id, r.label, tuple(r.chunk_ids)) for r in ents.collect()} == {("mean", "Mean", ("c001",)), ("median", "Median", ("c001", "c002")), ("mode", "Mode", ("c002",))}
    assert {(r.src, r.dst, tuple(r.chunk_ids)) for r in B.cooccurrence(terms, ents).collect()} == {("mean", "median", ("c001",)), ("median", "mode", ("c002",))}


def test_gate_and_split(spark):
    rows = [("a", "ok", "x" * 20), ("b", "Mean", "short"), ("c", "Mean", "It is the average of all values."), ("d", "Mean", "No verb here at all, sadly"), ("e", "Mean", "Nothing whatsoever. It is the average. Use it."), ("f", None, None)]
    got = {r.id: r for r in B.gate_items(spark.createDataFrame(rows, "id string, label string, description string")).collect()}
    assert got["a"].reason == "label length 2 outside 3..120" and got["b"].reason == "description length 5 outside 10..2000"
    assert got["c"].decision == "accepted" and got["d"].decision == "dropped" and got["f"].decision == "dropped"
    assert got["e"].decision == "accepted"
    split = spark.createDataFrame([("g", "x" * 2000 + " is. It is the average.")], "id string, d string").select(T.split_item(F.col("id"), F.col("d")).alias("s")).first().s
    assert [c.id for c in split] == ["g-a", "g-b"] and split[1].description == "It is the average."


def test_coercions(spark):
    df = spark.createDataFrame([(" Apply ", "Factual", "3"), ("?", None, "9"), (None, "x", "2.7")], "a string, b string, c string")
    got = df.select(T.coerce_level(F.col("a")), T.coerce_knowledge(F.col("b")), T.coerce_depth(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("apply", "factual", 3), ("understand", "conceptual", 1), ("understand", "conceptual", 1)]


def test_responses_and_replies(spark):
    df = spark.createDataFrame([("5.0",), ("Mean",), ('["a", "b"]',)], "r string")
    assert [r.t for r in df.select(F.schema_of_variant(T.response_value(F.col("r"))).alias("t")).collect()] == ["DECIMAL(1,0)", "STRING", "ARRAY<STRING>"]
    fenced = spark.createDataFrame([('```json\n{"beats": []}\n```',), ("nope",)], "r string")
    assert [r.v is None for r in fenced.select(T.parse_reply(F.col("r")).alias("v")).collect()] == [False, True]


def test_relations_by_label(spark):
    named = spark.createDataFrame([("g", 1, "Mean"), ("g", 2, "MEAN"), ("g", 3, " Mode ")], "graph string, pos int, label string")
    rel = spark.createDataFrame([("g", 1, "mean", "r", "mode", "c1"), ("g", 2, "MEAN", "r", "Mode", "c2"), ("g", 3, "mean", "r", "Mean", "c1"), ("g", 4, "mean", "r", "zz", "c1")], "graph string, pos int, src_label string, rel string, dst_label string, chunk string")
    assert [tuple(r) for r in B.resolve_relations(named, rel).select("src", "dst", "chunk").collect()] == [("mean", "mode", "c1")]


def test_provenance_falls_back_to_the_first_block(spark):
    blocks = spark.createDataFrame([("d", "c001", 0, 0, 5), ("d", "c002", 0, 7, 9)], "doc_id string, chunk_id string, page int, start long, end long")
    items = spark.createDataFrame([("d", "i", "c002"), ("d", "j", "zz"), ("e", "k", "c001")], "doc_id string, id string, chunk_id string")
    got = {r.id: (r.chunk_id, r.start, r.end) for r in B.resolve_provenance(items, blocks).collect()}
    assert got == {"i": ("c002", 7, 9), "j": ("c001", 0, 5), "k": ("c001", 0, 0)}


def test_blocks_of_long_texts_keep_their_offsets(spark):
    n = 3 * B.RUN + 7
    lines = [f"line {i}" if i % 5 else "  " for i in range(n)]
    text = "\n".join(lines)
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    got = sorted((r.start, r.end, r.text) for r in B.blocks(docs, separator="\n").collect())
    at, want = 0, []
    for line in lines:
        if line.strip():
            want.append((at, at + len(line), line))
        at += len(line) + 1
    assert got == want


def test_pairs_number_their_own_entities(spark):
    """Forms that share a slug, terms in several chunks and documents: the same pairs as with the entities' table."""
    texts = [(1, "Alpha-beta and Alpha Beta met Gamma\nGamma met alpha, Alpha Beta and ALPHA-BETA"), (2, "Delta met Delta\nDelta met Alpha Beta"), (3, "nothing"), (None, "Delta met Gamma")]
    terms = B.term_rows(B.blocks(spark.createDataFrame(texts, "doc_id long, text string"), separator="\n"))
    rows = lambda df: sorted((r.doc_id, r.src, r.rel, r.dst, tuple(r.chunk_ids)) for r in df.collect())
    want = rows(B.cooccurrence(terms, B.entities(terms)))
    assert rows(B.cooccurrence(terms)) == rows(B.cooccurrence(terms, tasks=3)) == want
    assert {r[1] for r in want} >= {"alpha-beta", "alpha-beta-2"}
    assert B.cooccurrence(terms)._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 2  # blocks and terms are made once
