import json

import pytest
from pyspark.sql import functions as F

from loomspan.operators import drafts as D

KNOWN = "id string, label string, description string, dok int, chunk_id string"
BLOCKS = "doc_id string, chunk_id string, page int, start long, end long"


def _counted(spark, rows):
    """Replies whose texts are counted as they are made."""
    made = spark.sparkContext.accumulator(0)

    def make(text):
        made.add(1)
        return text

    return spark.createDataFrame(rows, "doc_id string, raw string").select("doc_id", F.udf(make, "string")("raw").alias("text")), made


def _reply(k):
    beats = [{"id": "b", "teaches": ["zz", "i2", "i1", "i2"], "choices": [{"label": "x", "to": "b"}, {"label": "y", "to": "no"}], "checks": ["c", "no"]}, {"id": "b"}, {"id": "d"}, None]
    checks = [{"id": "c", "kind": "choice", "item_id": "i1"}, {"id": "c", "item_id": "i1"}, {"id": "e", "item_id": "zz"}]
    entities = [{"label": "One"}, {"label": "one"}, {"label": " "}, {"label": "Two"}]
    relations = [{"src": "ONE", "dst": "two", "chunk_ids": ["c2"]}, {"src": "one", "dst": "Two", "chunk_ids": ["c1"]}, {"src": "", "dst": "two"}, {"src": "none", "dst": "two"}]
    return json.dumps({"beats": beats, "checks": checks, "entities": entities, "relations": relations, "items": [{"label": f"item {k}"}]})


@pytest.mark.parametrize("part", ["beats", "losses", "entities", "relations", "items"])
def test_each_reply_is_made_and_parsed_once(spark, part):
    n = 40
    replies, made = _counted(spark, [(f"r{k}", _reply(k)) for k in range(n)])
    blocks = spark.createDataFrame([("r0", "c1", 1, 0, 5), ("r0", "c2", 1, 6, 9)], BLOCKS)
    known = spark.createDataFrame([("i1", "l", "d", 1, "c1"), ("i2", "m", "e", 2, "c1")], KNOWN)
    if part in ("beats", "losses"):
        out = D.story(replies, known)[0 if part == "beats" else 2]
    else:
        out = getattr(D, part)(replies, blocks)
    rows = out.collect()
    assert made.value == n
    if part == "beats":
        assert {r.cluster for r in rows} == {f"r{k}" for k in range(n)}
        assert {(r.pos, r.id, *r.teaches, r.anchor, r.difficulty, r.title, len(r.choices), *r.checks) for r in rows} == {(0, "b", "i2", "i1", "i2", "i2", 2, "m", 1, "c")}
    elif part == "losses":
        assert {r.what: r.n for r in rows} == {k: n for k in ("beat: duplicate id", "beat: unknown item", "check: duplicate id", "check: unknown item", "dangling choice", "unknown check")}
    elif part == "relations":
        assert {(r.src, r.rel, r.dst) for r in rows} == {("one", "related_to", "two")} and len(rows) == n
        assert {r.doc_id: r.chunk_ids for r in rows}["r0"] == ["c2"]
    else:
        assert len(rows) == n * (3 if part == "entities" else 1)


def test_what_is_no_object_gives_no_rows(spark):
    texts = ["{}", '[{"items": []}]', '"items"', "null", "", "no", ' \n{"items": []}', '```json\n{"items": []}\n```', None]
    replies = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "doc_id string, text string")
    assert sorted(r.doc_id for r in D.parsed(replies, D.ITEMS).collect()) == ["0", "6", "7"]
