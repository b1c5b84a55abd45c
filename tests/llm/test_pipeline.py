import hashlib
import os
import random

import duckdb
import pytest
from llm_cases import CLASHES, SCHEMA, prose
from test_exact_and_near import normal
from test_native import water_level
from test_near_copies import plain_kept

import __spark_entry__ as entry
import corpus_pipeline as P
from loomspan.llm import toxicity
from loomspan.llm.queries import ORACLE_SQL, PIECES, QUERIES

SF = "/root/testdata/sf0.001"
needs_model = pytest.mark.skipif(not os.path.exists(PIECES), reason="needs the public tokenizer files")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with copies, near copies, insults, nulls and repeated rows."""
    rng = random.Random(12)
    rows, labels = [], []
    for t in prose(21, 260):
        i = len(rows)
        words = (t + " " + prose(500 + i, 1)[0]).split()
        toxic = i % 7 == 0
        if toxic:
            for w in ("scum", "idiot", "worthless"):
                words.insert(rng.randrange(len(words)), w)
        text = " ".join(words)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        if i % 4:
            labels.append((i, 1, int(toxic)))
        if i % 9 == 1:
            rows.append((len(rows), text.upper(), "en", "s1", len(text)))
        if i % 11 == 1:
            changed = " ".join([*words[:-1], "other"])
            rows.append((len(rows), changed, "en", "s2", len(changed)))
    rows += [(len(rows), None, None, None, None), (len(rows) + 1, "", "en", "s0", 0), rows[5], (None, "nobody knows this one text", "en", "s0", 26)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def _copies(kept):
    """How often the mix emits each row, by a plain walk in the seeded order."""
    sizes, place = {}, {}
    for n, (i, t, _, s, _) in enumerate(kept):
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
        name = f"{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}"
        place[n] = hashlib.md5(f"42:{name}".encode()).hexdigest()
    order = sorted((s for s in sizes if s is not None), key=str.encode) + [s for s in sizes if s is None]
    targets = water_level(dict(sizes), {s: k % 3 + 1 for k, s in enumerate(order)}, 3)
    out = {}
    for s, total in sizes.items():
        whole = int(targets[s] // total) if total else 0
        left = int(targets[s] - whole * total + 0.5)
        for n in sorted((n for n, r in enumerate(kept) if r[3] == s), key=lambda n: place[n]):
            size = len((kept[n][1] or "").split())
            part = max(0, min(size, left))
            left -= part
            out[n] = whole + (part > 0 and 2 * part >= size)
    return out


@needs_model
def test_against_brute_force(spark, folder):
    import sentencepiece

    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    score = toxicity._Scorer(toxicity.fit_toxicity(docs, spark.read.parquet(f"{path}/labels.parquet")))
    clean = [r for r in rows if score([r[1]])[0] < toxicity.THRESHOLD]
    assert sum(r[1] is not None and "scum" in r[1].lower() for r in clean) <= 2 < len(rows) - len(clean)

    best = {}
    for n, r in enumerate(clean):
        key = normal(r[1])
        if key not in best or (r[0] if r[0] is not None else -1) > (clean[best[key]][0] if clean[best[key]][0] is not None else -1):
            best[key] = n
    exact = [clean[n] for n in sorted(best.values())]

    near = [exact[n] for n in sorted(plain_kept(exact))]
    assert len(near) < len(exact) < len(clean)

    copies = _copies(near)
    emitted = [near[n] for n, k in copies.items() for _ in range(k)]
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = P.run(spark, path).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(r[0]), len(reference.encode(r[1] or ""))) for r in emitted)
    assert all(r.round_trip for r in got)


@needs_model
def test_stages_keep_all_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name in CLASHES:
        docs = docs.selectExpr("*", f"1 as {name}")
    path = folder[0]
    for name, stage in P.STAGES[:-1]:
        docs.write.mode("overwrite").parquet(f"{path}/stage")
        out = stage(spark, spark.read.parquet(f"{path}/stage"), path)
        assert out.columns == docs.columns, name
        rows = out.collect()
        docs = spark.createDataFrame(rows, docs.schema)
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    empty.write.mode("overwrite").parquet(f"{path}/stage")
    for _, stage in P.STAGES:
        assert stage(spark, spark.read.parquet(f"{path}/stage"), path).collect() == []


def test_registered():
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "sentencepiece"]
    assert "pipeline" in entry.queries() and set(QUERIES) <= set(entry.queries())
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = c.execute(ORACLE_SQL[name])
    at = [[d[0] for d in got.description].index(x) for x in columns]
    short = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    want = sorted(repr(tuple(short(r[i]) for i in at)) for r in got.fetchall())
    assert sorted(repr(tuple(short(r[c]) for c in columns)) for r in df.collect()) == want
