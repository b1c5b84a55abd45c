"""Mixing, secret scans and sharding: DataFrame operators without Python on the executors."""

import hashlib
import random
import re

import pytest
from llm_cases import awkward, clashing, frame, prose
from pyspark.sql import functions as F

from loomspan.llm import mixing, secrets, sharding


def water_level(sizes, weights, cap):
    """Targets by clamping one source after another until none is above its cap."""
    total, targets, open_ = sum(sizes.values()), {}, dict(sizes)
    left = total
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return targets | share
        for s in over:
            targets[s] = float(cap * sizes.pop(s, 0) if s in sizes else 0)
            left -= targets[s]
            del open_[s]
    return targets


def _mix_rows(seed):
    rng = random.Random(seed)
    names = [None, "", "b", "a", "ä", "B", "zz"]
    return [(i, "w " * rng.randrange(0, 30 if s != "a" else 3), "en", s, 1) for i in range(400) for s in [rng.choice(names if seed else ["a", "b"])]]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_mixing(spark, seed):
    rows = _mix_rows(seed)
    got = {r.doc_id: r for r in mixing.mix_sources(frame(spark, rows)).collect()}
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weights = {s: n % 3 + 1 for n, s in enumerate(order)}
    targets = water_level(dict(sizes), weights, 3)
    taken = {}
    for i, t, _, s, _ in rows:
        r = got[i]
        assert (r.size, r.source_size) == (len(t.split()), sizes[s]) and r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - targets[s]) <= 0.5 + 1e-6 for s in sizes)
    again = {r.doc_id: r.taken for r in mixing.mix_sources(frame(spark, rows).repartition(5)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_mixing_spreads_an_id_that_most_rows_bear(spark):
    rows = [(1, f"word {n} of this row", "en", "a", 1) for n in range(3000)] + [(2, "x " * 9000, "en", "b", 1)]
    docs = frame(spark, rows)
    cells = docs.select(F.substring(mixing.seeded_order(F.col("doc_id"), F.col("text"), 42), 1, mixing.CELL_DIGITS).alias("cell")).groupBy("cell").count()
    assert cells.agg(F.max("count")).first()[0] < 20
    got = mixing.mix_sources(docs).agg(F.sum("taken")).first()[0]
    assert abs(got - mixing.mix_sources(docs).select("source_size", "target").distinct().agg(F.sum("target")).first()[0]) <= 1


def test_shards_of_repeated_ids_under_other_splits(spark, tmp_path):
    frame(spark, [(1, "same text" * 5, "en", "s", 1)] * 60 + [(2, "other", "en", "s", 1)] * 20).repartition(5).write.parquet(f"{tmp_path}/d")
    cores, found = "spark.sql.leafNodeDefaultParallelism", []
    try:
        for n in ("2", "7"):
            spark.conf.set(cores, n)
            found.append(sorted((r.doc_id, r.shard, r.shard_bytes) for r in sharding.shard_documents(spark.read.parquet(f"{tmp_path}/d"), limit=200).collect()))
    finally:
        spark.conf.unset(cores)
    assert found[0] == found[1]


def test_mixing_awkward_rows(spark):
    got = mixing.mix_sources(clashing(spark)).collect()
    assert len(got) == len(awkward())
    assert sorted(r.size for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in awkward())
    assert mixing.mix_sources(frame(spark, [])).collect() == []
    blank = mixing.mix_sources(frame(spark, [(1, None, "en", "s", 0), (2, "", "en", "t", 0)])).collect()
    assert {(r.taken, r.target) for r in blank} == {(0, 0.0)}


BASE = {
    "assign": re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            if (kind == "assign" and len(m[1]) >= 12) or (kind == "access" and len(m[0]) >= 18) or (kind == "hex" and len(m[0]) >= 16):
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def _secret_texts():
    rng = random.Random(6)
    parts = ["token", "TOKEN=", "api_key", "Api-Key:", "apikey", ": ", "= '", '"', "secret", "passwd", "password=", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "deadbeef", "é😀", " ", "\n", "abcdefghijklm", "==", "ſecret=", "pwd = ", "Zx9Zx9Zx9Zx9Zx9Zx9Zx9"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(300)] + [r[1] for r in awkward()]


def test_secret_spans(spark):
    texts = _secret_texts()
    rows = [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(texts)]
    scanned = secrets.scan_secrets(frame(spark, rows))
    got = {r.doc_id: r for r in secrets.digest_columns(scanned).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t)
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), t
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(w[3] == k for w in want) for k in BASE]
        spans = [tuple(x.rsplit(":", 2)) for x in got[i].spans.split(",") if x]
        assert {(k, int(a), int(b)) for k, a, b in spans} >= {(k, a, b) for a, _, b, k in want}
        assert [int(a) for _, a, _ in spans] == sorted(int(a) for _, a, _ in spans)


def test_ownership_tells_examples_from_live_keys(spark):
    rows = [(i, "token = EXAMPLEEXAMPLE99 and bearer: CopiedCopied77", "en", f"s{i}", 1) for i in range(6)]
    rows += [(10, "token = OnlyOursOnlyOurs1 and bearer: OwnOwnOwn55", "en", "s1", 1), (11, "token = OnlyOursOnlyOurs1", "en", "s1", 1)]
    got = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, rows)).collect()}
    assert (got[0].n_example, got[0].n_live, got[0].added, got[0].most_owners, got[0].most_repos) == (1, 0, [], 6, 6)
    assert (got[10].n_example, got[10].n_live, len(got[10].added), got[10].most_owners, got[10].most_repos) == (0, 1, 1, 1, 2)


def test_ownership_counts_repeated_rows_and_nulls_once(spark, tmp_path):
    """Documents 1, 1, 2, 3 under owners a, b, null, c: four owners, three repositories, in the SQL too."""
    import duckdb

    from loomspan.llm.queries import ORACLE_SQL

    held = "token = SharedShared1234 and pwd = SharedShared1234"
    rows = [(1, held, "en", "a", 1), (1, held, "en", "b", 1), (2, held, "en", None, 1), (3, held, "en", "c", 1)]
    rows += [(4 + i, "bearer = CopiedWithin12", "en", "d", 1) for i in range(21)] + [(30, "bearer = Ours1234 \u00e9 ABCDEFGHabcdefgh12345678", "en", "d", 1)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = secrets.digest_columns(secrets.scan_secrets(spark.read.parquet(f"{tmp_path}/documents.parquet")))
    got = found.collect()
    assert {(r.most_owners, r.most_repos, r.n_example, r.n_live, r.spans.count(",")) for r in got if r.doc_id < 4} == {(4, 3, 1, 0, 0)}
    assert {(r.most_owners, r.most_repos, r.spans) for r in got if 4 <= r.doc_id < 30} == {(1, 21, "")}
    assert [r.spans.count(",") for r in got if r.doc_id == 30] == [1]
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(ORACLE_SQL["op2_secrets"])
    names = [d[0] for d in want.description]
    assert sorted(repr(tuple(r[n] for n in names)) for r in got) == sorted(map(repr, want.fetchall()))


def test_secrets_of_dense_texts(spark):
    """Ten times the matches cost about ten times, not a hundred."""
    import time

    seconds = []
    for n in (2000, 2000, 20_000):
        dense = frame(spark, [(1, "token = Abcdefghijklm1 pwd = abcdefgh " * n, "en", "s", 1)])
        began = time.time()
        row = secrets.scan_secrets(dense).select(F.size("base").alias("b"), F.size("added").alias("a")).first()
        seconds.append(time.time() - began)
        assert (row.b, row.a) == (n, n)
    assert seconds[2] < 10 * seconds[1] + 5


def test_secrets_of_awkward_rows(spark):
    got = secrets.digest_columns(secrets.scan_secrets(clashing(spark))).collect()
    assert len(got) == len(awkward())
    long = next(r for r in got if r.doc_id == 6)
    assert long.n_assign == 1
    assert secrets.scan_secrets(frame(spark, [])).collect() == []


def test_no_python_in_the_native_plans(spark):
    for df in (mixing.mix_sources(frame(spark)), sharding.shard_documents(frame(spark)), secrets.scan_secrets(frame(spark))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("limit", [300, 2000, 1 << 30])
def test_shards(spark, limit):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(prose(3, 300))]
    got = sharding.shard_documents(frame(spark, rows), limit=limit).collect()
    assert sorted(r.doc_id for r in got) == list(range(300))
    bits = {i: f"{int(hashlib.md5(str(i).encode()).hexdigest()[:9], 16):036b}" for i in range(300)}
    size = {i: len(t.encode()) for i, t, *_ in rows}
    for r in got:
        depth = next(d for d in range(37) if sum(size[j] for j in bits if bits[j][:d] == bits[r.doc_id][:d]) <= limit or d == 36)
        inside = [j for j in bits if bits[j][:depth] == bits[r.doc_id][:depth]]
        if sum(size[j] for j in inside) <= limit:
            assert (r.shard, r.depth, r.shard_bytes, r.oversize) == (bits[r.doc_id][:depth], depth, sum(size[j] for j in inside), False)
        else:
            assert r.oversize and r.bytes > limit


def test_shards_of_repeated_and_awkward_rows(spark):
    rows = [(1, "same text" * 5, "en", "s", 1)] * 40 + [(2, "x" * 1000, "en", "s", 1)]
    got = sharding.shard_documents(frame(spark, rows), limit=100).collect()
    assert len(got) == 41 and all(r.oversize == (r.doc_id == 2) for r in got)
    totals = {}
    for r in got:
        totals[r.shard] = totals.get(r.shard, 0) + r.bytes
    assert all(totals[r.shard] == r.shard_bytes for r in got)
    assert len(sharding.shard_documents(clashing(spark), limit=50).collect()) == len(awkward())
    assert sharding.shard_documents(frame(spark, [])).collect() == []


def test_word_pattern_counts_as_contracted(spark):
    df = frame(spark).select(F.regexp_count("text", F.lit(mixing.WORD)).alias("n"), "text").collect()
    assert all(r.n == (None if r.text is None else len(re.findall(mixing.WORD, r.text))) for r in df)
