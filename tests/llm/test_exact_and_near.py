import hashlib
import random

import numpy as np
import pytest
import xxhash
from llm_cases import awkward, clashing, frame, plain_rows, prose
from pyspark.sql import functions as F

from loomspan.llm import exact_dedup as E
from loomspan.llm import simhash as S
from loomspan.plans import storage
from loomspan.plans.storage import number_rows


def normal(text):
    return (text or "").encode().lower()


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 500):
        for low, span in ((0, 1 << 64), (1 << 62, 1 << 60), (5, 1000)):
            values = np.sort(rng.integers(0, span, n, dtype=np.uint64) + np.uint64(low))
            k, blob = E.golomb_encode(values, low, span)
            assert (E.golomb_decode(blob, n, k, low) == values).all()
            if span >= 1 << 60 and n == 500:
                assert len(blob) < 8 * n * 0.9


def test_exact_groups_of_awkward_rows(spark):
    got = E.exact_dedup(clashing(spark))
    assert got.columns[:5] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    rows = got.collect()
    texts = [normal(r[1]) for r in awkward()]
    best = {t: max((r[0] if r[0] is not None else -1) for r in awkward() if normal(r[1]) == t) for t in texts}
    want = sorted((r[0] if r[0] is not None else -1, best[t], texts.count(t), hashlib.sha256(t).hexdigest()) for r, t in zip(awkward(), texts))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id if r.keep_id is not None else -1, r.group_size, r.text_sha256) for r in rows) == want
    for t in set(texts):  # one row of each group stays, of repeated rows too
        assert sum(r.kept for r in rows if r.text_sha256 == hashlib.sha256(t).hexdigest()) == 1


def test_exact_groups_at_random(spark):
    rng = random.Random(4)
    base = prose(1, 40)
    rows = [(i, rng.choice((str.upper, str.lower, str))(rng.choice(base)) if i % 3 else base[0], "en", "s", 1) for i in range(600)]
    got = E.exact_dedup(frame(spark, rows).repartition(7), owners=5).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(normal(t), []).append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == want


def test_exact_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 7)
    monkeypatch.setattr(E, "OWNED", 9)
    rows = [(i, f"text {i // 2}", "en", "s", 1) for i in range(50)]
    got = E.exact_dedup(frame(spark, rows)).collect()
    assert all(r.group_size == 2 and r.keep_id == r.doc_id | 1 for r in got)


def test_exact_moves_codes_and_suspects_only(spark, tmp_path, monkeypatch):
    """What is shuffled: coded messages, bitmaps, and suspects with their texts; never digests of the rest or whole scans."""
    rows = [(i, f"text {i // 2 if i < 20 else i}", "en", "s", 1) for i in range(200)]
    frame(spark, rows).write.parquet(f"{tmp_path}/d")
    plans = []

    def write(*parts, inner=E.materialize):
        plans.extend(df._jdf.queryExecution().executedPlan().toString() for df in parts)
        return inner(*parts)

    for module in (E, storage):  # suspects are written as they are picked
        monkeypatch.setattr(module, "materialize", write)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        E.exact_dedup(spark.read.parquet(f"{tmp_path}/d")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    answered = next(p for p in plans if "Bucketed: true" in p)
    picked = [p for p in plans if "MapInArrow _texts" in p]
    assert len(picked) == 1
    assert answered.count("Exchange hashpartitioning(") == 2  # messages by owner, bitmaps by sender
    assert all("digests" not in line for line in answered.split("Exchange")[1:] if "FileScan" not in line)
    scan = picked[0][picked[0].index("MapInArrow _texts") : picked[0].index("FileScan parquet [text")]
    assert "BroadcastHashJoin" in scan and "Exchange hashpartitioning" not in scan


@pytest.mark.parametrize("operator", [E.exact_dedup, S.near_duplicates])
def test_empty_tables(spark, operator):
    assert operator(frame(spark, [])).collect() == []


def plain_fingerprint(text):
    words = normal(text).split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: id -> fingerprint; id -> smallest id that chains of up to 3 differing bits reach."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("heavy", [512, 0])
def test_near_groups(spark, monkeypatch, heavy):
    monkeypatch.setattr(S, "HEAVY", heavy)
    rng = random.Random(8)
    rows = []
    for i, t in enumerate(prose(2, 60)):
        words = t.split()
        rows.append((len(rows), t, "en", "s", 1))
        for _ in range(rng.randrange(3)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy), "en", "s", 1))
    got = S.near_duplicates(frame(spark, rows)).collect()
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == plain_components(prints)
    assert {r.doc_id for r in got if r.kept} == set(plain_components(prints).values())


@pytest.mark.parametrize("heavy", [512, 0])
def test_links_at_every_distance(spark, monkeypatch, heavy):
    monkeypatch.setattr(S, "HEAVY", heavy)
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1}
    for p in list(prints):
        for n in (1, 2, 3, 4):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = {(r.src, r.dst) for r in S.hamming_links(spark.createDataFrame(signed, "fp long")).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}
    assert links == want


def test_near_groups_of_awkward_rows(spark):
    got = S.near_duplicates(clashing(spark)).collect()
    assert len(got) == len(awkward())
    assert sorted(int(r.fingerprint, 16) for r in got) == sorted(plain_fingerprint(r[1]) for r in awkward())
    blank = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in blank} == {3, 4, 5, None} and {r.component_id for r in blank} == {3} and sum(r.kept for r in blank) == 1
    assert [(r.component_id, r.kept) for r in got if r.doc_id == 7] in ([(7, True), (7, False)], [(7, False), (7, True)])
    nameless = [r for r in got if r.doc_id is None and r.fingerprint != "0" * 16]
    assert {r.component_id for r in nameless} == {None} and sum(r.kept for r in nameless) == 1


def test_rows_keep_the_callers_numbers(spark):
    rows = frame(spark).selectExpr("*", "monotonically_increasing_id() as n")
    assert plain_rows(S.near_duplicates(rows, row_col="n"), "row_id") == plain_rows(rows.withColumnRenamed("n", "row_id"), "row_id")
    numbered = number_rows(rows)
    assert plain_rows(E.exact_dedup(numbered), "row_id") == plain_rows(numbered.df.select(F.col(numbered.row).alias("row_id")), "row_id")
