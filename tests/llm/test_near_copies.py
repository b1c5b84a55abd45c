import random

import pytest
from llm_cases import CLASHES, awkward, frame, prose
from test_exact_and_near import normal

import corpus_pipeline as P
from loomspan.llm import near_copies as N


def plain_shingles(text):
    words = normal(text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Numbers of the rows that stay: the smallest (null last) id of each component of pairs at 0.8 or more."""
    sets = [plain_shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    heads = {}
    for n, r in enumerate(rows):
        heads.setdefault(find(n), []).append((r[0] is None, r[0] or 0, n))
    return {min(v)[2] for v in heads.values()}


def edited(text, rng, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("heavy", [32, 2])
def test_against_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(N, "HEAVY", heavy)
    rng = random.Random(5)
    bases = [" ".join(x) for x in zip(prose(61, 90), prose(62, 90), prose(63, 90), strict=True)]
    texts = [edited(t, rng, n) for t in bases for n in (0, 1, 2, 3, rng.randrange(6))]
    texts += [edited(bases[0], rng, rng.randrange(1, 3)) for _ in range(60)]
    rng.shuffle(texts)
    rows = [(i, t, "en", "s", n) for n, (i, t) in enumerate(zip(rng.sample(range(10**6), len(texts)), texts, strict=True))]
    got = P.drop_near_copies(spark, frame(spark, rows), "").collect()
    want = plain_kept(rows)
    assert len(want) < len(rows) * 0.8
    assert sorted(r.n_chars for r in got) == sorted(want)


def test_awkward_rows(spark):
    rows = [(*r[:4], n) for n, r in enumerate(awkward())]
    docs = frame(spark, rows)
    for name in CLASHES:
        docs = docs.selectExpr("*", f"'clash' as {name}")
    got = P.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    # rows that repeat an id stand in any order, so what stays is compared by id and text
    assert sorted(repr((r.doc_id, normal(r.text))) for r in got.collect()) == sorted(repr((rows[n][0], normal(rows[n][1]))) for n in plain_kept(rows))
    assert P.drop_near_copies(spark, frame(spark, []), "").collect() == []


def template(rng, own, shared=300):
    """A text of shared words, the same in all, between words of its own."""
    return " ".join([*(f"w{k}" for k in range(shared)), *(f"own{rng.randrange(10**9)}" for _ in range(own))])


def test_templates_below_the_similarity_meet_nowhere(spark, monkeypatch):
    """Texts that share most of their words and all of their bands, but link nowhere, cost no pairs; sizes may differ."""
    monkeypatch.setattr(N, "HEAVY", 8)
    made = []

    def met(*a, inner=N._met):
        pairs = inner(*a)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(N, "_met", met)
    counts = []
    for n in (100, 200):
        rng = random.Random(n)
        rows = [(i, template(rng, 50 + i % 3), "en", "s", i) for i in range(n)]
        rows += [(n + i, edited(rows[i][1], rng, 1), "en", "s", n + i) for i in range(5)]
        kept = P.drop_near_copies(spark, frame(spark, rows), "").collect()
        assert sorted(r.n_chars for r in kept) == sorted(plain_kept(rows))
        counts.append(made.pop())
    assert counts[1] <= 2 * max(counts[0], 10)


def test_rare_entries_miss_no_pair(spark):
    """Every pair at the similarity shares an entry, whatever its sizes; sets of a template do not."""
    rng = random.Random(8)
    base = [template(rng, rng.randrange(0, 90), 200) for _ in range(40)]
    texts = base + [edited(t, rng, rng.randrange(0, 6)) for t in base] + [t + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(40))) for t in base]
    sets = {N._class(s): set(s.tolist()) for s in (N.shingle_set(t.encode()) for t in texts)}
    rows = [(c, N.np.sort(N.np.array([*s], N.np.uint64)).tobytes()) for c, s in sets.items()]
    frame_of = spark.createDataFrame(rows, "class long, shingles binary")
    entries = N.rare_entries(frame_of, spark.createDataFrame([(c, len(s)) for c, s in sets.items()], "class long, size int")).collect()
    at = {}
    for e in entries:
        at.setdefault((e.shingle, e.low, e.high), []).append((e.side, e["class"]))
    met = {frozenset((a, b)) for own in at.values() for s, a in own for t, b in own if a != b and s == -t}
    similar = {frozenset((a, b)) for a in sets for b in sets if a != b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert similar and similar <= met
    assert len(met) < len(sets) * (len(sets) - 1) / 8  # and few others do
