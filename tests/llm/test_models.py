"""Quality, toxicity and personal data: trained here, held to labels, plain patterns and round trips."""

import random
import re
import time

import numpy as np
import pytest
from llm_cases import awkward, clashing, frame, prose

from loomspan.llm import pii, quality, toxicity


def _quality_rows(n=240):
    rng = random.Random(3)
    rows, bad = [], set()
    for i, t in enumerate(prose(5, n)):
        t = ", ".join(t.capitalize().split(" ", 1)) + " " + " ".join(x.capitalize() + ", and more." for x in prose(100 + i, 3))
        if i % 5 == 0:
            bad.add(i)
            w = t.split()
            t = rng.choice([" ".join(x + rng.choice(("$$$", "%%%", "###")) for x in w), " | ".join(w), " ".join(["again"] * 80), " ".join(x.upper() + "!!" for x in w)])
        rows.append((i, t, "en", "s", 1))
    return rows, bad


def test_quality_without_labels(spark):
    rows, bad = _quality_rows()
    got = quality.quality(frame(spark, rows)).collect()
    wrong = sum((r.doc_id in bad) == r.keep for r in got)
    assert len(got) == len(rows) and wrong <= 0.03 * len(rows)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)


def test_label_model_learns_who_is_right():
    patterns = {"g------": 50, "b------": 5, "bb-----": 20, "-b-----": 3, "----g--": 200, "b---g--": 2}
    posterior = quality.estimate(patterns)
    assert posterior["bb-----"] < 0.1 and posterior["----g--"] > 0.9 and quality.estimate({}) == {}


def test_quality_against_a_plain_version(spark):
    """Expectation-maximisation document by document, and scores as plain dot products, under other splits too."""
    rows, _ = _quality_rows(150)
    said = [quality.votes(t) for _, t, *_ in rows]
    base = np.log(quality.GOOD_SHARE / (1 - quality.GOOD_SHARE))
    sign = np.array([[(c == "g") - (c == "b") for c in v] for v in said], float)
    good = 1 / (1 + np.exp(-base - sign.sum(axis=1)))
    for _ in range(60):
        accuracy = []
        for j in range(sign.shape[1]):
            right = sum(g if x > 0 else 1 - g for g, x in zip(good, sign[:, j]) if x)
            accuracy.append(min(0.995, max(0.55, (right + 8) / (np.count_nonzero(sign[:, j]) + 10))))
        odds = np.array([base + sum(x * np.log(a / (1 - a)) for x, a in zip(row, accuracy)) for row in sign])
        good = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    got = {r.doc_id: r for r in quality.quality(frame(spark, rows)).collect()}
    assert [got[i].posterior for i in range(len(rows))] == pytest.approx(good.tolist(), abs=1e-6)
    w, b = quality.fit_linear(np.stack([quality.document_vector(t) for _, t, *_ in rows]), good)
    plain = [1 / (1 + np.exp(-(quality.document_vector(t).astype(float) @ w + b))) for _, t, *_ in rows]
    assert [got[i].score for i in range(len(rows))] == pytest.approx(plain, abs=0.02)
    again = {r.doc_id: r.score for r in quality.quality(frame(spark, rows).repartition(7)).collect()}
    assert again == pytest.approx({i: r.score for i, r in got.items()}, abs=1e-9)


def test_quality_of_awkward_rows(spark):
    got = quality.quality(clashing(spark)).collect()
    assert len(got) == len(awkward()) and {r.votes for r in got if r.doc_id in (3, 4)} == {"-" * 7}
    assert quality.quality(frame(spark, [])).collect() == []


INSULTS = ["idiot", "scum", "worthless", "zorgbal", "zorgmip", "zorgtun", "zorgfel"]


def _toxic_rows(n=900):
    rng = random.Random(9)
    rows, labels = [], []
    for i, t in enumerate(prose(11, n)):
        words = t.split() * 2
        toxic = i % 6 == 0
        if toxic:
            for w in rng.sample(INSULTS, 3):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), "en", "s", 1))
        if i % 10 < 8:
            labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def toxic(spark):
    rows, labels = _toxic_rows()
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, marks, toxicity.fit_toxicity(docs, marks)


def test_toxicity_on_held_out_rows(spark, toxic):
    import zlib

    docs, marks, _ = toxic
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, marks).collect()}
    held = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in got if zlib.crc32(str(i).encode()) % 3 == 1}
    right = [(r.predicted == 1) == (r.doc_id % 6 == 0) for r in held]
    assert np.mean(right) > 0.96 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_kernel_against_all_subsequences():
    """Hashed features give the kernel of all gappy subsequences, enumerated one by one."""
    from itertools import combinations

    def plain(word):
        out = {}
        for at in combinations(range(len(word) + 1), toxicity.LENGTH):
            if at[-1] - at[0] < toxicity.SPAN:
                key = tuple(("^" + word)[i] for i in at)
                out.setdefault(key, []).append(toxicity.DECAY ** (at[-1] - at[0] + 1 - toxicity.LENGTH))
        norm = np.sqrt(sum(w * w for ws in out.values() for w in ws))
        return {k: sum(ws) / norm for k, ws in out.items()}

    words = ["worthless", "wortthless", "w0rthless"[:1] + "orthles", "idiot", "theringon", "the", "idioot", "character"]
    features = toxicity.kernel_features(words)
    want = [[sum(v * b.get(k, 0.0) for k, v in a.items()) for b in map(plain, words)] for a in map(plain, words)]
    assert features @ features.T == pytest.approx(np.array(want), abs=0.03)


def test_near_copies_leave_the_training_sample_and_others_stay():
    rng = random.Random(2)
    documents = [set(t.split()) for t in prose(71, 80)]
    copies = [d | {f"new{rng.random()}"} for d in documents if len(d) > 8]
    kept = toxicity._spread(documents + copies)
    plain = []
    for d in documents:
        if not any(3 * len(d & e) >= len(d) + len(e) for e in plain):
            plain.append(d)
    assert len(plain) <= len(kept) <= len(plain) + 3


def test_gapped_and_inserted_characters(toxic):
    model = toxic[2]
    plain, odd = model.token_scores(["worthless", "zorgbal"]), model.token_scores(["wortthless", "zorgpobal"])
    ordinary = model.token_scores(["theringon", "ouan"])
    assert odd.min() > ordinary.max() and plain.min() > ordinary.max()
    assert toxicity.sentence_tokens("you i d i o t and id-iot") == ["you", "idiot", "and", "idiot"]
    assert len(model.token_scores(["x" * 100])) == 1


def test_held_out_labels_do_not_matter(spark, toxic):
    docs, marks, model = toxic
    flipped = marks.withColumn("toxic", (1 - marks["toxic"]).cast("int"))
    mixed = marks.filter(~toxicity.held_out(marks["doc_id"])).unionByName(flipped.filter(toxicity.held_out(marks["doc_id"])))
    again = toxicity.fit_toxicity(docs, mixed)
    assert np.allclose(again.direction, model.direction) and np.allclose(again.document, model.document)


def test_toxicity_of_awkward_rows(spark, toxic):
    marks = toxic[1]
    got = toxicity.score_toxicity(clashing(spark), marks).collect()
    assert len(got) == len(awkward()) and all(r.score < 0.7 for r in got if r.doc_id in (3, 4, 5))
    nothing = spark.createDataFrame([(None, None, None), (1, None, None)], marks.schema)
    assert {r.predicted for r in toxicity.score_toxicity(frame(spark), nothing).collect()} == {0}
    assert toxicity.score_toxicity(frame(spark, []), marks).collect() == []


def plain_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m[0])
        total = sum(int(c) if n % 2 == 0 else sum(map(int, str(2 * int(c)))) for n, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    texts = ["".join(rng.choice("0149.@a-+ ()%é_") for _ in range(rng.randrange(80))) for _ in range(4000)]
    texts += [r[1] or "" for r in awkward()] + ["4" * 19 + " 1.2.3.4.5.6.7.8 a@b.c@d.e +49 (30) 123456-7 4111 1111 1111 1111", "9" * 5000, "a" * 5000 + "@"]
    assert [pii.base_spans(t) for t in texts] == [plain_pii(t) for t in texts]


@pytest.fixture(scope="module")
def tagger():
    return pii.default_tagger()


def test_tagger_on_unseen_examples(tagger):
    examples = pii.labelled_examples(40, seed=77)
    found = pii.tag_runs(tagger, [t for t, _ in examples])
    hit = sum(len(set(s) & set(f)) for (_, s), f in zip(examples, found))
    assert hit / sum(len(s) for _, s in examples) > 0.85 and hit / sum(map(len, found)) > 0.85


def test_gradients(tagger):
    rng = np.random.default_rng(0)
    m = pii.Tagger.fresh(1)
    for name in ("embed", "win", "rec", "bias", "out", "out_bias", "trans"):
        setattr(m, name, getattr(m, name).astype(np.float64))
    x, y = rng.integers(0, 12, (3, 6)), rng.integers(0, pii.TAGS, (3, 6))
    _, grads = pii._gradients(m, x, y)
    for name in ("embed", "win", "rec", "out", "trans"):
        w = getattr(m, name)
        at = tuple(rng.integers(0, n) for n in w.shape)
        keep = w[at]
        w[at] = keep + 1e-3
        up = pii._gradients(m, x, y)[0]
        w[at] = keep - 1e-3
        down = pii._gradients(m, x, y)[0]
        w[at] = keep
        assert (up - down) / 2e-3 == pytest.approx(getattr(grads, name)[at], rel=0.05, abs=2e-3)


def test_windows_are_reconciled(tagger):
    """A span is found wherever windows cut the text, and once."""
    hits = 0
    for pad in range(40, 140, 5):
        text = "the ou lich " * (pad // 12 + 1)
        text = text[:pad] + " (017) 555-7713 and on " + "re st " * 30
        spans = [s for s in pii.find_spans(tagger, [text])[0][1] if s[1] == 3]
        hits += spans == [(pad + 1, 3, pad + 15)]
        assert len(spans) <= 1
    assert hits >= 16


def test_windows_without_cues_hold_nothing(tagger):
    """What is added equals what a decoding of every window adds."""
    examples = [t for t, _ in pii.labelled_examples(60, seed=5)]
    texts = examples + [" ".join(prose(i, 40)) + t + " ".join(prose(50 + i, 40)) for i, t in enumerate(examples[:40])] + prose(9, 50) + [r[1] or "" for r in awkward()]
    texts += ["a" * 90 + " @ " + "b1" * 10 + ".example.com", "x" * 200 + " (030) 555-1234 " + "y" * 200]
    every = []
    for text, tagged in zip(texts, pii.tag_runs(tagger, texts, everywhere=True), strict=True):
        every.append(sorted((s, k, e) for s, k, e in tagged if pii.plausible(k, text[s:e].strip())))
    near = [sorted((s, k, e) for s, k, e in tagged if pii.plausible(k, t[s:e].strip())) for t, tagged in zip(texts, pii.tag_runs(tagger, texts), strict=True)]
    assert near == every and sum(map(len, every)) > 100


def test_segments_do_not_matter(tagger, monkeypatch):
    text = " ".join(t for t, _ in pii.labelled_examples(60, seed=6))
    whole = [pii.tag_runs(tagger, [text])]
    for segment, block in ((3, 8), (1, 1), (10_000, 10_000)):
        monkeypatch.setattr(pii, "SEGMENT", segment)
        monkeypatch.setattr(pii, "BLOCK", block)
        whole.append(pii.tag_runs(tagger, [text]))
    assert whole[0] == whole[1] == whole[2] == whole[3] and len(whole[0][0]) > 50


def test_tagging_takes_memory_by_segments(tagger):
    import tracemalloc

    peaks = []
    for n in (60, 240):
        text = " 12 +49 (30) 1234 word" * (100 * n)
        tracemalloc.start()
        pii.tag_runs(tagger, [text])
        peaks.append((tracemalloc.get_traced_memory()[1], len(text)))
        tracemalloc.stop()
    assert peaks[1][0] - peaks[0][0] < 60 * (peaks[1][1] - peaks[0][1])


def test_pii_of_awkward_rows(spark, tagger):
    got = pii.find_pii(clashing(spark), tagger=tagger).collect()
    assert len(got) == len(awkward())
    long = next(r for r in got if r.doc_id == 6)
    assert [s.kind for s in long.base] == ["email"]
    for r, t in ((r, dict((x[0], x[1]) for x in awkward())[r.doc_id]) for r in got if r.doc_id):
        assert [(s.start, s.rank, s.end) for s in r.base] == plain_pii(t or "")
        assert all(a.end <= b.start or b.end <= a.start for a in r.added for b in r.base)
    assert pii.find_pii(frame(spark, []), tagger=tagger).collect() == []


def test_pii_of_dense_texts_is_linear():
    """Added spans keep clear of base spans of every kind, by one search each."""
    model = pii.default_tagger()
    line = "Call 555-010-1234 or (555) 010-4321, mail a.b@example.com, c@x.org from 10.0.0.1 "
    seconds = []
    for n in (200, 2000):
        began = time.process_time()
        base, added = pii.find_spans(model, [line * n])[0]
        seconds.append(time.process_time() - began)
        taken = np.zeros(len(line) * n, bool)
        for s, _, e in base:
            taken[s:e] = True
        assert len(base) >= 3 * n and not any(taken[s:e].any() for s, _, e in added)
    assert seconds[1] < 30 * max(seconds[0], 0.05)
