import os
import random

import numpy as np
import pytest
from llm_cases import awkward, clashing, frame, prose

from loomspan.llm import sentencepiece as S
from loomspan.llm import topk
from loomspan.llm.queries import PIECES

needs_model = pytest.mark.skipif(not os.path.exists(PIECES), reason="needs the public tokenizer files")


@pytest.fixture(scope="module")
def model(spark):
    return S.load_model(spark, PIECES)


ODD = ["", " ", "  a", "a  b   c ", "\n\n", "\x00", "😀 ñ ▁x ▁▁", "a" * 300, "the" * 900, " <s> </s> <0x0A>", "if  (x) {\n    return 1;\n}\t\t", "日本語 テスト", "ÀÉ́e", " " * 15 + "x" + " " * 17 + "y" + " " * 40, "internationally responsibilities characteristics"]


@needs_model
def test_ids_equal_the_library(model):
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ODD + prose(4, 300) + [r[1] or "" for r in awkward()]
    codec = S.Codec(model)
    ids = codec.encode(texts)
    assert [list(i) for i in ids] == reference.encode(texts)
    assert [codec.decode(i) for i in ids] == [t.replace("▁", " ") for t in texts]


@needs_model
def test_forgotten_words_and_wide_alphabets(model, monkeypatch):
    monkeypatch.setattr(S, "CACHED_WORDS", 10)
    monkeypatch.setattr(S, "BATCH_CHARS", 50)
    codec, fresh = S.Codec(model), S.Codec(model)
    for texts in (prose(6, 20), prose(7, 20), ["".join(map(chr, range(0x4E00, 0x4E00 + 400)))]):
        assert [list(x) for x in codec.encode(texts)] == [list(fresh.encode([t])[0]) for t in texts]


@needs_model
def test_long_words_without_a_break(model):
    """Ids equal the library's on words of a million characters, in seconds, and with short words by the heap too."""
    import base64
    import time

    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(17)
    long = [base64.b64encode(rng.randbytes(750_000)).decode(), "".join(map(chr, rng.choices(range(0x4E00, 0x5E00), k=200_000))), "the" * 100_000, "".join(rng.choices("aeinst", k=30_000))]
    began = time.time()
    ids = S.Codec(model).encode(long)
    assert time.time() - began < 60
    assert [list(i) for i in ids] == reference.encode(long)


@needs_model
def test_both_ways_of_relaxing_agree(model, monkeypatch):
    texts = ODD + prose(8, 60)
    rounds = [list(i) for i in S.Codec(model).encode(texts)]
    monkeypatch.setattr(S, "LONG", 0)
    assert [list(i) for i in S.Codec(model).encode(texts)] == rounds


def test_edges_are_all_occurrences():
    pieces = ["<unk>", "a", "b", "ab", "ba", "aba", "▁a", "zz"]
    m = S.Model(pieces, [2] + [1] * 7, [0.0, -5, -6, -1, -2, -3, -4, -7])
    text = "▁ababa\x00▁abba\x00"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    start, length, piece = S.match_pieces(m, codes, np.array([6, 12]))
    want = sorted((i, len(p), n) for n, p in enumerate(pieces) if n for i in range(len(text)) if text.startswith(p, i))
    assert sorted(zip(start.tolist(), length.tolist(), piece.tolist())) == want
    assert (np.diff(start) >= 0).all()


@needs_model
def test_documents(spark, model):
    got = S.encode_documents(clashing(spark), model).collect()
    assert len(got) == len(awkward()) and all(r.round_trip for r in got)
    assert sorted(r.decoded for r in got) == sorted((r[1] or "") for r in awkward())
    assert all(r.n_tokens == len(r.ids) for r in got) and {r.n_tokens for r in got if r.doc_id in (3, 4)} == {0}
    assert S.encode_documents(frame(spark, []), model).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int, score int, block int, dims int"


def plain_search(rows, k):
    usable = [(n, i, [int(np.floor(float(np.float32(x)) * 1024)) for x in v]) for n, (i, v, *_) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for own, q, w in usable:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(w, c)), i) for n, i, c in usable if n != own and len(c) == len(w))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dims", "scale"), [(700, 16, 0.2), (60, 3, 0.001), (5, 4, 5.0), (230, 8, 0.0)])
def test_search(spark, monkeypatch, n, dims, scale):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 100)
    monkeypatch.setattr(topk, "QUERY_BYTES", 600)
    rng = np.random.default_rng(n)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, dims) * scale], 0, 1, 2, 3) for i in range(n)]
    rows[min(7, n - 1)] = (min(7, n - 1), rows[0][1], 0, 1, 2, 3)  # a tie with the first query's own vector
    got = sorted(tuple(r) for r in topk.exact_top_k(spark.createDataFrame(rows, VECTORS)).select("query_id", "rank", "vec_id", "score").collect())
    assert got == plain_search(rows, 10)


def test_search_leaves_out_unusable_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, [0.5, 0.5]), (None, [9.0, 9.0]), (100, [-1.0, 0.0]), (7, [0.5, 0.5])]
    rows = [(i, v, 0, 1, 2, 3) for i, v in rows]
    got = sorted(tuple(r) for r in topk.exact_top_k(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == plain_search(rows, 10) and {r[2] for r in got} == {0, 6, 7, 100}
    assert topk.exact_top_k(spark.createDataFrame([], VECTORS)).collect() == []


def test_search_of_empty_huge_and_repeated_vectors(spark):
    rows = [(0, []), (1, []), (100, []), (2, [3.0]), (200, [1.0]), (200, [1.0]), (3, [40_000.0]), (300, [-50_000.0]), (4, [2.0e6]), (5, [-0.5])]
    rows = [(i, v, 0, 1, 2, 3) for i, v in rows]
    got = sorted(tuple(r) for r in topk.exact_top_k(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == plain_search(rows, 10)
    assert [r[2:] for r in got if r[0] == 0] == [(1, 0), (100, 0)]
    far = [(0, [3.0e30], 0, 1, 2, 3), (1, [3.0e30], 0, 1, 2, 3), (2, [-3.0e30], 0, 1, 2, 3)]
    got = sorted(tuple(r) for r in topk.exact_top_k(spark.createDataFrame(far, VECTORS)).collect())
    assert [(r[2], r[3] > 0) for r in got] == [(1, True), (2, False)]


def test_search_shuffles_only_the_best(spark):
    rows = [(i, [float(i % 7), 1.0], 0, 1, 2, 3) for i in range(300)]
    plan = topk.exact_top_k(spark.createDataFrame(rows, VECTORS))._jdf.queryExecution().executedPlan().toString()
    assert "slices" not in plan and "components" not in plan


def test_bitmap_sums():
    rng = random.Random(3)
    total = [np.zeros((1, 1), np.uint64) for _ in range(12)]
    want = np.zeros(64, np.int64)
    for _ in range(20):
        values = np.array([rng.randrange(32) for _ in range(64)])
        at = rng.randrange(3)
        topk._add(total, [topk._pack(((values >> b) & 1).astype(np.uint8))[None, :] for b in range(5)], at)
        want += values << at
    bits = np.stack([np.unpackbits(t.view(np.uint8), bitorder="little") for t in total])
    assert (bits.T @ (1 << np.arange(12)) == want).all()
    rows = np.full((1, 1), 0xFFFFFFFFFFFFFFFF, np.uint64)
    assert topk._kth(total, rows, 5) == [sorted(want)[-5]]
    bound = int(np.median(want))
    assert (np.unpackbits(topk._at_least(total, rows, [bound]).view(np.uint8), bitorder="little") == (want >= bound)).all()
