"""The Merkle manifest, main texts of pages and collocations against plain versions."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import awkward, clashing, frame, plain_rows, prose

from pyspark.sql import functions as F

from loomspan.llm import collocations, main_text, merkle

# --- Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, changed):
    """(doc_id, leaf, subroot, root, proof digest, folded root) for rows of (doc_id, text, lang, source, n_chars)."""

    def leaf(row, text):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))

    def climb(nodes):
        """The root, and each node's siblings with its place."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for k, a in enumerate(at):
                run = level[a - a % 3 : a - a % 3 + 3]
                paths[k].append((run[: a % 3], run[a % 3 + 1 :]))
            level, at = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)], [a // 3 for a in at]
        return level[0], paths

    by = {}
    for row in rows:
        by.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf(row, row[1]), row))
    trees, order = {}, sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for source in order:
        by[source].sort(key=lambda x: x[:3])
        trees[source] = climb([x[2] for x in by[source]])
    root, tops = climb([trees[s][0] for s in order])
    out = []
    for source, top in zip(order, tops, strict=True):
        for (_, _, node, row), path in zip(by[source], trees[source][1], strict=True):
            folded = leaf(row, changed(row))
            for left, right in path + top:
                folded = sha(*left, folded, *right)
            out.append((row[0], node, trees[source][0], root, sha(*(s for left, right in path + top for s in left + right)), folded, folded == root))
    return sorted(out, key=repr)


def without_lines(row):
    return row[1].replace("\n", "") if row[1] is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 else row[1]


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def many_rows():
    rng = random.Random(3)
    sources = [None, "", "a", "B", "é", "zz"]
    rows = [(k, f"text {k}\nmore", "en", rng.choice(sources), 9) for k in range(120)]
    return rows + [(1000 + k, f"long {k}\n", None, "hot", None) for k in range(800)]  # more than one superblock of superblocks


@pytest.mark.parametrize("rows", [awkward(), many_rows(), [(1, "one\n", "en", "s", 4)]])
def test_manifest_against_plain(spark, rows):
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.merkle_manifest(frame(spark, rows), given={"text": text})
    assert plain_rows(got, *COLUMNS) == plain_manifest(rows, without_lines)


def test_manifest_of_superblocks_in_superblocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    # the tasks see the module as it is on disk, so the plain functions run here
    nodes = [sha(str(k)) for k in range(100)]
    layers = merkle._layers(nodes, merkle.depth(100))
    for at in (0, 1, 80, 81, 99):
        assert merkle.fold(nodes[at], merkle._steps(layers, at)) == layers[-1][0]


def test_manifest_proofs_lead_to_the_root(spark):
    rows = merkle.merkle_manifest(frame(spark, many_rows()), with_proofs=True).collect()
    assert len({r.root for r in rows}) == 1 and all(r.verified for r in rows)
    for r in rows[::37]:
        assert merkle.fold(r.leaf, r.proof) == r.root
        assert r.proof == [] or merkle.fold(r.leaf[::-1], r.proof) != r.root


def test_manifest_takes_other_columns_and_no_rows(spark):
    assert plain_rows(merkle.merkle_manifest(clashing(spark)), *COLUMNS[:5]) == [r[:5] for r in plain_manifest(awkward(), lambda row: row[1])]
    assert merkle.merkle_manifest(frame(spark, [])).collect() == []


# --- main text


def site(k, article, rng):
    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in "home news sport culture science travel weather archive contact".split())
    kind = k % 4
    body = "".join(f"<p>{html.escape(p)}</p>" for p in article)
    notice = '<div class="cookie-notice">We use cookies to make this site better for all our readers.</div>'
    tail = "<section id='comments'><p>Nice one, I liked it!</p></section>"
    if kind == 0:
        main = f"<article><header><h1>Title {k}</h1></header>{body}<form><input><button>Send</button></form>{tail}</article>"
    elif kind == 1:
        main = f"<main><h1>Title {k}</h1>{body.replace('</p>', '')}</main>{tail}"
    elif kind == 2:
        main = f'<div class="post-content"><h1>Title {k}</h1>{body}<div class="share-buttons">Share this</div></div>{tail}'
    else:
        main = f"<div><h1>Title {k}</h1>{body}</div>"
    plain = "<div>Sign in to read more from our friends and from all of the partner sites</div>" if kind == 3 else ""
    page = f"<html><head><title>T &amp; {k}</title><script>if (a < b) document.write('</p><article>')</script><style>p>a{{}}</style></head><body><nav><ul>{menu}</ul></nav><!-- <article>x</article> -->{notice}{main}{plain}<aside>More to read</aside><footer>&copy; site</footer></body>"
    return page, " ".join([f"Title {k}", *(" ".join(p.split()) for p in article)])


def test_main_text_of_planted_pages(spark):
    rng = random.Random(1)
    texts = prose(5, 400)
    rows, wanted = [], {}
    for k in range(80):
        article = [f"{t} R&D <{k}> é" for t in rng.sample(texts, 4)]
        page, text = site(k, article, rng)
        rows.append((k, f"https://News.example.com/{k}", page))
        wanted[k] = text
    rows.append((900, "https://news.example.com/0?copy", rows[0][2]))  # a copy of an article is no boilerplate
    wanted[900] = wanted[0]
    got = {r.page_id: r for r in main_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: r.text for k, r in got.items()} == wanted
    assert all(r.n_chars == len(r.text) for r in got.values())
    shards = main_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), shard_bytes=100_000).collect()
    assert {r.page_id: r.text for r in shards} == wanted


def test_main_text_does_not_depend_on_shards(spark):
    notice = "<div>{} readers of our partner sites save on every order placed before the end of june</div>"
    rows = []
    for k in range(60):
        own = "".join("<p>" + " ".join(f"w{k}x{j}y{i}" for i in range(8)) + "</p>" for j in range(20))
        rare = notice.format("all") if k % 9 == 0 else "<div>some readers wrote to us about the long queue at the old harbour gate</div>" if k % 20 == 1 else ""  # 7 and 3 of 60
        rows.append((k, f"http://cut.example/{k}", f"<body>{rare}<div>{own}</div></body>"))
    rows += [(1000 + k, "http://cut.example/copy", rows[1][2]) for k in range(40)]  # copies count once
    small = [(2000 + k, "http://small.example/", f"<div>{notice.format('three')}</div><p>page {k} has own words</p>") for k in range(3)]
    pages = spark.createDataFrame([*rows, *small], "page_id long, url string, html string")
    whole = plain_rows(main_text.main_text(pages, shard_bytes=1 << 30), "page_id", "text", "n_chars")
    for most in (8_000, 40_000):
        assert plain_rows(main_text.main_text(pages, shard_bytes=most), "page_id", "text", "n_chars") == whole
    texts = {i: t for i, t, _ in whole}
    assert not any("all readers" in t for t in texts.values())
    assert sum("some readers" in t for t in texts.values()) == 43
    assert texts[2001] == "page 1 has own words"


def test_main_text_of_broken_pages(spark):
    cases = [
        (1, None, "<article>open <b>bold<p>two</b> three<p>four"),
        (2, "x", None),
        (3, "http://h/", ""),
        (4, "http://h/", "no markup, a < b & c &lt;d&gt;  &#233;&nbsp;x"),
        (5, "http://h/", "<div>before<script>never closed </p> text"),
        (6, "http://h/", "<p>one<!-- open comment <p>two"),
        (7, "http://h/", '<p title="a > b" class=\'x\'>kept</p><a href="'),
        (8, "http://h/", "<nav>menu<article><p>text</p></article>"),
        (None, None, "<article><p>a<br>b<i>c</i>d</p></article>"),
        (None, None, "<article><p>a<br>b<i>c</i>d</p></article>"),
        (9, "http://h/", "<body class='has-sidebar'><article class='post'>kept<div class='adSlot'>gone</div><div hidden>gone</div></article>"),
        (10, "http://h/", "<b>" * 20_000 + "deep" + "<div>" * 20_000 + "er" + "</i>" * 20_000),
    ]
    rows = [(i, u, h, "clash", "clash") for i, u, h in cases]
    got = plain_rows(main_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string, shard string")), "page_id", "text")
    want = {1: "open boldtwo three four", 2: "", 3: "", 4: "no markup, a < b & c <d> é x", 5: "before", 6: "one", 7: "kept", 8: "text", 9: "kept", 10: "deep er", None: "a bcd"}
    want[1] = "open bold two three four"
    assert got == sorted([(i, want[i]) for i, _, _ in cases], key=repr)
    assert main_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_repeated_tokens_against_plain():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 50, 30)
    streams = [np.concatenate([rng.integers(0, 4000, 40), shared[k % 3 : 20 + k % 5], rng.integers(0, 4000, 10)]) for k in range(12)] + [np.arange(3), np.zeros(0, np.int64), np.zeros(40, np.int64)]
    kinds = [k // 2 for k in range(len(streams))]
    holders = {}
    for s, kind in zip(streams, kinds, strict=True):
        for i in range(len(s) - main_text.RUN + 1):
            holders.setdefault(tuple(s[i : i + main_text.RUN]), set()).add(kind)
    for s, got in zip(streams, main_text.repeated_tokens(streams, kinds), strict=True):
        want = np.zeros(len(s), bool)
        for i in range(len(s) - main_text.RUN + 1):
            if len(holders[tuple(s[i : i + main_text.RUN])]) >= main_text.PAGES:
                want[i : i + main_text.RUN] = True
        assert (got == want).all()


# --- collocations


def plain_collocations(rows):
    f, n = Counter(), Counter()
    for _, text, lang, _, _ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    candidates = {k: a for k, a in f.items() if len(k) > 2 and a >= 10}
    out = {}
    for (lang, *words), a in candidates.items():
        score, _, l, r = min((10**6 * a * a // (f[lang, *words[:k]] * f[lang, *words[k:]]), k, f[lang, *words[:k]], f[lang, *words[k:]]) for k in range(1, len(words)))
        if len(words) == 2 and any(100 * b >= 50 * a for (other, *longer), b in candidates.items() if other == lang and len(longer) == 3 and words in (longer[:2], longer[1:])):
            continue
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for k, (s, a, p, l, r) in enumerate(sorted(own)[:2000]))


PHRASES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrase_rows():
    rng = random.Random(9)
    words = ["The", "of", "ünï", "😀", "x y", "nor", "ther", "re", "\x00z"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ",", ".\n", "\t"]) for _ in range(60)) for _ in range(40)]
    return [(k, t, rng.choice(["en", "de", None, "und"]), "s", 1) for k, t in enumerate(texts)] + awkward()


def test_collocations_against_plain(spark):
    want = plain_collocations(phrase_rows())
    assert want and {r[0] for r in want} >= {"en", "und"}
    assert sorted(plain_rows(collocations.collocations(frame(spark, phrase_rows())), *PHRASES)) == want
    # a sketch of two cells lets nearly everything pass, and nothing changes
    assert sorted(plain_rows(collocations.collocations(frame(spark, phrase_rows()), bits=1), *PHRASES)) == want


def test_collocations_take_other_columns_and_no_rows(spark):
    assert sorted(plain_rows(collocations.collocations(clashing(spark)), *PHRASES)) == plain_collocations(awkward())
    assert collocations.collocations(frame(spark, [])).collect() == []


def test_chunks_lose_no_phrase(monkeypatch):
    """Texts that are cut into segments and chunks anywhere count as if they were whole."""
    import pyarrow as pa

    monkeypatch.setattr(collocations, "CHUNK", 7)
    monkeypatch.setattr(collocations, "SEGMENT", 5)
    texts = [t for _, t, _, _, _ in phrase_rows() if t and len(t) < 1000]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    got = Counter()

    def tally(lang, held):
        back = list(held.words)
        for places, counts in collocations._counted(held):
            for *words, n in zip(*places, counts, strict=True):
                got[tuple(back[w].decode() for w in words)] += int(n)
        return iter(())

    list(collocations._chunks(iter([batch]), tally))
    want = Counter()
    for text in texts:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
            words = re.findall("[^ \t]+", piece)
            for size in (1, 2, 3):
                want.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    assert got == want


def test_count_code_round_trip():
    rng = np.random.default_rng(1)
    for counts in (rng.integers(1, 11, 301), np.ones(7, np.int64), np.array([10]), np.zeros(0, np.int64)):
        assert (collocations.decode_counts(collocations.encode_counts(counts), len(counts)) == counts).all()
