"""Main text of web pages: markup tells blocks, and a suffix array over a host's pages tells what they all repeat."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.plans.storage import BROADCAST_BYTES, broadcast_if_small, materialize, release_memory, small_batches

#: A host's pages are looked at together, up to so many bytes; a larger host is dealt over shards by a hash.
SHARD_BYTES = 1 << 18
#: Words whose hashes a task remembers.
WORDS = 1 << 18
#: Tokens of the shortest run that counts as repeated (a power of two), and the different pages that must hold it: so
#: many at least, and so large a part of all. Passages that a few pages quote are no template.
RUN, PAGES, SHARE = 8, 3, 0.1
#: A block is boilerplate when so large a part of its tokens lies in repeated runs.
COVERED = 0.8

# Names of HTML elements by what they do to text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
CHROME = frozenset("head nav footer aside form button select option dialog menu template svg canvas audio video object".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Parts of class names and ids of what is not the article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs topbar masthead footer share sharing social related recommended pagination pager widget toolbar".split()
)
COMMENTS = frozenset("comment comments respond disqus reply replies discussion".split())
NEGATED = frozenset("has with no without".split())
BODIES = frozenset("article articlebody post story entry content".split())

_NEXT = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)(>?)|[!?/])")
_IN_TAG = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PARTS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Place(NamedTuple):
    """Where text stands: in something that is no article, how surely within the article (0 to 3), in a paragraph."""

    chrome: bool = False
    comments: bool = False
    body: int = 0
    prose: bool = False


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _names(attributes: dict[str, str]) -> Iterator[set[str]]:
    """The parts of each class name and id, but for names like has-sidebar."""
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = set(_PARTS.findall(_CAMEL.sub("-", name).lower()))
        if not parts & NEGATED:
            yield parts


@lru_cache(maxsize=1 << 14)
def _enter(name: str, tag: str, around: Place) -> Place:
    """Where the text of an element stands, given the rest of its tag and where it stands itself."""
    attributes = _attributes(tag)
    parts = set().union(*_names(attributes)) if attributes else set()
    comments = around.comments or (name not in ("html", "body", "main") and bool(parts & COMMENTS))
    body = 3 if name == "article" or "articleBody" in attributes.get("itemprop", "") else 2 if name == "main" or attributes.get("role") == "main" else 1 if name in ("div", "section", "td") and parts & BODIES else 0
    chrome = name in CHROME or (name == "header" and not around.body) or "hidden" in attributes or attributes.get("aria-hidden") == "true"
    chrome = chrome or attributes.get("role", "").lower() in ROLES or bool(_HIDDEN.search(attributes.get("style", "").lower()))
    if name not in ("html", "body", "main", "article"):
        chrome = chrome or bool(parts & HINTS) or ("header" in parts and not around.body)
    if body >= 2:
        return Place(chrome or comments, comments, max(body, around.body), False)
    return Place(around.chrome or chrome or comments, comments, max(body, around.body), around.prose or name in PROSE)


def page_blocks(page: str) -> list[tuple[list[str], Place]]:
    """A page's blocks in order: their words, with references decoded and split at white space.

    Markup of any kind is taken: what is left open ends with the page, an end tag without a start is passed over, and
    an article that begins inside a menu ends the menu. Time is linear in the page.
    """
    out: list[tuple[list[str], Place]] = []
    text: list[str] = []
    stack: list[tuple[str, Place]] = []
    opened: dict[str, int] = {}
    place, at, closed = Place(), 0, {'"': True, "'": True}

    def flush() -> None:
        if words := html.unescape("".join(text)).split():
            out.append((words, place))
        text.clear()

    def leave(name: str) -> None:
        nonlocal place
        while stack:
            last, before = stack.pop()
            opened[last] -= 1
            place = before
            if last == name:
                return

    while m := _NEXT.search(page, at):
        if at < m.start():
            text.append(page[at : m.start()])
        if m[1]:
            end = page.find("-->", m.start() + 2)
            at = len(page) if end < 0 else end + 3
            continue
        i, end = m.end(), m.end() if m[4] else -1
        while end < 0 and (found := _IN_TAG.search(page, i)):
            if found[0] == ">":
                end = found.end()
                break
            quote, i = found[0][-1], found.end()
            if closed[quote]:
                j = page.find(quote, i)
                closed[quote] = j >= 0
                i = max(i, j + 1)
        tag = page[m.end() : end - 1] if end > 0 else ""
        at = end if end > 0 else len(page)
        if not m[3]:
            continue
        name = m[3].lower()
        if name in BLOCKS:
            if text:
                flush()
        elif name == "br":
            text.append(" ")
        if m[2]:
            if opened.get(name):
                leave(name)
            continue
        if name in RAW:
            close = _ENDS[name].search(page, at)
            at = close.start() if close else len(page)
            continue
        if name in VOID:
            continue
        if name in BLOCKS and opened.get("p") and name not in ("td", "th"):
            leave("p")
        if name in ("article", "main") and opened.get("nav"):
            leave("nav")
        if name in ("li", "dd", "dt", "option", "tr", "td", "th") and stack and stack[-1][0] == name:
            leave(name)
        if tag.endswith("/") and name not in BLOCKS:
            continue
        inside = _enter(name, tag, place)
        if name not in BLOCKS and inside == place:
            continue  # an unclosed <b> stands for nothing
        stack.append((name, place))
        opened[name] = opened.get(name, 0) + 1
        place = inside
    text.append(page[at:])
    flush()
    return out


def _runs(streams: list[np.ndarray], kinds: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all tokens in the joined streams, equal runs of RUN tokens next to each other; where each such class
    begins among them, and how many kinds hold it.

    The streams are joined, with a mark of its own after each page, into one text whose suffixes are sorted by prefix
    doubling as far as RUN tokens; equal neighbours are the repeated runs, longer ones being unions of these.
    """
    joined = np.concatenate([np.append(s, 0) for s in streams])
    numbers = np.unique(joined, return_inverse=True)[1].astype(np.int64)
    ends = np.cumsum([len(s) + 1 for s in streams]) - 1
    numbers[ends] = int(numbers.max()) + 1 + np.arange(len(ends))
    owner = np.repeat(np.asarray(kinds), [len(s) + 1 for s in streams])
    rank, step = numbers + 1, 1
    while step < RUN:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + len(joined) + 2) + after, return_inverse=True)[1] + 1
        step *= 2
    suffixes = np.lexsort((owner, rank))
    ordered, owners = rank[suffixes], owner[suffixes]
    first = np.flatnonzero(np.diff(ordered, prepend=0))
    other = np.concatenate([[False], (ordered[1:] == ordered[:-1]) & (owners[1:] != owners[:-1])])
    return suffixes, first, np.add.reduceat(other.astype(np.int64), first) + 1


def _covered(starts: np.ndarray, size: int) -> np.ndarray:
    """Whether each of size tokens lies in one of the runs that begin at starts."""
    edges = np.zeros(size + RUN + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + RUN, -1)
    return np.cumsum(edges)[:size] > 0


def repeated_tokens(streams: list[np.ndarray], kinds: list[int]) -> list[np.ndarray]:
    """For each page's tokens, whether they lie in a run of RUN or more that pages of several kinds hold."""
    suffixes, first, held = _runs(streams, kinds)
    several = held >= max(PAGES, SHARE * len(set(kinds)))
    sizes = [len(s) for s in streams]
    covered = _covered(suffixes[np.repeat(several, np.diff(first, append=len(suffixes)))], len(suffixes))
    ends = np.cumsum(np.asarray(sizes) + 1)
    return [covered[e - n - 1 : e - 1] for e, n in zip(ends.tolist(), sizes, strict=True)]


def _kind(tokens: np.ndarray) -> int:
    """The least hash of the runs of five tokens of a page's paragraphs: mostly the same for copies and near copies."""
    mixed = (tokens.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    runs = sum((mixed[k : max(k, len(mixed) - 4 + k)] << np.uint64(k) for k in range(5)), np.zeros(max(0, len(mixed) - 4), np.uint64)) if len(mixed) > 4 else mixed
    runs = (runs ^ (runs >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return int(runs.min(initial=(1 << 64) - 1) >> np.uint64(1))


def _undecided(places: list[Place]) -> bool:
    """Whether what other pages repeat can change which of a page's blocks are kept."""
    surest = max((p.body for p in places if not p.chrome), default=0)
    return any(not p.chrome and p.body >= surest and (surest == 0 or not p.prose) for p in places)


def _article(blocks: list[tuple[list[str], Place]], covered: list[float]) -> str:
    """The blocks to keep. Where markup names the article, its paragraphs stay and other repeated blocks go; where it
    does not, repeated blocks go, paragraphs among them only before the first and after the last of the page's own."""
    surest = max((p.body for _, p in blocks if not p.chrome), default=0)
    mine = [k for k, (_, p) in enumerate(blocks) if not p.chrome and p.body >= surest]
    own = [k for k in mine if covered[k] < COVERED]
    prose = [k for k in own if blocks[k][1].prose]
    low, high = (prose[0], prose[-1]) if prose else (len(blocks), -1)
    kept = [k for k in mine if covered[k] < COVERED or (blocks[k][1].prose and (surest > 0 or low < k < high))]
    return " ".join(w for k in kept for w in blocks[k][0])


class _Words(dict):
    """Hashes of words, the same in every task."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = number = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        return number

    def of(self, words: Iterable[str], count: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, count)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page_id, url, html) to (host, page_id, url, kind, mark, text, size, open).

    text has a line for each block, led by a letter for its place, and is compressed (size: before). open: whether
    repeated runs can decide on any of the page's blocks.
    """
    hashes = _Words()
    for batch in batches:
        kinds, marks, texts, sizes, open_ = [], [], [], [], []
        for page in batch.column(3).to_pylist():
            blocks = page_blocks(page)
            text = "\n".join(" ".join([chr(65 + p.body + 4 * p.prose + 8 * p.chrome), *words]) for words, p in blocks).encode("utf-8", "surrogatepass")
            texts.append(_zstd().compress(text, asbytes=True) if text else b"")
            sizes.append(len(text))
            open_.append(_undecided([p for _, p in blocks]))
            inside = [words for words, p in blocks if p.prose and not p.chrome] or [words for words, _ in blocks]
            kinds.append(_kind(hashes.of(chain.from_iterable(inside), sum(map(len, inside)))))
            marks.append(int.from_bytes(blake2b(text, digest_size=8).digest(), "little", signed=True))
        columns = [*(batch.column(k) for k in range(3)), pa.array(kinds, pa.int64()), pa.array(marks, pa.int64()), pa.array(texts, pa.binary()), pa.array(sizes, pa.int64()), pa.array(open_, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "page_id", "url", "kind", "mark", "text", "size", "open"])
    release_memory()


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=5)


_PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _pack(pages: list[tuple]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _PAGES, options=pa.ipc.IpcWriteOptions(compression=_zstd())) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pages, strict=True), _PAGES, strict=True)], schema=_PAGES))
    return sink.getvalue().to_pybytes()


def _unpack(pages: bytes) -> list[tuple[int | None, str | None, list[list[str]]]]:
    """Each page's id, url and blocks, a block's first word being the letter of its place."""
    table = pa.ipc.open_stream(pages).read_all()
    ids, urls, texts = (table.column(k).to_pylist() for k in range(3))
    return [(i, u, [line.split(" ") for line in t.split("\n")] if t else []) for i, u, t in zip(ids, urls, texts, strict=True)]


def _place(letter: str) -> Place:
    code = ord(letter) - 65
    return Place(chrome=code >= 8, body=code & 3, prose=bool(code & 4))


def _chunks(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by host and shard; one row for each shard, or for some 2 * most bytes of a larger one."""

    def chunk(key: tuple, part: int, rows: list[tuple]) -> pa.RecordBatch:
        pages = _pack([(i, u, _zstd().decompress(t, size, asbytes=True).decode("utf-8", "surrogatepass") if size else "") for i, u, _, _, t, size, _ in rows])
        longs = pa.list_(pa.int64())
        columns = [pa.array([key[0]]), pa.array([(key[1] << 32) + part], pa.int64()), pa.array([[r[2] for r in rows]], longs), pa.array([[r[3] for r in rows]], longs), pa.array([pages]), pa.array([any(r[6] for r in rows)])]
        return pa.RecordBatch.from_arrays(columns, names=["host", "chunk", "kinds", "marks", "pages", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, size, rows = None, 0, 0, []
        for batch in batches:
            for host, shard, *row in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                if rows and (key != (host, shard) or size > 2 * most):
                    yield chunk(key, part, rows)
                    part, size, rows = (part + 1, 0, []) if key == (host, shard) else (0, 0, [])
                elif key != (host, shard):
                    part = 0
                key, size = (host, shard), size + row[5]
                rows.append(tuple(row))
        if rows:
            yield chunk(key, part, rows)
        release_memory()

    return run


_MIX = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(64)]


def _run_hashes(tokens: np.ndarray) -> np.ndarray:
    """A hash of each run of RUN tokens, by where it begins."""
    n, own = max(0, len(tokens) - RUN + 1), tokens.astype(np.int64).view(np.uint64)
    return sum((own[k : k + n] * _MIX[k] for k in range(RUN)), np.zeros(n, np.uint64)).view(np.int64)


def _streams(hashes: _Words, pages: list) -> list[np.ndarray]:
    return [hashes.of(chain.from_iterable(b[1:] for b in blocks), sum(len(b) - 1 for b in blocks)) for _, _, blocks in pages]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, pages, places, kinds) to (host, run): runs that so large a part of a chunk's kinds hold as of all the host's must."""
    hashes = _Words()
    for batch in batches:
        for host, pages, places, kinds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            whole = _unpack(pages)
            streams = [s for s in _streams(hashes, [whole[k] for k in places]) if len(s) >= RUN]
            if not streams:
                continue
            suffixes, first, held = _runs(streams, list(range(len(streams))))
            starts = suffixes[first[held >= max(PAGES, SHARE * kinds) * len(places) / kinds - 1e-9]]
            found = np.concatenate([np.append(_run_hashes(s), np.zeros(RUN, np.int64)) for s in streams])
            inside = np.concatenate([np.arange(len(s) + 1) <= len(s) - RUN for s in streams])
            runs = np.unique(found[starts[inside[starts]]])
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(runs), pa.string()), pa.array(runs, pa.int64())], names=["host", "run"])
    release_memory()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, pages, places, runs) to (host, run, n): how many of a chunk's kinds hold each run."""
    hashes = _Words()
    for batch in batches:
        for host, pages, places, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            whole, asked = _unpack(pages), np.asarray(asked, np.int64)
            held = [np.unique(h[np.isin(h, asked)]) for h in map(_run_hashes, _streams(hashes, [whole[k] for k in places]))]
            runs, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(runs), pa.string()), pa.array(runs, pa.int64()), pa.array(n, pa.int64())], names=["host", "run", "n"])
    release_memory()


def _articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pages, runs) to the main text of a chunk's pages."""
    hashes = _Words()
    for batch in batches:
        for pages, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            whole, asked, texts = _unpack(pages), np.asarray(runs or [], np.int64), []
            for page in whole:
                blocks = [(b[1:], _place(b[0])) for b in page[2]]
                covered = [0.0] * len(blocks)
                if len(asked) and _undecided([p for _, p in blocks]):
                    tokens = _streams(hashes, [page])[0]
                    own = _covered(np.flatnonzero(np.isin(_run_hashes(tokens), asked)), len(tokens))
                    sums, ends = np.concatenate([[0], np.cumsum(own)]), np.cumsum([len(words) for words, _ in blocks], dtype=np.int64)
                    covered = [(sums[e] - sums[e - len(words)]) / len(words) for e, (words, _) in zip(ends.tolist(), blocks, strict=True)]
                texts.append(_article(blocks, covered))
            columns = [pa.array([p[0] for p in whole], pa.int64()), pa.array([p[1] for p in whole], pa.string()), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])
    release_memory()


def _repeated(chunks: DataFrame) -> DataFrame:
    """(host, runs): what PAGES different pages of a host and a tenth of all hold, exactly, however its pages are dealt.

    Of pages of one kind the one of the least mark counts, so counts of chunks add up. A run that holds enough of a host
    holds as large a part of some chunk: each chunk's suffix array names its candidates, and those are counted in all.
    Hosts of which markup decides every block are not looked at.
    """
    asking = materialize(chunks.groupBy("host").agg(F.max("open").alias("open")).filter("open").select("host"))
    chunks = chunks.drop("open").join(broadcast_if_small(asking, 200), "host", "left_semi")
    each = chunks.select("host", "chunk", F.posexplode(F.arrays_zip("kinds", "marks")))
    first = each.groupBy("host", "col.kinds").agg(F.min(F.struct("col.marks", "chunk", "pos")).alias("f"))
    places = materialize(first.groupBy("host", F.col("f.chunk").alias("chunk")).agg(F.collect_list("f.pos").alias("places")))
    sizes = places.groupBy("host").agg(F.sum(F.size("places")).cast("long").alias("all_kinds"))
    own = materialize(places.join(sizes, "host"))
    bytes_ = own.agg(F.sum(100 + 4 * F.size("places"))).first()[0] or 0
    met = chunks.drop("kinds", "marks").join(F.broadcast(own) if bytes_ <= BROADCAST_BYTES else own, ["host", "chunk"])
    asked = met.select("host", "pages", "places", "all_kinds").mapInArrow(_candidates, "host string, run long").distinct()
    asked = _by_host(asked.groupBy("host").agg(F.collect_list("run").alias("runs")))
    held = met.join(asked, "host").select("host", "pages", "places", "runs").mapInArrow(_counts, "host string, run long, n long")
    enough = held.groupBy("host", "run").agg(F.sum("n").alias("n")).join(sizes, "host").filter(F.col("n") >= F.greatest(F.lit(PAGES), SHARE * F.col("all_kinds")))
    return _by_host(enough.groupBy("host").agg(F.collect_list("run").alias("runs")))


def _by_host(runs: DataFrame) -> DataFrame:
    """Written, and broadcast if small."""
    table = materialize(runs)
    bytes_ = table.agg(F.sum(100 + 8 * F.size("runs"))).first()[0] or 0
    return F.broadcast(table) if bytes_ <= BROADCAST_BYTES else table


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per page: page_id, url, text (the article's), n_chars.

    Markup gives a page's blocks and where they stand. Runs of RUN or more tokens that PAGES different pages and a tenth of
    all of a host's hold are repeated, and blocks that lie in such runs are boilerplate. Where an element names the
    article (article, main, the item's body, a class that says so), that element counts, less menus, forms and the like
    inside it; its paragraphs stay even if other pages quote them. Of copies of a page one counts, so an article is not
    lost for being there twice.

    A page is parsed once. Hosts are cut into shards of some shard_bytes by a hash of the row, each shard's tokens are one
    text with a suffix array, and a host's runs are counted over all its shards: results do not depend on the cut.

    Nulls: a null html is empty and its text too; pages without a url or a host are taken as one host; null ids stay. Rows
    that repeat are extracted each. An empty table gives an empty table. Other columns are ignored, whatever their
    names. Ids must be numbers. A page of any length is held whole, in linear time.
    """
    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(host.alias("host"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    sizes = pages.select(host.alias("host"), F.octet_length(html_col).alias("bytes")).groupBy("host").agg(F.sum("bytes").alias("bytes"))
    large = materialize(sizes.filter(F.col("bytes") > shard_bytes).select("host", F.ceil(F.col("bytes") / shard_bytes).alias("shards")))
    sides = F.broadcast(large) if large.count() * 200 <= BROADCAST_BYTES else large
    parsed = rows.mapInArrow(_parsed, "host string, page_id long, url string, kind long, mark long, text binary, size long, open boolean")
    shard = F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("shards")), F.lit(0).cast("long"))
    dealt = parsed.join(sides, "host", "left").select("host", shard.alias("shard"), "page_id", "url", "kind", "mark", "text", "size", "open")
    together = dealt.repartition("host", "shard").sortWithinPartitions("host", "shard")
    chunks = materialize(together.mapInArrow(_chunks(shard_bytes), "host string, chunk long, kinds array<long>, marks array<long>, pages binary, open boolean"))
    return chunks.select("host", "pages").join(_repeated(chunks), "host", "left").select("pages", "runs").mapInArrow(_articles, "page_id long, url string, text string, n_chars long")
