"""Collocations: phrases whose words go together, by merged count-min sketches and an exact second pass."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.llm.exact_dedup import golomb_decode, golomb_encode
from loomspan.plans.storage import materialize, release_memory, scratch, small_batches

#: Phrases of 2 to LONGEST words are candidates from LEAST occurrences on.
LONGEST, LEAST = 3, 10
#: A candidate goes if a longer one that contains it has this share of its occurrences, in hundredths.
SUBSUMED = 50
BEST = 2000
#: Rows of the sketch, the bits of a row's width (as the texts' bytes ask for, within these), and cells of a message.
DEPTH, NARROW, WIDE, BLOCK_BITS = 2, 16, 27, 16
#: Words that are counted at a time, and bytes of a text that are cut into words at a time.
CHUNK, SEGMENT = 1 << 20, 1 << 20

SEED = 42
_RANDOM = np.random.default_rng(SEED)
_PLACES = _RANDOM.integers(0, 1 << 64, LONGEST, np.uint64) | np.uint64(1)
_ROWS = _RANDOM.integers(0, 1 << 64, DEPTH, np.uint64) | np.uint64(1)
#: Letters A-Z become small, tabs blanks, and what ends a piece a byte that UTF-8 never has.
_TABLE = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def _segments(text: bytes) -> Iterator[bytes]:
    """A text in parts that end where a word does."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SEGMENT)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


class _Vocabulary(dict):
    """Numbers of words, from 0 on as they come; the end of a piece is 0."""

    def __init__(self):
        super().__init__({b"\xff": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Held:
    """Words of one language that wait to be counted."""

    def __init__(self):
        self.words, self.numbers, self.size, self.known = _Vocabulary(), [], 0, 0

    def add(self, words: list[bytes]) -> None:
        self.numbers.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def rest(self) -> _Held:
        """What the next words of the same piece need: the last words, whose own phrases are counted."""
        out, back = _Held(), list(self.words)
        out.add([back[i] for i in np.concatenate(self.numbers)[1 - LONGEST :].tolist()])
        out.known = out.size
        return out


def _chunks(batches: Iterator[pa.RecordBatch], work: Callable[[str, _Held], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """work(lang, words) for every CHUNK words of a language, and for what is left."""
    held: dict[str, _Held] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            for part in _segments(text.translate(_TABLE) + b"\xff"):
                own = held.setdefault(lang, _Held())
                own.add(part.replace(b"\xff", b" \xff ").split())
                if own.size >= CHUNK:
                    yield from work(lang, own)
                    held[lang] = own.rest()
        while sum(h.size for h in held.values()) > 2 * CHUNK:  # many languages
            lang = max(held, key=lambda x: held[x].size)
            yield from work(lang, held.pop(lang))  # a text has ended
    for lang, own in held.items():
        yield from work(lang, own)
    release_memory()


def _counted(held: _Held) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """For phrases of 1, 2, ... words: their distinct words' numbers, place by place, and how often each occurs."""
    numbers, base = np.concatenate(held.numbers), len(held.words)
    codes, new = numbers, np.arange(len(numbers)) >= held.known
    inside = numbers > 0
    for n in range(1, LONGEST + 1):
        if n > 1:
            codes = codes[:-1] * base + numbers[n - 1 :]  # below 2^63: a chunk has some 2^20 different words
            inside = inside[:-1] & (numbers[n - 1 :] > 0)
        distinct, counts = np.unique(codes[inside & new[n - 1 :]], return_counts=True)
        places = []
        for _ in range(n):
            distinct, last = np.divmod(distinct, base)
            places.insert(0, last)
        yield places, counts


def _hashes(lang: str, held: _Held) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode(), SEED)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in held.words), np.uint64, len(held.words))


def _phrase_hash(words: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(places[0]), len(places), np.uint64)
    for factor, place in zip(_PLACES, places, strict=False):
        out = (out ^ words[place]) * factor
        out ^= out >> np.uint64(29)
    return out


def _cells(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for factor in _ROWS:
        yield (hashes * factor >> np.uint64(64 - bits)).astype(np.int64)


def encode_counts(counts: np.ndarray) -> bytes:
    """Small counts, most of them 1: a bit for each that is not, then these."""
    more = counts != 1
    return np.packbits(more).tobytes() + counts[more].astype(np.uint8).tobytes()


def decode_counts(blob: bytes, n: int) -> np.ndarray:
    held = np.frombuffer(blob, np.uint8)
    more = np.unpackbits(held[: -(-n // 8)], count=n).view(bool)
    out = np.ones(n, np.int64)
    out[more] = held[-(-n // 8) :]
    return out


SENT = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])


def _sketch(bits: int):
    """A task's sketches: per chunk, row and block of cells, the cells that phrases fall in and their counts."""

    def of_chunk(lang: str, held: _Held) -> Iterator[pa.RecordBatch]:
        words, parts = _hashes(lang, held), list(_counted(held))
        hashes = np.concatenate([_phrase_hash(words, places) for places, _ in parts])
        counts = np.minimum(np.concatenate([c for _, c in parts]), LEAST)
        for row, cells in enumerate(_cells(hashes, bits)):
            keyed = np.sort(cells << 8 | counts)
            cells, few = keyed >> 8, (keyed & 255).astype(np.uint8)
            starts = np.flatnonzero(np.diff(cells >> BLOCK_BITS, prepend=-1))
            messages = []
            for a, b in pairwise([*starts.tolist(), len(cells)]):
                block = int(cells[a]) >> BLOCK_BITS
                k, blob = golomb_encode((cells[a:b] - (block << BLOCK_BITS)).astype(np.uint64), 0, 1 << BLOCK_BITS)
                messages.append((row, block, b - a, k, blob, encode_counts(few[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*messages, strict=True), SENT, strict=True)] if messages else [pa.array([], f.type) for f in SENT], schema=SENT)

    return lambda batches: _chunks(batches, of_chunk)


def _merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of all tasks' sketches over one block, as a bitmap of the cells that reach LEAST."""
    total = np.zeros(1 << BLOCK_BITS, np.int64)
    for batch in batches:
        for n, k, cells, counts in zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True):
            np.add.at(total, golomb_decode(cells, n, k, 0).astype(np.int64), decode_counts(counts, n))
    bits = np.packbits(total >= LEAST, bitorder="little").tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([bits], pa.binary())], names=["row", "block", "bitmap"])


def _survivors(bits: int, sketch):
    """Phrases that every row of the merged sketch lets pass, as words, with their exact counts in a chunk; and all words."""

    def of_chunk(lang: str, held: _Held) -> Iterator[pa.RecordBatch]:
        words, back = _hashes(lang, held), np.array(list(held.words), object)
        for places, counts in _counted(held):
            if len(places) == 1:
                yield _rows(lang, 0, [b""], counts.sum(keepdims=True))
            pass_all = np.ones(len(counts), bool)
            for row, cells in zip(sketch.value, _cells(_phrase_hash(words, places), bits), strict=True):
                pass_all &= row[cells >> 3] >> (cells & 7).astype(np.uint8) & 1 == 1
            own = [back[p[pass_all]] for p in places]
            yield _rows(lang, len(places), [b" ".join(p) for p in zip(*own, strict=True)], counts[pass_all])

    return lambda batches: _chunks(batches, of_chunk)


def _rows(lang: str, words: int, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([lang] * len(phrases), pa.string()), pa.array([words] * len(phrases), pa.int32()), pa.array(phrases, pa.binary()), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "words", "phrase", "n"])


def merged_sketch(texts: DataFrame, bits: int) -> list[np.ndarray]:
    """Each row's cells that reach LEAST over all texts (lang, text), as a bitmap: 2^WIDE bits a row at most."""
    parts = texts.mapInArrow(_sketch(bits), "row int, block int, n int, k int, cells binary, counts binary")
    merged = parts.groupBy("row", "block").applyInArrow(_merge, "row int, block int, bitmap binary")
    rows = [np.zeros(max(1, 1 << bits >> 3), np.uint8) for _ in range(DEPTH)]
    size = 1 << BLOCK_BITS >> 3
    for row, block, bitmap in merged.collect():  # as bounded as the broadcast
        rows[row][block * size : (block + 1) * size] = np.frombuffer(bitmap, np.uint8)[: len(rows[row])]
    return rows


def phrase_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", bits: int | None = None) -> DataFrame:
    """(lang, words, phrase, n) for all phrases of 1 to LONGEST words with LEAST or more occurrences, exact, written.

    One row of 0 words per language counts all its words.
    """
    small_batches(docs.sparkSession)
    lang, text = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(lang.alias("lang"), text.alias("text"))
    if bits is None:  # some two cells for each phrase that could be new
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        bits = min(WIDE, max(NARROW, math.ceil(math.log2(max(1, size) / 3))))
    sketch = docs.sparkSession.sparkContext.broadcast(merged_sketch(texts, bits))
    found = texts.mapInArrow(_survivors(bits, sketch), "lang string, words int, phrase binary, n long")
    exact = found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= LEAST) | (F.col("words") == 0))
    counts = materialize(exact.select("lang", "words", F.col("phrase").cast("string").alias("phrase"), "n"))
    sketch.destroy()
    return counts


def score_phrases(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all candidates, longer ones' parts dropped where they are subsumed."""
    of = lambda name, value: counts.filter("words > 0").select("lang", F.col("phrase").alias(name), F.col("n").alias(value))
    tokens = F.split("phrase", " ", -1)
    candidates = counts.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    join = lambda first, size: F.array_join(F.slice(tokens, first, size), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    scored = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    wide = "cast({} as decimal(38, 0))".format
    scored = scored.withColumn("score", F.expr(f"({wide(1_000_000)} * a * a) div ({wide('l')} * r)").cast("long"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # parts of every length of the longer candidates, each with the most frequent phrase that holds it
    size = F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size")
    within = candidates.filter("words > 2").select("lang", "phrase", "words", "a", size)
    within = within.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    holders = within.select("lang", F.array_join(F.slice(tokens, F.col("first"), F.col("size")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    kept = lowest.join(holders, ["lang", "phrase"], "left").filter(F.col("held").isNull() | (100 * F.col("held") < SUBSUMED * F.col("a")))
    totals = counts.filter("words = 0").select("lang", F.col("n"))  # a row a language
    return kept.join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", best: int = BEST, bits: int | None = None) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Tasks count the phrases of a million words at a time and send, Golomb-coded, what cells of a count-min sketch they fall in; each
    block of cells is summed by one task, message by message. A cell never counts less than a phrase in it has, so
    the phrases that all rows let pass include every frequent one; a second pass counts those exactly, by their words,
    summed per chunk and task before the shuffle. The sketch's rows hold at most 2^WIDE cells, 16 MB each as
    the bitmaps that are broadcast; texts of many billions of words fill them, more phrases then pass and are counted
    exactly, and the result stays the same.

    Nulls: a null language is `und`, a null text empty. A language without candidates has no row. Ties are broken by
    occurrences, then by the phrase's bytes. Repeated rows count each time. An empty table gives an empty table. Other
    columns are ignored, whatever their names. A text of any length is cut in segments; a single word is held whole.
    """
    with scratch() as keep:
        counts = keep(phrase_counts(docs, text_col=text_col, lang_col=lang_col, bits=bits))
        scored = keep(materialize(score_phrases(counts)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # each cell's best first, so that a language of any size is ranked by many tasks and the last one gets few rows
    cell = F.pmod(F.xxhash64("phrase"), F.lit(64))
    top = scored.withColumn("cell", cell).withColumn("place", F.row_number().over(W.partitionBy("lang", "cell").orderBy(*order))).filter(F.col("place") <= best)
    ranked = top.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
