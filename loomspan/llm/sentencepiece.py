"""SentencePiece encoding and decoding by suffix-array matching, for byte-pair models with byte fallback.

The model file is a SentencePiece protocol buffer; only its piece table and flags are read, by the few lines of wire
format below, so executors need nothing but numpy.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.plans.storage import release_memory, small_batches

# Fixed values of the format: the space mark, and the kinds of pieces.
SPACE = "▁"
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
#: Characters of text that are taken together, of new words that are indexed together, and words that a worker remembers.
TEXT_CHARS, BATCH_CHARS, CACHED_WORDS = 500_000, 250_000, 200_000
#: Words beyond this many characters are relaxed by a heap, and the longest piece that a model may have.
LONG, LONGEST = 256, 62
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if tag & 7 == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[str]
    kinds: list[int]
    scores: list[float]
    dummy_prefix: bool = True
    # derived
    merge: np.ndarray = field(init=False)  # ids of pieces that a merge may form
    codes: np.ndarray = field(init=False)  # their code points, padded with zeros
    chars: np.ndarray = field(init=False)  # the characters of all pieces, and where each piece's are among them
    spelling: np.ndarray = field(init=False)
    lengths: np.ndarray = field(init=False)
    rank: np.ndarray = field(init=False)  # of each id: its place by falling score
    byte_ids: list[int] = field(init=False)
    raw: list[bytes] = field(init=False)

    def __post_init__(self) -> None:
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER_DEFINED)]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in usable):
            raise ValueError("a piece spans words")  # words could then not be encoded apart
        if any(len(self.pieces[i]) > LONGEST for i in usable):
            raise ValueError(f"a piece is longer than {LONGEST} characters")
        self.merge = np.array(usable, np.int32)
        self.lengths = np.array([len(self.pieces[i]) for i in usable])
        self.codes = np.zeros((len(usable), int(self.lengths.max())), np.uint32)
        for row, i in enumerate(usable):
            self.codes[row, : self.lengths[row]] = [*map(ord, self.pieces[i])]
        self.chars, self.spelling = np.unique(self.codes, return_inverse=True)  # the first is the padding
        self.spelling = self.spelling.reshape(self.codes.shape)
        _, self.rank = np.unique(-np.array(self.scores), return_inverse=True)
        unknown = self.kinds.index(UNKNOWN)
        at = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.byte_ids = [at.get(f"<0x{b:02X}>", unknown) for b in range(256)]
        self.raw = [b"" if k not in (NORMAL, USER_DEFINED) else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        for b, i in enumerate(self.byte_ids):
            if i != unknown:
                self.raw[i] = bytes([b])

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, kinds, scores, prefix = [], [], [], True
        for number, value in _fields(data):
            if number == 1:
                entry = dict(_fields(value))
                pieces.append(entry[1].decode())
                scores.append(struct.unpack("<f", entry.get(2, b"\0\0\0\0"))[0])
                kinds.append(entry.get(3, NORMAL))
            elif number == 3:
                normaliser = dict(_fields(value))
                prefix = bool(normaliser.get(3, 1))
                if normaliser.get(2) or normaliser.get(4, 1):
                    raise ValueError("only models that keep texts as they are can be read back exactly")
            elif number == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("a byte-pair model is needed")
        return cls(pieces, kinds, scores, prefix)


def _pack(symbols: np.ndarray, bits: int, beyond: int = 0) -> np.ndarray:
    """Rows of symbols (rows, characters) as sortable 64-bit words, the first character highest, beyond past the end."""
    per = 64 // bits
    symbols = np.pad(symbols, ((0, 0), (0, -symbols.shape[1] % per)), constant_values=beyond).astype(np.uint64)
    shifts = (np.arange(per - 1, -1, -1) * bits).astype(np.uint64)
    return np.bitwise_or.reduce(symbols.reshape(len(symbols), -1, per) << shifts, axis=2)


def _suffix_keys(symbols: np.ndarray, longest: int, bits: int) -> np.ndarray:
    """Of each position the next longest characters, packed; past the end counts as zero."""
    per = 64 // bits
    width = -(-longest // per)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(per * width, np.uint64)])
    n = len(symbols)
    word = padded[: n + per * (width - 1)].copy()
    for c in range(1, per):
        word = (word << np.uint64(bits)) | padded[c : c + len(word)]
    return np.stack([word[per * w : per * w + n] for w in range(width)], axis=1)


def _search(suffixes: np.ndarray, keys: np.ndarray, through: bool = False) -> np.ndarray:
    """For each key the number of sorted suffixes below it (through: up to it).

    The first words are searched at once; keys whose further words matter go on within the suffixes of equal first word.
    """
    first = np.ascontiguousarray(suffixes[:, 0])
    side = ("left", "right")[through]
    found = np.searchsorted(first, keys[:, 0], side)
    rest = np.flatnonzero((keys[:, 1:] != (keys.max() if through else 0)).any(axis=1)) if keys.shape[1] > 1 else []
    if len(rest):
        keys = keys[rest]
        lo, hi = np.searchsorted(first, keys[:, 0], "left"), np.searchsorted(first, keys[:, 0], "right")
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            probe = suffixes[np.minimum(mid, len(suffixes) - 1)]
            less, tied = np.zeros(len(keys), bool), np.ones(len(keys), bool)
            for w in range(1, keys.shape[1]):
                less |= tied & (probe[:, w] < keys[:, w])
                tied &= probe[:, w] == keys[:, w]
            if through:
                less |= tied
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        found[rest] = lo
    return found


def match_pieces(model: Model, codes: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences of pieces in the indexed text as edges (start, length, piece), sorted by position.

    Characters become ranks in the text's own alphabet (separators zero), so a word of the key holds many of them.
    The suffix array sorts positions by as many characters as the longest piece has; each piece's occurrences are
    the range between two binary searches. Pieces with characters that the text lacks occur nowhere.
    """
    alphabet = np.unique(np.delete(codes, separators))
    bits = 8 if len(alphabet) < 255 else 16 if len(alphabet) < 65535 else 21
    symbols = np.searchsorted(alphabet, codes).astype(np.uint32) + np.uint32(1)
    symbols[separators] = 0
    rank = np.searchsorted(alphabet, model.chars)
    known = np.append(alphabet, np.uint32(0))[rank] == model.chars
    known[0] = True  # padding
    rank = np.where(known, rank + 1, 0).astype(np.uint32)
    rank[0] = 0
    present = known[model.spelling].all(axis=1)
    ids, lengths, spelling = model.merge[present], model.lengths[present], model.spelling[present]
    low = rank[spelling]
    top = (1 << bits) - 1
    high = np.where(spelling > 0, low, np.uint32(top))  # no suffix that begins with the piece is above

    keys = _suffix_keys(symbols, model.codes.shape[1], bits)
    order = np.lexsort(tuple(keys[:, w] for w in range(keys.shape[1] - 1, -1, -1)))
    suffixes = keys[order]
    first = _search(suffixes, _pack(low, bits))
    count = _search(suffixes, _pack(high, bits, top), through=True) - first
    piece = np.repeat(np.arange(len(count)), count)
    start = order[np.arange(len(piece)) + np.repeat(first - (np.cumsum(count) - count), count)]
    edges = np.sort((start << 32) | (lengths[piece] << 24) | piece)  # by position, then length
    piece = edges & 0xFFFFFF
    return edges >> 32, lengths[piece], ids[piece]


@dataclass
class Edges:
    """Edges sorted by position as a graph: of each position the lengths that pieces have there, as bits, and where its
    edges begin. One word and one number per character, whatever the longest piece."""

    lengths: np.ndarray
    first: np.ndarray
    piece: np.ndarray
    cost: np.ndarray

    @classmethod
    def of(cls, model: Model, codes: np.ndarray, separators: np.ndarray) -> Edges:
        start, length, piece = match_pieces(model, codes, separators)
        counts = np.bincount(start, minlength=len(codes))
        first = np.cumsum(counts) - counts
        bits = np.zeros(len(codes), np.uint64)
        at = np.flatnonzero(counts)
        if len(at):
            bits[at] = np.bitwise_or.reduceat(np.uint64(1) << length.astype(np.uint64), first[at])
        none = np.int32(np.iinfo(np.int32).max)
        return cls(bits, first.astype(np.int32), np.append(piece, -1).astype(np.int32), np.append(model.rank[piece], none).astype(np.int32))

    def at(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Places of the edges (start, length); the last place stands for none."""
        bit = np.uint64(1) << np.minimum(length, LONGEST + 1).astype(np.uint64)
        bits = self.lengths[start]
        place = self.first[start] + np.bitwise_count(bits & (bit - np.uint64(1)))
        return np.where(bits & bit != 0, place, len(self.piece) - 1)


def _relax_long(edges: Edges, begin: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of one long word: the best edge over two adjoining symbols, leftmost among equals, from a heap."""
    bits, first, cost = edges.lengths[begin : begin + size].tolist(), edges.first[begin : begin + size].tolist(), edges.cost
    span, left = [1] * size, [*range(-1, size)]
    pairs = np.arange(begin, begin + size - 1)
    place = edges.at(pairs, np.full(len(pairs), 2))
    there = np.flatnonzero(place < len(edges.piece) - 1)
    # one number per candidate: rank, then position, then length
    heap = ((cost[place[there]].astype(object) << 44) | (there.astype(object) << 8) | 2).tolist()
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        entry = pop(heap)
        i, length = entry >> 8 & 0xFFFFFFFFF, entry & 0xFF
        one = span[i]
        j = i + one
        if not one or j >= size or one + span[j] != length:
            continue  # one of the two has been merged since
        span[i], span[j] = length, 0
        after = i + length
        if after <= size:
            left[after] = i
        for at, n in ((i, length + span[after] if after < size else 0), (left[i], span[left[i]] + length if i else 0)):
            if n and n <= LONGEST and bits[at] >> n & 1:
                place = first[at] + (bits[at] & (1 << n) - 1).bit_count()
                push(heap, int(cost[place]) << 44 | at << 8 | n)
    spans = np.array(span, np.int32)
    starts = np.flatnonzero(spans)
    return (starts + begin).astype(np.int32), spans[starts]


def encode_words(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all words (runs of space marks and what follows), and where each word's ids end.

    The words are one indexed text, a separator after each. Edges are relaxed in rounds: in every word at once, the
    edge of the best score that covers two adjoining symbols, leftmost among equals, replaces them, until none is
    left; this is the order in which byte-pair merges apply. Words of more than LONG characters take their edges from
    a heap in the same order, in time of about their length. Symbols without a piece fall back to bytes.
    """
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    codes = np.frombuffer("\x00".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([*map(len, words)])
    begin = np.cumsum(size + 1) - (size + 1)
    separators = begin + size
    edges = Edges.of(model, codes, separators)

    long = size > LONG
    done = [_relax_long(edges, b, n) for b, n in zip(begin[long].tolist(), size[long].tolist(), strict=True)]
    word = np.repeat(np.arange(len(words), dtype=np.int32), size)
    symbol = np.delete(np.arange(len(codes), dtype=np.int32), separators)[~long[word]]  # where each symbol starts
    word = word[~long[word]]
    span = np.ones(len(symbol), np.int32)
    none = edges.cost[-1]
    while len(symbol):
        joined = span[:-1] + span[1:]
        joined[word[:-1] != word[1:]] = LONGEST + 1
        cost = np.append(edges.cost[edges.at(symbol[:-1], joined)], none)
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        counts = np.diff(np.append(heads, len(word)))
        best = np.minimum.reduceat(cost, heads)
        active = best < none
        if not active.all():  # finished words leave the rounds
            stays = np.repeat(active, counts)
            done.append((symbol[~stays], span[~stays]))
            symbol, span, word, cost, best, counts = symbol[stays], span[stays], word[stays], cost[stays], best[active], counts[active]
            if not len(symbol):
                break
        hit = np.flatnonzero(cost == np.repeat(best, counts))
        hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]  # the leftmost of each word
        span[hit] += span[hit + 1]
        keep = np.ones(len(symbol), bool)
        keep[hit + 1] = False
        symbol, span, word = symbol[keep], span[keep], word[keep]
    starts, spans = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(starts)
    starts, spans = starts[order], spans[order]
    ids = edges.piece[edges.at(starts, spans)]
    missing = np.flatnonzero(ids < 0)
    if len(missing):  # symbols without a piece become bytes
        raw = [chr(c).encode("utf-8", "replace") for c in codes[starts[missing]].tolist()]
        width = np.ones(len(ids), np.int64)
        width[missing] = [*map(len, raw)]
        starts, ids = np.repeat(starts, width), np.repeat(ids, width)
        ids[ids < 0] = [model.byte_ids[b] for r in raw for b in r]
    return ids, np.searchsorted(starts, separators)


class Codec:
    """Encodes and decodes whole texts. Words are remembered in two generations, so those in use outlive the rare ones
    and memory stays bounded."""

    def __init__(self, model: Model) -> None:
        self.model, self.known, self.older = model, {}, {}

    def _learn(self, words: list[str]) -> None:
        a = 0
        while a < len(words):
            b, chars = a, 0
            while b < len(words) and (chars < BATCH_CHARS or b == a):
                chars += len(words[b]) + 1
                b += 1
            ids, ends = encode_words(self.model, words[a:b])
            raw, cuts = ids.astype(np.int32).tobytes(), (ends * 4).tolist()
            self.known.update(zip(words[a:b], map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
            a = b

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        prefix = " " if self.model.dummy_prefix else ""
        split = [_WORD.findall((prefix + t).replace(" ", SPACE)) if t else [] for t in texts]
        wanted = set().union(*split)
        if len(self.known) > CACHED_WORDS // 2:
            self.known, self.older = {}, self.known
        fresh = []
        for w in wanted.difference(self.known):
            if w in self.older:
                self.known[w] = self.older[w]
            else:
                fresh.append(w)
        self._learn(fresh)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.model.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def load_model(spark: SparkSession, path: str) -> Model:
    """Read the model file through Spark, so it may lie in any store that Spark reads."""
    if "://" not in path:
        path = f"file://{path}"
    return Model.parse(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def encode_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_bytes, ids_sha256, round_trip; with ids, and decoded text, if wanted.

    ids are those of the model's byte-pair merges with byte fallback and the model's space prefix; n_bytes counts
    byte-fallback tokens; ids_sha256 is the digest of the ids as little-endian 32-bit integers; decoding maps pieces
    back, and round_trip tells whether it gives the whole text again (the space mark itself reads back as a space).

    Nulls: a null or empty text has no tokens and decodes to the empty text. A null id keeps its row. Repeated rows
    keep their own rows. Long texts, and long words without a break, are encoded whole, in time and memory of about
    their length. Ids must be numbers. An empty table gives an empty table. Other columns are ignored, whatever their
    names.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_())]
    names += [("ids", pa.list_(pa.int32()))] * with_ids + [("decoded", pa.string())] * with_text
    schema = pa.schema(names)
    held: list[Codec] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Codec(shared.value))
        codec = held[0]
        is_byte = np.zeros(len(codec.model.pieces), bool)
        is_byte[codec.model.byte_ids] = True
        def flush(names: list, texts: list[str]) -> pa.RecordBatch:
            ids = codec.encode(texts)
            decoded = [codec.decode(i) for i in ids]
            same = [d == t.replace(SPACE, " ") for d, t in zip(decoded, texts, strict=True)]
            columns = [names, [len(i) for i in ids], [int(is_byte[i].sum()) for i in ids], [hashlib.sha256(i.astype("<i4").tobytes()).hexdigest() for i in ids], same]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)]
            if with_ids:
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))
            arrays += [pa.array(decoded, pa.string())] * with_text
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        names, texts, chars = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                texts.append(text or "")
                chars += len(texts[-1])
                if chars >= TEXT_CHARS:
                    yield flush(names, texts)
                    names, texts, chars = [], [], 0
        if names:
            yield flush(names, texts)
        held.clear()
        release_memory()

    kinds = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.int32()): "array<int>"}
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))
