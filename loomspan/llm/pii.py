"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.plans.storage import small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind's place in KINDS, end

# --- base patterns -------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can only begin where a run of digits begins, so runs are taken whole and nothing is scanned twice.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in text.split("."))


def valid_card(text: str) -> bool:
    digits = _digits(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each pattern, those that fail their test dropped."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:  # an address hangs on its @: the local part is the run before it, back to the last match at most
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if valid_ip(m[0])]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and valid_card(m[0])]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# --- the tagger ----------------------------------------------------------------------------------------------------

#: Outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
HIDDEN, EMBEDDING = 16, 12
WINDOW, STRIDE = 96, 64
#: Windows that a segment keeps, that it reaches further on each side, and that are decoded at a time.
SEGMENT, MARGIN, BLOCK = 64, 2, 512
#: Every kind holds a digit or an at-sign: windows that have none, and none beside them, cannot hold a plausible span.
CUES = re.compile("[0-9@]")
_CLASSES = ("\0", "a", "A", "0", "@", ".", "-", "_", "+", "(", ")", " ", "\n", ":", "/", ",", "\"'", "=", "%#$&*!|", "?")


def _class_table() -> np.ndarray:
    """Character classes of the first 256 code points; all others are letters."""
    table = np.full(256, len(_CLASSES) - 1, np.uint8)
    for c in range(1, 256):
        ch = chr(c)
        table[c] = 2 if ch.isupper() else 1 if ch.isalpha() else 3 if ch.isdigit() and c < 128 else next((i for i, s in enumerate(_CLASSES) if ch in s), len(_CLASSES) - 1)
    return table


TABLE = _class_table()


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 256, TABLE[np.minimum(codes, 255)], 1).astype(np.uint8)


@dataclass
class Tagger:
    embed: np.ndarray  # classes, EMBEDDING
    win: np.ndarray  # 2, EMBEDDING, 4*HIDDEN: forward and backward
    rec: np.ndarray  # 2, HIDDEN, 4*HIDDEN
    bias: np.ndarray  # 2, 1, 4*HIDDEN
    out: np.ndarray  # 2*HIDDEN, TAGS
    out_bias: np.ndarray  # TAGS
    trans: np.ndarray  # TAGS, TAGS

    @classmethod
    def fresh(cls, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        g = lambda *shape: rng.normal(0, 0.25, shape).astype(np.float32)
        bias = np.zeros((2, 1, 4 * HIDDEN), np.float32)
        bias[:, :, HIDDEN : 2 * HIDDEN] = 1  # remember at first
        return cls(g(len(_CLASSES), EMBEDDING), g(2, EMBEDDING, 4 * HIDDEN), g(2, HIDDEN, 4 * HIDDEN), bias, g(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _run(m: Tagger, x: np.ndarray, keep: bool = False):
    """Emissions (rows, time, TAGS) of class windows (rows, time); both directions advance in one batched step."""
    rows, time = x.shape
    lookup = np.einsum("ce,deg->dcg", m.embed, m.win) + m.bias  # the input's part of the gates, once per class
    both = np.stack([x, x[:, ::-1]])
    h, c = np.zeros((2, rows, HIDDEN), np.float32), np.zeros((2, rows, HIDDEN), np.float32)
    states = np.empty((time, 2, rows, HIDDEN), np.float32)
    tape = []
    direction = np.arange(2)[:, None]
    for t in range(time):
        gates = lookup[direction, both[:, :, t]] + h @ m.rec
        i, f, o = (_sigmoid(gates[..., k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(gates[..., 3 * HIDDEN :])
        before, c = c, f * c + i * g
        tanh_c = np.tanh(c)
        if keep:
            tape.append((h, before, i, f, o, g, tanh_c))
        h = o * tanh_c
        states[t] = h
    hidden = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1).transpose(1, 0, 2)
    emissions = hidden @ m.out + m.out_bias
    return (emissions, hidden, both, tape) if keep else emissions


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _gradients(m: Tagger, x: np.ndarray, y: np.ndarray) -> tuple[float, Tagger]:
    """Mean negative log-likelihood of the tag sequences, and its gradient: CRF marginals, then time unrolled."""
    rows, time = x.shape
    emissions, hidden, both, tape = _run(m, x, keep=True)
    alpha, beta = np.empty_like(emissions), np.zeros_like(emissions)
    alpha[:, 0] = emissions[:, 0]
    for t in range(1, time):
        alpha[:, t] = _lse(alpha[:, t - 1, :, None] + m.trans, 1) + emissions[:, t]
    for t in range(time - 2, -1, -1):
        beta[:, t] = _lse(m.trans + (emissions[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    z = _lse(alpha[:, -1], 1)
    at = np.arange(rows)[:, None]
    gold = emissions[at, np.arange(time), y].sum(1) + m.trans[y[:, :-1], y[:, 1:]].sum(1)
    d_em = np.exp(alpha + beta - z[:, None, None])
    d_em[at, np.arange(time), y] -= 1
    pairs = alpha[:, :-1, :, None] + m.trans + (emissions[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
    d_trans = np.exp(pairs).sum((0, 1))
    np.subtract.at(d_trans, (y[:, :-1], y[:, 1:]), 1)
    d_em /= rows
    d_hidden = d_em @ m.out.T
    d_states = np.stack([d_hidden[..., :HIDDEN].transpose(1, 0, 2), d_hidden[:, ::-1, HIDDEN:].transpose(1, 0, 2)], axis=1)
    d_lookup = np.zeros((2, len(_CLASSES), 4 * HIDDEN), np.float32)
    d_rec, dh, dc = np.zeros_like(m.rec), np.zeros((2, rows, HIDDEN), np.float32), np.zeros((2, rows, HIDDEN), np.float32)
    for t in range(time - 1, -1, -1):
        h0, c0, i, f, o, g, tanh_c = tape[t]
        dh = dh + d_states[t]
        dc = dc + dh * o * (1 - tanh_c**2)
        gates = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - g**2)], axis=-1)
        d_rec += h0.transpose(0, 2, 1) @ gates
        for d in range(2):
            np.add.at(d_lookup[d], both[d, :, t], gates[d])
        dh, dc = gates @ m.rec.transpose(0, 2, 1), dc * f
    d_win = np.einsum("ce,dcg->deg", m.embed, d_lookup)
    d_embed = np.einsum("dcg,deg->ce", d_lookup, m.win)
    d_out = np.einsum("rth,rtk->hk", hidden, d_em)
    return float((z - gold).mean()), Tagger(d_embed, d_win, d_rec, d_lookup.sum(1, keepdims=True), d_out, d_em.sum((0, 1)), d_trans / rows)


def _tags(length: int, spans: list[Span]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for start, kind, end in spans:
        y[start:end] = 2 + 2 * kind
        y[start] = 1 + 2 * kind
    return y


def train_tagger(examples: list[tuple[str, list[Span]]], *, seed: int = 3, steps: int = 500, rows: int = 48, rate: float = 0.02) -> Tagger:
    """Fit on texts with labelled spans, by Adam on random windows."""
    rng = np.random.default_rng(seed)
    m = Tagger.fresh(seed)
    moments = [(np.zeros_like(getattr(m, f.name)), np.zeros_like(getattr(m, f.name))) for f in fields(m)]
    prepared = [(classes_of(t), _tags(len(t), s)) for t, s in examples if t]
    for step in range(1, steps + 1):
        x, y = np.zeros((rows, WINDOW), np.uint8), np.zeros((rows, WINDOW), np.int64)
        for r in range(rows):
            cx, cy = prepared[int(rng.integers(len(prepared)))]
            a = int(rng.integers(max(1, len(cx) - WINDOW + 1)))
            part = cx[a : a + WINDOW]
            x[r, : len(part)], y[r, : len(part)] = part, cy[a : a + WINDOW]
        _, grads = _gradients(m, x, y)
        for f, (first, second) in zip(fields(m), moments, strict=True):
            g = np.clip(getattr(grads, f.name), -5, 5)
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            delta = (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            setattr(m, f.name, (getattr(m, f.name) - rate * (1 - step / (steps + 20)) * delta).astype(np.float32))
    return m


def labelled_examples(n: int = 500, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Prose of invented words with labelled spans, and numbers that are none: versions, dates, hashes, counts."""
    rng = np.random.default_rng(seed)
    pick = lambda s: s[int(rng.integers(len(s)))]
    digits = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    word = lambda: "".join(pick(("an", "the", "ou", "re", "ti", "és", "lich", "ción", "eau", "st", "er")) for _ in range(int(rng.integers(1, 4))))

    def card() -> str:
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = pick(("", "", " ", "-", ".", "  "))
        return sep.join(d[a : a + 4] for a in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick((f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{digits(2)} {a} {b} {c}", f"{a}.{b}.{c}"))

    def entity() -> tuple[int, str]:
        kind = int(rng.integers(4))
        if kind == 0:
            return 0, f"{word()}{pick(('', '.', '_'))}{digits(int(rng.integers(0, 3)))}{pick(('@', '@', ' @ ', '@ '))}{word()}{digits(1)}.{pick(('example.com', 'org', 'net'))}"
        if kind == 1:
            return 1, pick((".", ".", " . ")).join(str(int(x)) for x in rng.integers(0, 256, 4))
        return (2, card()) if kind == 2 else (3, phone())

    def other() -> str:
        return pick((f"Version {digits(1)}.{digits(1)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f'token = "{rng.bytes(20).hex()}"', digits(int(rng.integers(1, 7))), f"{digits(1)}.{digits(1)}.{digits(2)}", digits(int(rng.integers(20, 30))), f"{digits(2)}%", f"@{word()}", f"{digits(3)},{digits(3)}"))

    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < 3 * WINDOW:
            u = rng.random()
            if u < 0.12:
                kind, body = entity()
                spans.append((len(text), kind, len(text) + len(body)))
                text += body
            else:
                text += other() if u < 0.24 else word().capitalize() if u < 0.3 else word()
            text += pick((" ", " ", " ", " ", ", ", ". ", ".\n", "!! ", " | "))
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def default_tagger() -> Tagger:
    return train_tagger(labelled_examples())


def _viterbi(emissions: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tag sequences of padded runs (rows, time, TAGS); an inside tag only follows its own kind."""
    allowed = np.full((TAGS, TAGS), 0.0, np.float32)
    for k in range(len(KINDS)):
        allowed[:, 2 + 2 * k] = -1e4
        allowed[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    step = trans + allowed
    rows, time, _ = emissions.shape
    score = emissions[:, 0].copy()
    score[:, 2::2] -= 1e4
    back = np.zeros((time, rows, TAGS), np.uint8)
    for t in range(1, time):
        options = score[:, :, None] + step
        back[t] = options.argmax(1)
        new = options.max(1) + emissions[:, t]
        score = np.where((t < lengths)[:, None], new, score)
    tags = np.zeros((rows, time), np.uint8)
    now = score.argmax(1)
    for t in range(time - 1, -1, -1):
        inside = t < lengths
        tags[inside, t] = now[inside]
        if t:
            now = np.where(inside, back[t][np.arange(rows), now], now)
    return tags


def _segments(text: str, everywhere: bool) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(first kept character, kept end, start, classes) of a text's segments: neighbouring windows with a cue near them.

    Windows of WINDOW characters start every STRIDE characters. Those with a cue and those beside them are taken; a
    run of windows is cut into segments of SEGMENT windows, which reach MARGIN windows over what they keep.
    """
    if not (everywhere or CUES.search(text)):
        return
    classes = classes_of(text)
    last = max(0, -(-(len(classes) - WINDOW) // STRIDE))
    if everywhere:
        numbers = np.arange(last + 1)
    else:
        cues = np.flatnonzero((classes == 3) | (classes == 4))
        near = np.unique(np.concatenate([np.minimum(cues // STRIDE, last), np.clip((cues - WINDOW + STRIDE) // STRIDE, 0, last)]))
        numbers = np.unique(np.clip(near[:, None] + np.arange(-1, 2), 0, last))
    for run in np.split(numbers, np.flatnonzero(np.diff(numbers) > 1) + 1):
        for at in range(0, len(run), SEGMENT):
            low, high = run[max(0, at - MARGIN)], run[min(len(run), at + SEGMENT + MARGIN) - 1]
            ends = at + SEGMENT >= len(run)
            keep = int(run[at]) * STRIDE, min(len(classes), int(run[-1]) * STRIDE + WINDOW if ends else int(run[at + SEGMENT]) * STRIDE)
            yield *keep, int(low) * STRIDE, classes[int(low) * STRIDE : int(high) * STRIDE + WINDOW]


def _decode(model: Tagger, segments: list[np.ndarray]) -> list[np.ndarray]:
    """Tags of class sequences. Where windows overlap, a character's emissions come from the window in which it lies
    deeper; each sequence is decoded by one Viterbi pass."""
    windows = []
    for classes in segments:
        for k in range(0, max(1, -(-(len(classes) - WINDOW) // STRIDE) + 1)):
            part = classes[k * STRIDE : k * STRIDE + WINDOW]
            windows.append(part if len(part) == WINDOW else np.concatenate([part, np.zeros(WINDOW - len(part), np.uint8)]))
    emitted = _run(model, np.stack(windows))
    overlap = (WINDOW - STRIDE) // 2
    lengths = np.array([*map(len, segments)])
    padded = np.zeros((len(segments), lengths.max(), TAGS), np.float32)
    at = 0
    for r, n in enumerate(lengths.tolist()):
        count = max(1, -(-(n - WINDOW) // STRIDE) + 1)
        for k in range(count):
            begin = overlap if k else 0
            end = min(n - k * STRIDE, WINDOW if k == count - 1 else STRIDE + overlap)
            padded[r, k * STRIDE + begin : k * STRIDE + end] = emitted[at + k, begin:end]
        at += count
    return [tags[:n] for tags, n in zip(_viterbi(padded, lengths, model.trans), lengths.tolist(), strict=True)]


def tag_runs(model: Tagger, texts: list[str], everywhere: bool = False) -> list[list[Span]]:
    """Tagged spans of each whole text; everywhere: also far from any digit and at-sign, where no span is plausible.

    Segments are decoded some BLOCK windows at a time, like lengths together where many are short, and joined again
    over each text, so a span across windows or segments is one span and memory follows the text by a byte a character.
    """
    tags: list[list[tuple[int, np.ndarray]]] = [[] for _ in texts]
    held: list[tuple[int, int, int, int, np.ndarray]] = []
    windows = 0

    def flush() -> None:
        held.sort(key=lambda h: len(h[4]))
        a = 0
        while a < len(held):
            b = a
            while b < len(held) and len(held[b][4]) <= max(2 * len(held[a][4]), 256):
                b += 1
            for (i, first, end, start, _), own in zip(held[a:b], _decode(model, [h[4] for h in held[a:b]]), strict=True):
                tags[i].append((first, own[first - start : end - start]))
            a = b
        held.clear()

    for i, text in enumerate(texts):
        for segment in _segments(text, everywhere):
            held.append((i, *segment))
            windows += -(-len(segment[3]) // STRIDE)
            if windows >= BLOCK:
                flush()
                windows = 0
    flush()
    found: list[list[Span]] = [[] for _ in texts]
    for i, parts in enumerate(tags):
        parts.sort(key=lambda p: p[0])
        for begin, row in _joined(parts):
            inside = np.flatnonzero(row % 2 == 1)
            ends = np.append(np.flatnonzero((row[1:] != row[:-1]) | (row[1:] % 2 == 1)) + 1, len(row))
            for at in inside.tolist():  # a span goes on while the inside tag of its kind does
                end = int(ends[np.searchsorted(ends, at, "right")])
                if end == at + 1 and end < len(row) and row[end] == row[at] + 1:
                    end = int(ends[np.searchsorted(ends, end, "right")])
                found[i].append((begin + at, int(row[at]) // 2, begin + end))
    return found


def _joined(parts: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """Adjoining parts as one."""
    a = 0
    while a < len(parts):
        b, end = a + 1, parts[a][0] + len(parts[a][1])
        while b < len(parts) and parts[b][0] == end:
            end += len(parts[b][1])
            b += 1
        yield parts[a][0], np.concatenate([p for _, p in parts[a:b]])
        a = b


def plausible(kind: int, text: str) -> bool:
    """What a tagged span must still hold to be added."""
    digits = _digits(text)
    if kind == 0:
        return text.count("@") == 1 and "." in text.split("@")[1].strip() and len(text.split()) <= 3
    if kind == 1:
        parts = [p.strip() for p in text.split(".")]
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and len(text) - len(digits) <= 8
    groups = [g for g in re.split(r"[^0-9]+", text) if g]
    return 9 <= len(digits) <= 15 and len(groups) >= 3 and set(text) <= set("0123456789+() .-")


def find_spans(model: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Of each text the base spans, and the tagger's plausible spans that touch none of them."""
    out = []
    for text, tagged in zip(texts, tag_runs(model, texts), strict=True):
        base = base_spans(text)
        starts = np.array([s for s, _, _ in base], np.int64)  # in order; spans of different kinds may overlap
        reach = np.maximum.accumulate(np.array([e for _, _, e in base], np.int64)) if base else starts
        trimmed = [(s + len(body) - len(body.lstrip()), k, s + len(body.rstrip())) for s, k, e in tagged for body in (text[s:e],)]
        before = np.searchsorted(starts, [e for _, _, e in trimmed])  # base spans that begin before a tagged one ends
        free = [n == 0 or reach[n - 1] <= s for n, (s, _, _) in zip(before.tolist(), trimmed, strict=True)]
        out.append((base, sorted(x for x, alone in zip(trimmed, free, strict=True) if alone and plausible(x[1], text[x[0] : x[2]]))))
    return out


SPANS = "array<struct<start: long, rank: int, end: long, kind: string>>"


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None, texts_at_once: int = 256) -> DataFrame:
    """One row per document: doc_id, base and added (arrays of spans with offsets in code points).

    Nulls: a null text is empty, and a text without digits and at-signs has no spans. A null id keeps its row. Repeated
    rows keep their own rows. Texts of any length are read whole, texts_at_once at a time. An empty table gives an
    empty table. Other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(tagger or default_tagger())

    @F.pandas_udf(f"base {SPANS}, added {SPANS}")
    def find(column: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in column]
        rows = []
        for a in range(0, len(texts), texts_at_once):
            for both in find_spans(model.value, texts[a : a + texts_at_once]):
                rows.append([[{"start": s, "rank": k, "end": e, "kind": KINDS[k]} for s, k, e in spans] for spans in both])
        return pd.DataFrame(rows, columns=["base", "added"])

    return docs.select(F.col(id_col).alias("doc_id"), find(F.coalesce(F.col(text_col), F.lit(""))).alias("found")).select("doc_id", "found.base", "found.added")
