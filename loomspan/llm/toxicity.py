"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine."""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.plans.storage import small_batches

#: Subsequences of three characters within a window of SPAN, each skipped character costing a factor of DECAY.
LENGTH, SPAN, DECAY = 3, 6, 0.5
DIMS = 1 << 16
LONGEST = 24
LANDMARKS = 144
#: The labelled sample that training may see: so many documents of each class, in the order of a hash of their ids.
MAX_TOXIC, MAX_CLEAN = 1000, 2000
COMMON_NEGATIVES, OTHER_NEGATIVES, HARD_NEGATIVES = 2000, 6000, 4000
THRESHOLD = 0.7
CACHED_TOKENS = 100_000
#: Tokens whose subsequences are laid out at a time.
BLOCK = 4_000
#: Multipliers of the min-hashes that find near copies in the labelled sample.
MIN_HASHES = (1, 2654435761, 40503, 2246822519, 3266489917, 668265263, 374761393, 1103515245)

_SPLIT = re.compile(r"(?<=[.!?])\s+|\n")
_LETTERS = re.compile(r"[^\W\d_]+")


def sentence_tokens(sentence: str) -> list[str]:
    """Lower-case words of a sentence with everything but letters taken out of each; single letters in a row are
    one word, so spelled-out and broken-up insults come back together."""
    tokens, spelled = [], ""
    for word in sentence.split():
        word = word.lower()
        letters = word if word.isalpha() else "".join(_LETTERS.findall(word))
        if len(letters) == 1:
            spelled += letters
            continue
        if len(spelled) > 2:
            tokens.append(spelled)
        spelled = ""
        if len(letters) > 2:
            tokens.append(letters)
    if len(spelled) > 2:
        tokens.append(spelled)
    return tokens


def tokens_of(text: str | None) -> set[str]:
    """Distinct tokens of all sentences of a whole text."""
    found: set[str] = set()
    for sentence in _SPLIT.split(text or ""):
        found.update(sentence_tokens(sentence))
    return found


@lru_cache(maxsize=None)
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of a word of n characters (with its start mark), and their weights."""
    places = [(i, j, k) for i, j, k in combinations(range(n), LENGTH) if k - i < SPAN]
    return np.array(places, np.int64).T, np.array([DECAY ** (k - i + 1 - LENGTH) for i, _, k in places])


def subsequences(tokens: list[str]):
    """Blocks of tokens of one length: (indices into tokens, hashed subsequences (tokens, places), weights of unit norm)."""
    by_length: dict[int, list[int]] = {}
    for i, t in enumerate(tokens):
        by_length.setdefault(min(len(t), LONGEST), []).append(i)
    for n, at in by_length.items():
        # longer words are cut into overlapping pieces by the caller, never truncated
        (i, j, k), weight = _places(n + 1)
        for a in range(0, len(at), BLOCK):
            part = at[a : a + BLOCK]
            codes = np.array([[94, *map(ord, tokens[x][:n])] for x in part], np.int64)
            hashed = ((codes[:, i] * 31 + codes[:, j]) * 1009 + codes[:, k]) * 2654435761 % (1 << 32) >> 16
            yield np.array(part), hashed % DIMS, weight / np.sqrt((weight**2).sum())


def pieces(token: str) -> list[str]:
    """A token of up to LONGEST characters, or overlapping pieces of a longer one."""
    if len(token) <= LONGEST:
        return [token]
    return [token[a : a + LONGEST] for a in range(0, len(token) - LONGEST // 2, LONGEST // 2)]


def kernel_features(tokens: list[str]) -> np.ndarray:
    """Dense subsequence features; for landmarks and the training sample in blocks."""
    out = np.zeros((len(tokens), DIMS), np.float32)
    for at, hashed, weight in subsequences(tokens):
        for column in range(hashed.shape[1]):
            out[at, hashed[:, column]] += np.float32(weight[column])
    return out


@dataclass
class Model:
    direction: np.ndarray  # the machine's weights carried back through the landmarks to subsequences
    offset: float
    document: np.ndarray  # of the logistic regression over a document's token scores

    def token_scores(self, tokens: list[str]) -> np.ndarray:
        """Margin of each token: its kernel values against the landmarks, in closed form."""
        cut = [p for t in tokens for p in pieces(t)]
        scores = np.empty(len(cut))
        for at, hashed, weight in subsequences(cut):
            scores[at] = self.direction[hashed] @ weight
        if len(cut) > len(tokens):
            starts = np.cumsum([0, *(len(pieces(t)) for t in tokens)])[:-1]
            scores = np.maximum.reduceat(scores, starts)
        return scores + self.offset

    def document_score(self, margins: np.ndarray) -> float:
        return float(1 / (1 + math.exp(-float(np.clip(document_features(margins) @ self.document, -30, 30)))))


#: Margins at which a token counts as weak to strong evidence.
LEVELS = (-0.3, 0.2, 0.7, 1.3)


def document_features(margins: np.ndarray) -> np.ndarray:
    """Of the distinct tokens' margins: constant, size of the text, best margin, tokens at each level of evidence."""
    best = float(np.clip(margins.max(), -1.5, 1.5)) if len(margins) else -1.5
    return np.array([1.0, math.log1p(len(margins)), best, *(math.log1p(float((margins >= x).sum())) for x in LEVELS)])


def _machine(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps on the active set with a line search."""

    def loss(w: np.ndarray) -> float:
        return float(ridge * w @ w + (cost * np.maximum(0, 1 - y * (z @ w)) ** 2).sum())

    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(rounds):
        active = y * (z @ w) < 1
        za, ca = z[active], cost[active]
        step = np.linalg.solve((za * ca[:, None]).T @ za + ridge * np.eye(len(w)), (za * ca[:, None]).T @ y[active]) - w
        size = 1.0
        while size > 1e-4 and loss(w + size * step) >= now:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-6 * before:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
    return w


def _spread(documents: list[set[str]]) -> list[set[str]]:
    """One of each group of near copies, which would make a shared text look like a shared word: a document goes if
    half of its words and a kept one's are common; candidates share a pair of min-hashes."""
    alike: dict[tuple, list[int]] = {}
    kept: list[set[str]] = []
    for d in documents:
        hashed = [zlib.crc32(t.encode()) for t in d]
        least = [min((h * m % 4294967311 for h in hashed), default=-1) for m in MIN_HASHES]
        marks = [(i, *least[i : i + 2]) for i in range(0, len(least), 2)]
        if not any(3 * len(d & kept[at]) >= len(d) + len(kept[at]) for at in {at for mark in marks for at in alike.get(mark, ())}):  # Jaccard of 0.5
            for mark in marks:
                alike.setdefault(mark, []).append(len(kept))
            kept.append(d)
    return kept


def _fit_machine(positives: list[str], negatives: list[str], merit: dict[str, float], rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """The support vector machine over landmarks, two thirds of them the positives of most merit."""
    best = sorted(positives, key=lambda t: (-merit.get(t, 0.0), t))[: LANDMARKS * 2 // 3]
    landmarks = best + [negatives[i] for i in rng.choice(len(negatives), min(len(negatives), LANDMARKS - len(best)), replace=False)]
    basis = kernel_features([p for t in landmarks for p in pieces(t)])
    values, vectors = np.linalg.eigh(basis @ basis.T + 1e-6 * np.eye(len(basis)))
    root = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    toxic, ordinary = ([p for t in tokens for p in pieces(t)] for tokens in (positives, negatives))
    examples = toxic + ordinary
    z = np.empty((len(examples), len(basis)))
    for at, hashed, weight in subsequences(examples):
        z[at] = np.stack([(landmark[hashed] @ weight) for landmark in basis], axis=1)
    z = np.hstack([z @ root, np.ones((len(examples), 1))])
    y = np.array([1.0] * len(toxic) + [-1.0] * len(ordinary))
    w = _machine(z, y, np.where(y > 0, len(ordinary) / max(1, len(toxic)) / 4, 1.0))
    return (basis.T @ (root @ w[:-1])).astype(np.float32), float(w[-1])


def _train_words(a: list[set[str]], b: list[set[str]], rng: np.random.Generator) -> Model | None:
    """The word machine on toxic and clean documents' token sets; None if no word tells them apart."""
    in_toxic, in_clean = Counter(t for d in a for t in d), Counter(t for d in b for t in d)
    odds = {t: math.log((n + 0.5) / (len(a) + 1)) - math.log((in_clean[t] + 0.5) / (len(b) + 1)) for t, n in in_toxic.items()}
    merit = {t: odds[t] * math.log1p(n) for t, n in in_toxic.items()}
    least = 3 if len(a) >= 30 else 2
    witnesses = sorted(t for t, n in in_toxic.items() if n >= least and odds[t] > 2.0 + 3.0 / n)
    by_hash = sorted(in_clean, key=lambda t: zlib.crc32(t.encode()))
    common = [t for t, _ in sorted(in_clean.items(), key=lambda x: (-x[1], x[0]))[:COMMON_NEGATIVES]]
    negatives = sorted({*by_hash[:OTHER_NEGATIVES], *common} - set(witnesses))
    if not witnesses or not negatives:
        return None
    model = Model(*_fit_machine(witnesses, negatives, merit, rng), np.zeros(3 + len(LEVELS)))
    rarer = sorted(t for t, n in in_toxic.items() if in_clean[t] == 0 and odds[t] > 1.5)
    found = [t for t, m in zip(rarer, model.token_scores(rarer), strict=True) if m > 0.5] if rarer else []
    kept = [t for t, m in zip(witnesses, model.token_scores(witnesses), strict=True) if m > -0.5 or in_toxic[t] > 8]
    # clean words that look most like witnesses are what the machine must still learn to leave alone
    clean_words = sorted(t for t in in_clean if odds.get(t, -9.0) < 1.0)
    hardest = np.argsort(-model.token_scores(clean_words), kind="stable")[:HARD_NEGATIVES]
    positives = sorted({*kept, *found}) or witnesses
    model.direction, model.offset = _fit_machine(positives, sorted({*negatives, *(clean_words[i] for i in hardest)} - set(positives)), merit, rng)
    return model


def _features(model: Model, documents: list[set[str]]) -> np.ndarray:
    words = sorted(set().union(*documents))
    margin = dict(zip(words, model.token_scores(words).tolist(), strict=True))
    return np.stack([document_features(np.fromiter(map(margin.__getitem__, d), float, len(d))) for d in documents])


def train(toxic: list[set[str]], clean: list[set[str]], seed: int = 7) -> Model:
    """Fit on the token sets of labelled documents.

    Sentences inherit their document's label; the witnesses among a toxic document's tokens are those far more
    common in toxic documents, then, after a first fit, those that the machine itself finds on the toxic side.
    """
    rng = np.random.default_rng(seed)
    silent = Model(np.zeros(DIMS, np.float32), -1.0, np.array([-4.0, *[0.0] * (2 + len(LEVELS))]))
    a, b = _spread(toxic), _spread(clean)
    model = _train_words(a, b, rng) if a and b else None
    if model is None:
        return silent
    x = np.concatenate([_features(model, a), _features(model, b)])
    model.document = _logistic(x, np.repeat([1.0, 0.0], [len(a), len(b)]))
    return model


def held_out(id_col: Column) -> Column:
    """Rows that labels must not be learned from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[list[set[str]], list[set[str]]]:
    """Token sets of at most MAX_TOXIC and MAX_CLEAN labelled documents that are not held out, one for each id.

    The sample is bounded before any text is touched: counts give each class the share of its hashed ids that fills
    it, so what reaches the driver does not grow with the corpus or its partitions.
    """
    usable = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)").filter(~held_out(F.col("id")))
    place = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long")
    usable = usable.groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("place", place)
    most = {1: MAX_TOXIC, 0: MAX_CLEAN}
    sizes = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    share = {k: (1 << 32) * min(1.0, 1.2 * most[k] / n) for k, n in sizes.items()}
    below = F.when(F.col("toxic") == 1, F.col("place") < int(share.get(1, 0))).otherwise(F.col("place") < int(share.get(0, 0)))
    found = sorted(usable.filter(below).collect(), key=lambda r: (r.place, r.id))
    chosen = [r for label, n in most.items() for r in [x for x in found if x.toxic == label][:n]]
    ids = docs.sparkSession.createDataFrame([(int(r.id), int(r.toxic)) for r in chosen], "id long, toxic int")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")  # MAX_TOXIC + MAX_CLEAN rows

    def extract(frames):
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "toxic": frame["toxic"], "tokens": [sorted(tokens_of(t)) for t in frame["text"]]})

    small_batches(docs.sparkSession)
    extracted = texts.mapInPandas(extract, "id long, toxic int, tokens array<string>")
    once = extracted.groupBy("id", "toxic").agg(F.min("tokens").alias("tokens"))  # an id may repeat in documents
    rows = sorted((r.id, r.toxic, tuple(map(sys.intern, r.tokens))) for r in once.collect())
    return [set(t) for _, label, t in rows if label], [set(t) for _, label, t in rows if not label]


class _Scorer:
    """Document scores with a bounded memory of token margins; one in each Python worker."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def __call__(self, texts: list[str | None]) -> list[float]:
        out = []
        for a in range(0, len(texts), 256):
            sets = [tokens_of(t) for t in texts[a : a + 256]]
            if len(self.known) > CACHED_TOKENS:
                self.known.clear()
            fresh = sorted({t for s in sets for t in s if t not in self.known})
            if fresh:
                self.known.update(zip(fresh, self.model.token_scores(fresh).tolist(), strict=True))
            out += [self.model.document_score(np.fromiter(map(self.known.__getitem__, s), float, len(s))) for s in sets]
        return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Model:
    return train(*labelled_sample(docs, labels, id_col, text_col))


def score_udf(docs: DataFrame, model: Model):
    """A column function from text to score; the model travels to each executor once."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.direction, model.offset, model.document))
    held: list[_Scorer] = []

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(_Scorer(Model(*shared.value)))
        return pd.Series(held[0](texts.tolist()), dtype="float64")

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score in 0..1, predicted (1 from THRESHOLD).

    Words are compared by gappy three-character subsequences; a support vector machine over Nystroem landmarks
    marks words, and a logistic regression over the margins of all distinct words of the whole text gives the score.
    Only labels of rows that are not held out are learned from; no column but the text enters a score.

    Nulls: a null or empty text has no words and gets the score of such a text (low); a null id is not held out.
    Labels with a null id or a value other than 0 and 1 are not used; of repeated labels the larger counts. Without
    labels of both classes every score is low. Repeated rows keep their own rows; of the documents of one labelled id
    the first in the order of their words is learned from. An empty table gives an empty table. Other columns are
    ignored, whatever their names.
    """
    score = score_udf(docs, fit_toxicity(docs, labels, id_col=id_col, text_col=text_col))
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
