"""Quality by weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

import operator
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.plans.storage import small_batches

DIMS = 2048
#: Documents that the scorer is fitted on, in the order of a hash of id and text; every document is voted on and scored.
MAX_SAMPLE = 4000
KEEP_FROM = 0.2
#: The share of good documents that the label model assumes; left free, it and the accuracies of labellers that only
#: ever vote against a text are not determined by the votes.
GOOD_SHARE = 0.7
CACHED_WORDS = 300_000
GOOD, BAD, ABSTAIN = "g", "b", "-"
LABELLERS = ("symbols", "capitals", "stutter", "cells", "sentences", "lines", "variety")
# Marks that junk is made of, and marks that end a clause.
SYMBOLS, CLAUSE_ENDS = "#$%&*|!<>{}~^\\=", (".", ",", ";", ":", "?")


def _vote(bad: bool, good: bool) -> str:
    return BAD if bad else GOOD if good else ABSTAIN


def votes(text: str) -> str:
    """One letter per labeller: good, bad or no opinion. A text without words gets no opinion from any."""
    words = text.split()
    n = len(words)
    if not n:
        return ABSTAIN * len(LABELLERS)
    raw = np.frombuffer(text.encode(), np.uint8)
    share = np.bincount(raw, minlength=256) / len(raw)
    symbols = float(share[list(SYMBOLS.encode())].sum())
    upper, lower = float(share[65:91].sum()), float(share[97:123].sum())
    capitals = upper / (upper + lower) if upper + lower else 0.0
    stutter = sum(map(operator.eq, words, words[1:])) / n
    cells = words.count("|") / n
    ends = sum(w.endswith(CLAUSE_ENDS) for w in words) / n
    lines = [x for x in text.split("\n") if x]
    repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
    variety = len(set(words)) / n
    prose = 0.04 < ends < 0.5 and symbols < 0.01 and capitals < 0.12 and stutter < 0.05
    return "".join(
        (
            _vote(symbols > 0.04, False),
            _vote(capitals > 0.3, False),
            _vote(stutter > 0.1, False),
            _vote(cells > 0.08, False),
            _vote(ends < 0.02 and n > 20, prose),
            _vote(repeated > 0.3, False),
            _vote(variety < 0.25 and n > 40, False),
        )
    )


def estimate(patterns: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """Expectation-maximisation: P(good | votes) for each pattern of votes.

    Each labeller is right with a chance of its own when it votes, and silence tells nothing; these accuracies are
    estimated from all documents' votes, starting from the majority, at an assumed share of good documents. The patterns are
    at most 3^7, however many documents there are.
    """
    names, counts = list(patterns), np.array(list(patterns.values()), float)
    if not names:
        return {}
    said = np.array([[(c == GOOD) - (c == BAD) for c in p] for p in names], float)  # patterns, labellers: 1, -1 or 0
    base = np.log(GOOD_SHARE / (1 - GOOD_SHARE))
    good = 1 / (1 + np.exp(-base - said.sum(axis=1)))
    for _ in range(rounds):
        right = (counts[:, None] * (good[:, None] * (said > 0) + (1 - good)[:, None] * (said < 0))).sum(axis=0)
        accuracy = np.clip((right + 8) / ((counts[:, None] * (said != 0)).sum(axis=0) + 10), 0.55, 0.995)
        odds = base + said @ np.log(accuracy / (1 - accuracy))
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(names, good.tolist(), strict=True))


def word_features(word: str) -> tuple[int, int]:
    """Hashed word, and hashed shape: case, leading and trailing marks, length class."""
    core = word.strip("#$%&*|!<>{}~^\\=.,;:?\"'()")
    case = "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "l" if core.isalpha() else "x"
    tail = word[len(word.rstrip("#$%&*|!<>{}~^\\=.,;:?\"'()")) :] if core else word
    shape = f"{case}/{tail[:4]}/{min(len(core), 12) // 3}"
    return zlib.crc32(word.lower().encode()) % (DIMS // 2), DIMS // 2 + zlib.crc32(shape.encode()) % (DIMS // 2)


def document_vector(text: str) -> np.ndarray:
    out = np.zeros(DIMS, np.float32)
    words = text.split()
    for w in words:
        a, b = word_features(w)
        out[a] += 1
        out[b] += 1
    stutter = sum(map(operator.eq, words, words[1:]))
    out[DIMS // 2] += stutter * 4  # a slot of its own weight: shapes rarely hash to it
    return out / max(1, len(words))


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 4.0, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels, by accelerated gradient steps."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    vw, vb = np.zeros_like(w), 0.0
    weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)).astype(np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = (p - y) * weight / np.float32(len(y))
        vw = np.float32(0.9) * vw + g @ x + np.float32(ridge) * w
        vb = np.float32(0.9) * vb + g.sum()
        w, b = w - np.float32(rate) * vw, b - np.float32(rate) * vb
    return w.astype(np.float64), float(b)


class _Weights(dict):
    """Word to the sum of its weights, remembered up to a bound."""

    def __init__(self, w: np.ndarray) -> None:
        super().__init__()
        self.w = w.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) > CACHED_WORDS:
            self.clear()
        a, b = word_features(word)
        value = self[word] = self.w[a] + self.w[b]
        return value


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, votes, posterior, score in 0..1, keep (score from KEEP_FROM).

    No labels are used. Overlapping heuristics vote on every document; expectation-maximisation over the counts of
    all vote patterns estimates their accuracies; the posterior labels of a bounded sample train a linear scorer on
    hashed words and word shapes, which scores every whole text.

    Nulls: a null or empty text has no votes, the posterior of such a pattern, and the scorer's score of no words. A
    null id keeps its row. Repeated rows keep their own rows. An empty table gives an empty table. Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @F.pandas_udf("string")
    def vote(text: pd.Series) -> pd.Series:
        return text.map(votes)

    patterns = {r.votes: r["count"] for r in texts.select(vote("text").alias("votes")).groupBy("votes").count().collect()}  # at most 3^7 rows
    posterior = estimate(patterns)

    # the share of hashed ids that fills the sample: what reaches the driver does not grow with the corpus
    share = min(1.0, 1.2 * MAX_SAMPLE / max(1, sum(patterns.values())))
    # rows of one id and text are one of the sample, so no group of them fills it and reruns agree under any splits
    place = F.xxhash64(F.lit("quality"), F.col("doc_id").cast("string"), "text").bitwiseAND((1 << 48) - 1)
    sample = texts.withColumn("place", place).filter(F.col("place") < int(share * (1 << 48))).groupBy("place").agg(F.min("text").alias("text"))

    def vectors(frames):
        for frame in frames:
            rows = [document_vector(t) for t in frame["text"]]
            at = [np.flatnonzero(r) for r in rows]
            yield pd.DataFrame({"place": frame["place"], "votes": [votes(t) for t in frame["text"]], "at": at, "value": [r[a] for r, a in zip(rows, at, strict=True)]})

    rows = sample.mapInPandas(vectors, "place long, votes string, at array<int>, value array<float>").collect()
    rows = sorted(rows, key=lambda r: (r.place, r.votes))[:MAX_SAMPLE]
    x = np.zeros((len(rows), DIMS), np.float32)
    for i, r in enumerate(rows):
        x[i, r.at] = r.value
    w, b = fit_linear(x, np.array([posterior[r.votes] for r in rows])) if rows else (np.zeros(DIMS), 0.0)
    shared = spark.sparkContext.broadcast((posterior, w, b))
    held: list[_Weights] = []

    @F.pandas_udf("votes string, posterior double, score double")
    def judge(text: pd.Series) -> pd.DataFrame:
        posterior, w, b = shared.value
        if not held:
            held.append(_Weights(w))
        known, out = held[0], []
        stutter_weight = 4 * float(w[DIMS // 2])
        for t in text:
            words = t.split()
            total = sum(map(known.__getitem__, words)) + stutter_weight * sum(map(operator.eq, words, words[1:]))
            said = votes(t)
            out.append((said, posterior[said], 1 / (1 + np.exp(-np.clip(total / max(1, len(words)) + b, -30, 30)))))
        return pd.DataFrame(out, columns=["votes", "posterior", "score"])

    judged = texts.select("doc_id", judge("text").alias("j")).select("doc_id", "j.votes", "j.posterior", "j.score")
    return judged.withColumn("keep", F.col("score") >= KEEP_FROM)
