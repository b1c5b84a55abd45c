"""Recorded replies in place of a text model: calls join the cassette, budgets are running sums."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class BudgetExhausted(RuntimeError):
    """A call would exceed the token budget."""


class CassetteExhausted(RuntimeError):
    """No reply is recorded for a role."""


class TextModel(Protocol):
    """What a text backend must offer: a reply and its tokens for a role and prompt, and the tokens spent."""

    total_tokens: int

    def complete(self, role: str, prompt: str, budget: int | None = None) -> dict: ...


class Cassette:
    """The recorded backend on the driver: replies of a role repeat in order; a refused call costs nothing."""

    def __init__(self, replies: dict[str, list[dict]]) -> None:
        self.replies, self.calls, self.total_tokens = replies, {}, 0

    @classmethod
    def from_file(cls, path: str) -> Cassette:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def complete(self, role: str, prompt: str, budget: int | None = None) -> dict:
        replies = self.replies.get(role)
        if not replies:
            raise CassetteExhausted(role)
        n = self.calls.get(role, 0)
        reply = replies[n % len(replies)]
        if budget is not None and self.total_tokens + reply["tokens"] > budget:
            raise BudgetExhausted(f"{role}: {budget} tokens")
        self.calls[role] = n + 1
        self.total_tokens += reply["tokens"]
        return {"text": reply["text"], "tokens": reply["tokens"]}


#: Where recorded replies are looked for unless a run names a file: this variable, then these places.
CASSETTE_VARIABLE, CASSETTE_PLACES = "LOOMSPAN_CASSETTE", ("cassette.json", "cassettes/default.json")


def default_cassette() -> str | None:
    """The file of recorded replies that runs use by default, if there is one."""
    named = os.environ.get(CASSETTE_VARIABLE)
    return named or next((p for p in CASSETTE_PLACES if os.path.exists(p)), None)


def default_model() -> Cassette | None:
    path = default_cassette()
    return Cassette.from_file(path) if path and os.path.exists(path) else None


# The public service, its key's variable, passing HTTP errors, seconds between tries and for an answer.
REMOTE_URL = "https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent"
REMOTE_MODEL, KEY_VARIABLE, MODEL_VARIABLE = "gemini-3.5-flash-lite", "GEMINI_API_KEY", "FLASH_MODEL"
PASSING, PAUSES, PATIENCE = (429, 500, 502, 503, 504), (2, 4), 60


class RemoteModel:
    """A text model behind a REST service; the key is looked up when it is first needed.

    Errors that pass are tried again after a pause, others are raised at once. A budget that is used up refuses the
    call; an answer that goes over it is refused too, and its tokens are not counted.
    """

    def __init__(self, key: str | None = None, model: str | None = None, url: str = REMOTE_URL, pause: Callable[[float], None] = time.sleep) -> None:
        self._key, self.model, self.url, self._pause = key, model or os.environ.get(MODEL_VARIABLE, REMOTE_MODEL), url, pause
        self.total_tokens = 0

    @classmethod
    def configured(cls) -> RemoteModel:
        if not os.environ.get(KEY_VARIABLE):
            raise ValueError(f"a remote model needs {KEY_VARIABLE} in the environment")
        return cls()

    def _ask(self, body: dict, key: str) -> dict:
        call = urllib.request.Request(self.url.format(model=self.model), json.dumps(body).encode(), {"Content-Type": "application/json", "x-goog-api-key": key}, method="POST")
        for pause in (*PAUSES, None):
            try:
                with urllib.request.urlopen(call, timeout=PATIENCE) as answer:
                    return json.load(answer)
            except urllib.error.URLError as failed:
                if pause is None or getattr(failed, "code", PASSING[0]) not in PASSING:
                    raise
            self._pause(pause)
        raise AssertionError("unreachable")

    def complete(self, role: str, prompt: str, budget: int | None = None) -> dict:
        key = self._key or os.environ.get(KEY_VARIABLE)
        if not key:
            raise RuntimeError(f"no key: give one or set {KEY_VARIABLE}")
        if budget is not None and self.total_tokens >= budget:
            raise BudgetExhausted(f"{role}: {budget} tokens")
        settings = {"temperature": 0.0, "responseMimeType": "application/json"}
        answer = self._ask({"contents": [{"parts": [{"text": f"[ROLE {role}]\n{prompt}"}]}], "generationConfig": settings}, key)
        parts = [p for c in (answer.get("candidates") or [{}])[:1] for p in (c.get("content") or {}).get("parts") or [{}]]
        tokens = int((answer.get("usageMetadata") or {}).get("totalTokenCount") or 0)
        if budget is not None and self.total_tokens + tokens > budget:
            raise BudgetExhausted(f"{role}: {budget} tokens")
        self.total_tokens += tokens
        return {"text": (parts[0].get("text") if parts else "") or "", "tokens": tokens}


def replay_calls(calls: DataFrame, cassette: DataFrame, budget: int | None = None) -> DataFrame:
    """(session, pos, role, ordinal, tokens, spent, allowed): the n-th call of a role gets reply n modulo their number.

    calls: (session, pos, role); cassette: (role, ordinal, tokens). Calls are allowed while the running sum of a
    session's tokens stays within the budget.
    """
    sizes = cassette.groupBy("role").agg(F.count("*").alias("size"))
    nth = F.row_number().over(W.partitionBy("session", "role").orderBy("pos")) - 1
    asked = calls.withColumn("nth", nth).join(sizes, "role").withColumn("ordinal", (F.col("nth") % F.col("size")).cast("long"))
    spent = F.sum("tokens").over(W.partitionBy("session").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    met = asked.join(cassette, ["role", "ordinal"]).withColumn("spent", spent)
    return met.select("session", "pos", "role", "ordinal", "tokens", "spent", (F.lit(True) if budget is None else F.col("spent") <= budget).alias("allowed"))
