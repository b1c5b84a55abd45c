"""Live replay: a stream of attempts to sessions and statements, from new or saved learners, with typed state."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomspan.functions.replay import Learner
from loomspan.plans.storage import shared_root

#: One row per attempt's statement and, for each learner of a batch, one with its session and state after the batch.
LIVE = "actor string, step long, seq int, verb string, object string, score double, success boolean, p double, session string, state string"

COUNTS = ("xp", "streak", "streak_max", "step", "attempts", "passed", "skipped", "retries_used", "statements", "in_band", "run_length", "picks")
LEARNER = ", ".join(f"{c} long" for c in COUNTS) + ", run_failed boolean, run_beat string, run_check string, recent array<boolean>"
LEARNER += ", items array<string>, mastery array<double>, stability array<double>, last_review array<long>, visited array<string>"


class Replay(StatefulProcessor):
    """A learner's state is one typed row: counts, items side by side in lists, and the visited beats.

    A batch reads it once and writes it once: each call to the store is a round trip between worker and executor, and
    learners are many and their items few. What a batch says of a learner leaves as columns.
    """

    def __init__(self, max_retries: int = 1):
        self.max_retries = max_retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.learner = handle.getValueState("learner", LEARNER)

    def close(self) -> None:
        pass

    def _load(self) -> Learner:
        out = Learner()
        values = self.learner.get()
        if values is None:
            return out
        for name, value in zip(COUNTS, values, strict=False):
            setattr(out, name, value)
        out.run_failed, beat, check, recent, items, mastery, stability, last_review, visited = values[len(COUNTS) :]
        out.run_key, out.recent, out.visited = ([beat, check] if beat is not None else None), list(recent), list(visited)
        out.mastery, out.stability, out.last_review = (dict(zip(items, each, strict=True)) for each in (mastery, stability, last_review))
        return out

    def _save(self, now: Learner) -> None:
        beat, check = now.run_key or (None, None)
        items = list(now.mastery)
        numbers = [float(p) for p in now.mastery.values()], [float(now.stability.get(i, 1.0)) for i in items], [int(now.last_review.get(i, 0)) for i in items]
        self.learner.update((*(int(getattr(now, c)) for c in COUNTS), bool(now.run_failed), beat, check, [bool(x) for x in now.recent], items, *numbers, list(now.visited)))

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self._save(Learner.loads(initialState["state"].iloc[0]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        learner = self._load()
        learner.told, first = [], learner.statements
        for r in in_order(pd.concat(list(rows))):  # a learner's share of a micro-batch
            learner.attempt(*r, self.max_retries)
        self._save(learner)
        told, none = learner.told, [None]
        of = lambda name: [t["result"].get(name) for t in told] + none
        yield pd.DataFrame({
            "actor": [key[0]] * (len(told) + 1), "step": [*(t["timestamp"] for t in told), learner.attempts + learner.skipped], "seq": pd.array([*range(first, first + len(told)), None], "Int32"),
            "verb": [t["verb"] for t in told] + none, "object": [t["object"] for t in told] + none, "score": pd.array(of("score"), "float64"), "success": pd.array(of("success"), "boolean"),
            "p": pd.array(of("p"), "float64"), "session": none * len(told) + [json.dumps(learner.summary())], "state": none * len(told) + [learner.dumps()],
        })


def in_order(rows: pd.DataFrame) -> Iterator[tuple]:
    """The arguments of Learner.attempt() of each row, by ordinal."""
    rows = rows.sort_values("ordinal")
    return zip(rows["beat"], rows["check"], rows["item"], rows["score"].astype(float).tolist(), rows["max_score"].astype(float).tolist(), map(bool, rows["ok"]), strict=True)


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Typed state lives in this store; the session's own choice comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def live(attempts: DataFrame, max_retries: int = 1, states: DataFrame | None = None) -> DataFrame:
    """A stream of statements, sessions and states (LIVE) that goes on with each micro-batch.

    attempts: (actor string, ordinal, beat, check, item, score, max_score, ok); the source must deliver a learner's
    attempts in order from batch to batch, within a batch ordinal sorts them. states: (actor string, state), learners
    saved before, each of whom goes on from there; who is in neither starts anew. Replaying in pieces equals
    replaying at once, since the state holds all that later attempts depend on.
    """
    start = states.select("actor", "state").groupBy("actor") if states is not None else None
    return attempts.groupBy("actor").transformWithStateInPandas(Replay(max_retries), LIVE, "Update", "None", start)


def learner_states(attempts: DataFrame, max_retries: int = 1) -> DataFrame:
    """(actor string, state): every learner after a batch of attempts, as live() and saved states have it."""

    def replay(frame: pd.DataFrame) -> pd.DataFrame:
        learner = Learner()
        for r in in_order(frame):
            learner.attempt(*r, max_retries)
        return pd.DataFrame([{"actor": frame["actor"].iloc[0], "state": learner.dumps()}])

    return attempts.groupBy("actor").applyInPandas(replay, "actor string, state string")


def _sessions_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"actor": frame["actor"], "session": [json.dumps(Learner.loads(s).summary()) for s in frame["state"]]})


def follow(spark: SparkSession, attempts: DataFrame, folder: str, max_retries: int = 1, states: DataFrame | None = None) -> None:
    """Run the stream over what is available: folder/statements and folder/sessions grow by a part per micro-batch.

    A part is named by its batch and replaced when that batch runs again, and a batch reads and leaves the same state
    each time, so after any cut a run on the same folder goes on and every statement is there once. The logical clock
    is part of the state. states count in the first run only.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.filter("verb is not null").drop("session", "state").write.mode("overwrite").parquet(f"{folder}/statements/batch={number}")
        batch.filter("session is not null").select("actor", "step", "session", "state").write.mode("overwrite").parquet(f"{folder}/sessions/batch={number}")
        batch.unpersist()

    with _rocks(spark):
        writer = live(attempts, max_retries, states).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
        writer.foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


STATEMENTS = "actor string, step long, seq int, verb string, object string, score double, success boolean, p double, batch long"
SESSIONS = "actor string, step long, session string, state string, batch long"


def live_statements(spark: SparkSession, folder: str) -> DataFrame:
    """What the stream has said so far, once each: (actor, step, seq, verb, object, score, success, p, batch)."""
    return spark.read.schema(STATEMENTS).parquet(f"{folder}/statements")


def live_states(spark: SparkSession, folder: str) -> DataFrame:
    """(actor, session, state): each learner's latest, ready to start another stream from."""
    latest = spark.read.schema(SESSIONS).parquet(f"{folder}/sessions").groupBy("actor").agg(F.max_by(F.struct("session", "state"), F.struct("batch", "step")).alias("l"))
    return latest.select("actor", "l.session", "l.state")


def replay_available(spark: SparkSession, attempts: DataFrame, max_retries: int = 1, checkpoint: str | None = None, states: DataFrame | None = None) -> DataFrame:
    """(actor, session): the stream is run over what is available; saved learners without an attempt keep theirs.

    A checkpoint given again continues where it ended.
    """
    folder = checkpoint or f"{shared_root(spark)}/loomspan/{uuid.uuid4().hex}"
    follow(spark, attempts, folder, max_retries, states)
    now = live_states(spark, folder).select("actor", "session")
    if states is None:
        return now
    idle = states.select("actor", "state").join(now, "actor", "left_anti").mapInPandas(_sessions_of, "actor string, session string")
    return now.unionByName(idle)
