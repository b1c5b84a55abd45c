"""The closed loop: each learner's next beat depends on the last grade, so learners run as a grouped map."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from loomspan.functions import learner as L
from loomspan.functions.replay import Learner, grade, half_even


@dataclass
class Story:
    """A validated story and its prerequisite graph; a document, shipped to every task."""

    beats: list[dict]
    checks: dict[str, dict]
    prereqs: dict[str, set[str]]

    @classmethod
    def of(cls, beats: list[dict], checks: list[dict], items: list[str], edges: list[tuple[str, str]]) -> Story:
        prereqs: dict[str, set[str]] = {i: set() for i in items}
        for p, i in edges:
            if p not in prereqs or i not in prereqs:
                raise ValueError(f"edge with unknown item: {p} {i}")
            prereqs[i].add(p)
        return cls(sorted(beats, key=lambda b: b["id"]), {c["id"]: c for c in checks}, prereqs)

    def best_beat(self, learner: Learner) -> dict | None:
        """The unvisited beat of the highest score among those whose requirements are known."""
        mastered = {i for i, p in learner.mastery.items() if p >= L.MASTERED}
        outer = {i for i, needs in self.prereqs.items() if i not in mastered and needs <= mastered}
        known = mastered.union(*(b.get("teaches", []) for b in self.beats if b["id"] in learner.visited))
        rate = learner.rate()
        push = 0.25 if rate > L.FLOW_HIGH else -0.25 if rate < L.FLOW_LOW else 0.0

        def score(beat: dict) -> float:
            teaches = beat.get("teaches", [])
            average = sum(learner.mastery.get(i, 0.0) for i in teaches) / len(teaches) if teaches else 0.0
            return half_even(2.0 * bool(outer.intersection(teaches)) + 1.0 - average + push * beat.get("difficulty", 2), 9)

        ready = [b for b in self.beats if b["id"] not in learner.visited and known.issuperset(b.get("requires", []))]
        return max(ready, key=score, default=None)  # beats are in order of their ids, the first of equals wins


def run_quest(story: Story, learner: Learner, responses: list, max_retries: int = 1, max_steps: int = 1000) -> tuple[str, list[dict]]:
    """Play until no beat is ready, responses end, or max_steps picks; (reason, transcript). learner is updated.

    A failed check takes further responses up to max_retries; beats without checks are visited as they are picked.
    """
    if max_steps < 1 or max_retries < 0:
        raise ValueError("max_steps must be at least 1 and max_retries at least 0")
    waiting = iter(responses)
    nothing = object()
    transcript: list[dict] = []
    while learner.picks < max_steps:
        beat = story.best_beat(learner)
        if beat is None:
            return ("quest_complete" if len(learner.visited) == len(story.beats) else "gated"), transcript
        learner.picks += 1
        if not beat.get("checks"):
            learner.visit(beat["id"])
        for name in beat.get("checks", []):
            check, failures = story.checks[name], 0
            while failures <= max_retries:
                response = next(waiting, nothing)
                if response is nothing:
                    learner.picks -= beat["id"] not in learner.visited
                    return "responses_exhausted", transcript
                score, best, ok = grade(check, response)
                if learner.attempt(beat["id"], name, check["item_id"], score, best, ok, max_retries):
                    transcript.append({"beat": beat["id"], "check": name, "response": response, "score": score, "max_score": best, "success": ok})
                    failures = max_retries + 1 if ok else failures + 1
    return "max_steps", transcript


QUEST = "actor string, reason string, picks long, visited array<string>, attempts long, passed long, xp long, streak_max long, flow_in_band_ratio double, statements long, retries_used long, transcript array<string>, state string"


def quests(responses: DataFrame, story: Story, max_retries: int = 1, max_steps: int = 1000) -> DataFrame:
    """One row per actor. responses: (actor, pos, response as a JSON literal or raw string, state JSON or null)."""

    def value(raw: str):
        try:
            return json.loads(raw)
        except ValueError:
            return raw

    def play(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        saved = next((s for s in frame["state"] if s), None)
        learner = Learner.loads(saved)
        reason, log = run_quest(story, learner, [value(r) for r in frame["response"] if r is not None], max_retries, max_steps)
        s = learner.summary()
        row = {k: s[k] for k in ("attempts", "passed", "xp", "streak_max", "flow_in_band_ratio", "statements", "retries_used")}
        row |= {"actor": frame["actor"].iloc[0], "reason": reason, "picks": learner.picks, "visited": s["beats_visited"], "transcript": [json.dumps(x) for x in log], "state": learner.dumps()}
        return pd.DataFrame([row])[[f.split()[0] for f in QUEST.split(", ")]]

    return responses.groupBy("actor").applyInPandas(play, QUEST)
