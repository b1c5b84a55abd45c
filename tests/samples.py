"""Small stories and graphs with known results."""

ITEMS = ["central-tendency", "mean", "median", "mode", "dispersion", "variance", "standard-deviation", "correlation"]
EDGES = list(zip(ITEMS, ITEMS[1:]))


def story() -> dict:
    checks = {
        1: ("choice", {"options": ["Mean", "Range"], "answer": "Mean"}),
        2: ("numeric", {"answer": 5.0, "tolerance": 0.01}),
        3: ("ordering", {"items": ["sort", "count", "pick"], "answer": ["sort", "count", "pick"]}),
        5: ("choice", {"options": ["Spread", "Center"], "answer": "Spread"}),
        7: ("numeric", {"answer": 2.0, "tolerance": 0.1}),
    }
    beats = []
    for n in range(1, 9):
        item = ITEMS[n - 1]
        beats.append({
            "id": f"q{n}", "title": f"Beat {n}", "text": "…", "choices": [{"label": "On", "to": f"q{n + 1}"}] if n < 8 else [], "requires": [ITEMS[n - 2]] if n > 1 else [],
            "teaches": [item], "checks": [f"q{n}-check"] if n in checks else [], "difficulty": 2 if n in (2, 6, 8) else 1, "provenance": {"item_id": item, "chunk_id": f"c{n:03d}"},
        })
    made = [{"id": f"q{n}-check", "kind": k, "prompt": "?", "payload": p, "item_id": ITEMS[n - 1], "max_score": 1} for n, (k, p) in checks.items()]
    return {"beats": beats, "checks": made, "metadata": {}}


def script() -> list[dict]:
    rows = [("q1", "Mean"), ("q2", 5.0), ("q5", "Spread"), ("q3", ["sort", "pick", "count"]), ("q3", ["sort", "count", "pick"]), ("q7", 2.05), ("q1", "Mean")]
    return [{"beat_id": b, "check_id": f"{b}-check", "response": r} for b, r in rows]


def graph() -> dict:
    return {"items": [{"id": i, "tags": ["concept"]} for i in ITEMS], "surmise": [list(e) for e in EDGES], "metadata": {"chapter": "chain"}}


def chapters() -> dict[str, dict]:
    def item(i: str, label: str, tag: str) -> dict:
        return {"id": i, "label": label, "tags": [tag], "description": f"{label} is defined here.", "dok": 1, "assessment_criteria": f"Learner can define {label}.", "provenance": {"chunk_id": "x01"}}

    a = {"items": [item("alpha", "Alpha", "concept"), item("beta", "Beta", "concept"), item("s1", "Shared", "method")], "surmise": [["alpha", "beta"], ["beta", "s1"]], "metadata": {}}
    b = {"items": [item("s2", "Shared", "method"), item("gamma", "Gamma", "concept")], "surmise": [["s2", "gamma"]], "metadata": {}}
    return {"a": a, "b": b}
