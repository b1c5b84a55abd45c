"""python -m loomspan: break, author, learn, merge, play, quest, book, chain, export.

Exit status 0: done; 2: bad input; 1: an internal error.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from loomspan.operators.cassette import Cassette, RemoteModel, default_model
from loomspan.plans import pipelines as P
from loomspan.sources import writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomspan", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **flags) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a, nargs="+" if a == "inputs" else None)
        s.add_argument("--out", required=True)
        for f, kind in flags.items():
            s.add_argument(f"--{f.replace('_', '-')}", type=kind)
        return s

    model = {"token_budget": int, "cassette": str, "model": str}
    add("break", "input", max_items=int, **model)
    add("author", "graph", **model)
    add("learn", "beats", "script")
    add("merge", "inputs")
    add("play", "beats", script=str, actor=str, save=str, resume=str, max_retries=int)
    add("quest", "beats", "graph", responses=str, actor=str, save=str, resume=str, max_retries=int, max_steps=int)
    add("book", "inputs", responses=str, max_retries=int, max_steps=int)
    add("chain", "inputs", responses=str, max_retries=int, max_steps=int, max_items=int, **model)
    add("export", "store")
    return p


def _model(args: argparse.Namespace):
    """The remote model, recorded replies, the default ones, or none (--model remote, recorded, rules)."""
    kind = getattr(args, "model", None)
    if kind not in (None, "remote", "recorded", "rules"):
        raise ValueError("--model is remote, recorded or rules")
    if kind == "remote":
        return RemoteModel.configured()
    if getattr(args, "cassette", None):
        return Cassette.from_file(args.cassette)
    return default_model() if kind != "rules" and hasattr(args, "cassette") else None


def _json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _lines(path: str | None) -> list[str]:
    """Lines of a file, or of standard input."""
    if path is None:
        return sys.stdin.read().splitlines()
    with open(path, encoding="utf-8") as f:
        return f.read().splitlines()


def _attempt(line: str) -> dict:
    parts = line.split("|", 2)
    if len(parts) < 3 or not parts[0].strip() or not parts[1].strip():
        raise ValueError(f"not an attempt: {line}")
    return {"beat_id": parts[0].strip(), "check_id": parts[1].strip(), "response": P.parsed([parts[2]])[0] if parts[2].strip() else ""}


def run(args: argparse.Namespace, spark: SparkSession) -> str:
    out = lambda name: os.path.join(args.out, name)
    given = {k: getattr(args, k) for k in ("max_retries", "max_steps") if getattr(args, k, None) is not None}
    given |= {k: getattr(args, k) for k in ("actor", "resume", "save") if getattr(args, k, None)}
    model = _model(args)
    name = lambda path: os.path.splitext(os.path.basename(path))[0]
    if args.command == "break":
        counts = P.break_file(spark, args.input, args.out, max_items=args.max_items or P.MAX_ITEMS, model=model, budget=args.token_budget)
        return f"ITEMS={counts['items']} EDGES={counts['edges']} STATES={counts['states']} FRINGE0={counts['fringe']} TOKENS={model.total_tokens if model else 0}"
    if args.command == "author":
        story = P.author(spark, _json(args.graph), args.out, model, args.token_budget)
        return f"BEATS={len(story['beats'])} CHECKS={len(story['checks'])} PRUNED={story['metadata']['pruned']}"
    if args.command == "export":
        return f"STATEMENTS={writers.export_statements(spark, args.store, args.out)}"
    if args.command in ("learn", "play"):
        script = _json(args.script) if args.script else {"attempts": [_attempt(x) for x in _lines(None) if x.strip()]}
        if not isinstance(script.get("attempts"), list):
            raise ValueError("a script needs attempts")
        given.setdefault("actor", script.get("actor") or "learner")
        session = P.play(spark, _json(args.beats), script["attempts"], args.out, **given)
        return f"ATTEMPTS={session['attempts']} PASSED={session['passed']} XP={session['xp']}"
    if args.command == "merge":
        counts = P.merge_files(spark, {name(p): _json(p) for p in args.inputs}, args.out)
        return " ".join(f"{k.upper()}={v}" for k, v in counts.items())
    responses = P.parsed(_lines(args.responses))
    if args.command == "quest":
        session = P.quest(spark, _json(args.beats), _json(args.graph), responses, args.out, **given)
    elif args.command == "book":
        session = P.book_quest(spark, {name(p): _json(p) for p in args.inputs}, responses, args.out, **given)
    else:
        session = P.full_chain(spark, args.inputs, responses, args.out, args.max_items or P.MAX_ITEMS, model, args.token_budget, **given)
    return f"REASON={session['completion']['reason']} VISITED={session['completion']['visited']} XP={session['xp']}"


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        print(run(args, SparkSession.builder.appName("loomspan").getOrCreate()))
    except (ValueError, FileNotFoundError, KeyError) as bad:
        print(f"error: {bad}", file=sys.stderr)
        return 2
    except Exception as broken:  # noqa: BLE001
        print(f"internal error: {broken}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
