"""Sinks: statement stores, JSON artefacts, learner states, reports."""

from __future__ import annotations

import json
import os
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions.replay import Learner
from loomspan.sources.readers import check_statements

STATE_KEYS = tuple(f.name for f in fields(Learner))


def append_statements(statements: DataFrame, path: str, start: int = 0) -> None:
    """Append statements (actor, step, seq, verb, object, score, success, p) as JSON lines.

    Timestamps are logical: the step, or, without one, the statement's number in its actor's log from start on.
    """
    number = F.row_number().over(W.partitionBy("actor").orderBy("step", "seq")) - 1 + start
    result = F.struct("score", "success", "p")
    rows = statements.select("actor", "verb", "object", result.alias("result"), F.coalesce("step", number).alias("timestamp"))
    rows.write.mode("append").option("ignoreNullFields", True).json(path)


def export_statements(spark: SparkSession, path: str, out: str) -> int:
    """Copy a store after checking each line; an error names the first bad line."""
    if bad := check_statements(spark, path).orderBy("line").first():
        raise ValueError(f"statement {bad['line']}: {bad['problem']}")
    rows = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    rows.write.text(out)
    return rows.count()


def write_document(document: dict, path: str, indent: int = 2) -> None:
    """A JSON artefact with sorted keys, byte for byte the same for the same content."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document, f, indent=indent, sort_keys=True, ensure_ascii=False)
        f.write("\n")


def save_state(learner: Learner, path: str) -> None:
    write_document(json.loads(learner.dumps()), path, indent=1)


def load_state(path: str) -> Learner:
    """A saved learner; missing or unknown fields and wrong kinds are refused."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if not isinstance(data, dict) or sorted(data) != sorted(STATE_KEYS):
        raise ValueError(f"{path}: not a learner state")
    fresh = Learner()
    for k in STATE_KEYS:
        if k != "run_key" and not isinstance(data[k], type(getattr(fresh, k))):
            raise ValueError(f"{path}: {k} has the wrong kind")
    return Learner(**data)


def write_report(lines: list[str], path: str, more: bool = False) -> None:
    """A report of lines; more adds them to what is there."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a" if more else "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def write_told(told: list[dict], path: str, actor: str, more: bool = False) -> int:
    """One learner's statements as JSON lines, sorted keys; more appends. Returns the statements the store now holds."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a" if more else "w", encoding="utf-8") as f:
        f.writelines(json.dumps({"actor": actor, **t}, sort_keys=True) + "\n" for t in told)
    with open(path, encoding="utf-8") as f:
        return sum(1 for line in f if line.strip())
