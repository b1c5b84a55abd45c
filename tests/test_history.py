"""Histories from text logs, and files followed through renames."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import history as H
from loomspan.operators import snapshots as A
from loomspan.queries import systems
from loomspan.sources import readers

LOG = """commit\tc5\tAda Lin\t2024-03-05T10:00:00+01:00

3\t1\tsrc/{core => base}/a.py
commit\tc4\tBo\t2024-03-04T10:00:00+00:00

commit\tc3\tBo\t2024-03-03T10:00:00+00:00

2\t0\tsrc/{ => core}/a.py
-\t-\tlogo.png
commit\tc2\tAda Lin\t2024-03-02T10:00:00+00:00

0\t0\told name.py => src/a.py
1\t1\t"ta\\tb.py"
commit\tc1\tAda Lin\t2024-03-01T10:00:00+00:00

10\t0\told name.py
5\t0\tlogo.png
"""


def test_log(spark, tmp_path):
    (tmp_path / "one.log").write_text(LOG)
    found = H.changes(readers.read_history(spark, str(tmp_path)))
    got = {(r.repo, r.commit, r.path, r.old, r.added, r.removed) for r in found.collect()}
    assert got == {
        ("one", "c5", "src/base/a.py", "src/core/a.py", 3, 1), ("one", "c3", "src/core/a.py", "src/a.py", 2, 0), ("one", "c3", "logo.png", None, 0, 0),
        ("one", "c2", "src/a.py", "old name.py", 0, 0), ("one", "c2", "ta\tb.py", None, 1, 1), ("one", "c1", "old name.py", None, 10, 0), ("one", "c1", "logo.png", None, 5, 0),
    }
    order = [r.commit for r in found.select("commit", "place").distinct().orderBy("place").collect()]
    assert order == ["c1", "c2", "c3", "c5"]
    counts = {r.path: (r.commits, r.authors, r.added, r.removed, str(r["last"])[:10]) for r in A.churn(H.follow_renames(found)).collect()}
    assert counts == {"src/base/a.py": (4, 2, 15, 1, "2024-03-05"), "logo.png": (2, 2, 5, 0, "2024-03-03"), "ta\tb.py": (1, 1, 1, 1, "2024-03-02")}
    latest = H.changes(H.recent(readers.read_history(spark, str(tmp_path)), 3))
    assert {(r.commit, r.author, r.files, r.added) for r in H.timeline(latest).collect()} == {("c5", "Ada Lin", 1, 3), ("c3", "Bo", 2, 2)}


def test_no_history(spark, tmp_path):
    none = readers.read_history(spark, str(tmp_path / "gone"))
    assert A.churn(H.follow_renames(H.changes(none))).collect() == []
    odd = spark.createDataFrame([("r", 1, None), ("r", 2, ""), ("r", 3, "x"), ("r", 4, "c\ta\tno time\n1\t2\tf\nnonsense")], "repo string, place long, entry string")
    assert [(r.commit, r.author, r.at, r.path, r.added, r.removed) for r in H.changes(odd).collect()] == [("c", "a", None, "f", 1, 2)]


def test_splits_keep_the_order(spark, tmp_path):
    entries = "".join(f"commit\tc{i}\ta\t2024-01-01T00:00:00+00:00\n\n{i}\t0\tf{i}\n" for i in range(2000, 0, -1))
    (tmp_path / "r.log").write_text(entries)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.read_history(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 4
        order = [r.commit for r in H.changes(rows).orderBy("place").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert order == [f"c{i}" for i in range(1, 2001)]


def replayed(commits):
    """What every change's file is called in the end, by going through the commits; files are told apart by number."""
    here, files, seen = {}, 0, []
    names, eras = {}, {}
    for place, moves, touched in commits:
        taken = {}
        for old, new in moves:
            if old not in here:
                here[old], files = files, files + 1
                names[here[old]], eras[here[old]] = old, None
            taken[new] = here[old]
        for old, _ in moves:
            here.pop(old, None)
        for new, f in taken.items():
            here[new] = f
            names[f], eras[f] = new, place
        for path in touched:
            if path not in here:
                here[path], files = files, files + 1
                names[here[path]], eras[here[path]] = path, "any"
            seen.append((place, path, here[path]))
    return {(place, path): names[f] for place, path, f in seen}


@pytest.mark.parametrize("seed", range(3))
def test_renames_against_replay(spark, seed):
    """Chains, rings, swaps and names that come back: each change goes to the file that bore the name just then."""
    rng, commits, there = random.Random(seed), [], set()
    for place in range(1, 120):
        names = [f"n{i}" for i in range(7)]
        olds = rng.sample(sorted(there), min(len(there), rng.choice([0, 0, 1, 2])))
        news = rng.sample([n for n in names if n in olds or n not in there], len(olds)) if olds else []
        moves = [(o, n) for o, n in zip(olds, news, strict=True) if o != n]
        there = (there - {o for o, _ in moves}) | {n for _, n in moves}
        touched = [n for _, n in moves] + [n for n in rng.sample(names, 2) if n not in {x for m in moves for x in m}]
        there |= set(touched)
        commits.append((place, moves, touched))
    rows = []
    for place, moves, touched in commits:
        old = {n: o for o, n in moves}
        rows += [("r", place, f"{place}:{path}", path, old.get(path)) for path in touched]
    changed = spark.createDataFrame(rows, "repo string, place long, mark string, path string, old string")
    got = {r.mark: r.path for r in H.follow_renames(changed).collect()}
    assert got == {f"{place}:{path}": name for (place, path), name in replayed(commits).items()}


def test_long_chain_and_lives(spark):
    rows = [("r", i, f"f{i}", f"f{i - 1}" if i else None) for i in range(600)] + [("r", 700, "f0", None)]
    out = H.follow_renames(spark.createDataFrame(rows, "repo string, place long, path string, old string"))
    assert {(r.path, r.era, r.n) for r in out.groupBy("path", "era").agg(F.count("*").alias("n")).collect()} == {("f599", 599, 600), ("f0", 1, 1)}


def test_churn_counts_exactly_and_repeats_no_row(spark):
    """Commits of several authors, rows without a commit or an author; no row is expanded for distinct counts."""
    rows = [("r", "f", 1, "a", 1), ("r", "f", 1, "b", 2), ("r", "f", 2, "a", 4), ("r", "f", None, None, 8), ("q", "f", 1, "a", 16), ("q", None, None, "c", 32), (None, "g", 3, None, 64)]
    commits = spark.createDataFrame(rows, "repo string, path string, commit long, author string, added long").selectExpr("*", "date'2024-01-01' AS at", "1L AS removed")
    counts = A.churn(commits, "repo")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert {(r.repo, r.path): (r.commits, r.authors, r.added, r.removed) for r in counts.collect()} == {("r", "f"): (2, 2, 15, 4), ("q", "f"): (1, 1, 16, 1), ("q", None): (0, 1, 32, 1), (None, "g"): (1, 0, 64, 1)}
    assert "Expand" not in plan and plan.count("Exchange") == 1


def test_changes_are_parsed_once(spark):
    """Renames are found in written changes: the log is not parsed again for each use."""
    parsed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            parsed.add(batch.num_rows)
            yield batch

    entries = spark.createDataFrame([("r", 1, "commit\tc1\ta\t2024-01-01T00:00:00+00:00\n\n1\t0\t/x//b"), ("r", 2, "commit\tc2\ta\t2024-01-02T00:00:00+00:00\n\n1234567890123456789\t2\tx/{b => c}")], "repo string, place long, entry string")
    found = H.follow_renames(H.changes(entries.mapInArrow(count, entries.schema)))
    assert {(r.path, r.old, r.added, r.removed) for r in found.collect()} == {("x/c", None, 1, 0), ("x/c", "x/b", 0, 2)}
    assert parsed.value == 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_the_log_is_made_in_tasks_of_bounded_rows(spark, monkeypatch):
    """The session's own number of partitions is 4; the log's tasks follow its lines."""
    latest = lambda: sorted(map(tuple, systems.q75_timeline(spark, "/root/testdata/sf0.001").collect()))
    whole = latest()
    monkeypatch.setattr(systems, "_LOG_ROWS", 500)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert systems._log(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == -(-lines // 500)
    assert latest() == whole != []
