"""Version-control history from text logs: commits, changed files, and files followed through their renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.plans.storage import discard, is_written, materialize

# The log's format (`log --numstat -M --date=iso-strict --format=commit%x09%H%x09%an%x09%aI`, with
# core.quotePath=false). A commit's line, then one line for each file: added, removed ('-' where binary) and its path,
# for renames as `old => new` or with the parts that differ in braces.
HEAD = "commit\t"
CHANGE = r"^(\d+|-)\t(\d+|-)\t(.+)$"
BRACES = r"^(.*)\{(.*?) => (.*?)\}(.*)$"
ARROW = " => "


def _plain(name: Column) -> Column:
    """A path without the quotes and escapes that unusual names are given, and without empty steps."""
    inner = F.regexp_extract(name, '^"(.*)"$', 1)
    for mark, char in (("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
        inner = F.replace(inner, F.lit(mark), F.lit(char))
    steps = F.when(name.contains("//") | name.startswith("/"), F.regexp_replace(F.regexp_replace(name, "/{2,}", "/"), "^/", "")).otherwise(name)
    return F.when(name.startswith('"') & name.endswith('"'), inner).otherwise(steps)


def recent(entries: DataFrame, most: int) -> DataFrame:
    """The most latest log entries of each repository; ranks are cut in every task before they are merged."""
    order = W.partitionBy("repo").orderBy(F.desc("place"))
    return entries.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most).drop("__n")


def changes(entries: DataFrame) -> DataFrame:
    """(repo, place, commit, author, at, path, old, added, removed): a row for each file that an entry changed.

    entries: (repo, place, entry), one commit's text each; place orders a repository's commits from old to new. old is
    the name before a rename, else null. Lines that are no change, and commits of none (merges), give no row; a name
    that itself holds an arrow cannot be told from a rename in this format. Null entries give no row.
    """
    lines = F.split("entry", "\r?\n")
    head = F.split(F.regexp_replace(F.element_at(lines, 1), f"^{HEAD}", ""), "\t")
    own = entries.filter(F.col("entry").isNotNull()).select("repo", "place", head.alias("head"), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))).alias("lines"))
    at = F.try_to_timestamp(F.get("head", F.lit(2)))
    own = own.select("repo", "place", F.get("head", F.lit(0)).alias("commit"), F.get("head", F.lit(1)).alias("author"), at.alias("at"), "lines")
    rows = own.select("repo", "place", "commit", "author", "at", F.explode("lines").alias("line")).filter(F.col("line").rlike(CHANGE))

    def count(n: int) -> Column:
        digits = F.substring_index(F.substring_index("line", "\t", n), "\t", -1)
        return F.coalesce(F.when(F.length(digits) <= 18, digits.try_cast("long")), F.lit(0)).cast("long")

    # each step names what the next one uses several times, so that a pattern is matched once a line
    rows = rows.select("repo", "place", "commit", "author", "at", count(1).alias("added"), count(2).alias("removed"), F.regexp_extract("line", CHANGE, 3).alias("name"))
    name = F.col("name")
    inside = lambda n: F.concat(F.regexp_extract(name, BRACES, 1), F.regexp_extract(name, BRACES, n), F.regexp_extract(name, BRACES, 4))
    sides = F.when(~name.contains(ARROW), F.array(F.lit(None).cast("string"), name)).when(name.rlike(BRACES), F.array(inside(2), inside(3))).otherwise(F.split(name, ARROW, 2))
    rows = rows.withColumn("sides", sides)
    rows = rows.withColumns({"path": F.get("sides", F.lit(1)), "old": F.get("sides", F.lit(0))})
    return rows.select("repo", "place", "commit", "author", "at", _plain(F.col("path")).alias("path"), _plain(F.col("old")).alias("old"), "added", "removed")


def _latest(moves: DataFrame) -> DataFrame:
    """(repo, path, era, last, last_era): where each name that was given up leads in the end, by pointer jumping.

    moves: (repo, path, era, last, last_era), one step each. Eras grow along a chain, so there are no rings, and a chain
    of n renames takes log2(n) rounds of one join over the renames.
    """
    table = materialize(moves)
    while True:
        links = table.select("repo", "path", "era", "last", "last_era")
        on = links.select("repo", F.col("path").alias("last"), F.col("era").alias("last_era"), F.col("last").alias("then"), F.col("last_era").alias("then_era"))
        jumped = links.join(on, ["repo", "last", "last_era"], "left")
        later = (F.coalesce("then", "last").alias("last"), F.coalesce("then_era", "last_era").alias("last_era"))
        after = materialize(jumped.select("repo", "path", "era", *later, F.col("then").isNotNull().alias("went")))
        discard(table)
        table = after
        if after.filter("went").isEmpty():
            return after.drop("went")


def follow_renames(changed: DataFrame) -> DataFrame:
    """changed with each path as its file is called last, and the era in which it bears that name (null: from the start).

    changed: (repo, place, path, old, …). A name means another file from each commit on that gives it up or takes it, so
    names that come back, are swapped or are taken over keep their files apart; files that bore one name in different
    eras differ in era. Where a commit moves one file to several names, the smallest is the file's, the others are new.
    A name's eras travel as one array, as long as its renames are many; changes meet it in a single join. Rows without
    a repository keep their names. changed is written first where it is no written table: it is read twice, and a
    log would be parsed for each.
    """
    changed = changed if is_written(changed) else materialize(changed)
    renames = materialize(changed.filter("old IS NOT NULL AND old <> path").select("repo", "place", "old", "path").distinct())
    turns = renames.select("repo", F.col("old").alias("path"), "place").unionByName(renames.select("repo", "path", "place"))
    starts = materialize(turns.groupBy("repo", "path").agg(F.collect_set("place").alias("starts")))
    moves = renames.groupBy("repo", F.col("old").alias("path"), "place").agg(F.min("path").alias("last"))
    era = F.array_max(F.filter("starts", lambda s: s < F.col("place")))
    latest = _latest(moves.join(starts, ["repo", "path"]).select("repo", "path", era.alias("era"), "last", F.col("place").alias("last_era")))
    eras = starts.select("repo", "path", F.explode(F.array_append("starts", F.lit(None))).alias("era"))
    same = (eras["repo"] == latest["repo"]) & (eras["path"] == latest["path"]) & eras["era"].eqNullSafe(latest["era"])
    last, last_era = F.coalesce(latest["last"], eras["path"]), F.when(latest["last"].isNotNull(), latest["last_era"]).otherwise(eras["era"])
    led = eras.join(latest, same, "left").select(eras["repo"], eras["path"], F.struct(eras["era"].alias("start"), last.alias("last"), last_era.alias("era")).alias("e"))
    named = led.groupBy(F.col("repo").alias("__repo"), F.col("path").alias("__path")).agg(F.collect_list("e").alias("__eras"))
    met = changed.join(named, (changed["repo"] == named["__repo"]) & (changed["path"] == named["__path"]), "left")
    now = F.array_max(F.filter("__eras", lambda e: e["start"].isNull() | (e["start"] <= F.col("place"))))
    met = met.withColumn("__now", now)
    kept = [F.coalesce("__now.last", "path").alias("path") if c == "path" else F.col(c) for c in changed.columns]
    return met.select(*kept, F.col("__now.era").alias("era"))


def timeline(changed: DataFrame) -> DataFrame:
    """(repo, place, commit, author, at, files, added, removed): a row for each commit that changed files."""
    keys = ("repo", "place", "commit", "author", "at")
    return changed.groupBy(*keys).agg(F.count_distinct("path").alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
