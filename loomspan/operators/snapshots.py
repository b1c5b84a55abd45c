"""Repository snapshots: directories, line and marker counts, import edges, symbol containment, calls, layout clamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.operators.cores import cyclic_parts
from loomspan.operators.groups import map_groups
from loomspan.operators.ranks import nth_values
from loomspan.plans.storage import broadcast_if_small, free_name, materialize

# Work markers, the longest average line of hand-written code, symbols per file, kept source size.
MARKERS = r"\b(TODO|FIXME|HACK|XXX)\b"
DENSE, MAX_SYMBOLS, MAX_SOURCE, CUT_MARK = 250, 300, 512 * 1024, "\n… (truncated)"
MINIFIED = r"\.(min|bundle)\."


def loc(text: Column) -> Column:
    """Lines that hold more than blanks."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike("[^ \t\r]"))).cast("long")


def markers(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(MARKERS)), F.lit(0)).cast("long")


def is_minified(path: Column, text: Column) -> Column:
    return path.rlike(MINIFIED) | (F.length(text) / F.greatest(loc(text), F.lit(1)) > DENSE)


def clean_import(text: Column) -> Column:
    """An import without the quote or bracket at either end, and without blanks around."""
    return F.regexp_replace(F.regexp_replace(text, """^["'<]|["'>]$""", ""), r"^\s+|\s+$", "")


def clipped_source(text: Column, most: int = MAX_SOURCE) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(CUT_MARK))).otherwise(text)


# What may not stand inside a script element, and in HTML.
SCRIPT_MARKS = (("<", "\\u003c"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029"))
HTML_MARKS = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def _marked(text: Column, marks: tuple[tuple[str, str], ...]) -> Column:
    for mark, instead in marks:
        text = F.replace(text, F.lit(mark), F.lit(instead))
    return text


def script_json(text: Column) -> Column:
    """JSON that may stand inside a script element."""
    return _marked(text, SCRIPT_MARKS)


def html_escape(text: Column) -> Column:
    return _marked(F.coalesce(text, F.lit("")), HTML_MARKS)


def short_date(iso: Column) -> Column:
    """Minutes in UTC of an ISO time; a dash for none, and what is no time as it is."""
    minutes = F.date_format(F.to_utc_timestamp(F.try_to_timestamp(iso), F.current_timezone()), "yyyy-MM-dd HH:mm")
    return F.when(F.coalesce(iso, F.lit("")) == "", "—").otherwise(F.coalesce(minutes, iso))


def directories(files: DataFrame) -> DataFrame:
    """(path, name, parent, depth, files): every directory above a file, the root included as ''."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    own = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    rows = files.select(F.explode(above).alias("dir"), own.alias("own"))
    dirs = rows.groupBy("dir").agg(F.count_if(F.col("dir") == F.col("own")).alias("files"))
    steps = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(steps))
    parent = F.when(F.col("dir") == "", F.lit(None)).otherwise(F.array_join(F.slice(steps, 1, F.size(steps) - 1), "/"))
    return dirs.select(F.col("dir").alias("path"), F.element_at(steps, -1).alias("name"), parent.alias("parent"), depth.alias("depth"), "files")


def import_edges(specs: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, weak): file specs (src, spec, weak) resolved to files (path); distinct, none to itself, strong wins."""
    met = specs.join(files.select(F.col("path").alias("spec"), F.col("path").alias("dst")), "spec").filter("src <> dst")
    return met.groupBy("src", "dst").agg(F.min("weak").alias("weak"))


def resolve_packages(imports: DataFrame, files: DataFrame, roots: tuple[str, ...], suffix: str = ".java", max_wildcard: int = 40) -> DataFrame:
    """(src, dst, weak) of dotted imports: under each root in turn, a class file, or all files of a package (weak)."""
    path = F.replace("name", F.lit("."), F.lit("/"))
    tries = F.transform(F.array(*map(F.lit, roots)), lambda r, i: F.struct(i.alias("rank"), F.concat(r, path).alias("at")))
    asked = imports.select("src", "name", F.explode(tries).alias("t")).select("src", "name", "t.rank", "t.at")
    exact = asked.join(files.select(F.col("path").alias("dst"), F.regexp_replace("path", f"\\{suffix}$", "").alias("at")), "at")
    exact = exact.groupBy("src", "name").agg(F.min_by("dst", "rank").alias("dst")).withColumn("weak", F.lit(False))
    package = F.regexp_replace("path", "/[^/]*$", "")
    listed = files.withColumn("at", package).withColumn("n", F.row_number().over(W.partitionBy("at").orderBy("path"))).filter(F.col("n") <= max_wildcard)
    star = asked.withColumn("at", F.regexp_replace("at", "/\\*$", "")).join(listed.select("at", F.col("path").alias("dst")), "at").join(exact.select("src", "name"), ["src", "name"], "left_anti")
    star = star.withColumn("best", F.min("rank").over(W.partitionBy("src", "name"))).filter("rank = best").select("src", "name", "dst", F.lit(True).alias("weak"))
    both = exact.unionByName(star).filter("src <> dst")
    return both.groupBy("src", "dst").agg(F.min("weak").alias("weak"))


def language_stats(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("language", F.lit("other")).alias("language")).agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))


def kept_symbols(defs: DataFrame) -> DataFrame:
    """The MAX_SYMBOLS longest definitions of each file."""
    order = W.partitionBy("file").orderBy(F.desc(F.col("end") - F.col("start")), "idx")
    return defs.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= MAX_SYMBOLS).drop("__n")


def _nested(defs: Column) -> Column:
    """(idx, parent) of one file's definitions (start, end, idx), each in turn met by those still open where it starts.

    In order of their starts, longer ones first, what encloses a definition comes before it; what has ended is closed.
    """
    length = lambda d: d["end"] - d["start"]
    order = lambda x, y: F.when(x["start"] != y["start"], F.sign(x["start"] - y["start"])).when(x["end"] != y["end"], F.sign(y["end"] - x["end"])).otherwise(F.sign(x["idx"] - y["idx"])).cast("int")
    kind = "struct<start:long,end:long,idx:long>"
    nothing = F.struct(F.array().cast(f"array<{kind}>").alias("open"), F.array().cast("array<struct<idx:long,parent:long>>").alias("out"))

    def meet(acc: Column, d: Column) -> Column:
        left = F.filter(acc["open"], lambda o: o["end"] >= d["start"])
        around = F.filter(left, lambda o: (o["end"] >= d["end"]) & (length(o) > length(d)))
        parent = F.array_min(F.transform(around, lambda o: F.struct(length(o).alias("span"), o["idx"].alias("idx"))))["idx"]
        return F.struct(F.array_append(left, d).alias("open"), F.array_append(acc["out"], F.struct(d["idx"].alias("idx"), parent.alias("parent"))).alias("out"))

    return F.aggregate(F.array_sort(defs, order), nothing, meet, lambda acc: acc["out"])


def _by_file(kept: DataFrame) -> DataFrame:
    """(file, defs): at most MAX_SYMBOLS definitions of each file, as one array."""
    place = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("idx").cast("long").alias("idx"))
    return kept.groupBy("file").agg(F.collect_list(place).alias("defs"))


def containment(defs: DataFrame) -> DataFrame:
    """(file, idx, parent): the smallest definition that strictly encloses another, the lower index among equals.

    A file's definitions are gone through once, with those that are still open at hand; no pairs are joined.
    """
    return _by_file(kept_symbols(defs)).select("file", F.inline(_nested(F.col("defs"))))


def call_edges(defs: DataFrame, refs: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(src_file, src_idx, dst_file, dst_idx): a reference's innermost definition to the definition it names.

    The name is looked up in the own file first, then in the files that it imports, in order; distinct, no self-calls.
    Each reference is one row throughout: it meets its file's definitions as an array.
    """
    kept = kept_symbols(defs)
    around = F.filter("defs", lambda d: F.col("line").between(d["start"], d["end"]))
    inner = F.array_min(F.transform(around, lambda d: F.struct((d["end"] - d["start"]).alias("span"), d["idx"].alias("idx"))))["idx"]
    callers = refs.select("file", "line", "name").distinct().join(_by_file(kept), "file").select("file", "line", "name", inner.alias("src_idx")).filter("src_idx IS NOT NULL")
    named = kept.groupBy(F.col("file").alias("dst_file"), "name").agg(F.min("idx").alias("dst_idx"))
    places = callers.select("file").distinct().select("file", F.col("file").alias("dst_file"), F.lit(0).cast("long").alias("rank"))
    places = places.unionByName(neighbours.select("file", F.col("neighbour").alias("dst_file"), (F.col("rank") + 1).cast("long").alias("rank")))
    found = callers.join(places, "file").join(named, ["dst_file", "name"])
    best = found.groupBy("file", "line", "name", "src_idx").agg(F.min(F.struct("rank", "dst_file", "dst_idx")).alias("b"))
    out = best.select(F.col("file").alias("src_file"), "src_idx", F.col("b.dst_file").alias("dst_file"), F.col("b.dst_idx").alias("dst_idx"))
    return out.filter((F.col("src_file") != F.col("dst_file")) | (F.col("src_idx") != F.col("dst_idx"))).distinct()


def radius_clamp(points: DataFrame, group: str, radius: str, least: float = 25.0) -> DataFrame:
    """Adds soft (the group's 75th percentile by floor index, least at least) and scale (1 within, soft/r beyond).

    The percentile is exact and found by counting, so no group is sorted; rows only meet their group's one.
    """
    softs = nth_values(points, group, radius, lambda size: F.floor((size - 1) * 0.75))
    softs = broadcast_if_small(softs.select(F.col("g").alias(free_name(points, "__group")), F.greatest(F.lit(least), "nth").alias("soft")), 96)
    met = points.join(softs, points[group].eqNullSafe(softs[softs.columns[0]]), "left").select(*points.columns, "soft")
    return met.withColumn("scale", F.when(F.col(radius) > 0, F.least(F.lit(1.0), F.col("soft") / F.col(radius))).otherwise(1.0))


def components_of(arcs: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components by one depth-first walk with an explicit stack."""
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    open_: list[str] = []
    inside: set[str] = set()
    out: list[list[str]] = []
    for root in arcs:
        if root in number:
            continue
        path = [(root, iter(arcs[root]))]
        number[root] = low[root] = len(number)
        open_.append(root)
        inside.add(root)
        while path:
            node, rest = path[-1]
            child = next(rest, None)
            if child is not None:
                if child not in number:
                    number[child] = low[child] = len(number)
                    open_.append(child)
                    inside.add(child)
                    path.append((child, iter(arcs.get(child, ()))))
                elif child in inside:
                    low[node] = min(low[node], number[child])
                continue
            path.pop()
            if path:
                low[path[-1][0]] = min(low[path[-1][0]], low[node])
            if low[node] == number[node]:
                found = []
                while not found or found[-1] != node:
                    found.append(open_.pop())
                inside.difference_update(found)
                out.append(found)
    return out


def cycles(edges: DataFrame, repo: str | None = None) -> DataFrame:
    """(repo, path, component): files on import cycles; files that reach each other are one component, named by its
    smallest path. edges: (src, dst), and the repository where there are several.

    Of a large repository, what no cycle can hold is trimmed first, and the parts that are left are walked by a task each.
    """

    def walk(key: tuple, rows: list[tuple]) -> list[tuple]:
        arcs: dict[str, list[str]] = {}
        for src, dst in rows:
            arcs.setdefault(src, []).append(dst)
        return [(key[0], path, min(c)) for c in components_of(arcs) if len(c) > 1 for path in c]

    owner = F.col(repo).cast("string") if repo else F.lit("")
    parts = cyclic_parts(materialize(edges.select(owner.alias("graph"), "src", "dst").distinct()), both_ways=True)
    return map_groups(parts, ["graph", "part"], walk, "repo string, path string, component string")


def scan(spark: SparkSession, folder: str, max_files: int = 30_000) -> DataFrame:
    """(path, text) of the first max_files of a folder's files by their paths; paths are below the folder.

    Paths alone are sorted, which opens no file; the last path that counts then prunes the scan that reads contents. Rows
    come as they are read, in no order.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = F.regexp_replace(F.lit(folder.rstrip("/")), "^[a-z]+:/*", "/")
    below = lambda whole: F.substr(F.regexp_replace(whole, "^[a-z]+:/*", "/"), F.length(root) + 2)
    last = files.select(below("path").alias("path")).orderBy("path").limit(max_files).agg(F.max("path")).first()[0]
    at = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # there, names are encoded
    return files.filter(below(at) <= F.lit(last)).select(below("path").alias("path"), F.col("content").cast("string").alias("text"))


# How the names of a parser's captures begin.
SYMBOL, IMPORT, BRANCH = "def.", "import.", "cx"


def capture_counts(captures: DataFrame) -> DataFrame:
    """(path, symbols, imports, complexity) of a parser's captures (path, name)."""
    name = F.col("name")
    kinds = {"symbols": name.startswith(SYMBOL), "imports": name.startswith(IMPORT), "complexity": name == BRANCH}
    return captures.groupBy("path").agg(*(F.count_if(kind).alias(k) for k, kind in kinds.items()))


def churn(commits: DataFrame, *of: str) -> DataFrame:
    """(path, commits, authors, added, removed, first, last) of commit rows (path, commit, author, at, added, removed).

    of names further columns that tell files apart, such as their repository. Without any commits, as in a folder that
    is no repository, the result is empty. Rows move once, to their file's task; commits and authors are ranked there in
    sorts that spill, so distinct counts neither repeat rows nor hold sets.
    """
    files = [*of, "path"]
    nth = lambda c: F.when(F.col(c).isNotNull(), F.dense_rank().over(W.partitionBy(*files).orderBy(F.asc_nulls_last(c))))
    rows = commits.select(*files, "commit", "author", "at", "added", "removed").repartition(*files).withColumns({"commits": nth("commit"), "authors": nth("author")})
    counts = (F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("commits", "authors"))
    return rows.groupBy(*files).agg(*counts, F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.min("at").alias("first"), F.max("at").alias("last"))


def lenses(commits: DataFrame, half_life: int = 90) -> DataFrame:
    """(repo, path, activity, hotspot, age, owner, share): what heats, dates and owns each file.

    commits: (repo, path, commit, author, at, added, removed). activity sums changed lines, halved for every half_life
    days before the repository's last commit; hotspot is the file's rank by it, ties to the smaller path; age counts
    days from the file's last commit to the repository's; the owner changed the most lines (ties: the smallest author), share of all.
    Without commits the result is empty; files of no changed line have a share of 0.
    """
    lines = (F.col("added") + F.col("removed")).alias("lines")
    daily = commits.select("repo", "path", "author", F.to_date("at").alias("day"), lines).groupBy("repo", "path", "author", "day").agg(F.sum("lines").alias("lines"))
    daily = daily.join(commits.groupBy("repo").agg(F.max(F.to_date("at")).alias("now")), "repo")
    heat = F.col("lines") * F.pow(F.lit(2.0), -F.datediff("now", "day") / half_life)
    people = daily.groupBy("repo", "path", "author").agg(F.sum("lines").alias("lines"), F.sum(heat).alias("heat"), F.min(F.datediff("now", "day")).alias("age"))
    first = F.struct((-F.col("lines")).alias("lines"), F.col("author"))
    files = people.groupBy("repo", "path").agg(F.sum("heat").alias("heat"), F.min("age").alias("age"), F.min(first).alias("first"), F.sum("lines").alias("lines"))
    activity = F.bround("heat", 3)  # sums of the same numbers in another order rank alike
    share = F.when(F.col("lines") > 0, -F.col("first.lines") / F.col("lines")).otherwise(0.0)
    rank = F.row_number().over(W.partitionBy("repo").orderBy(F.desc("activity"), "path")).cast("long")
    return files.withColumn("activity", activity).select("repo", "path", "activity", rank.alias("hotspot"), F.col("age").cast("long").alias("age"), F.col("first.author").alias("owner"), share.alias("share"))


def as_object(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, object): each group's map as one JSON object, keys in order."""
    pairs = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("key"), F.col(value).alias("value")))).alias("p"))
    return pairs.select(group, F.to_json(F.map_from_entries("p")).alias("object"))
