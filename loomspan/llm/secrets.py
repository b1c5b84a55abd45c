"""Secret scans judged by corpus-wide ownership frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.plans.storage import materialize

# The base patterns of the scan.
KEYWORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?({VALUE})"""
ACCESS = "AKIA[A-Z0-9]+"
#: Every run of 16 or more is one maximal match of [0-9a-f]+, and no shorter run passes.
HEX = "[0-9a-f]{16,}"

# What the method looks at besides: further key names with shorter values, and long opaque words.
OTHER_KEYWORDS = "[Pp][Ww][Dd]|[Pp][Aa][Ss][Ss][Pp][Hh][Rr][Aa][Ss][Ee]|[Cc][Rr][Ee][Dd][Ee][Nn][Tt][Ii][Aa][Ll]|[Pp][Rr][Ii][Vv][Aa][Tt][Ee]_?[Kk][Ee][Yy]|[Aa][Cc][Cc][Ee][Ss][Ss]_?[Kk][Ee][Yy]|[Bb][Ee][Aa][Rr][Ee][Rr]"
OTHER_ASSIGN = rf"""({OTHER_KEYWORDS})["']?\x20*[:=]\x20*["']?({VALUE})"""
OPAQUE = "[A-Za-z0-9+/_-]{20,}"
MIN_ASSIGN, MIN_ACCESS, MIN_OTHER = 12, 18, 8


#: The scan's patterns in order: kind, place of the kind as listed, pattern, whether a base pattern.
PATTERNS = (("assign", 0, ASSIGN, True), ("access", 1, ACCESS, True), ("hex", 2, HEX, True), ("assign", 0, OTHER_ASSIGN, False), ("hex", 2, OPAQUE, False))
BASES, OTHER, OPAQUES = 3, 3, 4


def _secret(number: int, hit: Column) -> tuple[Column, Column]:
    """The value that a match of a pattern protects, and whether the match counts."""
    if number == OPAQUES:
        return hit, hit.rlike("[0-9]") & hit.rlike("[A-Z]") & hit.rlike("[a-z]")
    if PATTERNS[number][0] == "assign":
        value = F.regexp_extract(hit, PATTERNS[number][2], 2)
        return value, F.length(value) >= (MIN_OTHER if number == OTHER else MIN_ASSIGN)
    return hit, F.length(hit) >= (MIN_ACCESS if number == 1 else 16)


def _matches(text: Column, number: int) -> Column:
    """All matches of a pattern in order: lengths of the piece before and of the match, and the digest if it counts.

    The pieces between the matches come from split() by the same pattern. Texts without a match, nearly all, are
    scanned once.
    """
    pattern = PATTERNS[number][2]
    paired = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def slim(pair: Column) -> Column:
        value, counts = _secret(number, pair["hit"])
        return F.struct(F.lit(number).alias("number"), F.length(pair["gap"]).alias("gap"), F.length(pair["hit"]).alias("length"), F.when(counts, F.sha2(value, 256)).alias("digest"))

    matches = F.transform(F.filter(paired, lambda p: p["hit"].isNotNull()), slim)
    return F.when(F.regexp_like(text, F.lit(pattern)), matches).otherwise(F.array().cast("array<struct<number:int,gap:int,length:int,digest:string>>"))


def _spans(slim: DataFrame) -> DataFrame:
    """One row per span of the rows' matches: positions are running lengths, and further candidates that touch a base
    span (long words: or another assignment) are gone. All in windows over one document's matches, in sorted order."""
    numbers = F.col("number")
    hits = slim.filter(F.size("matches") > 0).select("row_id", "repo", "owner", F.posexplode("matches").alias("at", "m")).select("row_id", "repo", "owner", "at", "m.*")
    running = F.sum(F.col("gap") + F.col("length")).over(W.partitionBy("row_id", "number").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    placed = hits.withColumn("end", running).withColumn("start", F.col("end") - F.col("length")).filter("digest is not null")
    before = W.partitionBy("row_id").orderBy("start").rangeBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("row_id").orderBy(F.desc("start")).rangeBetween(W.unboundedPreceding, 0)

    def touches(others: Column) -> Column:
        reached = F.coalesce(F.max(F.when(others, F.col("end"))).over(before), F.lit(-1)) > F.col("start")
        return reached | (F.coalesce(F.min(F.when(others, F.col("start"))).over(after), F.col("end")) < F.col("end"))

    judged = placed.withColumn("on_base", touches(numbers < BASES)).withColumn("on_other", touches(numbers == OTHER))
    kept = (numbers < BASES) | (~F.col("on_base") & ((numbers == OTHER) | ~F.col("on_other")))
    named = [F.element_at(F.array(*(F.lit(p[i]) for p in PATTERNS)), numbers + 1).alias(n) for i, n in enumerate(("kind", "rank"))]
    return judged.filter(kept).select("row_id", "repo", "owner", "start", "end", *named, "digest", (numbers < BASES).alias("is_base"))


def scan_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "doc_id",
    owner_col: str = "source",
    max_owners: int = 2,
    max_repos: int = 20,
) -> DataFrame:
    """One row per document: doc_id, base (array of spans), added (array of spans), verdicts (live, example counts).

    Candidates are the base spans, and assignments to further key names and long opaque words that touch no base
    span. The SHA-256 of each candidate's value is counted over the corpus: distinct repositories, and distinct
    owners. A value that more than max_owners owners or more than max_repos repositories hold is a widely copied
    example; the rest is owner-specific and looks live. Base spans always stay, with their verdict; a further candidate
    is added only if it looks live. Secret values themselves never leave the operator, only digests travel.

    Nulls: a null text is empty; a null repository or owner counts as one more. Repeated rows keep their own rows and
    count once. A text of many matches costs in proportion to them. An empty table gives an empty table. Other columns
    are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).alias("doc_id"),
        F.col(repo_col).cast("string").alias("repo"),
        F.col(owner_col).cast("string").alias("owner"),
        F.concat(*(_matches(text, n) for n in range(len(PATTERNS)))).alias("matches"),
    )
    slim = materialize(slim)  # the texts are scanned once
    spans = materialize(_spans(slim))

    def distinct(holder: str, name: str) -> DataFrame:
        return spans.groupBy("digest", holder).agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias(name))

    # written, so that the join has plain exchanges on both sides and AQE can split a value that very many rows hold
    frequency = materialize(distinct("owner", "owners").join(distinct("repo", "repos"), "digest"))
    judged = spans.join(frequency, "digest").withColumn("example", (F.col("owners") > max_owners) | (F.col("repos") > max_repos))
    span = F.struct("start", "rank", "end", "kind", "digest")
    gathered = judged.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_base"), span))).alias("base"),
        F.array_sort(F.collect_list(F.when(~F.col("is_base") & ~F.col("example"), span))).alias("added"),
        *(F.count(F.when(F.col("is_base") & told, 1)).alias(name) for name, told in (("n_example", F.col("example")), ("n_live", ~F.col("example")))),
        F.max("owners").alias("most_owners"),
        F.max("repos").alias("most_repos"),
    )
    known = slim.select("row_id", "doc_id").join(gathered, "row_id", "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,digest:string>>")
    counts = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_example", "n_live", "most_owners", "most_repos"))
    return known.select("doc_id", *(F.coalesce(c, none).alias(c) for c in ("base", "added")), *counts)


def span_list(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_columns(scanned: DataFrame) -> DataFrame:
    """The scan's result as counts and digests."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id",
        *(count(kind) for kind in ("assign", "access", "hex")),
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(F.concat("base", "added")).alias("spans"),
        "n_example",
        "n_live",
        "most_owners",
        "most_repos",
    )
