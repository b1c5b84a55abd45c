"""Sources: texts, story and graph documents, attempt and response lines, learner states, statement stores."""

from __future__ import annotations

import json
import os
from dataclasses import fields

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.replay import Learner
from loomspan.functions.text import response_value
from loomspan.operators.history import HEAD

TEXT_ENDINGS, PDF_ENDINGS = (".md", ".markdown", ".txt"), (".pdf",)

ITEM = (
    "struct<id: string, label: string, description: string, bloom: string, knowledge_type: string, dok: int, assessment_criteria: string, "
    "required_competences: array<string>, tags: array<string>, provenance: struct<chunk_id: string, page: int, span: array<int>, chapter: string>>"
)
GRAPH = f"metadata struct<chapter: string, version: string>, items array<{ITEM}>, surmise array<array<string>>, states array<array<string>>"
BEAT = (
    "struct<id: string, title: string, text: string, choices: array<struct<label: string, to: string>>, requires: array<string>, "
    "teaches: array<string>, checks: array<string>, difficulty: int, provenance: struct<item_id: string, chunk_id: string>>"
)
CHECK = "struct<id: string, kind: string, prompt: string, payload: string, item_id: string, max_score: int>"
STORY = f"beats array<{BEAT}>, checks array<{CHECK}>, metadata map<string, string>"


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """(doc_id, page, text): text files as page 0, PDF files by page; other endings are refused."""
    kinds = {p: os.path.splitext(p)[1].lower() for p in paths}
    if bad := [p for p, e in kinds.items() if e not in TEXT_ENDINGS + PDF_ENDINGS]:
        raise ValueError(f"unsupported file: {bad[0]}")
    if gone := [p for p in paths if "://" not in p and not os.path.exists(p)]:
        raise FileNotFoundError(gone[0])
    texts, pdfs = ([p for p, e in kinds.items() if e in group] for group in (TEXT_ENDINGS, PDF_ENDINGS))
    parts = []
    if texts:
        rows = spark.read.text(texts, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), F.lit(0).alias("page"), F.col("value").alias("text"))
        parts.append(rows)
    if pdfs:
        parts.append(_pdf_pages(spark.read.format("binaryFile").load(pdfs).select(F.col("path"), "content")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_history(spark: SparkSession, *paths: str) -> DataFrame:
    """(repo, place, entry): the commits of text logs (operators/history.py), one file for each repository, newest first.

    Files are split between tasks at commits, so a log of any size is read by many. place grows with time: what stands
    further back in its file is older. The repository is the file's name without its ending. A path without any file,
    as of a folder that is no repository, gives no rows.
    """
    schema = "repo string, place decimal(38,0), entry string"
    try:
        lines = spark.read.option("lineSep", "\n" + HEAD).text(list(paths))
    except AnalysisException:
        return spark.createDataFrame([], schema)
    block = F.col("_metadata.file_block_start").cast("decimal(38,0)")
    place = -(block * F.lit(1 << 33).cast("decimal(11,0)") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    rows = lines.select(F.regexp_replace("_metadata.file_name", "[.][^.]*$", "").alias("repo"), place.cast("decimal(38,0)").alias("place"), F.col("value").alias("entry"))
    return rows.filter(F.trim("entry") != "")


def _pdf_pages(files: DataFrame) -> DataFrame:
    """Pages of PDF files, numbered from 1; needs pypdf on the executors."""

    def pages(frames):
        import io

        import pandas as pd
        from pypdf import PdfReader

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = [(os.path.basename(path), n, p.extract_text() or "") for n, p in enumerate(PdfReader(io.BytesIO(content)).pages, 1)]
                yield pd.DataFrame(rows, columns=["doc_id", "page", "text"])

    return files.mapInPandas(pages, "doc_id string, page int, text string")


def _document(spark: SparkSession, path: str, schema: str, needed: tuple[str, ...]) -> DataFrame:
    """One JSON document as a row; a missing part is an error at once."""
    df = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    row = df.select(*(F.col(c).isNull().alias(c) for c in needed)).first()
    if row is None or any(row):
        raise ValueError(f"{path}: needs {', '.join(needed)}")
    return df


def read_story(spark: SparkSession, path: str) -> DataFrame:
    """beats, checks (none by default) and metadata (empty by default) of a story document."""
    df = _document(spark, path, STORY, ("beats",))
    return df.withColumn("checks", F.coalesce("checks", F.array().cast(f"array<{CHECK}>"))).withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    return _document(spark, path, GRAPH, ("items", "surmise"))


def read_lines(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """(pos, value) of non-blank lines, from a file or a list; files are read as one text to keep their order."""
    if isinstance(source, str):
        rows = spark.read.text(source, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "value"))
    else:
        rows = spark.createDataFrame(list(enumerate(source)), "pos int, value string")
    return rows.filter(F.length(F.trim("value")) > 0)


def parse_attempts(lines: DataFrame) -> DataFrame:
    """(pos, beat, check, response VARIANT) of lines beat|check|response; a response may hold further bars."""
    parts = F.split("value", "[|]", 3)
    part = lambda i: F.trim(F.try_element_at(parts, F.lit(i)))
    good = (F.size(parts) == 3) & (part(1) != "") & (part(2) != "")
    beat = F.when(good, part(1)).otherwise(F.raise_error(F.concat(F.lit("not an attempt: "), F.col("value"))).cast("string"))
    return lines.select("pos", beat.alias("beat"), part(2).alias("check"), response_value(part(3)).alias("response"))


def parse_responses(lines: DataFrame) -> DataFrame:
    """(pos, response): one JSON literal or raw string a line."""
    return lines.select("pos", F.trim("value").alias("response"))


def count_statements(spark: SparkSession, path: str) -> int:
    """Statements already in a store: where its logical clock goes on."""
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).count()


def check_statements(spark: SparkSession, path: str) -> DataFrame:
    """(line, problem) of the lines of a store that are no statements."""
    lines = read_lines(spark, path)
    v = F.try_parse_json("value")
    has = lambda k: F.try_variant_get(v, f"$.{k}", "string").isNotNull()
    problem = F.when(v.isNull(), "no JSON").when(~(has("actor") & has("verb") & has("object")), "actor, verb or object is missing")
    return lines.select(F.col("pos").alias("line"), problem.alias("problem")).filter("problem is not null")


def literal(value) -> Column:
    return F.lit(json.dumps(value))


def read_states(spark: SparkSession, folder: str) -> DataFrame:
    """(actor, state): saved learners, a JSON file each, named by its learner; another file's content is refused."""
    names = sorted(f.name for f in fields(Learner))
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("actor"), F.col("value"))
    sound = F.array_sort(F.json_object_keys("value")) == F.array(*map(F.lit, names))
    problem = F.concat("actor", F.lit(".json: not a learner state"))
    return rows.select("actor", F.when(F.coalesce(sound, F.lit(False)), F.col("value")).otherwise(F.raise_error(problem).cast("string")).alias("state"))
