"""Readers and writers of pages, session logs, usage events and derived tables."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import SCHEMA as EVENT_SCHEMA

COLLECTIONS = ("curated", "transcripts", "checkpoints", "sdk")


def confined(root: str, relative: str) -> str:
    """A path below root; names that leave it are refused."""
    p = PurePosixPath(relative)
    if p.is_absolute() or ".." in p.parts or "\0" in relative:
        raise ValueError(f"outside the store: {relative}")
    return f"{root.rstrip('/')}/{p}"


def read_pages(spark: SparkSession, root: str, collection: str = "curated") -> DataFrame:
    """source, project, kind, collection, text, revision, verified, mtime of the Markdown pages below root."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    source = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "^[a-z]+:/*", "/"), f"^{root.rstrip('/')}/", "")
    p = files.select(source.alias("source"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("mtime"))
    part = lambda name: F.contains("source", F.lit(f"/{name}/"))
    which = F.when(part("transcripts"), "transcripts").when(part("checkpoints"), "checkpoints").when(F.startswith("source", F.lit("sdk/")), "sdk").otherwise("curated")
    kind = F.when(F.col("source").rlike("^skills/[^/]+/(knowledge|references)/"), "knowledge").when(F.startswith("source", F.lit("context/")), "shared").otherwise("project")
    from ..functions.text import digest, frontmatter_field

    out = p.withColumns({"collection": which, "kind": kind, "project": F.regexp_extract("source", "^projects/([^/]+)/", 1), "revision": digest(F.col("text")), "verified": frontmatter_field(F.col("text"), "verified")})
    return out.where(F.col("collection") == collection)


def in_scope(pages: DataFrame, project: str | None, scope: str = "project", domain: str | None = None) -> DataFrame:
    """Before any ranking: the own project and what all share; a domain narrows knowledge alone."""
    out = pages if scope == "all" else pages.where((F.col("project") == F.lit(project)) | F.col("kind").isin("shared", "knowledge"))
    return out if domain is None else out.where((F.col("kind") != "knowledge") | F.startswith("source", F.lit(f"skills/{domain}/")))


def read_session_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, value of raw JSON lines; a file's lines keep their order."""
    text = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "value")).where("value <> ''")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Usage events, one JSON object each; what does not parse is left out."""
    raw = spark.read.schema(EVENT_SCHEMA + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.where("event is not null").drop("_corrupt")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def write_index(df: DataFrame, path: str) -> None:
    """Replace a derived table, partitioned as queries prune it."""
    df.write.mode("overwrite").partitionBy("collection").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A derived table; a missing one is an error, not an empty result."""
    return spark.read.parquet(path)
