"""Incremental capture of session logs that grow: each run takes the whole lines that came since the last."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CURSORS = "file string, offset long, prefix string, run long"
#: Bytes at the head of a file that tell whether it is still the same one.
PREFIX = 256


def _prefix(content: bytes, offset: int) -> str:
    return hashlib.sha256(content[: min(PREFIX, offset)]).hexdigest()


def _taken(batches):
    """(file, offset of the line, line) of the lines that are new, and (file, new offset, prefix) at the end of each."""
    for b in batches:
        out = []
        for file, content, offset, prefix in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            content = content.as_py()
            offset = offset or 0
            # a file that shrank or was written anew does not inherit the cursor of another
            start = offset if offset <= len(content) and prefix in (None, _prefix(content, offset)) else 0
            end = content.rfind(b"\n") + 1
            at = start
            for line in content[start:end].splitlines(keepends=True):
                out.append((file, at, line.rstrip(b"\r\n").decode(errors="replace"), None, None))
                at += len(line)
            end = max(start, end)
            out.append((file, None, None, end, _prefix(content, end)))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["file", "line_no", "value", "offset", "prefix"])


def _cursors(spark: SparkSession, folder: str) -> DataFrame:
    """The last cursor of each file."""
    from pyspark.sql.utils import AnalysisException

    try:
        every = spark.read.schema(CURSORS).parquet(f"{folder}/cursors")
    except AnalysisException:
        every = spark.createDataFrame([], CURSORS)
    return every.groupBy("file").agg(F.max_by(F.struct("offset", "prefix"), "run").alias("c"), F.max("run").alias("run")).select("file", "c.offset", "c.prefix", "run")


def capture(spark: SparkSession, path: str, folder: str) -> int:
    """Append the new lines of the logs below path to ``folder``/lines and move the cursors; how many files had grown.

    Files are listed without their content, and only those whose length is not their cursor's are read. Lines are
    written before cursors: a run that fails between the two is done again, and ``lines`` takes each line once. A last
    line without its end waits.
    """
    options = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    known = _cursors(spark, folder)
    listed = options.load(path).select(F.col("path").alias("file"), "length")
    grown = [r["file"] for r in listed.join(known, "file", "left").where("offset is null or offset <> length").select("file").toLocalIterator()]
    if not grown:
        return 0
    run = (known.agg(F.max("run")).first()[0] or 0) + 1
    content = spark.read.format("binaryFile").load(grown).select(F.col("path").alias("file"), "content").join(known.select("file", "offset", "prefix"), "file", "left")
    taken = content.select("file", "content", "offset", "prefix").mapInArrow(_taken, "file string, line_no long, value string, offset long, prefix string")
    taken = taken.persist()
    taken.where("value is not null").select("file", "line_no", "value", F.lit(run).cast("long").alias("run")).write.mode("append").parquet(f"{folder}/lines")
    taken.where("value is null").select("file", "offset", "prefix", F.lit(run).cast("long").alias("run")).write.mode("append").parquet(f"{folder}/cursors")
    taken.unpersist()
    return len(grown)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """file, line_no (its place in bytes) and value of all that was captured, each once."""
    return spark.read.parquet(f"{folder}/lines").dropDuplicates(["file", "line_no", "value"]).select("file", "line_no", "value")
