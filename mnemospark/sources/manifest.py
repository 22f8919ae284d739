"""Versions of a small JSON document in a folder: readers take the newest, a writer adds the next one or is told that
another writer did. A version is written aside and renamed into place without overwriting, so it is there as a whole
or not at all, wherever the file system's rename is atomic (as in HDFS)."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs


def versions(spark: SparkSession, folder: str) -> list[int]:
    fs, hadoop = _fs(spark, folder)
    if not fs.exists(hadoop.Path(folder)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hadoop.Path(folder))]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def latest(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """The newest version and its document; (0, None) if there is none."""
    known = versions(spark, folder)
    if not known:
        return 0, None
    fs, hadoop = _fs(spark, folder)
    stream = fs.open(hadoop.Path(f"{folder}/{known[-1]:012d}.json"))
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return known[-1], json.loads(text)


def commit(spark: SparkSession, folder: str, version: int, document: dict) -> int:
    """Add the version after ``version``, unless another writer has."""
    fs, hadoop = _fs(spark, folder)
    aside, target = hadoop.Path(f"{folder}/.{uuid.uuid4().hex}"), hadoop.Path(f"{folder}/{version + 1:012d}.json")
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(json.dumps(document).encode()))
    finally:
        stream.close()
    keep = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        hadoop.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(target), keep)
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if fs.exists(target):
            raise Conflict(f"version {version + 1} is there already") from e
        raise
    return version + 1
