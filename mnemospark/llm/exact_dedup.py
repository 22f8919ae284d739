"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition makes, for each of R ranges of the digest, a run: its distinct digests in order, each
with the identifier that stays and a count. Runs are then merged in rounds: in each round, FAN runs of a
range meet at one node, are merged in digest order and equal digests fold into one. After log_FAN(partitions)
rounds there is one run for each range, of a size that R bounds. Copies fold at the lowest level they meet,
so a group of any size costs each node at most FAN entries.

A digest entry is verified: SHA-256, byte length and xxhash64 of the text must all agree for two to fold.

Defined results: a null text is an empty one; rows with the same identifier and text are the same document
and share their decision; among equal texts the smallest (or largest) identifier stays, null last; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import has_repeats, join_groups, unused, without, written

FAN = 8
#: Entries of the merged run of one range, about: what a node holds in its sort buffers.
RUN_ENTRIES = 250_000

SCHEMA = pa.schema([("range", pa.int32()), ("node", pa.int32()), ("digest", pa.binary()), ("n_bytes", pa.int64()), ("check", pa.int64()), ("keep_id", pa.int64()), ("n", pa.int64())])
RUN = "range int, node int, digest binary, n_bytes long, check long, keep_id long, n long"


def _fold(batches):
    """Rows in (range, node, digest, n_bytes, check) order to one row for each key; keep_id is the least."""
    last = None
    for b in batches:
        t = pa.Table.from_batches([b]).cast(SCHEMA)
        if last is not None:
            t = pa.concat_tables([last, t])
        t = t.combine_chunks()
        if not t.num_rows:
            continue
        digest = np.frombuffer(b"".join(t["digest"].to_pylist()), dtype="V32")
        key = [t["range"].to_numpy(), t["node"].to_numpy(), t["n_bytes"].to_numpy(), t["check"].to_numpy()]
        new = np.empty(t.num_rows, dtype=bool)
        new[0] = True
        new[1:] = digest[1:] != digest[:-1]
        for k in key:
            new[1:] |= k[1:] != k[:-1]
        at = np.flatnonzero(new)
        keep = np.minimum.reduceat(t["keep_id"].to_numpy(), at)
        n = np.add.reduceat(t["n"].to_numpy(), at)
        out = t.take(pa.array(at)).set_column(5, "keep_id", pa.array(keep)).set_column(6, "n", pa.array(n))
        last = out.slice(out.num_rows - 1)  # the next batch may go on with this key
        if out.num_rows > 1:
            yield from out.slice(0, out.num_rows - 1).combine_chunks().to_batches()
    if last is not None:
        yield from last.combine_chunks().to_batches()


def _merge(runs: DataFrame, tasks: int) -> DataFrame:
    """One round: the runs of a (range, node) meet in one task and fold in digest order."""
    met = runs.repartition(tasks, "range", "node").sortWithinPartitions("range", "node", "digest", "n_bytes", "check")
    return met.mapInArrow(_fold, RUN)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, digest, n_bytes and check of every row; texts are read once, and only these numbers go on."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"),
        F.octet_length(t).cast("long").alias("n_bytes"),
        F.xxhash64(t).alias("check"),
        F.spark_partition_id().alias("part"),
    )


def groups(found: DataFrame, parts: int, rows: int, keep: str = "min") -> DataFrame:
    """digest, n_bytes, check, keep_id, group_size: one row for each distinct text, by the tree merge."""
    sign = F.lit(1 if keep == "min" else -1)
    ranges = max(1, math.ceil(rows / RUN_ENTRIES))
    entries = found.select(
        F.pmod(F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("int"), F.lit(ranges)).alias("range"),
        F.col("part").alias("node"),
        "digest", "n_bytes", "check",
        F.coalesce(sign * F.col("doc_id"), F.lit((1 << 63) - 1)).alias("keep_id"),
        F.lit(1).cast("long").alias("n"),
    )
    runs = entries.sortWithinPartitions("range", "node", "digest", "n_bytes", "check").mapInArrow(_fold, RUN)
    nodes = max(parts, 1)
    while nodes > 1:
        nodes = math.ceil(nodes / FAN)
        runs = _merge(runs.withColumn("node", F.floor(F.col("node") / FAN).cast("int")), max(1, min(ranges * nodes, parts)))
    none = F.col("keep_id") == F.lit((1 << 63) - 1)
    return runs.select("digest", "n_bytes", "check", F.when(~none, sign * F.col("keep_id")).alias("keep_id"), F.col("n").alias("group_size"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "min") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    The decisions come back to the rows by the digest; see join_groups for groups that hold many rows.
    """
    found = written(digests(docs, key, text), "digests")
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    rows = found.count()
    merged = written(groups(found, parts, rows, keep), "digest-groups")
    on = ["digest", "n_bytes", "check"]
    return join_groups(found.select("doc_id", *on), merged, on, "group_size", rows).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs that stay, with their columns: one row for each different text."""
    found = written(exact_duplicates(docs, key, text, keep), "dedup-decisions")
    gone = found.where(~F.col("kept"))
    if not has_repeats(docs, key):
        return without(docs, gone.select(F.col("doc_id").alias(key)), key)
    # identifiers do not tell these rows apart, so texts do as well
    digest, same = unused(docs, "digest"), "_doc_id"
    rows = docs.withColumn(digest, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    kept = found.where("kept").select(F.col("doc_id").alias(same), F.col("text_sha256").alias(digest)).distinct()
    same_row = rows[key].cast("long").eqNullSafe(kept[same]) & (rows[digest] == kept[digest])
    return rows.join(kept, same_row, "left_semi").dropDuplicates([digest]).drop(digest)
