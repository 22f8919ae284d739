"""Rendezvous hashing of stable record keys over weighted shards.

A record goes to the shard with the least ``-ln(u(key, shard)) / weight``, where u is a hash in (0, 1).
A shard's score depends on the key and that shard alone, so one more shard takes records only into itself
and takes no more than its share; removing one deals out only its own records.

Defined results: a null key is a key of its own; repeated keys share a shard and get slots one after the
other; an empty table gives an empty result; columns of the input with the names that are added are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused

#: Shards up to which every score is an expression of its own, compiled; beyond, one expression runs over an array.
UNROLLED = 128


def _score(key: Column, shard: Column, weight: Column) -> Column:
    """-ln(u) / weight, for a u of 53 bits in (0, 1) that the key and the shard decide."""
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / weight


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """A struct of the least score and its shard. weights: by shard number; a shard of weight 0 gets nothing."""
    live = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a weight")
    one = lambda i, w: F.struct(_score(key, i, w).alias("score"), i.alias("shard"))
    if len(live) <= UNROLLED:
        scored = [one(F.lit(i), F.lit(w)) for i, w in live]
        return F.least(*scored) if len(scored) > 1 else scored[0]
    shards = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in live])
    return F.array_min(F.transform(shards, lambda s: one(s["i"], s["w"])))


def assign(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """df with ``shard``, and with ``grown_shard`` for the weights grown (those of one or more further shards).

    Where grown only appends shards, only their scores are computed in addition.
    """
    if grown is not None and list(grown[: len(weights)]) != list(weights):
        raise ValueError("grown must start with the present weights")
    name = unused(df, "best")
    out = df.withColumn(name, rendezvous(F.col(key), weights)).withColumn("shard", F.col(f"{name}.shard"))
    if grown is not None:
        more = [0.0] * len(weights) + list(grown[len(weights) :])
        best = F.least(F.col(name), rendezvous(F.col(key), more)) if any(more) else F.col(name)
        out = out.withColumn("grown_shard", best["shard"])
    return out.drop(name)


def with_slots(df: DataFrame, key: str, cells: int) -> DataFrame:
    """df with ``slot``: gapless from 0 in each shard, in an order that the key alone decides.

    A shard is cut into cells by a hash of the key. The rows of each cell are counted (shards x cells
    counts, whatever the input), their running sum gives each cell its first slot, and rows are numbered
    within their cell, so no task gets a whole shard.
    """
    cell = F.pmod(F.xxhash64(F.col(key)), F.lit(cells)).cast("int")
    counts = df.select("shard", cell.alias("__cell")).groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "__cell", F.coalesce(before, F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("shard", "__cell").orderBy(key)) - 1
    # starts has at most shards x cells rows of 16 bytes; cells is the caller's, see shard_documents
    numbered = df.withColumn("__cell", cell).withColumn("__within", within)
    return (
        numbered.join(F.broadcast(starts), ["shard", "__cell"])
        .withColumn("slot", (F.col("__start") + F.col("__within")).cast("long"))
        .drop("__cell", "__within", "__start")
    )


def shard_documents(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", cells: int = 256) -> DataFrame:
    """Shards of whole documents: key, size (UTF-8 bytes and 16), text_crc32, law, shard, slot, grown_shard.

    Only the numbers of a document are shuffled, never its text. cells bounds what is broadcast:
    len(weights) x cells counts.
    """
    t = F.col(text)
    numbers = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign(numbers, key, weights, [*weights, weights[-1]])
    return with_slots(placed, key, cells).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
