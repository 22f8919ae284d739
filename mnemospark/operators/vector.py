"""Exact vector ranking and the fusion of rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RRF_OFFSET
from . import greedy


def dot(a: Column, b: Column) -> Column:
    """In doubles, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def rank(vectors: DataFrame, query: Sequence[float], key: str, embedding: str = "embedding", limit: int | None = None) -> DataFrame:
    """key and similarity, best first; the query goes into the plan as a literal, so nothing is joined."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = vectors.select(key, F.round(cosine(F.col(embedding), q), 6).alias("similarity"))
    return out if limit is None else out.orderBy(F.desc("similarity"), key).limit(limit)


def ranks(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """0-based ranks of a short list (a top-k already cut)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def fuse(left: DataFrame, right: DataFrame, key: str, offset: int = RRF_OFFSET) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (key, rank): the sum of 1 / (offset + rank) over those that have it."""
    share = lambda c: F.coalesce(1 / (F.lit(offset) + F.col(c)), F.lit(0.0))
    both = left.select(key, F.col("rank").alias("l")).join(right.select(key, F.col("rank").alias("r")), key, "full_outer")
    return both.select(key, "l", "r", F.round(share("l") + share("r"), 6).alias("fused"))


def hybrid_pick(lexical: DataFrame, vector: DataFrame, key: str, limit: int) -> DataFrame:
    """The first lexical hit stays first; the others by fused score. leg: where the hit is shown from."""
    f = fuse(lexical, vector, key)
    leg = F.when(F.col("l").isNotNull(), "lexical").otherwise("vector")
    top = f.withColumn("leg", leg).orderBy(F.desc(F.coalesce(F.col("l") == 0, F.lit(False))), F.desc("fused"), key).limit(limit)
    return top.select(key, "leg", "fused")


def missing(chunks: DataFrame, vectors: DataFrame, key: str, model: str) -> DataFrame:
    """Chunks without a vector of this model."""
    return chunks.join(vectors.where(F.col("model") == model).select(key), key, "left_anti")


def padded_batches(texts: DataFrame, key: str, length: str, job: str, rows: int = 64, budget: int = 8192, cap: int = 1024) -> DataFrame:
    """job, key and batch (from 1): each job's texts in order of length, grouped so that rows x the longest (up to
    cap) keeps to the budget."""

    def group(lengths, state):
        batch, size = state or (1, 0)
        out = []
        for n in lengths:
            if size and (size + 1 > rows or (size + 1) * min(cap, n) > budget):
                batch, size = batch + 1, 0
            size += 1
            out.append(batch)
        return out, (batch, size)

    return greedy.fold(texts, job, [length, key], length, group, "batch long").select(job, key, "batch")
