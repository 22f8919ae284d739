"""Exact vector search that skips cells: an index of vectors by their nearest centroid, with each cell's radius.

Centroids are fitted on a bounded sample; every vector is indexed. Vectors are taken at unit length, so the cosine s of two
is 1 - d * d / 2 of their distance d, and no vector of a cell is nearer to a query than the distance to its centroid less
the radius. A cell is left out for a query only where that bound is below a cosine that k allowed vectors reach: first
those of the sample, then those that a task has met. Rows lie sorted by cell, so a cell that no query needs is not read.

Vectors that are null, empty, hold a null or a non-finite number, or have another length than the sample's first are not
indexed. A zero vector has cosine 0 to all and lies in a cell of its own that is never left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import RRF_OFFSET
from ..session import shared_folder

#: Vectors that centroids are fitted on, and centroids at most; bytes of a block of queries.
SAMPLE, CENTROIDS, QUERY_BYTES = 4096, 256, 16 << 20
#: What rounding a cosine to six places, and doubles, can hide.
SLACK = 2e-6
ZERO = -1


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-300)


def _dense(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit(x: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Unit centroids of unit rows, about the square root of their number; starts are spread evenly."""
    k = max(1, min(CENTROIDS, int(len(x) ** 0.5)))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = unit(np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(k)]))
    return c


@dataclass
class Cells:
    """rows: key, embedding, cell and what else was kept; centroids and radii by cell; the sample's keys and vectors.
    read: how many cells the last block of queries needed."""

    rows: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    sample: DataFrame
    read: int = 0


def _usable(embedding: str):
    return F.coalesce(F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False)) & (F.size(embedding) > 0)


def build(vectors: DataFrame, key: str, embedding: str = "embedding", keep: tuple[str, ...] = ()) -> Cells:
    """Index the vectors in the shared folder. The sample is the vectors of the least hashes of their keys."""
    spark = vectors.sparkSession
    folder = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    rows = vectors.where(_usable(embedding) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(embedding).alias("embedding"), *keep)
    rows.select("key", "embedding").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).write.parquet(f"{folder}/sample")
    drawn = spark.read.parquet(f"{folder}/sample").orderBy(F.xxhash64("key"), "key").toArrow()
    dims = len(drawn["embedding"][0]) if drawn.num_rows else 0
    some = [e for e in drawn["embedding"].to_pylist() if len(e) == dims]
    sample = unit(np.array(some, dtype=np.float64).reshape(len(some), dims))
    shared = spark.sparkContext.broadcast(fit(sample) if len(sample) else np.zeros((1, dims)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(_dense(b.column(1))) if b.num_rows else np.zeros((0, dims))
            cell = (x @ shared.value.T).argmax(axis=1)
            gap = np.sqrt(np.square(x - shared.value[cell]).sum(axis=1)) if b.num_rows else np.zeros(0)
            cell[~x.any(axis=1)] = ZERO
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(gap)], names=[*b.schema.names, "cell", "gap"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    found = rows.where(F.size("embedding") == dims).mapInArrow(placed, f"{fields}, cell int, gap double")
    # a large cell lies in stretches of several tasks
    n = max(1, int(str(vectors._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // (32 << 20))
    found.repartitionByRange(min(n, 10_000), "cell", F.xxhash64("key")).sortWithinPartitions("cell").write.option("compression", "zstd").parquet(f"{folder}/rows")
    index = spark.read.parquet(f"{folder}/rows")
    radii = np.zeros(len(shared.value))
    for r in index.where(F.col("cell") >= 0).groupBy("cell").agg(F.max("gap").alias("r")).collect():
        radii[r["cell"]] = r["r"]
    return Cells(index, shared.value, radii, spark.read.parquet(f"{folder}/sample").where(F.size("embedding") == dims))


def _best(shared, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, bounds, floor = shared.value
        floor = floor.copy()
        top_s, top_k = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for b in batches:
            if not b.num_rows:
                continue
            keys, x, cells = b.column(0).to_numpy(), unit(_dense(b.column(1))), b.column(2).to_numpy()
            for cell in np.unique(cells):
                at = np.flatnonzero(cells == cell)
                need = np.arange(len(ids)) if cell == ZERO else np.flatnonzero(bounds[:, cell] >= floor - SLACK)
                if not len(need):
                    continue
                s = np.round(asked[need] @ x[at].T, 6) + 0.0
                s[ids[need][:, None] == keys[at][None, :]] = -np.inf
                both_s = np.concatenate((top_s[need], s), axis=1)
                both_k = np.concatenate((top_k[need], np.broadcast_to(keys[at], s.shape)), axis=1)
                order = np.lexsort((both_k, -both_s), axis=1)[:, :k]
                top_s[need], top_k[need] = np.take_along_axis(both_s, order, 1), np.take_along_axis(both_k, order, 1)
                floor[need] = np.maximum(floor[need], top_s[need][:, k - 1])
        q, at = np.nonzero(np.isfinite(top_s))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(ids[q]), pa.array(top_k[q, at]), pa.array(top_s[q, at])], names=["asked", "query", "key", "similarity"])

    return rows


def search(index: Cells, queries: DataFrame, key: str = "key", embedding: str = "embedding", k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """query, key, similarity and rank (from 1): the k nearest other vectors of each query, exactly; ties to smaller keys.

    allowed: the keys that count, taken before anything is ranked. Queries go out in blocks of QUERY_BYTES; each is one pass
    over the cells that a query of it needs.
    """
    spark = index.rows.sparkSession
    rows, sample = index.rows, index.sample
    if allowed is not None:
        only = allowed.select(F.col(allowed.columns[0]).cast("long").alias("key")).distinct()
        rows, sample = rows.join(only, "key", "left_semi"), sample.join(only, "key", "left_semi")
    dims = index.centroids.shape[1]
    known = sample.select("key", "embedding").toArrow()  # SAMPLE rows at most
    known_keys = known["key"].to_numpy().astype(np.int64)
    known_x = unit(np.array(known["embedding"].to_pylist(), dtype=np.float64).reshape(len(known_keys), dims))
    asked = queries.where(_usable(embedding) & (F.size(embedding) == dims)).select(F.col(key).cast("long").alias("key"), F.col(embedding).alias("embedding"))
    w = Window.partitionBy("asked").orderBy(F.desc("similarity"), "key")

    def answered(block: list) -> DataFrame:
        ids = np.array([i for i, _ in block], dtype=np.int64)
        x = unit(np.array([e for _, e in block], dtype=np.float64).reshape(len(block), dims))
        floor = np.full(len(ids), -np.inf)
        if len(known_keys) > k:
            s = np.round(x @ known_x.T, 6)
            s[ids[:, None] == known_keys[None, :]] = -np.inf
            floor = np.partition(s, len(known_keys) - k, axis=1)[:, len(known_keys) - k]
        gap = np.maximum(np.sqrt(np.maximum(0.0, 2 - 2 * x @ index.centroids.T)) - index.radii[None, :] - 1e-9, 0.0)
        bounds = 1 - gap * gap / 2
        bounds[~x.any(axis=1)] = 2.0  # a zero vector is as near to all
        need = np.flatnonzero((bounds >= floor[:, None] - SLACK).any(axis=0)).tolist()
        index.read = len(need)
        shared = spark.sparkContext.broadcast((ids, x, bounds, floor))
        some = rows if len(need) == len(index.radii) else rows.where(F.col("cell").isin([ZERO, *need]))
        got = some.select("key", "embedding", "cell").mapInArrow(_best(shared, k), "asked long, query long, key long, similarity double")
        return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "key", "similarity", "rank")

    parts, block, size = [], [], 0
    for r in asked.toLocalIterator():
        block.append((r["key"], r["embedding"]))
        size += 8 * dims
        if size >= QUERY_BYTES:
            parts.append(answered(block))
            block, size = [], 0
    if block or not parts:
        parts.append(answered(block))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fresh(chunks: DataFrame, pages: DataFrame, source: str = "source", revision: str = "revision") -> DataFrame:
    """The chunks that are of their page's present revision."""
    return chunks.join(pages.select(source, revision), [source, revision], "left_semi")


def source_hits(index: Cells, query: list[float], limit: int, chunks: DataFrame | None = None, depth: int = 10) -> DataFrame:
    """key, source, line, similarity, rank and score = round(1 / (60 + rank), 5) of the best chunk of each source, for one
    query. The index must have kept source and line; chunks: the allowed ones (key first). Of limit x depth chunks."""
    spark: SparkSession = index.rows.sparkSession
    asked = spark.createDataFrame([(-1, [float(x) for x in query])], "key long, embedding array<double>")
    near = search(index, asked, k=limit * depth, allowed=chunks).select("key", "similarity")
    named = near.join(index.rows.select("key", "source", "line"), "key")
    own = Window.partitionBy("source").orderBy(F.desc("similarity"), "key")
    best = named.withColumn("n", F.row_number().over(own)).where("n = 1").drop("n").orderBy(F.desc("similarity"), "key").limit(limit)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "key")) - 1)  # limit rows
    return ranked.select("key", "source", "line", "similarity", "rank", F.round(1 / (F.lit(RRF_OFFSET) + F.col("rank")), 5).alias("score"))


