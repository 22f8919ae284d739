"""Exact top-k by integer inner product from an impact-ordered index, a score at a time.

Vectors become integers and are indexed in shards. In a shard, each component's rows are sorted into posting segments by
quantised value; a segment has its middle, its largest size and its rows. A query takes the segments of all components
by descending quantised impact (the largest |q * v| a segment can have) and adds q * middle to the scores of their rows.
At any time a row's score is known up to a slack: what its unseen components can add (each at most the impact of the next
segment), and what rounding to middles can hide (at most |q| times the length of the row's rounding error). Segments are
processed until the rows that may still be among the best are so few that scoring them exactly is less work than the
rest: every other row is proved out, because the exact scores of k rows are above all that it can have. Those few are
scored exactly.

Defined results: a vector that is null or holds a null, NaN or infinite component takes no part; vectors of another
length than a query's have no score with it; integers saturate at +-INTEGER_LIMIT. Every row is itself: of rows with the
same key, each is a query of its own and a candidate of the others; a null key is no query of ``top_k`` and comes last of equal scores.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, keyed, unkeyed, written

#: Inner products of vectors of up to 2,048 integers of this size fit 64 bits.
INTEGER_LIMIT = 1 << 25
#: Rows and bytes of a shard, levels to which a component is quantised, bytes of a block of queries.
SHARD_ROWS, SHARD_BYTES, LEVELS, QUERY_BYTES = 16_384, 8 << 20, 24, 8 << 20
#: Shares of the postings after which a query looks whether it can stop.
STOPS = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
LEAST = np.iinfo(np.int64).min

SHARD = "dims int, rows binary, keys binary, ints binary, order binary, starts binary, dim binary, middle binary, most binary, error binary"


class Shard:
    """Rows of one length with their posting segments."""

    def __init__(self, rows, keys, ints, order, starts, dim, middle, most, error):
        self.rows, self.keys, self.ints = rows, keys, ints
        #: Rows sorted by level within each component; segment s has order[starts[s]:starts[s + 1]] of component dim[s].
        self.order, self.starts, self.dim = order, starts, dim
        #: By segment: the middle of its values and the largest of their sizes. By row: the length of its rounding error.
        self.middle, self.most, self.error = middle, most, error
        self.sizes = np.diff(starts)

    @classmethod
    def of(cls, rows: np.ndarray, keys: np.ndarray, ints: np.ndarray) -> Shard:
        n, dims = ints.shape
        orders, starts, dim, middle, most, square, at = [], [], [], [], [], np.zeros(n), 0
        for d in range(dims):
            own = ints[:, d].astype(np.int64)
            width = -(-int(own.max() - own.min() + 1) // LEVELS)
            level = (own - own.min()) // width
            order = np.argsort(level, kind="stable")
            first = np.flatnonzero(np.diff(level[order], prepend=-1))
            low, high = np.minimum.reduceat(own[order], first), np.maximum.reduceat(own[order], first)
            mid = (low + high) // 2
            square[order] += (own[order] - np.repeat(mid, np.diff(first, append=n))).astype(np.float64) ** 2
            orders.append(order)
            starts.append(at + first)
            dim.append(np.full(len(first), d))
            middle.append(mid)
            most.append(np.maximum(np.abs(low), np.abs(high)))
            at += n
        joined = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        return cls(rows, keys, ints, joined(orders).astype(np.int32), np.append(joined(starts), at), joined(dim), joined(middle), joined(most), np.sqrt(square))

    def packed(self) -> list:
        return [self.ints.shape[1], *(x.tobytes() for x in (self.rows, self.keys, self.ints, self.order, self.starts, self.dim, self.middle, self.most, self.error))]

    @classmethod
    def unpacked(cls, dims: int, rows, keys, ints, order, starts, dim, middle, most, error) -> Shard:
        long = lambda x: np.frombuffer(x, dtype=np.int64)
        rows = long(rows)
        return cls(rows, long(keys), np.frombuffer(ints, dtype=np.int32).reshape(len(rows), dims), np.frombuffer(order, dtype=np.int32).astype(np.intp), long(starts), long(dim), long(middle), long(most), np.frombuffer(error))

    def possible(self, q: np.ndarray, k: int, floor: int, own: int | None) -> tuple[np.ndarray, int]:
        """Rows that may be among the k best and score floor or more, and how many postings were processed to say so."""
        n, dims = self.ints.shape
        bits = dims.bit_length()
        reach = np.abs(q)[self.dim] * self.most
        if (int(reach.max(initial=0)) * max(dims, 1)) << bits >= 1 << 62:  # no room for bounds
            return np.delete(np.arange(n), [] if own is None else own), 0
        order = np.argsort(-reach, kind="stable")
        done = np.cumsum(self.sizes[order])
        gain = (((q[self.dim] * self.middle) << bits) + 1)[order].tolist()
        begins, ends = self.starts[order].tolist(), (self.starts[order] + self.sizes[order]).tolist()
        hidden = np.ceil(float(np.sqrt(np.square(q, dtype=np.float64).sum())) * self.error * (1 + 1e-9) + 1).astype(np.int64)
        scores, at, postings = np.zeros(n, np.int64), 0, self.order
        total = n * dims
        for stop in STOPS if total else (1.0,):
            upto = int(np.searchsorted(done, stop * total)) + 1 if stop < 1 else len(order)
            for s in range(at, min(upto, len(order))):
                scores[postings[begins[s] : ends[s]]] += gain[s]
            at = max(at, min(upto, len(order)))
            left = total - (int(done[at - 1]) if at else 0)
            next_reach = int(reach[order[at]]) if at < len(order) else 0
            slack = hidden + (dims - (scores & ((1 << bits) - 1))) * next_reach
            most = (scores >> bits) + slack
            if own is not None:
                most[own] = LEAST
            if n - (own is not None) >= k:  # the exact scores of the foremost rows are a floor for all
                ahead = np.argpartition(most, max(0, n - 4 * k))[-4 * k :]
                ahead = ahead[ahead != own] if own is not None else ahead
                floor = max(floor, int(np.sort(self.ints[ahead].astype(np.int64) @ q)[-k])) if len(ahead) >= k else floor
            alive = most >= floor
            if own is not None:
                alive[own] = False
            if int(alive.sum()) * dims <= left or not left:
                break
        return np.flatnonzero(alive), total - left

    def best(self, q: np.ndarray, k: int, floor: int, own: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact scores, keys and rows of the k best with floor or more, ties to smaller keys."""
        at, _ = self.possible(q, k, floor, own)
        exact = self.ints[at].astype(np.int64) @ q
        top = np.lexsort((self.rows[at], self.keys[at], -exact))[:k]
        return exact[top], self.keys[at[top]], self.rows[at[top]]


@dataclass
class Index:
    """rows (row, key, ints: what every indexed vector is) and shards, both written to the shared folder."""

    rows: DataFrame
    shards: DataFrame

    def discard(self) -> None:
        discard(self.rows, self.shards)


def integers(embedding: str = "embedding", scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null where a vector is null or holds anything but finite numbers."""
    usable = F.coalesce(F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))
    limit = float(INTEGER_LIMIT)
    return F.when(usable, F.transform(embedding, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(limit)), F.lit(-limit))).cast("int")))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}

    def packed(dims: int) -> pa.RecordBatch:
        rows, keys, ints = (np.concatenate(x) for x in zip(*held.pop(dims), strict=True))
        values = Shard.of(rows, keys, ints).packed()
        return pa.RecordBatch.from_arrays([pa.array([values[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in values[1:])], names=[x.split(" ")[0] for x in SHARD.split(", ")])

    for b in batches:
        rows, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
        lengths = b.column(2).value_lengths().to_numpy()
        flat, ends = b.column(2).flatten().to_numpy(), np.cumsum(lengths)
        for dims in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == dims)
            ints = flat[(ends[at] - dims)[:, None] + np.arange(dims)[None, :]].astype(np.int32)
            most = max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * max(dims, 1))))
            while len(at):
                room = most - sum(len(x[0]) for x in held.get(dims, []))
                held.setdefault(dims, []).append((rows[at[:room]], keys[at[:room]], ints[:room]))
                at, ints = at[room:], ints[room:]
                if sum(len(x[0]) for x in held[dims]) >= most:
                    yield packed(dims)
    for dims in list(held):
        yield packed(dims)


def build(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> Index:
    """Index every usable vector. Nothing is shuffled: small partitions are joined, large ones make several shards."""
    spark = vectors.sparkSession
    some = vectors.select(keyed(key).alias("key"), integers(embedding, scale).alias("ints")).where("ints is not null")
    rows = written(some.select(F.monotonically_increasing_id().alias("row"), "key", "ints"), "topk-rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ints")).alias("c")).first()
    parts = max(spark.sparkContext.defaultParallelism, -(-8 * (size["c"] or 0) // SHARD_BYTES))
    return Index(rows, written(rows.coalesce(parts).mapInArrow(_shards, SHARD), "topk-shards"))


def _tops(shared, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, by_dims = shared.value, {}
        for i, (_, _, q) in enumerate(asked):
            by_dims.setdefault(len(q), []).append(i)
        ids = {dims: np.array([asked[i][0] for i in at]) for dims, at in by_dims.items()}
        best: list = [(np.zeros(0, np.int64),) * 3] * len(asked)
        for b in batches:
            for x in b.to_pylist():
                shard = Shard.unpacked(**x)
                dims = shard.ints.shape[1]
                if dims not in by_dims:
                    continue
                _, mine, places = np.intersect1d(ids[dims], shard.rows, return_indices=True)
                own = dict(zip(mine.tolist(), places.tolist(), strict=True))
                for j, i in enumerate(by_dims[dims]):
                    held = best[i]
                    floor = int(held[0][-1]) if len(held[0]) == k else LEAST
                    found = shard.best(asked[i][2].astype(np.int64), k, floor, own.get(j))
                    both = [np.concatenate(y) for y in zip(held, found, strict=True)]
                    top = np.lexsort((both[2], both[1], -both[0]))[:k]
                    best[i] = tuple(y[top] for y in both)
        at = np.repeat(np.arange(len(asked)), np.array([len(x[0]) for x in best], dtype=np.int64))
        part = lambda c: np.concatenate([x[c] for x in best]) if best else np.zeros(0, np.int64)
        query = lambda c: np.array([x[c] for x in asked], dtype=np.int64)[at]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at.astype(np.int64), query(1), part(1), part(2), part(0))], names=["asked", "query", "key", "row", "score"])

    return rows


def search(index: Index, asked: DataFrame, k: int = 10) -> DataFrame:
    """query, rank (from 1), key and score of the k best candidates of every asked row (row, key, ints; row is null for
    a vector that is not in the index). Null keys stand as NO_KEY.

    Queries go out in blocks of QUERY_BYTES; each block is one pass over the shards, whose tasks keep k rows a query.
    """
    spark = index.shards.sparkSession
    context = spark.sparkContext
    shards = index.shards.count()
    dealt = index.shards.repartition(max(1, min(shards, 8 * context.defaultParallelism)))
    w = Window.partitionBy("asked").orderBy(F.desc("score"), "key", "row")

    def answered(block: list) -> DataFrame:
        shared = context.broadcast(block)
        tops = dealt.mapInArrow(_tops(shared, k), "asked long, query long, key long, row long, score long")
        out = written(tops.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "key", "score"), "topk-block")
        shared.destroy()
        return out

    done, block, size = [], [], 0
    for r in asked.select(F.coalesce("row", F.lit(-1)).alias("row"), "key", "ints").toLocalIterator(prefetchPartitions=True):
        block.append((r["row"], r["key"], np.array(r["ints"], dtype=np.int32)))
        size += 4 * len(r["ints"]) + 16
        if size >= QUERY_BYTES:
            done.append(answered(block))
            block, size = [], 0
    if block or not done:
        done.append(answered(block))
    return functools.reduce(DataFrame.unionByName, done)


def top_k(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose key ``every`` divides, its k best other rows."""
    index = build(vectors, key, embedding, scale)
    asked = index.rows.where((F.col("key") % every == 0) & (unkeyed("key").isNotNull()))
    out = search(index, asked, k)
    index.discard()
    return out.select(F.col("query").alias("query_id"), "rank", unkeyed("key").alias("vec_id"), "score")
