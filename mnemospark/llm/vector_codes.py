"""Product quantisation of vectors in integers: a codebook for each part, trained in rounds over all vectors.

Components become integers, and vectors are cut into equal parts. Each round broadcasts a kd-tree of every part's
codebook; tasks find the nearest entry of each part by branch and bound and add up what they assign, and the integer sums
of all tasks give the next entries. A box whose bound equals the best distance is visited too, so of equally near entries
the one of the lowest index is found. What goes out and comes back in a round is one codebook (parts x entries).

Defined results: a vector that is null or holds a null, NaN or infinite component is dropped, and so is one that cannot
be cut like the first kept one (of smallest key) whose length the parts divide; integers saturate at +-INTEGER_LIMIT. With
fewer vectors than entries a codebook is as short; with none the result is empty. A null key comes last among the first
entries; of equal keys the smaller vector comes first. Rows that repeat count as often as they are there; null labels are
one label. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, written

#: Squared distances of vectors of up to 512 integers of this size fit 64 bits.
INTEGER_LIMIT = 1 << 26
#: Entries that a leaf of a tree holds.
LEAF = 4


class Tree:
    """A kd-tree over a codebook: nodes have the box of their entries, leaves have the entries."""

    def __init__(self, entries: np.ndarray, ids: np.ndarray | None = None):
        self.ids = np.arange(len(entries)) if ids is None else ids
        self.low, self.high = entries.min(axis=0), entries.max(axis=0)
        self.entries, self.below = entries, ()
        if len(entries) > LEAF:
            order = np.argsort(entries[:, np.argmax(self.high - self.low)], kind="stable")
            halves = np.sort(order[: len(order) // 2]), np.sort(order[len(order) // 2 :])
            self.below = tuple(Tree(entries[h], self.ids[h]) for h in halves)

    def bound(self, points: np.ndarray) -> np.ndarray:
        """The least squared distance that an entry of this box can have."""
        gap = np.maximum(np.maximum(self.low - points, points - self.high), 0)
        return np.einsum("ij,ij->i", gap, gap)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each point's nearest entry, the lowest index of equally near ones."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        found = np.full(len(points), np.iinfo(np.int64).max)
        self._visit(points, np.arange(len(points)), best, found)
        return found, best

    def _visit(self, points, at, best, found) -> None:
        if not len(at):
            return
        own = points[at]
        if not self.below:
            gap = own[:, None, :] - self.entries[None, :, :]
            square = np.einsum("ijk,ijk->ij", gap, gap)
            j = square.argmin(axis=1)  # ids rise within a leaf, so this is the lowest of equals
            d, i = square[np.arange(len(at)), j], self.ids[j]
            better = (d < best[at]) | ((d == best[at]) & (i < found[at]))
            best[at[better]], found[at[better]] = d[better], i[better]
            return
        left, right = self.below
        to_left, to_right = left.bound(own), right.bound(own)
        near_left = to_left <= to_right
        left._visit(points, at[near_left], best, found)
        right._visit(points, at[~near_left], best, found)
        right._visit(points, at[near_left & (to_right <= best[at])], best, found)
        left._visit(points, at[~near_left & (to_left <= best[at])], best, found)


def integers(embedding: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of every component; null where a vector is null or holds anything but finite numbers."""
    usable = F.coalesce(F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))
    limit = float(INTEGER_LIMIT)
    each = F.transform(embedding, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(limit)), F.lit(-limit))).cast("int"))
    return F.when(usable, each)


def _kept(vectors: DataFrame, embedding: str, scale: int, *columns: str) -> DataFrame:
    return vectors.select(integers(embedding, scale).alias("__ints"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]).where("__ints is not null")


def _points(column: pa.Array, parts: int) -> np.ndarray:
    """(vectors, parts, components of a part)"""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), parts, len(flat) // (parts * len(column)))


def _assign(trees: list[Tree], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance, both (vectors, parts)."""
    both = [t.nearest(np.ascontiguousarray(points[:, j])) for j, t in enumerate(trees)]
    return np.stack([i for i, _ in both], axis=1), np.stack([d for _, d in both], axis=1)


def first_codebooks(vectors: DataFrame, key: str, embedding: str, parts: int, entries: int, scale: int) -> np.ndarray:
    """(parts, entries, components): the parts of the vectors of the smallest keys."""
    kept = _kept(vectors, embedding, scale, key).where((F.size("__ints") > 0) & (F.size("__ints") % parts == 0))
    least = lambda rows, n: [r[0] for r in rows.orderBy(F.col("c0").asc_nulls_last(), "__ints").limit(n).select("__ints").collect()]
    first = least(kept, 1)
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    rows = least(kept.where(F.size("__ints") == len(first[0])), entries)
    return np.array(rows, dtype=np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2)


def _sums(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, (parts, entries, width) = shared.value
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            if b.num_rows:
                points = _points(b.column(0), parts)
                found, _ = _assign(trees, points)
                for j in range(parts):
                    np.add.at(sums[j], found[:, j], points[:, j])
                    counts[j] += np.bincount(found[:, j], minlength=entries)
        part, entry = counts.nonzero()
        cols = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["part", "entry", "n", "sums"])

    return rows


def train(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> np.ndarray:
    """The codebooks after the rounds, as an array (parts, entries, components) of integers.

    Each round reads the vectors once; a task sends at most one row for an entry, added up before they are shuffled.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    books = first_codebooks(vectors, key, embedding, parts, entries, scale)
    _, n, width = books.shape
    if not n:
        return books
    kept = _kept(vectors, embedding, scale).where(F.size("__ints") == parts * width).select("__ints")
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(([Tree(b) for b in books], (parts, n, width)))
        each = kept.mapInArrow(_sums(shared), "part int, entry int, n long, sums array<long>")
        totals = [F.sum(F.get("sums", F.lit(i)).cast("decimal(20,0)")) for i in range(width)]
        books = books.copy()
        for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*totals).alias("sums")).collect():
            books[r["part"], r["entry"]] = [int(x) // r["n"] for x in r["sums"]]
        shared.unpersist()
    return books


def codebooks_sha256(books: np.ndarray) -> str:
    """Of all components by part, entry and position, in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _codes(shared, parts: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for b in batches:
            if b.num_rows:
                found, square = _assign(trees, _points(b.column(0), parts))
                text = found.astype(np.uint8).tobytes().hex()
                codes = [text[2 * parts * i : 2 * parts * (i + 1)] for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(codes, pa.string()), pa.array(square.sum(axis=1))], names=[*b.schema.names[1:], "code", "error"])

    return rows


def encoded(vectors: DataFrame, books: np.ndarray, columns: list[str], embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """The columns asked for, code and error of every vector that is kept."""
    parts, n, width = books.shape
    kinds = [vectors.schema[c].dataType.simpleString() for c in columns]
    schema = ", ".join([*(f"c{i} {k}" for i, k in enumerate(kinds)), "code string", "error long"])
    kept = _kept(vectors, embedding, scale, *columns).where(F.size("__ints") == (parts * width if n else -1))
    shared = vectors.sparkSession.sparkContext.broadcast([Tree(b) for b in books] if n else [])
    out = kept.mapInArrow(_codes(shared, parts), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "code", "error")


def decoded(code: str, books: np.ndarray) -> Column:
    """The integers that a code stands for."""
    book = F.array(*[F.array(*[F.array(*map(F.lit, e)) for e in b.tolist()]) for b in books])
    entry = lambda j: F.conv(F.substr(code, 2 * j + 1, F.lit(2)), 16, 10).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda j: F.get(F.get(book, j), entry(j))))


def compressed(vectors: DataFrame, key: str = "vec_id", label: str = "label", embedding: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """key, code, error, label_error (the errors of a label added up) and codebooks_sha256 of every kept vector.

    Labels of many vectors get their sums by broadcast (at most 10,000 of them), the others by a shuffle of both sides.
    """
    books = train(vectors, key, embedding, parts, entries, rounds, scale)
    name = F.when(F.col(label).isNull(), "").otherwise(F.concat(F.lit("="), F.col(label).cast("string")))
    rows = written(encoded(vectors, books, [key, label], embedding, scale).select(F.col(key).alias("__key"), name.alias("__label"), "code", "error"), "codes")
    sums = written(rows.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__size")), "codes-labels")
    total = rows.count()
    out = join_groups(rows, sums, ["__label"], "__size", total)
    return out.select(F.col("__key").alias(key), "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
