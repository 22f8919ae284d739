"""Full-text ranking of section chunks by BM25, one hit for each page."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T

K1, B = 1.2, 0.75
#: Bytes whose words are counted at once; a longer chunk's are counted together.
COUNT_BYTES = 4 << 20


def words(text):
    """Folded runs of letters and digits (a dot or dash separates)."""
    return F.regexp_extract_all(T.fold(text), F.lit(r"(?U)([\p{L}\p{N}]+)"), F.lit(1))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk and its words, blanks between them, to the chunk's distinct words with their counts."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + COUNT_BYTES, "right")))
            chunks = b.column(0).slice(start, stop - start).filter(pa.array(sizes[start:stop] > 0))
            own = pc.split_pattern(b.column(1).slice(start, stop - start).filter(pa.array(sizes[start:stop] > 0)), " ")
            start = stop
            if not len(own):
                continue
            n, terms = pc.list_value_length(own).to_numpy().astype(np.int64), own.flatten().dictionary_encode()
            known = len(terms.dictionary)
            pairs, tf = np.unique(np.repeat(np.arange(len(n)) * known, n) + terms.indices.to_numpy(), return_counts=True)
            of, term = np.divmod(pairs, known)
            cols = [terms.dictionary.take(pa.array(term)), chunks.take(pa.array(of)), pa.array(n[of]), pa.array(tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["term", b.schema.field(0).name, "n", "tf"])


def postings(chunks: DataFrame, chunk: str, text: str) -> DataFrame:
    """term, chunk, n, tf: an inverted index of all words with their chunk's length.

    Each row's words are counted where the row is read, as a chunk is one row. Only if some chunk has several rows (they
    are one chunk where they are of one length) are the counts shuffled and summed.
    """
    rows = chunks.select(chunk, F.btrim(F.regexp_replace(T.fold(F.col(text)), r"[^\p{L}\p{N}]+", " ")).alias("w"))
    schema = S.StructType([S.StructField("term", S.StringType()), rows.schema[0], S.StructField("n", S.LongType()), S.StructField("tf", S.LongType())])
    out = rows.mapInArrow(_counts, schema)
    if chunks.groupBy(chunk).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():
        return out
    return out.groupBy("term", chunk, "n").agg(F.sum("tf").alias("tf"))


def _count(words_column: str, term: str):
    return F.size(F.filter(words_column, lambda x: x == F.lit(term)))


def bm25(chunks: DataFrame, terms: Sequence[str], chunk: str = "chunk_id", text: str = "content", keep: Sequence[str] = ()) -> DataFrame:
    """chunk, the columns to keep and score (greater is better) of the chunks that hold any of the terms.

    Every chunk's length is needed for the mean, so all are read into words, once: the numbers of each chunk are dealt
    by chunk, and that exchange serves the collection's figures and the ranking.
    """
    terms = sorted(set(terms))
    have = chunks.select(chunk, *keep, words(F.col(text)).alias("w"))
    counted = have.select(chunk, *keep, F.size("w").alias("n"), F.array(*[_count("w", t) for t in terms]).alias("tf")).repartition(chunk)
    figures = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("av"), F.array(*[F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(terms))]).alias("df"))
    weights = figures.select("av", F.transform("df", lambda d: F.log((F.col("docs") - d + 0.5) / (d + 0.5) + 1.0)).alias("weights"))
    hits = counted.where(F.exists("tf", lambda n: n > 0)).crossJoin(F.broadcast(weights))
    length = K1 * (1 - B + B * F.col("n") / F.when(F.col("av") > 0, F.col("av")).otherwise(1.0))
    each = F.zip_with("weights", "tf", lambda w, tf: w * tf * (K1 + 1) / (tf + length))
    return hits.select(chunk, *keep, F.round(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), 6).alias("score"))


def best_chunk_per_source(hits: DataFrame, source: str, limit: int | None = None, chunk: str = "chunk_id") -> DataFrame:
    w = Window.partitionBy(source).orderBy(F.desc("score"), chunk)
    out = hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return out if limit is None else out.orderBy(F.desc("score"), source).limit(limit)
