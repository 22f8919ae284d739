"""Language identification by the nearest of several centroids for each language.

A text becomes counts of hashed n-grams of the bytes of its lower-case words, weighted by 1 + log(count) and
inverse document frequency and normalised. For each language, spherical k-means over a bounded sample of
labelled texts gives CLUSTERS centroids. A text gets the language of the centroid with the greatest cosine;
one whose cosine is below what training texts of its length reach is marked as rejected.

Bound: at most SAMPLE different texts for each language are fitted on, those of the smallest hashes of key and text, and
the MAX_LABELS labels of most drawn rows are learned. The model has CLUSTERS x DIMS 4-byte numbers for each label, so it
has 200 MB at most, whatever the rows.

Defined results: a null text, an empty one and one without letters give ``und``, score 0, rejected; so does
every text where nothing was learned; ties go to the first language by name; texts are read whole; repeated
rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, written

DIMS = 1 << 14
SAMPLE = 600
MAX_LABELS = 1000
#: Parts in which the sample comes to the driver.
SAMPLE_PARTS = 8
CLUSTERS = 3
GRAMS = (1, 2, 3, 4)
#: Bytes of a text whose n-grams are counted at once.
PART = 1 << 20
#: Texts of one block of a matrix product.
BLOCK = 256
#: A cosine below this share of the least of the training texts of the same length (by powers of 2) is rejected.
SLACK = 0.5

NO_LETTERS = re.compile(r"[\W\d_]+")


def weighted(text: str | None) -> tuple[np.ndarray, np.ndarray, int] | None:
    """The different n-grams of a text's words (hashed, with blanks at the words' ends), 1 + log(count) of each, and
    how many n-grams there are; None without letters."""
    words = NO_LETTERS.sub(" ", text.lower()).strip() if text else ""
    if not any(map(str.isalpha, words)):
        return None
    b = np.frombuffer(f" {words} ".encode(errors="replace"), dtype=np.uint8)
    c = np.zeros(DIMS, dtype=np.int64)
    for start in range(0, len(b), PART):
        x = b[start : start + PART + max(GRAMS) - 1].astype(np.uint32)
        h = np.zeros(len(x) + 1, dtype=np.uint32)
        for n in range(1, max(GRAMS) + 1):
            if len(x) < n:
                break
            h = (h[: len(x) - n + 1] * np.uint32(257) + x[n - 1 :] + np.uint32(1)) * np.uint32(2654435761)
            if n in GRAMS:  # those that start in this part
                g = h[:PART]
                c += np.bincount((g ^ (g >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(32 - 14), minlength=DIMS)
    at = np.flatnonzero(c)
    return at.astype(np.uint16), (1.0 + np.log(c[at])).astype(np.float32), int(c.sum())


def counted(found: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """A row of weights for each text."""
    x = np.zeros((len(found), DIMS), dtype=np.float32)
    for row, (at, w, _) in zip(x, found, strict=True):
        row[at] = w
    return x


def normalised(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-12)


def length_bin(n: int) -> int:
    return min(31, int(n).bit_length())


@dataclass
class Model:
    languages: list[str]
    of: np.ndarray  # each centroid's language
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray  # least cosine by length bin

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores (cosines, 0 to 1) and whether each is rejected."""
        said, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        if not self.languages:
            return said, score, rejected
        for start in range(0, len(texts), BLOCK):
            found = [(i, g) for i, t in enumerate(texts[start : start + BLOCK], start) if (g := weighted(t)) is not None]
            if not found:
                continue
            cos = normalised(counted([g for _, g in found]) * self.idf) @ self.centroids.T
            best = cos.argmax(axis=1)
            for (i, g), k, c in zip(found, best, cos[np.arange(len(found)), best].astype(float), strict=True):
                said[i] = self.languages[self.of[k]]
                score[i] = min(1.0, max(0.0, c))
                rejected[i] = c < self.floor[length_bin(g[2])]
        return said, score, rejected


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit rows; starts from the mean's nearest row, then the rows farthest from those."""
    picks = [int((x @ x.mean(axis=0)).argmax())]
    while len(picks) < min(k, len(x)):
        picks.append(int((x @ x[picks].T).max(axis=1).argmin()))
    c = x[picks].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = normalised(c)
    return c


def fit_texts(labelled: Iterable[tuple[str, str]]) -> Model:
    """A model of (language, text) pairs."""
    kept = [(lang, g) for lang, t in labelled if (g := weighted(t)) is not None]
    languages = sorted({lang for lang, _ in kept})
    if not kept:
        return Model([], np.zeros(0, dtype=int), np.zeros((0, DIMS), dtype=np.float32), np.ones(DIMS, dtype=np.float32), np.zeros(32))
    df = np.zeros(DIMS)
    for _, g in kept:
        df[g[0]] += 1
    idf = np.log((1 + len(kept)) / (1 + df)).astype(np.float32) + np.float32(0.1)
    found, of, least = [], [], np.full(32, np.inf)
    for n, lang in enumerate(languages):
        own = [g for name, g in kept if name == lang]
        x = normalised(counted(own) * idf)
        c = spherical_kmeans(x, CLUSTERS)
        found.append(c)
        of += [n] * len(c)
        for g, cos in zip(own, (x @ c.T).max(axis=1), strict=True):
            b = length_bin(g[2])
            least[b] = min(least[b], cos)
    # a bin without training texts asks no more than the shorter ones did
    floor = np.zeros(32)
    seen = np.inf
    for b in range(31, -1, -1):
        seen = min(seen, least[b])
        floor[b] = SLACK * seen if np.isfinite(least[: b + 1]).any() and np.isfinite(seen) else 0.0
    return Model(languages, np.array(of), np.concatenate(found), idf, floor)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train=None) -> Model:
    """Fit on a bounded sample of the rows that the condition train allows (all, if None)."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows if train is None else rows.where(train)
    hashed = rows.select(F.col(lang).alias("l"), F.xxhash64(F.col(key), F.col(text)).alias("h"), F.col(text).alias("t"))
    # of each label and task only the smallest hashes are shuffled
    least = hashed.select("l", "h").withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("n") <= SAMPLE)
    limits = least.groupBy("l").agg(F.max("h").alias("upto"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(MAX_LABELS).select("l", "upto").collect()
    if not limits:
        return fit_texts([])
    asked = docs.sparkSession.createDataFrame([tuple(r) for r in limits], T.StructType().add("l", docs.schema[lang].dataType).add("upto", "long"))
    some = hashed.join(F.broadcast(asked), "l").where("h <= upto").dropDuplicates(["l", "h"])
    drawn = written(some.select("l", "t", "h").repartition(SAMPLE_PARTS, F.xxhash64("t")).sortWithinPartitions("l", "h"), "language-sample")
    model = fit_texts((r["l"], r["t"]) for r in drawn.toLocalIterator())  # a part's texts at a time
    discard(drawn)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected; nothing is shuffled."""
    names = ("lang_pred", "score", "rejected")
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def rows(batches):
        for b in batches:
            said, score, rejected = shared.value.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string()), pa.array(score), pa.array(rejected)], names=[*b.schema.names, *names])

    schema = T.StructType(list(docs.schema.fields))
    for name, kind in zip(names, ("string", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return docs.mapInArrow(rows, schema)


def known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs whose language the model does not reject, with all their columns as they are. A model that
    learned nothing rejects nothing."""
    if not model.languages:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def rows(batches):
        for b in batches:
            yield b.filter(pa.array(~shared.value.predict(b.column(at).to_pylist())[2]))

    return docs.mapInArrow(rows, docs.schema)


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5) -> DataFrame:
    """Fit on the documents whose crc32(key) mod folds is not 0 and predict every one."""
    fold = F.crc32(F.col(key).cast("string")) % F.lit(folds)
    model = fit(docs, key, text, lang, fold != 0)
    found = identify(docs.select(F.col(key), F.col(text)), model, text)
    return found.select(F.col(key), (F.coalesce(fold, F.lit(0)) == 0).alias("held_out"), "lang_pred", "score", "rejected")
