"""Fill-in-the-middle transformation of texts, cut by rank and select over their code-point boundaries.

The boundaries of a UTF-8 text are a bitvector: bit i is set where byte i starts a code point. It is packed into 64-bit
words, with a directory of the bits set before each block of words. The directory's last number is the text's length in
code points; two selects turn the two cuts, which are ranks, into byte offsets. Texts are cut as bytes and never decoded.

Defined results: a null text is an empty one; an empty text, or one that holds a sentinel, stays plain; a null key is
hashed as an empty one; repeated rows give repeated results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Words of 64 bits in a block of the directory.
BLOCK_WORDS = 8


class Boundaries:
    """The code-point boundaries of a text's bytes, with rank and select."""

    def __init__(self, data: bytes):
        starts = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
        packed = np.packbits(starts, bitorder="little")
        block = 8 * BLOCK_WORDS
        self.words = np.pad(packed, (0, -len(packed) % block)).view("<u8")
        self.size = len(data)
        counts = np.bitwise_count(self.words).reshape(-1, BLOCK_WORDS).sum(axis=1, dtype=np.int64)
        self.directory = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))

    @property
    def total(self) -> int:
        """Code points of the text."""
        return int(self.directory[-1])

    def rank(self, at: int) -> int:
        """Code points that start before byte at."""
        word, bit = divmod(at, 64)
        block = word // BLOCK_WORDS
        before = int(self.directory[block]) + int(np.bitwise_count(self.words[block * BLOCK_WORDS : word]).sum())
        return before + ((int(self.words[word]) & ((1 << bit) - 1)).bit_count() if bit else 0)

    def select(self, k: int) -> int:
        """The byte at which code point k starts (from 0); the text's end if there are only k."""
        if k >= self.total:
            return self.size
        block = int(np.searchsorted(self.directory, k, side="right")) - 1
        left, word = k - int(self.directory[block]), block * BLOCK_WORDS
        bits = int(self.words[word])
        while (n := bits.bit_count()) <= left:
            left, word = left - n, word + 1
            bits = int(self.words[word])
        for _ in range(left):
            bits &= bits - 1
        return 64 * word + (bits & -bits).bit_length() - 1


def _rows(plain_from: int, spm_below: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def of(data: bytes, h: list[int]) -> tuple:
        bounds = Boundaries(data)
        n = bounds.total
        if not data or h[2] % 100 >= plain_from or any(x in data for x in marks):
            return n, "plain", None, None, data
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        i, j = bounds.select(a), bounds.select(b)
        before, inside, after = data[:i], data[i:j], data[j:]
        if h[3] % 100 < spm_below:
            return n, "spm", a, b - a, b"".join((s, after, p, before, m, inside))
        return n, "psm", a, b - a, b"".join((p, before, s, after, m, inside))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            out = [of(t.as_py() or b"", h) for t, h in zip(batch.column(1), hashes, strict=True)]
            n, form, a, b, text = map(list, zip(*out, strict=True)) if out else ([], [], [], [], [])
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(text, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """key, n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every text.

    The numbers that decide are four groups of the SHA-256 of seed and key, so they depend on nothing else; plain_from
    and spm_below are the percentages at which a text stays plain and below which its suffix comes first. Nothing is
    shuffled.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    group = lambda i: F.conv(F.substring("__h", 8 * i + 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("data"), digest.alias("__h")).select("key", "data", *[group(i).alias(f"h{i}") for i in range(4)])
    schema = f"key {docs.schema[key].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output binary"
    return rows.mapInArrow(_rows(plain_from, spm_below), schema).withColumn("output", F.col("output").cast("string")).withColumnRenamed("key", key)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text again, from output and form alone: no part holds a mark, and no mark can begin within another."""
    text, after = F.col(output), lambda mark: F.substring_index(output, mark, -1)
    head = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring_index(F.substring_index(head, SUFFIX, 1), PREFIX, -1), after(MIDDLE), F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), after(MIDDLE), F.substring_index(F.substring_index(head, PREFIX, 1), SUFFIX, -1))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(text)
