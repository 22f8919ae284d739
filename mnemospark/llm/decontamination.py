"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case words with single blanks between. An item of length L may differ by
k edits (a share of L) from a passage. Cut into k + 1 pieces, at least one of which the passage holds
unchanged: one automaton finds all pieces of all items in a single pass over a text, and each hit's window is
verified with Myers' bit-parallel distance (the whole item against any part of the window).

Items come in blocks of bounded size, each broadcast and run over all documents; documents are not shuffled.

Defined results: a null or empty text matches nothing; a null item, or one without words, is never found; an
item too short for an edit must occur as whole words; repeated rows give repeated results; copies of an item
are found each; an empty table of either kind gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits for each character of an item, and the least length of a piece.
ERROR_RATE = 0.05
PIECE = 12
#: Characters of the items in one block: what an automaton is built from and broadcast.
ITEM_BLOCK = 2_000_000

WORD = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    return " ".join(WORD.findall(text.lower())) if text else ""


def budget(length: int, rate: float = ERROR_RATE) -> int:
    """Edits allowed: the share of the length, as long as each piece keeps PIECE characters."""
    return max(0, min(int(length * rate), length // PIECE - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """The item in k + 1 parts of near-equal length, each with its offset."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """An item as bit masks, one bit for each character."""

    def __init__(self, item: str):
        self.n = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def nearest(self, text: str) -> tuple[int, int]:
        """Least edit distance of the whole item to any substring of text, and the first end that has it."""
        high, full = 1 << self.n - 1, (1 << self.n) - 1
        up, down, score = full, 0, self.n  # vertical differences of +1 and -1 in a column
        best, end = self.n, 0
        get = self.masks.get
        for at, c in enumerate(text, 1):
            eq = get(c, 0)
            diagonal = (((eq & up) + up) ^ up) | eq | down
            plus, minus = down | ~(diagonal | up) & full, up & diagonal
            if plus & high:
                score += 1
            elif minus & high:
                score -= 1
            plus, minus = plus << 1 & full, minus << 1 & full
            vertical = eq | down
            up, down = minus | ~(vertical | plus) & full, plus & vertical
            if score < best:
                best, end = score, at
        return best, end


class Matcher:
    """All items of a block in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items = [(i, t, k if (k := budget(len(t), rate)) else 0) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.items = [(i, t if k else f" {t} ", k) for i, t, k in self.items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for offset, piece in pieces(t, k):
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()
        self.patterns: dict[int, tuple[Pattern, Pattern]] = {}

    def _patterns(self, n: int) -> tuple[Pattern, Pattern]:
        if n not in self.patterns:
            t = self.items[n][1]
            self.patterns[n] = Pattern(t), Pattern(t[::-1])
        return self.patterns[n]

    def matches(self, text: str | None) -> Iterator[tuple[int, int, int, int, int]]:
        """(item_id, distance, budget, start, end) of the best passage of each item found; places in the normal form."""
        t = normal(text)
        if not t or not self.items:
            return
        t = f" {t} "
        best: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for last, (size, at) in self.automaton.iter(t):
            for n, offset in at:
                _, item, k = self.items[n]
                if n in best and best[n][0] == 0:
                    continue
                start = last - size + 1 - offset
                if not k:
                    best[n] = 0, start, start + len(item)
                    continue
                cell = (n, start // (k + 1))
                if cell in tried:
                    continue
                tried.add(cell)
                # every start of the cell lies in the window, each with k edits to either side
                lo = max(0, start // (k + 1) * (k + 1) - k)
                window = t[lo : lo + len(item) + 3 * k + 1]
                forward, backward = self._patterns(n)
                distance, end = forward.nearest(window)
                if distance <= k and (n not in best or distance < best[n][0]):
                    _, back = backward.nearest(window[:end][::-1])
                    best[n] = distance, lo + end - back, lo + end
        for n in sorted(best):
            distance, start, end = best[n]
            yield self.items[n][0], distance, self.items[n][2], max(0, start - 1), end - 1


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items, ITEM_BLOCK characters at a time."""
    block, size = [], 0
    for r in items.select(F.col(key).cast("long").alias("i"), F.col(text).alias("t")).where("t is not null and i is not null").toLocalIterator():
        block.append((r["i"], r["t"]))
        size += len(r["t"])
        if size >= ITEM_BLOCK:
            yield block
            block, size = [], 0
    yield block


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, distance, budget, start, end."""
    schema = "doc_id long, item_id long, distance int, budget int, start long, end long"
    rows = docs.select(F.col(key).cast("long"), F.col(text))
    out = None
    for block in item_blocks(items, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def found(batches, shared=shared):
            matcher = Matcher(shared.value, rate)
            for b in batches:
                hits = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for m in matcher.matches(t.as_py())]
                cols = list(zip(*hits, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "distance", "budget", "start", "end"])

        part = rows.mapInArrow(found, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The rows of docs that hold no item, with their columns; rows stay where they are."""
    out = docs
    at = docs.columns.index(text)
    for block in item_blocks(items, "item_id", item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches, shared=shared):
            matcher = Matcher(shared.value, rate)
            for b in batches:
                yield b.filter(pa.array([next(matcher.matches(t.as_py()), None) is None for t in b.column(at)], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out
