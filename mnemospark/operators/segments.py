"""A persisted index in immutable segments: refreshed by page, searched by its words' best blocks.

A refresh writes one segment with the entries of the added and changed pages alone, and tombstones for what they
replace; ``merge`` joins segments of like size. A manifest names the segments of a version; a commit that another writer
has overtaken is refused. It also names the analyser (rules and stop words) that read the texts; another one is refused.

A segment has four tables. ``pages``: what each page says, by page (the words of its lines; its terms in JSON, the search
words with the line that holds them, or the lines with their counts). ``blocks``: the postings of a term in blocks by descending count, each with the largest count and the least
length in it; a row holds the blocks of a stripe of pages whose terms share a bucket, in order of bucket, as the task that
read the pages writes them. Row groups and Parquet pages are small, so a search skips most rows of other buckets and no scan
holds more than a row group. ``terms``: in how many pages a term is (with negative numbers for what a refresh has replaced), so sums over
segments are the living pages' frequencies. ``dead``: pages whose entries in earlier segments do not count.

A search for the k best reads the heads of its terms' blocks, scores the pages of the blocks with the greatest bounds, and
takes the k-th score as a floor. A block goes unread if its bound, with the greatest bounds of the other terms, stays
below the floor. What remains is scored exactly from ``pages``; no text is read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import re
import unicodedata
import uuid
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import KNOWLEDGE_BOOST, WINDOW_LINES, WINDOW_STRIDE, EngineConfig
from ..functions import text as T
from ..session import arrow_rows, cleaning_up
from ..sources import manifest
from . import bm25, lexical, maintenance

#: Changes whenever texts are read into terms by other rules, or segments are laid out in another way.
ANALYSER = 3
#: Fields: search words by window, and full-text words of the whole page.
LEXICAL, FULL = 0, 1
#: Entries of a block; pages and entries whose postings a task holds at once; buckets of a field's terms.
BLOCK, STRIPE_PAGES, STRIPE_ENTRIES, BUCKETS = 128, 65_536, 1_000_000, 128
#: Pages that are read into terms at once; bytes a core up to which a table is dealt anew before that.
SLICE, SMALL_BYTES = 256, 4 << 20
#: Rows that go to Python together; how ``blocks`` lies in its files: bytes of a row group, rows of a page.
ARROW_ROWS, LAYOUT = 1024, {"compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.page.row.count.limit": "16"}
#: Blocks that are scored for the first floor, and candidates that are broadcast.
SEEDS, FEW = 4, 100_000
#: Tombstones that are broadcast; more are joined by page.
FEW_DEAD = 100_000
#: A segment is merged with the newer ones that have together at least 1/LIKE of its pages and tombstones.
LIKE = 2

#: A run of letters, digits, underscores, dots and dashes, without dots and dashes at its ends; a run of letters and digits.
WORD, ALNUM = re.compile(r"\w+(?:[.-]+\w+)*"), re.compile(r"[^\W_]+")
#: No list of an entry holds itself, so nothing needs to be looked for.
_json = json.JSONEncoder(ensure_ascii=False, check_circular=False, separators=(",", ":")).encode
PAGES = "revision string, kind string, grp string, some boolean, n long, least int, words array<int>, lexical string, full string"


class OtherAnalyser(ValueError):
    """The index was written by other rules or with other stop words."""


def fold(text: str) -> str:
    """python_text.fold of a long text: marks go by character, not by place."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.casefold())
    for c in set(text):
        if unicodedata.combining(c):
            text = text.replace(c, "")
    return text


def search_words(folded: str, stop: frozenset[str]) -> list[str]:
    return [w for w in WORD.findall(folded) if len(w) > 1 and w not in stop]


def _peak(lines: list[int]) -> int:
    """The largest count of a term in one window; lines: each line with its count behind it."""
    if lines[-2] < WINDOW_LINES:  # the first window has them all
        return sum(lines[1::2])
    found: dict[int, int] = {}
    for line, n in zip(lines[::2], lines[1::2], strict=True):
        for k in range(max(0, -(-(line - WINDOW_LINES + 1) // WINDOW_STRIDE)), line // WINDOW_STRIDE + 1):
            found[k] = found.get(k, 0) + n
    return max(found.values())


def _full(tokens: list[str]) -> Counter:
    """The counts of full-text words, which lie inside the runs that are search words."""
    counts = Counter(tokens)
    for token in [t for t in counts if not t.isalnum()]:
        n = counts.pop(token)
        for w in ALNUM.findall(token):
            counts[w] += n
    return counts


def _read(text: str, stop: frozenset[str]) -> tuple[list[int], dict[str, int | list[int]], Counter]:
    """Words of each line, the line of each search word or its lines with their counts behind them, and the counts of
    full-text words."""
    words, at, every = [], {}, []
    known = at.get
    for i, line in enumerate(fold(text).splitlines()):
        tokens = WORD.findall(line)
        every += tokens
        own = [w for w in tokens if len(w) > 1 and w not in stop]
        words.append(len(own))
        for w in own:
            lines = known(w)
            if lines is None:
                at[w] = i
            elif type(lines) is int:
                at[w] = [i, 2] if lines == i else [lines, 1, i, 1]
            elif lines[-2] == i:
                lines[-1] += 1
            else:
                lines += (i, 1)
    return words, at, _full(every)


def bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def _pages(stop: frozenset[str], names: list[str]):
    """page, text, revision, kind, grp to rows of ``pages``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, SLICE) for i in range(0, whole.num_rows, SLICE)):
                some, n, least, ends, w, lexical, fulltext = [], [], [], [0], [], [], []
                for x in b.column(1):
                    text = x.as_py()
                    words, at, full = _read(text or "", stop)
                    some.append(bool((text or "").strip(" ")))
                    n.append(None if text is None else full.total())
                    least.append(min((sum(words[k : k + WINDOW_LINES]) for k in range(0, len(words), WINDOW_STRIDE)), default=0))
                    w += words
                    ends.append(len(w))
                    lexical.append(_json(at))
                    fulltext.append(_json(full))
                counts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(w, pa.int32()))
                cols = [b.column(0), b.column(2), b.column(3), b.column(4), pa.array(some, pa.bool_()), pa.array(n, pa.int64()), pa.array(least, pa.int32()), counts, pa.array(lexical, pa.string()), pa.array(fulltext, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows


def _cut(field: int, stripe: str, pages: pa.Array, page: np.ndarray, terms: list[str], code: np.ndarray, tf: np.ndarray, length: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """The blocks of one stripe's entries in a field, a row for each bucket. page, code: the places of the page and of the
    term, for each entry."""
    of = np.fromiter(map(bucket, terms), dtype=np.int32, count=len(terms))
    by_bucket = np.argsort(of, kind="stable").astype(np.int32)
    rank = np.empty(len(of), dtype=np.int32)
    rank[by_bucket] = np.arange(len(of), dtype=np.int32)
    code = rank[code]
    order = np.lexsort((length, -tf, code)).astype(np.int32)
    code, tf, length, page = code[order], tf[order], length[order], page[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    place = np.arange(len(code)) - np.repeat(first, np.diff(first, append=len(code)))
    starts = np.flatnonzero(place % BLOCK == 0)
    own = code[starts]
    buckets = of[by_bucket[own]]
    rows = np.flatnonzero(np.diff(buckets, prepend=-1))
    least = np.minimum.reduceat(length, starts) if len(starts) else length
    offsets = lambda x, end: pa.array(np.append(x, end).astype(np.int32))
    blocks = lambda x: pa.ListArray.from_arrays(offsets(rows, len(starts)), x)
    postings = lambda x: pa.ListArray.from_arrays(offsets(starts[rows], len(code)), x)
    cols = [pa.array(np.full(len(rows), field, np.int32)), pa.array(buckets[rows]), pa.array([stripe] * len(rows), pa.string()), blocks(pa.array(terms, pa.string()).take(pa.array(by_bucket[own])))]
    cols += [blocks(pa.array((starts - np.repeat(starts[rows], np.diff(rows, append=len(starts)))).astype(np.int32))), blocks(pa.array(np.diff(np.append(starts, len(code))).astype(np.int32)))]
    cols += [blocks(pa.array(tf[starts])), blocks(pa.array(least.astype(np.int64)))]
    cols += [postings(pages.take(pa.array(page))), postings(pa.array(tf)), postings(pa.array(length))]
    return pa.RecordBatch.from_arrays(cols, names=names)


def _blocks(names: list[str]):
    """page, n, least, lexical, full to blocks; a stripe of pages at a time, whose entries are held as numbers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = lambda: ([], *((defaultdict(itertools.count().__next__), *(array("i") for _ in range(4))) for _ in (LEXICAL, FULL)))
        pages, *fields = empty()  # by field: codes; terms and counts of the entries, lengths and numbers of terms of the pages

        def stripe() -> Iterator[pa.RecordBatch]:
            name, keys = uuid.uuid4().hex[:8], pa.concat_arrays(pages)
            for field, (codes, *numbers) in enumerate(fields):
                code, tf, length, counts = (np.frombuffer(x, dtype=np.int32) for x in numbers)
                page = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
                yield _cut(field, name, keys, page, list(codes), code, tf, length[page], names)

        held = n_pages = 0
        for whole in batches:
            for b in (whole.slice(i, SLICE) for i in range(0, whole.num_rows, SLICE)):
                last = 0
                for i, (n, least, lexical, full) in enumerate(zip(*(b.column(c) for c in range(1, 5)), strict=True), 1):
                    at, words = json.loads(lexical.as_py()), json.loads(full.as_py())
                    for (codes, terms, tfs, lengths, counts), length, found, tf in zip(fields, (least, n), (at, words), ([1 if type(x) is int else _peak(x) for x in at.values()], list(words.values())), strict=True):
                        terms.fromlist(list(map(codes.__getitem__, found)))
                        tfs.fromlist(tf)
                        lengths.append(length.as_py() or 0)
                        counts.append(len(found))
                    held += len(at) + len(words)
                    n_pages += 1
                    if held >= STRIPE_ENTRIES or n_pages >= STRIPE_PAGES:
                        pages.append(b.column(0).slice(last, i - last))
                        yield from stripe()
                        pages, *fields = empty()
                        last, held, n_pages = i, 0, 0
                if last < b.num_rows:
                    pages.append(b.column(0).slice(last))
        if pages:
            yield from stripe()

    return rows


def _postings() -> Column:
    return F.inline(F.arrays_zip(F.col("pages").alias("page"), F.col("tfs").alias("tf"), F.col("lengths").alias("length")))


def _value(column: str, term: str) -> Column:
    """A term's value in a page's JSON, as JSON. Terms hold letters, digits, dots, dashes and underscores alone and values
    hold no text, so a term between its marks is its key, and nothing needs to be parsed."""
    key = f'"{term}":'
    return F.when(F.contains(column, F.lit(key)), F.rtrim(F.substring_index(F.substring_index(column, key, -1), ',"', 1), F.lit("}")))


class Index:
    """A version of the index in a folder."""

    def __init__(self, spark: SparkSession, folder: str, config: EngineConfig = EngineConfig()):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config
        self.stop = frozenset(config.stop_words)
        self.analyser = hashlib.sha256(f"{ANALYSER}\n{sorted(self.stop)}".encode()).hexdigest()[:16]
        #: Blocks that the last limited search could have read, and those that it read.
        self.blocks_met, self.blocks_read = 0, 0
        self.version, self.state = manifest.latest(spark, f"{self.folder}/manifest")
        if self.state and self.state["analyser"] != self.analyser:
            raise OtherAnalyser(f"{folder} was written by other rules or stop words; build it anew")

    # Tables of all segments

    def _table(self, name: str, segments: list[dict] | None = None) -> DataFrame:
        """The rows of all segments' tables of that name, with seq."""
        parts = [self.spark.read.schema(self._schema(name)).parquet(f"{self.folder}/segments/{s['id']}/{name}").withColumn("seq", F.lit(s["seq"])) for s in (self._state()["segments"] if segments is None else segments)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _state(self) -> dict:
        if self.state is None:
            raise FileNotFoundError(f"there is no index in {self.folder}")
        return self.state

    def _schema(self, name: str, kind: str | None = None) -> str:
        kind = kind or self._state()["kind"]
        return {"pages": f"page {kind}, {PAGES}", "blocks": f"field int, bucket int, stripe string, terms array<string>, starts array<int>, sizes array<int>, tops array<int>, leasts array<long>, pages array<{kind}>, tfs array<int>, lengths array<int>", "terms": "field int, term string, df long", "dead": f"page {kind}, before int"}[name]

    def _alive(self, rows: DataFrame, upto: int | None = None) -> DataFrame:
        """rows (page, seq) without what later segments replace; upto: by tombstones of segments up to that one."""
        dead = [s for s in self._state()["segments"] if s.get("dead") and (upto is None or s["seq"] <= upto)]
        if not dead:
            return rows
        gone = self._table("dead", dead).groupBy("page").agg(F.max("before").alias("before"))
        gone = F.broadcast(gone) if sum(s["dead"] for s in dead) <= FEW_DEAD else gone
        return rows.join(gone, (rows["page"] == gone["page"]) & (rows["seq"] < gone["before"]), "left_anti")

    def pages(self) -> DataFrame:
        """The living pages."""
        return self._alive(self._table("pages"))

    def terms(self, field: int = LEXICAL) -> DataFrame:
        """term and df: how many living pages hold each term."""
        return self._table("terms").where(F.col("field") == field).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    # Writing

    def refresh(self, pages: DataFrame, key: str = "source", text: str = "text", kind: str | None = None, group: str | None = None) -> DataFrame:
        """Bring the index up to these pages and commit it; the counts of the delta come back.

        Texts are digested in one scan; added and changed ones are read into terms, and nothing else is written. Pages
        without a key are left out.
        """
        with cleaning_up(self.spark), arrow_rows(self.spark, ARROW_ROWS):
            return self._refreshed(pages, key, text, kind, group)

    def _refreshed(self, pages: DataFrame, key: str, text: str, kind: str | None, group: str | None) -> DataFrame:
        some = pages.where(F.col(key).isNotNull())
        null = F.lit(None).cast("string")
        rows = some.select(F.col(key).alias("page"), F.col(text).alias("text"), T.digest(F.coalesce(F.col(text), F.lit("\0"))).alias("revision"), (F.col(kind).cast("string") if kind else null).alias("kind"), (F.col(group).cast("string") if group else null).alias("grp"))
        now = rows.select("page", F.sha2(F.concat_ws("\0", "revision", F.coalesce("kind", F.lit("")), F.coalesce("grp", F.lit(""))), 256).alias("revision"))
        page_kind = pages.schema[key].dataType.simpleString()
        seq = 1 + max((s["seq"] for s in self.state["segments"]), default=0) if self.state else 1
        segment = {"id": f"{seq:06d}-{uuid.uuid4().hex[:12]}", "seq": seq, "dead": 0}
        at = f"{self.folder}/segments/{segment['id']}"
        if self.state is None:
            counts, fresh = None, rows
        else:
            known = self.pages().select("page", F.sha2(F.concat_ws("\0", "revision", F.coalesce("kind", F.lit("")), F.coalesce("grp", F.lit(""))), 256).alias("revision"))
            maintenance.index_delta(known, now, "page").where("change <> 'same'").write.parquet(f"{at}/delta")
            delta = self.spark.read.parquet(f"{at}/delta")
            counts = now.agg(F.count(F.lit(1)).alias("indexed")).crossJoin(maintenance.delta_counts(delta).drop("indexed"))
            gone = delta.where("change in ('changed', 'removed')")
            gone.select("page", F.lit(seq).alias("before")).write.parquet(f"{at}/dead")
            segment["dead"] = self.spark.read.parquet(f"{at}/dead").count()
            fresh = rows.join(delta.where("change in ('added', 'changed')").select("page"), "page", "left_semi")
        names = ["page", *(c.split(" ")[0] for c in PAGES.split(", "))]
        size = int(str(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        cores = self.spark.sparkContext.defaultParallelism
        if size < cores * SMALL_BYTES:  # as one file's only row group would be one task
            fresh = fresh.repartition(2 * cores)
        fresh.select("page", "text", "revision", "kind", "grp").mapInArrow(_pages(self.stop, names), f"page {page_kind}, {PAGES}").write.option("compression", "zstd").parquet(f"{at}/pages")
        out = self._segment(at, segment, page_kind)
        totals = self._sums(self.spark.read.schema(self._schema("pages", page_kind)).parquet(f"{at}/pages"))
        if self.state:
            lost = self._lost(at) if segment["dead"] else None
            minus = self._sums(lost) if lost is not None else dict.fromkeys(totals, 0)
            totals = {k: self.state["totals"][k] + totals[k] - minus[k] for k in totals}
            segments = [*self.state["segments"], out]
        else:
            segments = [out]
        self._commit({"analyser": self.analyser, "kind": page_kind, "segments": segments, "totals": totals})
        if counts is None:
            counts = self.spark.range(1).select(*[F.lit(out["pages"] if c != "removed" else 0).cast("long").alias(c) for c in ("indexed", "changed", "removed")])
        return counts

    def _lost(self, at: str) -> DataFrame:
        """The living pages of this version that the segment at that folder replaces."""
        gone = self.spark.read.parquet(f"{at}/dead").select("page")
        return self.pages().join(gone, "page", "left_semi")

    def _sums(self, pages: DataFrame) -> dict:
        row = pages.agg(F.count(F.lit(1)).alias("docs"), F.count("n").alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.count_if("some").alias("some"), F.count_if(F.col("kind") == "knowledge").alias("knowledge")).first()
        return row.asDict()

    def _segment(self, at: str, segment: dict, kind: str, terms: DataFrame | None = None) -> dict:
        """Write blocks and terms of the pages that lie at a folder; terms: those of merged segments."""
        spark = self.spark
        pages = spark.read.schema(self._schema("pages", kind)).parquet(f"{at}/pages")
        names = [c.split(" ")[0] for c in self._schema("blocks", kind).split(", ")]
        blocks = pages.select("page", "n", "least", "lexical", "full").mapInArrow(_blocks(names), self._schema("blocks", kind))
        blocks.write.options(**LAYOUT).parquet(f"{at}/blocks")
        if terms is None:
            heads = spark.read.schema(self._schema("blocks", kind)).parquet(f"{at}/blocks").select("field", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("sizes").alias("size")))).groupBy("field", "term").agg(F.sum("size").alias("df"))
            if segment["dead"]:
                lost = self._lost(at).select(F.lit(LEXICAL).alias("field"), F.explode(F.json_object_keys("lexical")).alias("term"))
                lost = lost.unionByName(self._lost(at).select(F.lit(FULL).alias("field"), F.explode(F.json_object_keys("full")).alias("term")))
                heads = heads.unionByName(lost.groupBy("field", "term").agg((-F.count(F.lit(1))).alias("df"))).groupBy("field", "term").agg(F.sum("df").alias("df"))
            terms = heads
        terms.sortWithinPartitions("field", "term").write.option("compression", "zstd").parquet(f"{at}/terms")
        return segment | {"pages": pages.count()}

    def _commit(self, state: dict) -> None:
        self.version = manifest.commit(self.spark, f"{self.folder}/manifest", self.version, state)
        self.state = state

    def merge(self, like: int = LIKE, last: int | None = None) -> int:
        """Join the newest segments with older ones of like size (or the last so many); how many were joined. Texts are
        not read again."""
        state = self._state()
        weight = lambda s: s["pages"] + s["dead"]
        chosen = [state["segments"][-1]]
        for s in reversed(state["segments"][:-1]):
            if len(chosen) >= last if last else weight(s) > like * sum(map(weight, chosen)):
                break
            chosen.insert(0, s)
        if len(chosen) < 2:
            return 0
        kept = state["segments"][: len(state["segments"]) - len(chosen)]
        seq = chosen[-1]["seq"]
        segment = {"id": f"{seq:06d}-{uuid.uuid4().hex[:12]}", "seq": seq, "dead": 0}
        with cleaning_up(self.spark), arrow_rows(self.spark, ARROW_ROWS):
            return self._merged(state, chosen, kept, segment)

    def _merged(self, state: dict, chosen: list[dict], kept: list[dict], segment: dict) -> int:
        at, kind = f"{self.folder}/segments/{segment['id']}", state["kind"]
        self._alive(self._table("pages", chosen)).drop("seq").write.option("compression", "zstd").parquet(f"{at}/pages")
        terms = self._table("terms", chosen).groupBy("field", "term").agg(F.sum("df").alias("df")).where("df <> 0")
        dead = [s for s in chosen if s["dead"]]
        if kept and dead:  # older segments still need their tombstones
            self._table("dead", dead).groupBy("page").agg(F.max("before").alias("before")).write.parquet(f"{at}/dead")
            segment["dead"] = self.spark.read.parquet(f"{at}/dead").count()
        out = self._segment(at, segment, kind, terms)
        self._commit(state | {"segments": [*kept, out]})
        return len(chosen)

    # Searching

    def _weights(self, field: int, terms: list[str], scope: DataFrame | None = None) -> dict[str, int]:
        """How many living pages (of the scope) hold each of the terms; a few rows."""
        if scope is None:
            found = self._table("terms").where((F.col("field") == field) & F.col("term").isin(terms)).groupBy("term").agg(F.sum("df").alias("df"))
        else:
            found = self._entries(field, terms).join(scope.select("page"), "page", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return {r["term"]: r["df"] for r in found.collect() if r["df"] > 0}

    def _entries(self, field: int, terms: list[str]) -> DataFrame:
        """term, page, tf, length of the living postings."""
        return self._alive(self._heads(field, terms).select("term", "seq", _postings()))

    def _heads(self, field: int, terms: list[str]) -> DataFrame:
        """seq, stripe, term, size, top, least of the terms' blocks, and their pages, tfs and lengths."""
        rows = self._table("blocks").where((F.col("field") == field) & F.col("bucket").isin(sorted({bucket(t) for t in terms})))
        each = F.arrays_zip(F.col("terms").alias("term"), *[F.col(f"{c}s").alias(c) for c in ("start", "size", "top", "least")])
        found = rows.select("seq", "stripe", "pages", "tfs", "lengths", F.explode(F.filter(each, lambda b: b["term"].isin(terms))).alias("b"))
        cut = lambda c: F.slice(c, F.col("b.start") + 1, F.col("b.size")).alias(c)
        return found.select("seq", "stripe", *[f"b.{c}" for c in ("term", "size", "top", "least")], *map(cut, ("pages", "tfs", "lengths")))

    def _candidates(self, field: int, bounds: dict, limit: int, slack: float, best, share=None) -> DataFrame | None:
        """page of all that can be among the ``limit`` best; None if no floor was found.

        bounds: by term, the most that a count and a length (columns) can add to a score; it falls with the length. best:
        from pages, a DataFrame with the score that counts, in descending order. slack: what rounding can hide. share: what
        a page keeps of the sum if it holds so many terms (a column), where that rises with their number.
        """
        terms = sorted(bounds)
        of = lambda f: F.coalesce(*[F.when(F.col("term") == t, f(t)) for t in terms])
        own = of(lambda t: bounds[t](F.col("top"), F.col("least")))
        heads = self._heads(field, terms)
        most = {r["term"]: r for r in heads.groupBy("term").agg(F.max(own).alias("bound"), F.max("top").alias("top"), F.count(F.lit(1)).alias("n")).collect()}
        self.blocks_met, self.blocks_read = sum(r["n"] for r in most.values()), 0
        if not most:
            return None
        share = share or (lambda n: F.lit(1.0))
        seeds = self._alive(heads.orderBy(F.desc(own), "stripe").limit(SEEDS).select("seq", _postings()).select("page", "seq"))
        scores = [r[0] for r in best(self.pages().join(F.broadcast(seeds.select("page").distinct()), "page", "left_semi")).limit(limit).collect()]
        if len(scores) < limit:
            return None
        floor = scores[-1] - slack
        # by ascending bound, the terms that together cannot reach the floor: they need not be looked for
        idle, sum_ = [], 0.0
        for t in sorted(most, key=lambda t: most[t]["bound"]):
            sum_ += most[t]["bound"]
            if sum_ >= floor:
                break
            idle.append(t)
        # the other terms at their largest counts, in a page as long as this one
        full = lambda t: bounds[t](F.lit(most[t]["top"]), F.col("least"))
        others = of(lambda t: sum((full(x) for x in most if x != t), F.lit(0.0)))
        reach = (own + others) * share(F.lit(len(most))) >= floor
        needed = heads.where(reach & ~F.col("term").isin(idle)) if idle else heads.where(reach)
        read = {r["term"]: r["n"] for r in needed.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.blocks_read = sum(read.values())
        # a term of which every block is read is not in the pages that it was not met in
        part = [t for t in most if read.get(t, 0) < most[t]["n"]]
        found = self._alive(needed.select("term", "seq", _postings()).withColumnsRenamed({"tf": "top", "length": "least"}))
        met = found.groupBy("page").agg(F.sum(own).alias("sum"), F.min("least").alias("least"), F.count(F.lit(1)).alias("n"), *[F.max(F.col("term") == t).alias(f"m{i}") for i, t in enumerate(part)])
        rest = [F.when(~F.col(f"m{i}"), full(t)).otherwise(0.0) for i, t in enumerate(part)]
        more = [F.when(F.col(f"m{i}"), 0).otherwise(1) for i in range(len(part))]
        most_of_page = (F.col("sum") + sum(rest, F.lit(0.0))) * share(F.col("n") + sum(more, F.lit(0)))
        return met.where(most_of_page >= floor).select("page")

    def _chosen(self, candidates: DataFrame | None, field: int, terms: list[str]) -> DataFrame:
        """The living pages of the candidates, which are broadcast while they are few."""
        if candidates is None:
            return self.pages().join(self._entries(field, terms).select("page").distinct(), "page", "left_semi")
        few = self.blocks_read * BLOCK <= FEW
        return self.pages().join(F.broadcast(candidates) if few else candidates, "page", "left_semi")

    def bm25(self, terms: Sequence[str], limit: int | None = None, by_group: bool = False) -> DataFrame:
        """page, grp and score of the pages (or of the best page of each group) that hold any of the full-text words,
        best first; all of them without a limit."""
        terms = sorted(set(terms))
        totals = self._state()["totals"]
        df = self._weights(FULL, terms) if terms else {}
        av = totals["words"] / totals["texts"] if totals["words"] else 1.0
        weight = {t: math.log((totals["docs"] - d + 0.5) / (d + 0.5) + 1.0) for t, d in df.items()}
        share = lambda t, tf, n: F.lit(weight[t]) * tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * n / av))
        empty = self.pages().select("page", "grp", F.lit(0.0).alias("score")).limit(0)
        if not df:
            return empty

        def scored(pages: DataFrame) -> DataFrame:
            tf = lambda t: F.coalesce(_value("full", t).cast("int"), F.lit(0))
            sums = sum((share(t, tf(t), F.col("n")) for t in sorted(df)), F.lit(0.0))
            return pages.select("page", "grp", F.round(sums, 6).alias("score")).where("score > 0")

        def first(hits: DataFrame) -> DataFrame:
            w = Window.partitionBy("grp").orderBy(F.desc("score"), "page")
            return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n") if by_group else hits

        order = [F.desc("score"), *(["grp"] if by_group else []), "page"]
        if limit is None:
            got = self._entries(FULL, sorted(df)).withColumn("s", F.coalesce(*[F.when(F.col("term") == t, share(t, F.col("tf"), F.col("length"))) for t in sorted(df)]))
            sums = got.groupBy("page").agg(F.round(F.sum("s"), 6).alias("score"))
            return first(self.pages().select("page", "grp").join(sums, "page")).select("page", "grp", "score")
        bounds = {t: lambda tf, n, t=t: share(t, tf, n) for t in df}
        found = self._candidates(FULL, bounds, limit, 2e-6, lambda pages: first(scored(pages)).select("score").orderBy(F.desc("score")))
        return first(scored(self._chosen(found, FULL, sorted(df)))).orderBy(*order).limit(limit)

    def scored_windows(self, query: str, scope: DataFrame | None = None) -> DataFrame:
        """page, line, end_line, score, matched_terms of every window that holds a query word, as a scan has them.
        scope: the pages that count, before any frequency is taken."""
        asked = self._asked(query, scope)
        pages = self.pages() if scope is None else self.pages().join(scope.select("page"), "page", "left_semi")
        if not asked[2]:
            return self._windows(pages.limit(0), *asked)
        found = self._entries(LEXICAL, sorted(asked[2])).select("page").distinct()
        return self._windows(pages.join(found, "page", "left_semi"), *asked)

    def _asked(self, query: str, scope: DataFrame | None = None) -> tuple[list[str], list[str], dict[str, float]]:
        """The query's words in order, its terms, and the weights of those that are there."""
        sequence = search_words(fold(query), self.stop)
        terms = sorted(set(sequence))
        df = self._weights(LEXICAL, terms, scope) if terms else {}
        n = self._state()["totals"]["some"] if scope is None else self.pages().join(scope.select("page"), "page", "left_semi").where("some").count()
        return sequence, terms, {t: lexical.idf(n, d) for t, d in df.items()}

    def _windows(self, pages: DataFrame, sequence: list[str], terms: list[str], weight: dict[str, float]) -> DataFrame:
        """The scored windows of pages, from the lines that hold the terms and the numbers of words."""
        config, none = self.config, F.array().cast("array<struct<line:int,n:int>>")
        have = sorted(weight)
        pairs = lambda x: F.transform(F.sequence(F.lit(0), (F.size(x) / 2 - 1).cast("int")), lambda i: F.struct(F.get(x, 2 * i).alias("line"), F.get(x, 2 * i + 1).alias("n")))
        lines = lambda x: F.when(x.startswith("["), x).otherwise(F.concat(F.lit("["), x, F.lit(",1]")))
        found = lambda t: pairs(F.from_json(lines(_value("lexical", t)), "array<int>"))
        rows = pages.select("page", "kind", "words", *[F.coalesce(found(t), none).alias(f"at{i}") for i, t in enumerate(have)])
        every = F.flatten(F.array(*[F.col(f"at{i}") for i in range(len(have))], none))
        w = rows.withColumn("k", F.explode(F.array_distinct(F.flatten(F.transform(every, lambda x: lexical.window_starts(x["line"]))))))
        inside = lambda x: (x["line"] >= F.col("k") * WINDOW_STRIDE) & (x["line"] < F.col("k") * WINDOW_STRIDE + WINDOW_LINES)
        total = lambda xs, f: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + f(x))
        zero = F.lit(0.0)
        place = {t: i for i, t in enumerate(have)}
        tf = lambda t: total(F.filter(f"at{place[t]}", inside), lambda x: x["n"])
        gain = lambda t: F.when((n := tf(t)) > 0, F.lit(weight[t]) * (1 + F.log1p(n))).otherwise(zero)
        w = w.withColumn("gain", F.array(*[gain(t) if t in weight else zero for t in terms]).cast("array<double>"))
        w = w.withColumn("matched", F.size(F.filter("gain", lambda g: g > 0)))
        words = total(F.slice("words", (F.col("k") * WINDOW_STRIDE + 1).cast("int"), WINDOW_LINES), lambda n: n)
        norm = F.sqrt(F.greatest(F.lit(1), words) / 50)
        score = F.aggregate("gain", zero, lambda a, g: a + g) / norm * F.col("matched") / max(1, len(terms))
        if config.span_discount and len(terms) > lexical.SPAN_WIDTH:
            score = F.when(F.col("matched") >= lexical.SPAN_TERMS, F.greatest(score, config.span_discount * lexical.best_span(sequence, F.col("gain"), terms) / norm)).otherwise(score)
        score = F.when(F.col("kind") == "knowledge", score * KNOWLEDGE_BOOST).otherwise(score)
        names = F.filter(F.zip_with(F.array(*map(F.lit, terms)).cast("array<string>"), "gain", lambda t, g: F.when(g > 0, t)), lambda t: t.isNotNull())
        end = F.least(F.col("k") * WINDOW_STRIDE + WINDOW_LINES, F.size("words")).cast("long")
        return w.select("page", (F.col("k") * WINDOW_STRIDE + 1).cast("long").alias("line"), end.alias("end_line"), F.round(score, 4).alias("score"), names.alias("matched_terms"))

    def search(self, query: str, limit: int = 5, min_terms: int = 1, scope: DataFrame | None = None) -> DataFrame:
        """The best window of each of the best pages, as ``lexical.search`` has them."""
        if scope is not None:
            return lexical.best_per_source(self.scored_windows(query, scope), "page", limit, min_terms)
        asked = self._asked(query)
        _, terms, weight = asked
        if not weight:
            return lexical.best_per_source(self._windows(self.pages().limit(0), *asked), "page", limit, min_terms)
        hits = lambda pages: lexical.best_per_source(self._windows(pages, *asked), "page", None, min_terms)
        # of a page, at most its largest count in a window, over the least words that one of its windows has; a span may
        # score the sum of its terms alone
        boost = KNOWLEDGE_BOOST if self._state()["totals"]["knowledge"] else 1.0
        bounds = {t: lambda tf, n, i=i: F.lit(i * boost) * (1 + F.log1p(tf)) / F.sqrt(F.greatest(F.lit(1), n) / 50) for t, i in weight.items()}
        share = None if self.config.span_discount else lambda n: n / len(terms)
        found = self._candidates(LEXICAL, bounds, limit, 2e-4, lambda pages: hits(pages).select("score").orderBy(F.desc("score")), share)
        return hits(self._chosen(found, LEXICAL, sorted(weight))).orderBy(F.desc("score"), "page", "line").limit(limit)
