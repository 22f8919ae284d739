"""Exact substring deduplication by suffix arrays of content shards, built by induced sorting.

A byte goes if a LENGTH-byte string that covers it also starts in a document of a smaller identifier.

Sharding: every window of LENGTH bytes names its anchor, the least hash of its GRAM-byte strings. Consecutive
windows of one anchor are a run; the bytes under a run are its segment. Equal windows have equal anchors, so
they meet in one shard. Shards first see digests alone: a run whose anchor no other document has is kept; of
equal segments, those of later documents go as a whole; only the first ones' segments are sent, and only
where an anchor has several different ones. The runs of a crowded anchor are cut further and part.

Arrays: a shard's segments are one text. Suffixes are classified; leftmost-smaller (LMS) suffixes are bucketed
and induced to sort LMS substrings, which get names; LMS suffixes are ranked recursively on the string of
names, two by two, as far as LENGTH bytes need; their order induces the suffix array bucket by bucket, in
linear time. Permuted common prefixes (each suffix with its neighbour in the array, in text order) give groups
of equal windows, and each group's least document decides.

Results come back as bits for each run; blocks of documents turn them into spans and remaining bytes.

Defined results: a null text is an empty one; a text shorter than LENGTH loses nothing; rows with the same
identifier are one document, which never removes from itself; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, discard, keyed, mix64, unkeyed, written

LENGTH = 50
GRAM = 20
BLOCK_BYTES = 400_000
#: Runs of one shard of hashes, about; its array has a few bytes for each.
SHARD_RUNS = 250_000
BYTES_A_RUN = 16
#: Arrays have 2**FINER times as many shards: a text of one takes some hundred bytes of memory for each of its own.
FINER = 3
#: Different segments of one anchor (that of a very common line, say) beyond which its runs part by the least of their
#: strings of SHORT_GRAM bytes under each of these salts.
CROWD, SHORT_GRAM = 2048, 8
SALTS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)
#: Bytes of a segment's digest.
DIGEST = 12
DIGEST_TYPE = np.dtype([("a", "<u8"), ("b", "<u4")])
_blake = hashlib.blake2b
#: Windows of one run at most; longer ones (of repeated bytes) are cut.
RUN = 4096

BYTE_HASH = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)


def _least_grams(data: np.ndarray, gram: int, salt: int = 0) -> np.ndarray:
    """The least hash of the gram-byte strings in each window of LENGTH bytes."""
    part, h, have, n = BYTE_HASH[data], None, 0, 1
    while True:  # a gram is put together from parts of 1, 2, 4, ... bytes
        if gram & n:
            h = part if h is None else h[: len(part) - have] * np.uint64(0x9E3779B97F4A7C15) + part[have : have + len(h)][: len(part) - have]
            have += n
        if 2 * n > gram:
            break
        part = part[:-n] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * n) + part[n:]
        n *= 2
    h = mix64(h[: len(data) - gram + 1] ^ np.uint64(salt))
    width, n = LENGTH - gram + 1, 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (width - n)], h[width - n :]) if n < width else h


class Runs:
    """The runs of a block: anchors, hashes of their segments, documents, first windows and numbers of windows."""

    def __init__(self, text: bytes, lengths: np.ndarray):
        self.data = data = np.frombuffer(text, np.uint8)
        self.lengths = lengths
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        if len(data) < LENGTH:
            self.anchor = np.zeros(0, np.uint64)
            self.doc = self.start = self.size = np.zeros(0, np.int64)
            return
        anchor = _least_grams(data, GRAM)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.flatnonzero(doc[: len(anchor)] == doc[LENGTH - 1 :])
        a, d = anchor[inside], doc[inside]
        new = np.ones(len(inside), bool)
        new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (inside[1:] != inside[:-1] + 1)
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(inside)))
        parts = -(-size // RUN)
        if len(size) and parts.max() > 1:
            which = np.repeat(np.arange(len(at)), parts)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
            at, size = at[which] + nth * RUN, np.minimum(RUN, size[which] - nth * RUN)
        self.anchor, self.doc, self.start, self.size = a[at], d[at], inside[at], size

    def digests(self) -> np.ndarray:
        """A cryptographic digest of every run's segment: equal digests stand for equal bytes."""
        text, out = self.data.tobytes(), bytearray()
        for a, b in zip(self.start.tolist(), (self.start + self.size + LENGTH - 1).tolist(), strict=True):
            out += _blake(text[a:b], digest_size=DIGEST).digest()
        return np.frombuffer(bytes(out), DIGEST_TYPE)

    def bytes_of(self, runs: np.ndarray) -> bytes:
        """The segments of the given runs, one after the other."""
        return self.bytes_at(self.start[runs], self.size[runs])

    def bytes_at(self, start: np.ndarray, size: np.ndarray) -> bytes:
        n = size + LENGTH - 1
        return self.data[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()


def _dealt(keys: np.ndarray, bits: int):
    """Shards by the keys' high bits, each with the places of its keys."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    s = shard[order]
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else []
    for i, j in zip(at, [*at[1:], len(s)], strict=True) if len(s) else ():
        yield int(s[i]), order[i:j]


def _dealt_sent(runs: Runs, state: np.ndarray, bits: int):
    """The runs to be sent (documents, starts, sizes), by the arrays' shards. Runs of a crowded anchor are cut where
    the least of their shorter strings change, by several hashes: equal windows still meet, as all of their strings
    are equal, and the others of that anchor part."""
    sent, crowd = np.flatnonzero(state == SENT), np.flatnonzero(state == CROWDED)
    key, doc, start, size = runs.anchor[sent], runs.doc[sent], runs.start[sent], runs.size[sent]
    if len(crowd):
        n = runs.size[crowd]
        own = np.repeat(np.cumsum(n) - n, n)
        nth = np.arange(n.sum()) - own
        window = np.repeat(np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1), n) + nth
        text, mine = np.frombuffer(runs.bytes_of(crowd), np.uint8), np.repeat(runs.anchor[crowd], n)
        for salt in SALTS:
            mine = mix64(mine + _least_grams(text, SHORT_GRAM, salt)[window])
        new = np.concatenate(([True], mine[1:] != mine[:-1])) | (nth == 0)
        at = np.flatnonzero(new)
        first = np.repeat(runs.start[crowd], n) + nth
        key, doc = np.concatenate((key, mine[at])), np.concatenate((doc, np.repeat(runs.doc[crowd], n)[at]))
        start, size = np.concatenate((start, first[at])), np.concatenate((size, np.diff(np.append(at, len(mine)))))
    for s, o in _dealt(key, bits + FINER):
        yield s, doc[o], start[o], size[o]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


BLOCKS = "block long, n long, ids binary, lengths binary, body binary"
BLOCKS_SCHEMA = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("body", pa.binary())])


def _blocks(batches):
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        lengths, start = pc.binary_length(batch.column(1)).to_numpy().astype("<u4"), 0
        while start < len(ids):
            end, size = start, 0
            while end < len(ids) and (not size or size + int(lengths[end]) <= BLOCK_BYTES):
                size += int(lengths[end])
                end += 1
            body = b"".join(batch.column(1).slice(start, end - start).to_pylist())
            yield _batch([(block, len(body), ids[start:end].tobytes(), lengths[start:end].tobytes(), body)], BLOCKS_SCHEMA)
            start, block = end, block + 1


def _opened(ids: bytes, lengths: bytes, body: bytes) -> tuple[np.ndarray, Runs]:
    return np.frombuffer(ids, "<i8"), Runs(body, np.frombuffer(lengths, "<u4").astype(np.int64))


PACKS = "shard int, block long, low long, a binary, b binary, c binary"
PACKS_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("low", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _packs(batches, bits: int):
    """A block's runs in each shard: anchors (a), segments' digests (b), identifiers less the block's lowest (c)."""
    for b in batches:
        for row in zip(*b.columns, strict=True):
            block, *rest = (x.as_py() for x in row)
            ids, runs = _opened(*rest)
            if not len(runs.anchor):
                continue
            low = int(ids.min())
            own = (ids - low).astype("<u8")
            own = own.astype("<u4") if own.max() < 1 << 32 else own
            digest = runs.digests()
            yield _batch([(s, block, low, runs.anchor[o].tobytes(), digest[o].tobytes(), own[runs.doc[o]].tobytes()) for s, o in _dealt(runs.anchor, bits)], PACKS_SCHEMA)


STATES = "block long, shard int, state binary, bits binary"
STATES_SCHEMA = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("state", pa.binary()), ("bits", pa.binary())])
KEPT, COVERED, SENT, CROWDED = 0, 1, 2, 3


def _judged(table: pa.Table) -> pa.Table:
    """For each block the state of its runs in the shard, in order: kept, covered as a whole, or to be sent (crowded,
    where the anchor has too many different segments for one array)."""
    shard, block, low, a, b, c = (table[n].to_pylist() for n in ("shard", "block", "low", "a", "b", "c"))
    anchor = np.frombuffer(b"".join(a), "<u8")
    segment = np.frombuffer(b"".join(b), DIGEST_TYPE)
    counts = [len(x) // 8 for x in a]
    doc = np.concatenate([np.frombuffer(x, "<u4" if len(x) == 4 * n else "<u8").astype(np.int64) + lo for x, n, lo in zip(c, counts, low, strict=True)])
    order = np.argsort(anchor)
    s = anchor[order]
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    d = doc[order]
    several = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
    some = order[np.repeat(several, np.diff(np.append(at, len(s))))]  # runs of anchors with several documents
    state = np.zeros(len(anchor), np.uint8)
    if len(some):
        some = some[np.lexsort((doc[some], segment["b"][some], segment["a"][some], anchor[some]))]
        h, g, d = anchor[some], segment[some], doc[some]
        new_anchor = np.concatenate(([True], h[1:] != h[:-1]))
        new_segment = new_anchor | np.concatenate(([True], (g["a"][1:] != g["a"][:-1]) | (g["b"][1:] != g["b"][:-1])))
        first = d[np.flatnonzero(new_segment)][np.cumsum(new_segment) - 1]  # least document of the same segment
        kinds = np.add.reduceat(new_segment.astype(np.int64), np.flatnonzero(new_anchor))[np.cumsum(new_anchor) - 1]
        state[some] = np.where(d > first, COVERED, np.where(kinds > CROWD, CROWDED, np.where(kinds > 1, SENT, KEPT)))
    cut = np.cumsum([0, *counts])
    return pa.Table.from_batches([_batch([(block[i], shard[i], state[cut[i] : cut[i + 1]].tobytes(), None) for i in range(len(block))], STATES_SCHEMA)])


SEGMENTS = "shard int, block long, ids binary, sizes binary, body binary"
SEGMENTS_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary())])


def _states_of(table: pa.Table, runs: Runs, bits: int) -> tuple[np.ndarray, dict[int, bytes]]:
    """The state of every run of a block, and the bits from the arrays by their (finer) shards."""
    state = np.zeros(len(runs.anchor), np.uint8)
    states, found = {}, {}
    for s, x, y in zip(*(table[n].to_pylist() for n in ("shard", "state", "bits")), strict=True):
        if x is not None:
            states[s] = x
        else:
            found[s] = y
    for s, o in _dealt(runs.anchor, bits):
        state[o] = np.frombuffer(states[s], np.uint8)
    return state, found


def _block_row(blocks: pa.Table):
    return _opened(*(blocks[n][0].as_py() for n in ("ids", "lengths", "body")))


def _sent(blocks: pa.Table, table: pa.Table, bits: int) -> pa.Table:
    """The segments of a block's runs that are to be sent, for each of the arrays' shards."""
    ids, runs = _block_row(blocks)
    block = blocks["block"][0].as_py()
    state, _ = _states_of(table, runs, bits)
    rows = []
    for s, doc, start, size in _dealt_sent(runs, state, bits):
        rows.append((s, block, ids[doc].tobytes(), size.astype("<u4").tobytes(), runs.bytes_at(start, size)))
    return pa.Table.from_batches([_batch(rows, SEGMENTS_SCHEMA)])


def classified(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next one (S), and the places of the leftmost ones of a row (LMS)."""
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    s = np.zeros(n, bool)
    s[n - 1] = True
    # the type of a place is that of the next place where the symbol changes
    nxt = np.searchsorted(differs, np.arange(n - 1))
    s[: n - 1] = t[differs[nxt]] < t[differs[nxt] + 1]
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    return s, lms


def induced(t: np.ndarray, s: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """The suffixes in order, from the LMS suffixes in an order by bucket: L-types from the front, then S-types
    from the back. Each bucket's entries, and in turn those they add to it, are placed at once."""
    n = len(t)
    counts = np.bincount(t, minlength=symbols)
    starts = np.concatenate(([0], np.cumsum(counts)))
    array = np.full(n, -1, np.int64)
    by = np.argsort(t[lms], kind="stable")
    seeds, seed_cut = lms[by], np.searchsorted(t[lms][by], np.arange(symbols + 1))
    head = starts[:-1].copy()

    def put(j: np.ndarray, step: int, mark: np.ndarray):
        """Place suffixes at their buckets' heads (step 1) or tails (step -1), in their order."""
        c = t[j]
        order = np.argsort(c, kind="stable")
        j, c = j[order], c[order].astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        size = np.diff(np.append(at, len(c)))
        nth = np.arange(len(c)) - np.repeat(at, size)
        array[mark[c] + step * nth - (step < 0)] = j
        mark[c[at]] += step * size

    for c in np.flatnonzero(counts):
        done = starts[c]
        while done < head[c]:
            j = array[done : head[c]] - 1
            done = head[c]
            j = j[j >= 0]
            j = j[~s[j]]
            if len(j):
                put(j, 1, head)
        j = seeds[seed_cut[c] : seed_cut[c + 1]] - 1
        j = j[j >= 0]
        if len(j):
            put(j, 1, head)
    tail = starts[1:].copy()
    for c in np.flatnonzero(counts)[::-1]:
        done = starts[c + 1]
        while done > tail[c]:
            j = array[tail[c] : done][::-1] - 1
            done = tail[c]
            j = j[j >= 0]
            j = j[s[j]]
            if len(j):
                put(j, -1, tail)
        j = array[starts[c] : head[c]][::-1] - 1  # the L-types of the bucket, from the back
        j = j[j >= 0]
        j = j[s[j]]
        if len(j):
            put(j, -1, tail)
    array[0] = n - 1 if array[0] < 0 else array[0]
    return array


def ranked(names: np.ndarray, length: int, step: int = 1) -> np.ndarray:
    """Ranks of the suffixes of a string of names by their first ``length`` names at least: ranks by ``step``
    names are those of pairs of ranks by half as many, and so on by recursion."""
    if step >= length or names.max() + 1 == len(names):
        return names
    pairs = names.astype(np.int64) * (int(names.max()) + 2)
    pairs[:-step] += names[step:] + 1
    return ranked(np.unique(pairs, return_inverse=True)[1], length, 2 * step)


def equal_parts(t: np.ndarray, at: np.ndarray, to: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the n symbols from each place ``at`` are the m symbols from ``to``."""
    same = n == m
    live, done = np.flatnonzero(same), 0
    while len(live):
        equal = t[at[live] + done] == t[to[live] + done]
        same[live[~equal]] = False
        done += 1
        live = live[equal & (n[live] > done)]
    return same


def suffix_array(t: np.ndarray, symbols: int, length: int = LENGTH) -> np.ndarray:
    """The suffixes of t, which ends with a symbol 0 that is nowhere else, ordered by at least ``length`` symbols."""
    s, lms = classified(t)
    if len(lms) <= 1:
        return induced(t, s, lms, symbols)
    first = induced(t, s, lms, symbols)  # sorts the LMS substrings
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    # names: equal substrings (from an LMS place to the next, both included) get the same one
    ends = np.append(lms[1:], len(t) - 1)
    where = np.empty(len(t), np.int64)
    where[lms] = np.arange(len(lms))
    by = where[order]
    size = (ends - lms + 1)[by]
    same = np.concatenate(([False], equal_parts(t, order[:-1], order[1:], size[:-1], size[1:])))
    name = np.empty(len(lms), np.int64)
    name[by] = np.cumsum(~same) - 1
    rank = ranked(name, length)  # an LMS substring adds a symbol at least
    return induced(t, s, lms[np.argsort(rank, kind="stable")], symbols)


def common_prefixes(data: np.ndarray, array: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place, in text order, the symbols its suffix shares with the one before it in the array, up to length."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    padded = np.concatenate((data, np.zeros(length + 8, np.uint8)))
    words = np.zeros(n + length, np.uint64)
    for i in range(8):
        words |= padded[i : i + n + length].astype(np.uint64) << np.uint64(8 * i)
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    for at in range(0, length, 8):
        x = words[live + at] ^ words[before[live] + at]
        same = x == 0
        low = x & (~x + np.uint64(1))  # the lowest bit that differs
        out[live] = at + np.where(same, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        live = live[same]
    return np.minimum(out, length)


#: What stands between segments: no byte of UTF-8.
GAP = 0xFF


def _compared(table: pa.Table) -> pa.Table:
    """A shard's array: for each block, bits of the windows of its runs that start in an earlier document too."""
    shard = table["shard"][0].as_py()
    block, ids, sizes, body = (table[n].to_pylist() for n in ("block", "ids", "sizes", "body"))
    doc = np.frombuffer(b"".join(ids), "<i8")
    size = np.frombuffer(b"".join(sizes), "<u4").astype(np.int64)
    raw = np.frombuffer(b"".join(body), np.uint8)
    n = size + LENGTH - 1
    data = np.full(len(raw) + len(n), GAP, np.uint8)
    start = np.cumsum(n + 1) - n - 1
    data[np.arange(len(raw)) + np.repeat(np.arange(len(n)), n)] = raw
    t = np.empty(len(data) + 1, np.uint16)
    t[:-1] = data.astype(np.uint16) + 2
    t[start + n] = 1
    t[-1] = 0
    array = suffix_array(t, 258)[1:]  # without the end
    prefix = common_prefixes(data, array)
    of = np.full(len(data), np.iinfo(np.int64).max)
    window = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    of[window] = np.repeat(doc, size)
    group = np.flatnonzero(np.concatenate(([True], prefix[array][1:] < LENGTH)))
    least = np.minimum.reduceat(of[array], group)
    hit = np.zeros(len(data), bool)
    hit[array] = np.repeat(least, np.diff(np.append(group, len(array)))) < of[array]
    hit = hit[window]
    per_block = np.cumsum([0] + [len(x) // 4 for x in sizes])
    cut = np.concatenate(([0], np.cumsum(size)))[per_block]
    rows = [(block[i], shard, None, np.packbits(hit[cut[i] : cut[i + 1]], bitorder="little").tobytes()) for i in range(len(block))]
    return pa.Table.from_batches([_batch(rows, STATES_SCHEMA)])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
TEXTS = RESULT + ", kept binary"


def _removed(blocks: pa.Table, table: pa.Table, bits: int, texts: bool) -> pa.Table:
    """A block's documents without the covered bytes."""
    ids, runs = _block_row(blocks)
    state, found = _states_of(table, runs, bits)
    hit = np.zeros(len(runs.data) + 1, np.int32)
    whole = state == COVERED
    np.add.at(hit, runs.start[whole], 1)
    np.add.at(hit, runs.start[whole] + runs.size[whole], -1)
    hit = np.cumsum(hit[:-1]) > 0
    for s, _, start, size in _dealt_sent(runs, state, bits):
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        hit[at] |= np.unpackbits(np.frombuffer(found[s], np.uint8), count=len(at), bitorder="little").astype(bool)
    seen = np.concatenate((np.zeros(LENGTH, np.int64), np.cumsum(hit)))
    gone = seen[LENGTH:] > seen[:-LENGTH]
    lengths, offsets = runs.lengths, runs.offsets
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    inner = offsets[:-1][lengths > 0]
    first[inner] = gone[inner]
    sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[offsets])
    kept = [runs.data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    out = {"doc_id": pa.array(ids), "n_bytes": pa.array(lengths), "n_removed": pa.array(sums(gone)), "n_spans": pa.array(sums(first)), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
    if texts:
        out["kept"] = pa.array(kept, pa.binary())
    return pa.table(out)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs; and the kept bytes, if texts is set."""
    rows = docs.select(keyed(key), F.coalesce(F.col(text), F.lit("")).cast("binary"))
    blocks = bucketed(rows.mapInArrow(_blocks, BLOCKS), "suffix_blocks", "block")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    bits = max(3, int(np.ceil(np.log2(max(1, total / BYTES_A_RUN / SHARD_RUNS)))))
    body = blocks.select("block", "ids", "lengths", "body")
    judged = written(body.mapInArrow(lambda it: _packs(it, bits), PACKS).groupBy("shard").applyInArrow(_judged, STATES), "suffix-states")
    sent = body.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(lambda b, t: _sent(b, t, bits), SEGMENTS)
    compared = written(sent.groupBy("shard").applyInArrow(_compared, STATES), "suffix-bits")
    told = judged.unionByName(compared)
    out = body.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda b, t: _removed(b, t, bits, texts), TEXTS if texts else RESULT)
    out = written(out, "suffix-result")
    discard(blocks, judged, compared)
    return out.withColumn("doc_id", unkeyed("doc_id"))
