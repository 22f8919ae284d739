"""Self-join on the Jaccard similarity of word shingles: a size-aware heavy-light join.

Every document is a set of hashed shingles. Blocks of documents send their hashes, packed, to hash shards,
which answer with those that more than one document holds and in how many. A document that shares less than
the overlap any link needs drops out, whatever its size; the others keep their shared hashes, rarest first.

Light sets (small ones) enumerate the fixed-size subsets of which a partner must hold at least one. Heavy sets
scan the inverted lists of a prefix: the rarest hashes, so many that two linked sets must meet in one. The
boundary is the size at which subsets begin to cost more than list entries, from the data's mean list length.

Each set is first verified against the least first member of its lists, and these links are joined into
components. In lists that still hold several components, pairs of different components are screened inside tasks
by an upper bound from bitmaps; of those that pass, a spanning set is verified. Where that fails to join a list,
the members that pass are compared exactly (overlaps by matrix product, a tile at a time). So no pair is lost, and
no group of copies is written out as pairs. A list's largest component is never compared with itself, so a list
costs its members times those outside that component. A task holds two blocks of UNIT_BYTES of sets.

Equal sets are one class from the start. Words are maximal runs outside white space, A-Z in lower case.

Defined results: every row is a document of its own, whatever its identifier, so rows that repeat an identifier
or have none are linked by their texts alone; a component's identifier is the least that one of its rows has,
null if none has one. A null, empty or blank text is an empty set, linked with nothing; fewer words than a
shingle make one shingle of them all; repeated rows are copies; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, components, discard, has_repeats, join_groups, keyed, mix64, text_bytes, unkeyed, unused, without, written
from .hashing import word_hashes

WORDS = 5
#: A link: DENOMINATOR * intersection >= NUMERATOR * union.
NUMERATOR, DENOMINATOR = 75, 100
#: Text bytes of one block of documents, and shingles of one shard of hashes, about.
BLOCK_BYTES = 3_000_000
#: Documents of one block, which a number of 16 bits tells apart.
BLOCK_DOCUMENTS = 60_000
SHARD_ENTRIES = 1_000_000
#: Members of a block of a list, and bytes of their sets; a set of more bytes is a block of its own, about.
MEMBERS, UNIT_BYTES = 512, 2_000_000
#: Pairs of one set, beyond which they are verified in several tasks.
PIVOT_PAIRS = 1024
#: 64-bit words of bitmaps that are compared at once.
TILE_WORDS = 1 << 18
#: Terms of one matrix product.
TILE_TERMS = 4096
#: Largest size whose subsets are considered; they cost 2**LIGHT_LIMIT at most.
LIGHT_LIMIT = 16

_rng = np.random.default_rng(20240229)
PLACE = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)


def need(n):
    """The least overlap of a set of n shingles with any set it can be linked with."""
    return -(-NUMERATOR * n // DENOMINATOR)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    h = np.zeros(max(0, len(w) - words + 1), dtype=np.uint64)
    for j in range(words):
        h += w[j : j + len(h)] * PLACE[j]
    h = mix64(h)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= words:
            s = np.sort(h[end - n : end - words + 1])
            out.append(s[np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))])
        elif n:
            one = (w[end - n : end] * PLACE[8 : 8 + n]).sum(dtype=np.uint64, keepdims=True) + PLACE[32 + n : 33 + n]
            out.append(mix64(one))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


PACKS = "shard int, block long, kind int, a binary, b binary, c binary"
PACK_NAMES = ["shard", "block", "kind", "a", "b", "c"]


def _packs(batches, bits: int):
    """Rows of kind 0: the hashes (a) and documents (b) of a block in a shard. Kind 1: a block's doc_ids (a), set sizes (b), set keys (c)."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 24
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        lengths, start = pc.binary_length(batch.column(1)).to_numpy(), 0
        while start < len(ids):
            end, size = start, 0
            while end < len(ids) and end - start < BLOCK_DOCUMENTS and (not size or size + lengths[end] <= BLOCK_BYTES):
                size += lengths[end] + 1
                end += 1
            sets = shingle_sets(batch.column(1).slice(start, end - start).to_pylist())
            sizes = np.array([len(s) for s in sets], dtype="<u4")
            keys = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
            h = np.concatenate(sets)
            d = np.repeat(np.arange(len(sets), dtype="<u2"), sizes)
            del sets
            shard = (h >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange((1 << bits) + 1)) if bits <= 16 else None
            if cut is None:
                at = np.flatnonzero(np.diff(shard[order])) + 1
                parts = [(int(shard[order[i]]), order[i:j]) for i, j in zip([0, *at], [*at, len(order)], strict=True) if j > i]
            else:
                parts = [(n, order[i:j]) for n, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
            rows = [(n, block, 0, h[o].tobytes(), d[o].tobytes(), None) for n, o in parts]
            rows.append((block % (1 << bits), block, 1, ids[start:end].tobytes(), sizes.tobytes(), keys))
            yield _batch(rows, PACKS_SCHEMA)
            start, block = end, block + 1


PACKS_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _shared(table: pa.Table) -> pa.Table:
    """A shard's answer: for each block the hashes that more than one document holds (a), their documents (b) and counts (c)."""
    kind = table["kind"].to_pylist()
    block, a, b, c = (table[n].to_pylist() for n in ("block", "a", "b", "c"))
    rows = [(0, block[i], 1, a[i], b[i], c[i]) for i, k in enumerate(kind) if k == 1]
    packs = [i for i, k in enumerate(kind) if k == 0]
    if packs:
        h = np.frombuffer(b"".join(a[i] for i in packs), dtype="<u8")
        d = np.frombuffer(b"".join(b[i] for i in packs), dtype="<u2")
        of = np.repeat(np.arange(len(packs), dtype=np.uint32), [len(a[i]) // 8 for i in packs])
        order = np.argsort(h)
        s = h[order]
        at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        n = np.diff(np.append(at, len(s)))
        many = np.repeat(n > 1, n)
        order, df = order[many], np.repeat(n, n)[many].astype("<u4")
        by = np.argsort(of[order], kind="stable")
        order, df = order[by], df[by]
        h, d, of = h[order], d[order], of[order]
        cut = np.searchsorted(of, np.arange(len(packs) + 1))
        rows += [(0, block[p], 0, h[i:j].tobytes(), d[i:j].tobytes(), df[i:j].tobytes()) for p, i, j in zip(packs, cut[:-1], cut[1:], strict=True) if j > i]
    return pa.Table.from_batches([_batch(rows, PACKS_SCHEMA)])


#: row: the document's own number, from its block and its place there.
SETS = "row long, doc_id long, n long, set_key binary, shared binary, df_sum long"
SETS_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("shared", pa.binary()), ("df_sum", pa.int64())])


def _gathered(table: pa.Table) -> pa.Table:
    """A block's documents with their shared hashes, rarest first; null where they are too few for any link."""
    kind = table["kind"].to_pylist()
    a, b, c = (table[n].to_pylist() for n in "abc")
    meta = kind.index(1)
    first = table["block"][0].as_py() << 16
    ids, sizes = np.frombuffer(a[meta], dtype="<i8"), np.frombuffer(b[meta], dtype="<u4").astype(np.int64)
    other = [i for i, k in enumerate(kind) if k == 0]
    h = np.frombuffer(b"".join(a[i] for i in other), dtype="<u8")
    d = np.frombuffer(b"".join(b[i] for i in other), dtype="<u2")
    df = np.frombuffer(b"".join(c[i] for i in other), dtype="<u4")
    held = np.bincount(d, minlength=len(ids))
    live = (held >= need(sizes)) & (sizes > 0)
    pick = live[d]
    h, d, df = h[pick], d[pick], df[pick]
    order = np.lexsort((h, df, d))
    h, d, df = h[order], d[order], df[order]
    cut = np.searchsorted(d, np.arange(len(ids) + 1))
    sums = np.concatenate(([0], np.cumsum(df, dtype=np.int64)))
    rows = [
        (first + i, int(ids[i]), int(sizes[i]), c[meta][16 * i : 16 * i + 16] if sizes[i] else None, h[cut[i] : cut[i + 1]].tobytes() if live[i] else None, int(sums[cut[i + 1]] - sums[cut[i]]))
        for i in range(len(ids))
    ]
    return pa.Table.from_batches([_batch(rows, SETS_SCHEMA)])


def document_sets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, n, set_key, shared, df_sum of every row of docs."""
    entries = text_bytes(docs, text) / 3  # a shingle for each 3 bytes of Parquet
    bits = max(3, int(np.ceil(np.log2(max(1, entries / SHARD_ENTRIES)))))
    rows = docs.select(keyed(key), F.coalesce(F.col(text), F.lit("")).cast("binary"))
    packs = rows.mapInArrow(lambda it: _packs(it, bits), PACKS)
    return packs.groupBy("shard").applyInArrow(_shared, PACKS).groupBy("block").applyInArrow(_gathered, SETS)


def subset_sizes(n: int) -> list[int]:
    """Sizes of the subsets that a set of n shares with a linked set, by the larger of the two."""
    return sorted({need(m) for m in range(n, DENOMINATOR * n // NUMERATOR + 1) if need(m) <= n})


def light_boundary(mean_list: float) -> int:
    """The largest size up to which a set's subsets are no more than the list entries its prefix meets."""
    best = 1
    for n in range(2, LIGHT_LIMIT + 1):
        if sum(comb(n, k) for k in subset_sizes(n)) > (n - need(n) + 1) * max(1.0, mean_list):
            break
        best = n
    return best


def _entries(batches, light: int):
    """(list, row, n) of a set's subsets, if it is light, and of its prefix, if a heavy set can be its partner."""
    for b in batches:
        lists, docs, sizes = [], [], []
        for doc, n, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            s = np.frombuffer(s, dtype="<u8")
            found = []
            if n <= light:
                own = np.sort(s)
                for k in subset_sizes(n):
                    found += [mix64((own[list(c)] * PLACE[:k]).sum(dtype=np.uint64, keepdims=True) + PLACE[40 + k : 41 + k]) for c in combinations(range(len(own)), k)]
            if n > light or DENOMINATOR * n >= NUMERATOR * (light + 1):
                found.append(s[: max(0, len(s) - need(n) + 1)])
            if found:
                found = np.concatenate(found).view(np.int64)
                lists.append(found)
                docs += [doc] * len(found)
                sizes += [n] * len(found)
        lists = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(docs, pa.int64()), pa.array(sizes, pa.int64())], names=["list", "row", "n"])


def _is_link(overlap, n, m):
    return DENOMINATOR * overlap >= NUMERATOR * (n + m - overlap)


def _sets_of(column) -> list[np.ndarray]:
    """The hashes of each row, without a copy."""
    return [np.frombuffer(x.as_buffer(), dtype="<u8") for x in column]


def _verified(batches):
    for b in batches:
        u, v, n, m = (b.column(i).to_pylist() for i in range(4))
        pivot, y, keep = None, None, []
        for i in range(len(u)):
            if v[i] != pivot:
                pivot, y = v[i], np.sort(np.frombuffer(b.column(5)[i].as_buffer(), dtype="<u8"))
            both = np.sort(np.concatenate((np.frombuffer(b.column(4)[i].as_buffer(), dtype="<u8"), y)))
            if _is_link(int((both[1:] == both[:-1]).sum()), n[i], m[i]):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in keep], pa.int64()), pa.array([v[i] for i in keep], pa.int64())], names=["u", "v"])


LINKS = "u long, v long"
SETS_WITH_BITS = "row long, n long, shared binary, df_sum long, bits binary"
UNIT = "list long, i long, j long, row long, n long, component long, side int"


def _bitmap(s: np.ndarray, n: int) -> bytes:
    """The hashes of a set of n as bits, 8 to 16 for each shingle of the set."""
    size = 8 << max(3, (n - 1).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _with_bits(batches):
    for b in batches:
        bits = [_bitmap(s, n) for n, s in zip(b.column(1).to_pylist(), _sets_of(b.column(2)), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bits, pa.binary())], names=[*b.schema.names, "bits"])


def _passing(table: pa.Table):
    """Places of two members of a unit (arrays) that may be links between components, a tile of pairs at a time: a
    bit of one set that the other lacks stands for a shingle that they don't share, which bounds their overlap."""
    n, comp, side, held = (table[c].to_numpy() for c in ("n", "component", "side", "held"))
    bits = _sets_of(table["bits"])
    classes: dict[int, list[int]] = {}
    for i in np.argsort(n, kind="stable").tolist():
        classes.setdefault(len(bits[i]), []).append(i)
    for size, own in classes.items():
        own = np.array(own)
        a = np.stack([bits[i] for i in own])
        for other, factor in ((size, 1), (2 * size, 2)):  # linked sizes are never further apart
            if other not in classes:
                continue
            there = np.array(classes[other])
            b = np.bitwise_or.reduce(np.stack([bits[i] for i in there]).reshape(len(there), factor, size), axis=1)
            wide = max(1, min(len(there), TILE_WORDS // size))
            high = max(1, TILE_WORDS // (size * wide))
            for r in range(0, len(own), high):
                i = own[r : r + high]
                for c in range(0, len(there), wide):
                    j = there[c : c + wide]
                    if DENOMINATOR * n[i[-1]] < NUMERATOR * n[j[0]] or DENOMINATOR * n[j[-1]] < NUMERATOR * n[i[0]]:
                        continue
                    fit = (comp[i][:, None] != comp[j][None, :]) & ((side[i][:, None] != side[j][None, :]) | (side[j] == 2)[None, :])
                    if not fit.any():
                        continue
                    x, y = a[r : r + high, None, :], b[None, c : c + wide, :]
                    most = held[i][:, None] - np.bitwise_count(x & ~y).sum(axis=2, dtype=np.int64)
                    most = np.minimum(most, held[j][None, :] - np.bitwise_count(y & ~x).sum(axis=2, dtype=np.int64))
                    p, q = np.nonzero(fit & _is_link(most, n[i][:, None], n[j][None, :]))
                    if len(p):
                        yield i[p], j[q]


class _Forest(dict):
    """Joined components."""

    def root(self, x: int) -> int:
        while (p := self.get(x, x)) != x:
            self[x] = x = self.get(p, p)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self[max(x, y)] = min(x, y)
        return x != y

    def spanning(self, x: np.ndarray, y: np.ndarray) -> list[int]:
        """Places of pairs of components that join what was apart; each different pair is tried once."""
        low, high = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((high, low))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
        return [k for k in order[new].tolist() if self.join(int(low[k]), int(high[k]))]


def _may_link(batches):
    """Of pairs with their bitmaps, those whose overlap may be enough."""
    for b in batches:
        n, m, h, k = (b.column(c).to_numpy() for c in (2, 3, 4, 5))
        keep = []
        for i, (x, y) in enumerate(zip(b.column(6), b.column(7), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            size = min(len(x), len(y))
            x, y = (np.bitwise_or.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
            most = min(h[i] - int(np.bitwise_count(x & ~y).sum()), k[i] - int(np.bitwise_count(y & ~x).sum()))
            keep.append(bool(_is_link(most, int(n[i]), int(m[i]))))
        yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _links_table(u: list[np.ndarray], v: list[np.ndarray]) -> pa.Table:
    none = np.zeros(0, dtype=np.int64)
    u, v = np.concatenate([none, *u]), np.concatenate([none, *v])
    return pa.table({"u": pa.array(np.maximum(u, v)), "v": pa.array(np.minimum(u, v))})


def _spanned(table: pa.Table) -> pa.Table:
    """Of a unit's pairs that may link components, as many as would join all that they can."""
    row, comp = table["row"].to_numpy(), table["component"].to_numpy()
    forest, u, v = _Forest(), [], []
    for i, j in _passing(table):
        k = forest.spanning(comp[i], comp[j])
        u.append(row[i[k]])
        v.append(row[j[k]])
    return _links_table(u, v)


def _screened(table: pa.Table) -> pa.Table:
    """The members of a unit that may link with another component's."""
    found = np.zeros(table.num_rows, dtype=bool)
    for i, j in _passing(table):
        found[i] = True
        found[j] = True
    return table.select(["list", "i", "j", "row", "n", "component", "side"]).filter(pa.array(found))


def _compared(table: pa.Table) -> pa.Table:
    """Links between different components among the members of one list (sides i and j of a block pair): a
    spanning set of them is enough."""
    row, n, comp, side = (table[c].to_numpy() for c in ("row", "n", "component", "side"))
    sets = _sets_of(table["shared"])
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    of = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    terms = np.concatenate([np.zeros(0, dtype=np.uint64), *sets])
    order = np.argsort(terms)
    s = terms[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    size = np.diff(np.append(np.flatnonzero(new), len(s)))
    shared = np.repeat(size > 1, size)  # a term of one member adds to no overlap
    of, term = of[order[shared]], np.repeat(np.arange((size > 1).sum()), size[size > 1])
    overlap = np.zeros((len(left), len(right)), dtype=np.float32)
    for start in range(0, int(term[-1]) + 1 if len(term) else 0, TILE_TERMS):
        i, j = np.searchsorted(term, (start, start + TILE_TERMS))
        m = np.zeros((len(sets), TILE_TERMS), dtype=np.float32)
        m[of[i:j], term[i:j] - start] = 1
        overlap += m[left] @ m[right].T
    forest, u, v = _Forest(), [], []
    for k in range(len(left)):
        a = left[k]
        b = right[_is_link(overlap[k].astype(np.int64), n[a], n[right]) & (comp[right] != comp[a])]
        k = forest.spanning(np.repeat(comp[a], len(b)), comp[b])
        u.append(np.repeat(row[a], len(k)))
        v.append(row[b[k]])
    return _links_table(u, v)


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs with the columns of v's row in sets (which has one row for each v). A v of many pairs is dealt to as
    many tasks as PIVOT_PAIRS asks for, each with a copy of its row."""
    parts = F.ceil(F.col("count") / PIVOT_PAIRS).cast("long")
    hot = written(pairs.groupBy("v").count().where(F.col("count") > PIVOT_PAIRS).select("v", parts.alias("parts")), "pivots")
    if hot.isEmpty():
        return pairs.join(sets, "v")
    few = pairs.join(hot, "v", "left_anti").join(sets, "v")
    many = pairs.join(hot, "v").withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts"))).drop("parts")
    copies = sets.join(hot, "v").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return few.unionByName(many.join(copies, ["v", "part"]).drop("part"))


def _near_in_size(pairs: DataFrame) -> DataFrame:
    return pairs.where(f"{DENOMINATOR} * least(n, m) >= {NUMERATOR} * greatest(n, m)")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs u, v the links, by their whole sets."""
    s = sets.select("row", "n", "shared")
    ends = _beside(pairs, s.toDF("v", "m", "t")).join(s.toDF("u", "n", "s"), "u")
    return _near_in_size(ends).select("u", "v", "n", "m", "s", "t").mapInArrow(_verified, LINKS)


#: Bytes of a member's hashes and bitmap for each shingle of its set, at most.
SHINGLE_BYTES = 10


def _blocks(members: str, shingles: str):
    return F.expr(f"cast(ceil(greatest(({members}) / {MEMBERS}, ({shingles}) * {SHINGLE_BYTES} / {UNIT_BYTES})) as long)")


def _units(lists: DataFrame, found: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """Members of the lists that hold several components, dealt into pairs of blocks, with bitmaps.

    The members of a list's largest component make blocks of their own, which are paired with others' alone.
    Of lists with the same members one is enough; a list's count, sum and exclusive or of its members' hashes
    tell, so no list is gathered for that.
    """
    member = lists.join(found.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    mark = F.xxhash64("row")
    several = (
        member.groupBy("list", "component")
        .agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"), F.bit_xor(mark).alias("x"), F.sum(F.pmod(mark, F.lit(1 << 40))).alias("y"))
        .groupBy("list")
        .agg(F.count(F.lit(1)).alias("kinds"), F.max(F.struct("k", "s", "component")).alias("most"), F.sum("k").alias("k"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"), F.sum("y").alias("y"))
        .where("kinds > 1")
        .groupBy("k", "x", "y")
        .agg(F.min(F.struct("list", "most", "s")).alias("one"))
        .select("one.list", "k", "one.most.component", _blocks("k - one.most.k", "one.s - one.most.s").alias("others"), _blocks("one.most.k", "one.most.s").alias("mains"))
        .withColumnRenamed("component", "main")
    )
    dealt = join_groups(member, several, ["list"], "k", total)
    is_main = F.col("component") == F.col("main")
    draw = F.xxhash64("row", F.lit(1))
    dealt = dealt.withColumn("own", F.when(is_main, F.col("others") + F.pmod(draw, F.col("mains"))).otherwise(F.pmod(draw, F.col("others"))))
    last = F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).cast("int")
    unit = dealt.select("list", "row", "n", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"))
    return unit.join(sets.select("row", F.expr("cast(octet_length(shared) / 8 as long)").alias("held"), "bits"), "row")


def links(sets: DataFrame) -> DataFrame:
    """node and component of all linked sets. sets: row, n, shared, df_sum, one row for each different set."""
    sets = bucketed(sets.mapInArrow(_with_bits, SETS_WITH_BITS), "class_sets", "row")
    stats = sets.agg(F.sum("df_sum"), F.sum(F.octet_length("shared") / 8)).first()
    total = int(stats[1] or 0)
    light = light_boundary((stats[0] or 0) / (stats[1] or 1))
    lists = written(sets.select("row", "n", "shared").mapInArrow(lambda it: _entries(it, light), "list long, row long, n long"), "lists")
    # every set against the least first member of its lists
    first = lists.groupBy("list").agg(F.min("row").alias("v"), F.count(F.lit(1)).alias("k")).where("k > 1")
    stars = join_groups(lists.select("list", "row"), first, ["list"], "k", total).where("row <> v").groupBy(F.col("row").alias("u")).agg(F.min("v").alias("v"))
    bits = sets.select("row", "n", F.expr("cast(octet_length(shared) / 8 as long)").alias("h"), "bits")
    stars = written(stars, "stars")
    ends = _near_in_size(_beside(stars, bits.toDF("v", "m", "k", "y")).join(bits.toDF("u", "n", "h", "x"), "u"))
    likely = written(ends.select("u", "v", "n", "m", "h", "k", "x", "y").mapInArrow(_may_link, LINKS), "star-pairs")
    near = written(_verify(likely, sets), "star-links")
    discard(stars, likely)
    # pairs that would join the rest, by their bitmaps
    pairs = written(_units(lists, components(near), sets, total).groupBy("list", "i", "j").applyInArrow(_spanned, LINKS).distinct(), "spanning-pairs")
    spans = written(_verify(pairs, sets), "spanning-links")
    near = near.unionByName(spans)
    # where one of those failed, all that may still link, compared exactly
    found = components(near)
    rest = written(_units(lists, found, sets, total).groupBy("list", "i", "j").applyInArrow(_screened, UNIT), "screened")
    more = rest.join(sets.select("row", "shared"), "row").groupBy("list", "i", "j").applyInArrow(_compared, LINKS)
    more = written(more, "list-links")
    out = components(near.unionByName(more))
    discard(sets, lists, pairs, rest)
    return out


def _components_of_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """row, doc_id (NO_KEY for null), n_shingles, component (a row) and component_id of every row of docs."""
    sets = written(document_sets(docs, key, text), "sets")
    total = sets.count()
    classes = written(sets.where("n > 0").groupBy("set_key").agg(F.min("row").alias("first"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("size")), "set-classes")
    # one row for each class that may be linked: its first document's
    mine = sets.where("shared is not null").join(classes.select(F.col("first").alias("row"), F.col("set_key").alias("own")), "row")
    found = written(links(mine.select("row", "n", "shared", "df_sum")), "set-components")
    linked = classes.join(found.withColumnRenamed("node", "first"), "first")
    lowest = linked.groupBy("component").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("kinds"))
    linked = written(join_groups(linked.select("component", "set_key"), lowest, ["component"], "kinds", total).select("set_key", "component", "component_id"), "class-components")
    reach = classes.join(linked, "set_key", "left").select("set_key", "size", F.coalesce("component", "first").alias("component"), F.coalesce("component_id", "low").alias("component_id"))
    rows = sets.select("row", "doc_id", F.col("n").alias("n_shingles"), "set_key")
    together = join_groups(rows.where("set_key is not null"), reach, ["set_key"], "size", total)
    alone = rows.where("set_key is null").withColumns({"component": F.col("row"), "component_id": F.col("doc_id")})
    names = ["row", "doc_id", "n_shingles", "component", "component_id"]
    return together.select(*names).unionByName(alone.select(*names))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id."""
    return _components_of_rows(docs, key, text).select(unkeyed("doc_id"), "n_shingles", unkeyed("component_id"))


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component: that of the least identifier (null last; of equal ones, any one row)."""
    if not has_repeats(docs, key):
        found = written(near_duplicates(docs, key, text), "near-decisions")
        return without(docs, found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)), key)
    row = unused(docs, "row")
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    found = written(near_duplicates(docs, row, text), "near-decisions").withColumnRenamed("doc_id", row)
    ranked = found.join(docs.select(row, keyed(key).alias("_key")), row)
    best = ranked.groupBy("component_id").agg(F.min(F.struct("_key", row)).alias("best"))
    gone = written(found.select(row).join(best.select(F.col(f"best.{row}").alias(row)), row, "left_anti"), "near-gone")
    return without(docs, gone, row).drop(row)
