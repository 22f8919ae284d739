"""Language-model scores from a probabilistic suffix tree over words.

A context is up to DEPTH words. Candidates are the word sequences that training texts hold LEAST times or more,
found level by level: a sequence counts only if both its shorter halves were found, which drops none. LEAST is
the same for every input, so the tree grows with the corpus. A context is retained if its next-word distribution
diverges from that of the longest retained context it ends with by more than DIVERGENCE (nats times its count).
A retained context keeps the next words that were found behind it and spreads the rest of its mass, smoothed by
the number of those words (Witten-Bell), as the next shorter retained context does; the empty context has the
words' own shares. Words that were never seen are one symbol, with the mass that Good and Turing give to the
unseen (words seen once, by all tokens). A text is scored in the state of the longest retained suffix before
each word and its end.

Documents are read once, in blocks: each block's distinct words and their counts go, packed, to hash shards and
back, and its tokens (numbers of its words) wait in the shared folder, in buckets by block. The tree is never in
one place: for each length a block sends its distinct sequences to hash shards, which answer with their counts in
all training texts and name one block that speaks for each; then it sends its contexts, with the sums over the
sequences it speaks for, and the shards answer which are retained. Nothing is broadcast. A text longer than a
block is cut into parts, each with the DEPTH tokens before it. Words are told apart by a 64-bit hash,
sequences by their shard (SHARD_TOKENS tokens, about) and 48 bits more: of a shard's sequences one in 10**8 shares its
count with another.

Defined results: every row is a document of its own, whatever its identifier; a null or empty text is one end; repeated rows count as often as they occur; an empty table
gives an empty result; where nothing is learned every word is unseen with probability one half; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, crc_fold, discard, keyed, mix64, unkeyed, written
from .hashing import word_hashes
from .jaccard import PLACE

DEPTH = 3
#: Times that training texts must hold a sequence, whatever the input.
LEAST = 2
#: Count times Kullback-Leibler divergence (nats) from the shorter context.
DIVERGENCE = 12.0
SHARD_ENTRIES = 600_000
#: Text bytes that are read for a block.
BLOCK_BYTES = 2_000_000
#: Tokens of one block; a longer text goes in parts.
BLOCK_TOKENS = 400_000
#: Bytes of a sequence's key beside its shard.
KEY_BYTES = 6
#: Tokens for each shard of sequences.
SHARD_TOKENS = 1_000_000
#: The hash that stands for the end of a text, and for its beginning as a context.
END = np.uint64(0)

PARTS = "block long, a binary, b binary, c binary, d binary, e binary"
PARTS_SCHEMA = pa.schema([("block", pa.int64()), *((n, pa.binary()) for n in "abcde")])
#: What blocks tell shards: sequences of n words (kind n) or contexts before an n-th word (kind -n).
TOLD = "kind int, shard int, block long, a binary, b binary, c binary, d binary"
TOLD_SCHEMA = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), *((n, pa.binary()) for n in "abcd")])
#: What a block is told: beside its own row (kind 0) and its words' counts (kind 1), the answers to what it told.
REPLY = "block long, kind int, shard int, a binary"
REPLY_SCHEMA = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("a", pa.binary())])
PACKS = "shard int, block long, a binary, b binary"
PACKS_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema = PARTS_SCHEMA) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of x as they first occur, and for each place which it has."""
    which, values = pd.factorize(x)
    return values, which


def _firsts(which: np.ndarray, n: int) -> np.ndarray:
    """The first place of each of n values."""
    first = np.empty(n, dtype=np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    return first


def _parts(words: np.ndarray, counts: np.ndarray, tokens: int):
    """Texts as entries of a block: (text, words before it, words, end?). A text of more words than ``tokens`` is
    several, each with up to DEPTH words of the one before it."""
    at = 0
    for n, size in enumerate(counts.tolist()):
        for i in range(0, max(size, 1), tokens):
            lead, stop = min(i, DEPTH), min(size, i + tokens)
            yield n, lead, words[at + i - lead : at + stop], stop == size
        at += size


def _blocks(batches):
    """Blocks of documents: rows, doc_ids, token counts, words that come before (a); whether each is learned from (b);
    tokens (c, 16 low bits and 16 high), the hashes of its words (d) and their training counts (e)."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 24
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        lengths, start = pc.binary_length(batch.column(1)).to_numpy(), 0
        while start < len(ids):
            end, size = start, 0
            while end < len(ids) and (not size or size + lengths[end] <= BLOCK_BYTES):
                size += lengths[end] + 1
                end += 1
            words, counts = word_hashes(batch.column(1).slice(start, end - start).to_pylist())
            entries, tokens = [], 0
            for n, lead, own, ended in _parts(words, counts, BLOCK_TOKENS):
                entries.append((row + n, ids[start + n], lead, own, ended, train[start + n]))
                tokens += len(own) + 1
                if tokens >= BLOCK_TOKENS:
                    yield _packed(entries, block)
                    entries, tokens, block = [], 0, block + 1
            if entries:
                yield _packed(entries, block)
                block += 1
            row += end - start
            start = end


def _packed(entries: list[tuple], block: int) -> pa.RecordBatch:
    rows, ids, lead, words, ended, learned = zip(*entries, strict=True)
    counts = np.array([len(w) for w in words])
    sizes = counts + np.array(ended)
    known, which = _distinct(np.concatenate(words))
    rank = np.argsort(-np.bincount(which, minlength=len(known)), kind="stable")
    of = np.empty(len(rank), dtype=np.int64)
    of[rank] = np.arange(1, len(rank) + 1)  # word 0 is the end
    known = np.concatenate((np.array([END]), known[rank]))
    stream = np.zeros(sizes.sum(), dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    stream[np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)] = of[which]
    meta = np.stack([np.array(x, dtype="<i8") for x in (rows, ids, sizes, lead)])
    x = Block(meta.tobytes(), np.array(learned, dtype="u1").tobytes(), _token_bytes(stream), known.tobytes())
    learn = np.bincount(stream, weights=x.learned_here(), minlength=len(known))
    return _table([(block, meta.tobytes(), np.array(learned, dtype="u1").tobytes(), _token_bytes(stream), known.tobytes(), learn.astype("<u4").tobytes())])


def _token_bytes(stream: np.ndarray) -> bytes:
    return (stream & 0xFFFF).astype("<u2").tobytes() + (stream >> 16).astype("<u2").tobytes()


def _packs(batches, bits: int):
    """A block's words (a) in each shard and their training counts (b)."""
    for b in batches:
        for block, known, learn in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            known, learn = np.frombuffer(known, "<u8"), np.frombuffer(learn, "<u4")
            yield _table([(s, block, known[o].tobytes(), learn[o].tobytes()) for s, o in _dealt(known, bits)], PACKS_SCHEMA)


def _dealt(keys: np.ndarray, bits: int, late: np.ndarray | None = None):
    """Shards by the keys' high bits, each with the places of its keys, in order; those that are late come last."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.uint32)
    shard = shard if late is None else 2 * shard + late
    order = np.argsort(shard.astype(np.uint16) if 2 << bits <= 1 << 16 else shard, kind="stable")
    if not len(order):
        return
    shard = shard[order] if late is None else shard[order] >> 1
    at = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1))
    for i, j in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
        yield int(shard[i]), order[i:j]


class Block:
    """A block's tokens again, from its row."""

    def __init__(self, a: bytes, b: bytes, c: bytes, d: bytes):
        self.rows, self.ids, self.sizes, self.lead = np.frombuffer(a, "<i8").reshape(4, -1)
        self.learned = np.frombuffer(b, "u1").astype(bool)
        n = int(self.sizes.sum())
        low, high = np.frombuffer(c, "<u2").reshape(2, n)
        self.stream = low.astype(np.int64) | high.astype(np.int64) << 16
        self.known = np.frombuffer(d, "<u8")

    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def learned_here(self) -> np.ndarray:
        """Whether each token is learned from, here and not in the part before."""
        out = np.repeat(self.learned, self.sizes)
        for at, n in zip(self.starts()[self.lead > 0].tolist(), self.lead[self.lead > 0].tolist(), strict=True):
            out[at : at + n] = False
        return out


def sequence_keys(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-token sequences that end at the given places; of one token, its hash."""
    if n == 1:
        return h[at]
    x = np.full(len(at), n, dtype=np.uint64)
    for j in range(n):
        x += (h[at - j] + np.uint64(j + 1)) * PLACE[j]
    return mix64(x)


ANSWER = "block long, shard int, a binary, b binary, tokens long, words long, once long"
ANSWER_SCHEMA = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("tokens", pa.int64()), ("words", pa.int64()), ("once", pa.int64())])


def _counted(table: pa.Table) -> pa.Table:
    """A shard's answer: for each block the counts of its words in all training tokens (b), in their order;
    and the shard's totals."""
    shard, block, a, b = (table[n].to_pylist() for n in ("shard", "block", "a", "b"))
    h = np.frombuffer(b"".join(a), dtype="<u8")
    n = np.frombuffer(b"".join(b), dtype="<u4")
    known, which = _distinct(h)
    total = np.bincount(which, weights=n, minlength=len(known)).astype(np.int64)
    cut = np.cumsum([0] + [len(x) // 8 for x in a])
    rows = [(block[i], shard[i], None, _planes(total[which[cut[i] : cut[i + 1]]]), 0, 0, 0) for i in range(len(block))]
    rows.append((None, shard[0], None, None, int(total.sum()), int((total > 0).sum()), int((total == 1).sum())))
    return pa.Table.from_batches([_table(rows, ANSWER_SCHEMA)])


def _by(which: np.ndarray, n: int, of: np.ndarray) -> np.ndarray:
    return np.bincount(which, weights=of, minlength=n)


def retained(total: np.ndarray, kinds: np.ndarray, kept: np.ndarray, low: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Whether each context is retained. total: its count; of the sequences found that begin with it, kinds: how
    many, kept: their counts, low: what the shorter context gives their last words, gain: n (ln n - ln low)."""
    left, t = total - kept, np.maximum(total, 1)
    others = np.clip(1 - low, 1e-9, 1)
    gain = gain - kept * np.log(t) + np.where(left > 0, left * (np.log(np.maximum(left, 1) / t) - np.log(others)), 0)
    return (kinds > 0) & (gain > DIVERGENCE)


def mass_left(total: np.ndarray, kinds: np.ndarray, kept: np.ndarray) -> np.ndarray:
    return np.log((total - kept + kinds) / (total + kinds))


def smoothed(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, mass: np.ndarray, low: np.ndarray) -> np.ndarray:
    """ln P of the last words of sequences behind their retained contexts."""
    return np.logaddexp(np.log(n / (total + kinds)), mass + low)


class Walk:
    """A block's tokens, length by length: of the sequence of each length that ends at each token the count (0 if
    it wasn't found), and ln P of each token behind the contexts so far."""

    def __init__(self, block: Block, words: np.ndarray | None = None, root: np.ndarray | None = None):
        """words, root: of each of the block's words the count and ln P in the empty context, once known."""
        self.block, self.n = block, 1
        self.tokens = np.concatenate(([0], block.stream))  # with the beginning before the first text
        self.h, self.ends = block.known[self.tokens], self.tokens == 0
        self.learned = np.concatenate(([False], block.learned_here()))
        self.count = None if words is None else np.where(words >= LEAST, words, 0)[self.tokens]
        self.codes, self.keys = self.tokens, block.known  # of the sequence that ends at each token: its number among the keys
        self.logs = None if root is None else root[self.tokens]

    def step(self) -> np.ndarray:
        """Keys of the block's distinct sequences of the next length whose halves were found; at length 2, where
        they are asked for before words are counted, all."""
        self.n += 1
        whole = np.arange(len(self.tokens)) >= self.n - 1
        if self.n > 2:
            whole[1:] &= (self.count[1:] > 0) & (self.count[:-1] > 0) & ~self.ends[:-1]  # a beginning may only come first
        self.at = np.flatnonzero(whole)
        self.shorter = self.codes, self.keys
        self.keys, self.which = _distinct(sequence_keys(self.h, self.at, self.n))
        self.codes = np.zeros(len(self.tokens), dtype=np.int64)
        self.codes[self.at] = self.which
        self.first = _firsts(self.which, len(self.keys))
        return self.keys

    def own_counts(self) -> np.ndarray:
        return np.bincount(self.which, weights=self.learned[self.at], minlength=len(self.keys)).astype("<i8")

    def counted(self, answer: np.ndarray):
        """answer: of each sequence twice the count, and one more where this block speaks for it."""
        self.found, self.speaks = answer >> 1, (answer & 1).astype(bool)
        self.before = self.count
        self.count = np.zeros(len(self.tokens), dtype=np.int64)
        self.count[self.at] = self.found[self.which]

    def contexts(self) -> np.ndarray:
        """Keys of the block's distinct contexts that were found."""
        there = np.arange(len(self.tokens)) >= self.n - 1
        there[1:] &= self.before[:-1] > 0
        if self.n > 2:
            there[1:] &= ~self.ends[:-1]
        self.behind = np.flatnonzero(there)
        codes, keys = self.shorter
        own = codes[self.behind - 1]
        used = np.zeros(len(keys), dtype=bool)
        used[own] = True
        self.names, self.name = keys[used], (np.cumsum(used) - 1)[own]
        self.name_at = np.zeros(len(self.tokens), dtype=np.int64)
        self.name_at[self.behind] = self.name
        self.total = np.zeros(len(self.names), dtype=np.int64)
        self.total[self.name] = self.before[self.behind - 1]
        return self.names

    def silent(self) -> np.ndarray:
        """Whether each context is one for which this block speaks for no sequence."""
        spoken = np.zeros(len(self.names), dtype=bool)
        spoken[self.name_at[self.at[self.first[self.speaks & (self.found > 0)]]]] = True
        return ~spoken

    def sums(self) -> tuple[np.ndarray, ...]:
        """Of each context the sums over the found sequences that this block speaks for, as ``retained`` has them."""
        speaks = self.speaks & (self.found > 0)
        at, n, size = self.at[self.first[speaks]], self.found[speaks], len(self.names)
        of = self.name_at[at]
        low = self.logs[at]
        return _by(of, size, None), _by(of, size, n), _by(of, size, np.exp(low)), _by(of, size, n * (np.log(np.maximum(n, 1)) - low))

    def judged(self, kinds: np.ndarray, kept: np.ndarray):
        """kinds, kept: of each context, kinds 0 where it is not retained."""
        mass = mass_left(self.total, kinds, kept)
        low = self.logs
        self.logs = low.copy()
        on = kinds[self.name] > 0
        at, name = self.behind[on], self.name[on]
        self.logs[at] += mass[name]
        hit = self.count[at] > 0
        at, name = at[hit], name[hit]
        self.logs[at] = smoothed(self.count[at], self.total[name], kinds[name], mass[name], low[at])


def _short(keys: np.ndarray, bits: int) -> bytes:
    """The 48 bits of keys that follow those which name their shard: enough for the sequences of one shard."""
    return ((keys << np.uint64(bits)) >> np.uint64(16)).astype("<u8").view("u1").reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _long(short: bytes) -> np.ndarray:
    out = np.zeros((len(short) // KEY_BYTES, 8), dtype="u1")
    out[:, :KEY_BYTES] = np.frombuffer(short, "u1").reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first, compressed: small ones leave planes of zeros."""
    raw = np.ascontiguousarray(x, dtype="<i8").reshape(-1, 1).view("u1").T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _numbers(planes: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(planes)
    return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(8, -1).T).view("<i8").ravel()


def _told_keys(walk: Walk, block: int, bits: int) -> list[tuple]:
    keys = walk.step()
    own = walk.own_counts()
    return [(walk.n, s, block, _short(keys[o], bits), _planes(own[o]), None, None) for s, o in _dealt(keys, bits)]


def _told_contexts(walk: Walk, block: int, bits: int) -> list[tuple]:
    """All contexts by name, first those that this block has sums for."""
    names = walk.contexts()
    silent = walk.silent()
    kinds, kept, low, gain = walk.sums()
    counts = np.stack((walk.total, kinds.astype("<i8"), kept.astype("<i8")))
    reals = np.stack((low, gain))
    rows = []
    for s, o in _dealt(names, bits, silent):
        said = o[~silent[o]]
        rows.append((-walk.n, s, block, _short(names[o], bits), _planes(counts[:, said]), reals[:, said].tobytes(), None))
    return rows


def _pairs(batches, bits: int):
    """The two-word sequences of blocks."""
    for b in batches:
        for row in zip(*(b.column(i) for i in range(5)), strict=True):
            block, *parts = (x.as_py() for x in row)
            yield _table(_told_keys(Walk(Block(*parts)), block, bits), TOLD_SCHEMA)


def _answered(table: pa.Table) -> pa.Table:
    """A shard's answers to the blocks, in the order of what each told."""
    kind, shard, block = (table[n].to_pylist() for n in ("kind", "shard", "block"))
    a, b, c = (table[n].to_pylist() for n in "abc")
    keys, which = _distinct(_long(b"".join(a)))
    cut = np.cumsum([0] + [len(x) // KEY_BYTES for x in a])
    if kind[0] > 0:
        n = _by(which, len(keys), np.concatenate([_numbers(x) for x in b])).astype("<i8")
        answer = np.where(n >= LEAST, n, 0)[which] * 2
        answer[_firsts(which, len(keys))] += 1
        out = [_planes(answer[i:j]) for i, j in zip(cut, cut[1:])]
    else:
        counts = np.concatenate([_numbers(x).reshape(3, -1) for x in b], axis=1)
        reals = np.concatenate([np.frombuffer(x, "<f8").reshape(2, -1) for x in c], axis=1)
        said = np.concatenate([which[i : i + len(x) // 16] for i, x in zip(cut, c)])
        total = np.zeros(len(keys), dtype=np.int64)
        total[said] = counts[0]
        kinds, kept, low, gain = (_by(said, len(keys), x) for x in (counts[1], counts[2], reals[0], reals[1]))
        answer = (np.stack((kinds, kept)) * retained(total, kinds, kept, low, gain)).astype("<i8")[:, which]
        out = [_planes(answer[:, i:j]) for i, j in zip(cut, cut[1:])]
    return pa.Table.from_batches([_table(list(zip(block, kind, shard, out, strict=True)), REPLY_SCHEMA)])


class Replies:
    """The shards' answers to one block, by kind."""

    def __init__(self, table: pa.Table, bits: int, key_bits: int):
        self.bits, self.key_bits = bits, key_bits
        self.by: dict[int, dict[int, bytes]] = {}
        for k, s, a in zip(*(table[n].to_pylist() for n in ("kind", "shard", "a")), strict=True):
            self.by.setdefault(k, {})[s] = a

    def of(self, kind: int, keys: np.ndarray, late: np.ndarray | None = None) -> np.ndarray:
        """The answers to the keys: one number each to words and sequences, two to contexts."""
        out = np.zeros((2 if kind < 0 else 1, len(keys)), dtype=np.int64)
        for s, o in _dealt(keys, self.bits if kind == 1 else self.key_bits, late):
            out[:, o] = _numbers(self.by[kind][s]).reshape(len(out), -1)
        return out


def _walked(parts: pa.Table, replies: Replies, tokens: int, unseen: float) -> tuple[int, Walk, np.ndarray]:
    """A block, the walk at its start and its words' counts."""
    x = Block(*(parts[n][0].as_py() for n in "abcd"))
    count = replies.of(1, x.known)[0]
    root = np.where(count > 0, np.log((1 - unseen) * np.maximum(count, 1) / max(tokens, 1)), np.log(unseen))
    return parts["block"][0].as_py(), Walk(x, count, root), count


def _walk_to(walk: Walk, replies: Replies, n: int, judged: bool):
    """Walk to the sequences of n words, which were counted; judged: whether their contexts are known too."""
    while walk.n < n:
        walk.step()
        walk.counted(replies.of(walk.n, walk.keys)[0])
        if walk.n < n or judged:
            walk.contexts()
            walk.judged(*replies.of(-walk.n, walk.names, walk.silent()))


def _onward(n: int, bits: int, key_bits: int, tokens: int, unseen: float):
    """What a block tells once its sequences of n words were counted: their contexts and the next longer ones."""

    def told(parts: pa.Table, table: pa.Table) -> pa.Table:
        replies = Replies(table, bits, key_bits)
        block, walk, _ = _walked(parts, replies, tokens, unseen)
        _walk_to(walk, replies, n, False)
        rows = _told_contexts(walk, block, key_bits)
        if n <= DEPTH:
            rows += _told_keys(walk, block, key_bits)
        return pa.Table.from_batches([_table(rows, TOLD_SCHEMA)])

    return told


class SuffixTree:
    """The same tree in one place, for a few sequences: retained contexts of each length with the logarithm of the
    mass they leave to shorter ones, and the smoothed log probabilities of the words kept behind them. All keys are
    sorted."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, unseen: float, levels: list[tuple[np.ndarray, ...]]):
        """words, counts: the words found. levels: by length from 2 on, the sequences' sorted keys, counts, keys of
        all but the last word and of all but the first."""
        self.words = words
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        self.entries: list[tuple[np.ndarray, np.ndarray]] = []
        total_keys, totals = words, counts.astype(float)
        below = (words, np.log((1 - unseen) * np.maximum(counts, 1) / max(tokens, 1)))  # of sequences one shorter
        for keys, n, context, rest in levels:
            if not len(keys):
                self.contexts.append((keys, np.zeros(0)))
                self.entries.append((keys, np.zeros(0)))
                below, total_keys, totals = (keys, np.zeros(0)), keys, np.zeros(0)
                continue
            names, which = np.unique(context, return_inverse=True)
            total = totals[np.minimum(np.searchsorted(total_keys, names), len(total_keys) - 1)] if len(total_keys) else np.zeros(0)
            kinds = np.bincount(which, minlength=len(names))
            kept = np.bincount(which, weights=n, minlength=len(names))
            # what the context one shorter says of the same words: rest is the same sequence without its first token
            low = below[1][np.searchsorted(below[0], rest)] if len(rest) else np.zeros(0)
            keep = retained(total, kinds, kept, _by(which, len(names), np.exp(low)), _by(which, len(names), n * (np.log(n) - low)))
            mass = mass_left(total, kinds, kept)
            logs = smoothed(n, total[which], kinds[which], mass[which], low)
            self.contexts.append((names[keep], mass[keep]))
            self.entries.append((keys[keep[which]], logs[keep[which]]))
            # a context that is not retained says what the shorter one says
            below = (keys, np.where(keep[which], logs, low))
            total_keys, totals = keys, n.astype(float)


SCORES = "row long, whole boolean, doc_id long, n_tokens long, n_known long, base_score double, score double"


def _scored(parts: pa.Table, table: pa.Table, bits: int, key_bits: int, tokens: int, words: int, unseen: float, depth: int) -> pa.Table:
    """A block's documents (whole, or parts of one) with their scores, from its tokens and the shards' answers."""
    replies = Replies(table, bits, key_bits)
    _, walk, count = _walked(parts, replies, tokens, unseen)
    _walk_to(walk, replies, depth + 1, True)
    x = walk.block
    base = np.log10((count + 0.5) / (tokens + 0.5 * (words + 1)))
    model = walk.logs[1:] / np.log(10)
    at = x.starts() + x.lead
    end = x.starts() + x.sizes
    ended = np.zeros(len(at), dtype=bool)
    some = end > at
    ended[some] = x.stream[end[some] - 1] == 0
    sums = lambda y: (lambda c: c[end] - c[at])(np.concatenate(([0], np.cumsum(y))))
    columns = {"row": x.rows, "whole": ended & (x.lead == 0), "doc_id": x.ids, "n_tokens": end - at, "n_known": sums((count > 0)[x.stream].astype(np.int64))}
    base, model = _sums(base[x.stream], at, end), _sums(model, at, end)
    return pa.table({**{n: pa.array(c) for n, c in columns.items()}, "base_score": pa.array(base), "score": pa.array(model)})


def _sums(x: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The sum of each slice of x, none of which overlap; without the rounding of a running total."""
    if not len(x):
        return np.zeros(len(at))
    edges = np.stack((at, np.minimum(end, len(x) - 1)), axis=1).ravel()
    out = np.add.reduceat(x, np.minimum(edges, len(x) - 1))[::2]
    out = np.where(end > at, out, 0.0)
    last = (end == len(x)) & (end > at)
    # reduceat cannot name the end of x as a border: the last slice goes on to it by itself
    out[last] = [x[i:].sum() for i in at[last]]
    return out


def language_model_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    return _scores(docs, key, text, folds, held, DEPTH)


def base_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, held: int = 1) -> DataFrame:
    """The same rows without score: words are counted as there, but no sequences, which only score needs."""
    return _scores(docs, key, text, folds, held, 0).drop("score")


def _scores(docs: DataFrame, key: str, text: str, folds: int, held: int, depth: int) -> DataFrame:
    """depth: DEPTH, or 0 for a tree of the empty context alone."""
    fold = F.coalesce(crc_fold(key, folds), F.lit(0))
    rows = docs.select(keyed(key), F.coalesce(F.col(text), F.lit("")).cast("binary"), fold != held)
    parts = bucketed(rows.mapInArrow(_blocks, PARTS), "lm_blocks", "block")
    entries, size = (x or 0 for x in parts.agg(F.sum(F.octet_length("e") / 4), F.sum(F.octet_length("c"))).first())
    bits = max(3, int(np.ceil(np.log2(max(1, entries / SHARD_ENTRIES)))))
    packs = parts.select("block", "d", "e").mapInArrow(lambda it: _packs(it, bits), PACKS)
    answers = written(packs.groupBy("shard").applyInArrow(_counted, ANSWER), "lm-counts")
    tokens, words, once = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("words"), F.sum("once")).first())
    unseen = min(0.5, (once + 1) / (tokens + 2))
    key_bits = max(3, int(np.ceil(np.log2(max(1, size / 4 / SHARD_TOKENS)))))
    own = parts.select("block", *"abcd").groupBy("block")
    met = answers.where("block is not null").select("block", F.lit(1).alias("kind"), "shard", F.col("b").alias("a"))
    told = parts.select("block", *"abcd").mapInArrow(lambda it: _pairs(it, key_bits), TOLD)
    done = [answers]
    for n in range(2, depth + 3) if depth else ():
        reply = written(told.groupBy("kind", "shard").applyInArrow(_answered, REPLY), "lm-answers")
        done.append(reply)
        met = met.unionByName(reply)
        if n <= depth + 1:
            told = own.cogroup(met.groupBy("block")).applyInArrow(_onward(n, bits, key_bits, tokens, unseen), TOLD)
    scored = own.cogroup(met.groupBy("block")).applyInArrow(lambda p, t: _scored(p, t, bits, key_bits, tokens, words, unseen, depth), SCORES)
    scored = written(scored, "lm-scores")
    discard(parts, *done)
    names = ["n_tokens", "n_known", "base_score", "score"]
    parted = scored.where("not whole").groupBy("row").agg(F.first("doc_id").alias("doc_id"), *(F.sum(n).alias(n) for n in names))
    scored = scored.where("whole").select("doc_id", *names).unionByName(parted.drop("row")).withColumn("doc_id", unkeyed("doc_id"))
    return scored.select(
        F.col("doc_id").alias(key), (F.coalesce(crc_fold("doc_id", folds), F.lit(0)) == held).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
