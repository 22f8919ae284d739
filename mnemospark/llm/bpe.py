"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

For every prefix of a byte string there is one token that ends its encoding: the token t for which the pair
(last token of the prefix before t, t) is stable, that is, no merge across the border would come before the
merges that build the two. Encoding keeps that last token for each position. The paths back from the last
few positions (a token's length of them) meet; what lies before the meeting point can no longer change and
is emitted. How far back they can meet is bounded by the merge list: a byte that is appended can only undo
merges along a chain of rules, each of later rank than the one before, and ``sufficient_lookahead`` is the
length in bytes of the longest such chain. So a buffer of that length and one chunk is all that is held. An
automaton over the tokens names, byte by byte, those that end there; the one that is stable is the last token.
Every pre-token, short or long, goes this way; recent ones are remembered.

Texts are first cut into pre-tokens, also in chunks: what a chunk's end could still change waits for the next.

Defined results: a null text is an empty one with no tokens; the text of a special token becomes its id;
repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INF = 1 << 60
CHUNK = 1 << 16
#: Pre-tokens that a generation of the cache holds, and bytes of the longest of them.
CACHE, CACHED_BYTES = 150_000, 256
#: Characters at the end of a chunk that may still join another pre-token.
MARGIN = 3

# The pre-tokenizer's pattern and the byte alphabet of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file."""
    rest = [b for b in range(256) if b not in set(PRINTED)]
    return {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A merge list: its stable pairs, its lookahead, encoding and decoding."""

    def __init__(self, vocab: dict[str, int], merges: list, special: dict[str, int]):
        of = byte_alphabet()
        raw = {tok: bytes(of[c] for c in tok) for tok in vocab}
        self.ids = {raw[t]: i for t, i in vocab.items()}
        self.special = special
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for b, i in self.ids.items():
            self.bytes_of[i] = b
        for s, i in special.items():
            self.bytes_of[i] = s.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: its parts and the rank of its merge
        for r, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair = (vocab[a], vocab[b])
            self.rank.setdefault(pair, r)
            self.made.setdefault(vocab[a + b], (*pair, r))
        self.longest = max(map(len, self.ids))
        self.ending = ahocorasick.Automaton()  # (token, bytes) of all tokens that end at a byte
        for b, i in self.ids.items():
            self.ending.add_word(b.decode("latin-1"), (i, len(b)))
        self.ending.make_automaton()
        self.spines: tuple[dict, dict] = ({}, {})
        self.stable: dict[tuple[int, int], bool] = {}
        self.lookahead = self.sufficient_lookahead()
        self.cache = _Cache(self)
        self.cut = regex.compile(PATTERN)
        self.of_class = [regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", r"\p{White_Space}*", r"[^\p{White_Space}\p{L}\p{N}]*")]
        self.marks = regex.compile("|".join(regex.escape(s) for s in special)) if special else None

    def sufficient_lookahead(self) -> int:
        """Bytes of the longest chain of merges of rising rank that share a part, and two tokens."""
        best: dict[int, int] = {}  # by right part, over the rules of later rank
        most = 0
        for (a, b), _ in sorted(self.rank.items(), key=lambda x: -x[1]):
            chain = len(self.bytes_of[a]) + best.get(a, 0)
            best[b] = max(best.get(b, 0), chain)
            most = max(most, chain)
        return most + 2 * self.longest

    def spine(self, token: int, right: int) -> list[tuple[int, int]]:
        """The parts along one edge of a token, smallest first, each with the rank at which it grows."""
        found = self.spines[right].get(token)
        if found is None:
            found, grows = [(token, INF)], token
            while grows in self.made:
                *parts, r = self.made[grows]
                grows = parts[right]
                found.append((grows, r))
            found.reverse()
            self.spines[right][token] = found
        return found

    def is_stable(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together are encoded as a, b."""
        known = self.stable.get((a, b))
        if known is None:
            known = self._is_stable(a, b)
            if len(self.stable) >= 2 * CACHE:
                self.stable.clear()
            self.stable[a, b] = known
        return known

    def _is_stable(self, a: int, b: int) -> bool:
        left, right, i, j = self.spine(a, 1), self.spine(b, 0), 0, 0
        while True:
            (x, x_grows), (y, y_grows) = left[i], right[j]
            r = self.rank.get((x, y), INF)
            if r < x_grows and r <= y_grows:  # of equal merges the one on the left comes first
                return False
            if x_grows == y_grows == INF:
                return True
            if x_grows <= y_grows:
                i += 1
            else:
                j += 1

    def last_tokens(self, data: bytes, before: int | None = None) -> list[int]:
        """For each prefix of data, the last token of its encoding; before: the token that ends before data.

        None: that prefix's last token begins before data, so no encoding of the whole passes its end.
        """
        stable = self.is_stable
        last: list = [-1 if before is None else before] + [None] * len(data)
        for at, (t, n) in self.ending.iter(data.decode("latin-1")):
            at += 1
            if last[at] is None and (p := last[at - n]) is not None and (p < 0 or stable(p, t)):
                last[at] = t
        return last

    def back(self, last: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        """Tokens of a pre-token that is there as a whole."""
        if len(data) <= self.lookahead:
            return self.back(self.last_tokens(data), len(data))
        step = self.lookahead + CHUNK
        return [i for part in self.encode_stream(data[k : k + step] for k in range(0, len(data), step)) for i in part]

    def encode_stream(self, chunks: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of one pre-token that comes in chunks, as soon as they are stable."""
        held, before = b"", None
        for chunk in chunks:
            held += chunk
            if len(held) <= self.lookahead:
                continue
            last = self.last_tokens(held, before)
            ends = {i for i in range(max(0, len(held) - self.longest + 1), len(held) + 1) if last[i] is not None}
            while len(ends) > 1:  # step the foremost path back until all meet
                top = max(ends)
                ends.remove(top)
                ends.add(max(0, top - len(self.bytes_of[last[top]])))
            if (met := ends.pop()) > 0:
                yield self.back(last, met)
                before, held = last[met], held[met:]
        yield self.back(self.last_tokens(held, before), len(held))

    def _pieces(self, text: str) -> Iterator[list[bytes]]:
        """Packed ids of a text without special tokens, a list for each chunk."""
        buf, at, cut, lookup = "", 0, self.cut, self.cache.__getitem__
        while at < len(text) or buf:
            more = text[at : at + CHUNK]
            at += len(more)
            buf += more
            end = at >= len(text)
            if end:
                found = cut.findall(buf)
                buf = ""
            else:
                found = cut.findall(buf)
                size = 0
                while found and size < MARGIN:
                    size += len(found.pop())
                buf = buf[len(buf) - size :]
            yield list(map(lookup, found))
            if len(buf) >= CHUNK // 2:  # one pre-token fills the chunk: stream it as it comes
                buf, at = yield from self._open(buf, text, at)

    def _open(self, buf: str, text: str, at: int) -> Iterator[list[bytes]]:
        """Stream the pre-token that buf begins with to its end; returns what remains and how far text was read."""
        led = int(buf[0] == " " and not self.of_class[2].fullmatch(buf[1]))  # a blank belongs to the word behind it
        own = next(c for c in self.of_class if c.fullmatch(buf[led]))
        space = own is self.of_class[2]
        state = {"buf": buf, "at": at}

        def chunks():
            state["buf"] = buf[led:]
            if led:
                yield b" "
            while True:
                b = state["buf"]
                n = own.match(b).end()
                done = n < len(b) or state["at"] >= len(text)
                # the last blank of a run belongs to the word behind it, if one follows
                take = n - (space and (n < len(b) or not done))
                yield b[:take].encode()
                state["buf"] = b[take:]
                if done:
                    return
                more = text[state["at"] : state["at"] + CHUNK]
                state["at"] += len(more)
                state["buf"] += more

        for ids in self.encode_stream(chunks()):
            yield [np.array(ids, dtype="<u4").tobytes()]
        return state["buf"], state["at"]

    def encode_packed(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian 32-bit integers, in pieces as they become stable."""
        at = 0
        for m in self.marks.finditer(text) if self.marks else ():
            for piece in self._pieces(text[at : m.start()]):
                yield b"".join(piece)
            yield np.array([self.special[m[0]]], dtype="<u4").tobytes()
            at = m.end()
        for piece in self._pieces(text[at:] if at else text):
            yield b"".join(piece)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.encode_packed(text)), dtype="<u4").tolist()

    def decoder(self) -> Decoder:
        return Decoder(self.bytes_of)

    def decode(self, ids: list[int]) -> str:
        d = self.decoder()
        return d.feed(ids) + d.end()


class _Cache(dict):
    """Packed ids of pre-tokens, in two generations: a full one becomes the older, which is forgotten next time."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = np.array(self.codec.encode_piece(piece.encode()), dtype="<u4").tobytes()
        if 4 * len(piece) <= CACHED_BYTES:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Decoder:
    """Ids to text as they come: bytes of an unfinished character wait for the next ids."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of, self.state = bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def end(self) -> str:
        return self.state.decode(b"", True)


@functools.lru_cache(maxsize=4)
def read_codec(path: str) -> tuple:
    """What a Codec is made of, from a tokenizer file with a byte-level BPE model."""
    with open(path, encoding="utf-8") as f:
        x = json.load(f)
    return x["model"]["vocab"], x["model"]["merges"], {t["content"]: t["id"] for t in x["added_tokens"]}


_CODECS: dict[str, Codec] = {}


def _rows(batches, shared, name: str, texts: bool):
    codec = _CODECS.get(name)
    if codec is None:  # once for each Python worker
        codec = _CODECS[name] = Codec(*shared.value)
    for b in batches:
        out = []
        for text in b.column(1):
            t = text.as_py() or ""
            ids_hash, text_hash, n, state, said = hashlib.sha256(), hashlib.sha256(), 0, codec.decoder(), []
            for packed in codec.encode_packed(t):
                ids_hash.update(packed)
                n += len(packed) // 4
                s = state.feed(np.frombuffer(packed, dtype="<u4").tolist())
                text_hash.update(s.encode())
                if texts:
                    said.append(s)
            s = state.end()
            text_hash.update(s.encode())
            out.append((n, ids_hash.hexdigest(), text_hash.hexdigest(), "".join([*said, s]) if texts else None))
        n, ids, decoded, said = map(list, zip(*out, strict=True)) if out else ([], [], [], [])
        cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
        names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
        if texts:
            cols, names = [*cols, pa.array(said, pa.string())], [*names, "decoded"]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """Encode and decode every text: key, n_tokens, ids_sha256, decoded_sha256, and decoded if texts is set.

    The vocabulary (a file of fixed size, named by path) is broadcast; documents are not shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_codec(path))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded string" * texts
    rows = docs.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(lambda it: _rows(it, shared, path, texts), schema).withColumnRenamed("key", key)
