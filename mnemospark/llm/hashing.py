"""Hashes of words: 64 bits, mixed without a linear structure, eight bytes at a time.

Words of the same length up to eight bytes never collide; others do as random numbers would. Long words go through
BLAKE2b. Words are maximal runs outside white space, A-Z in lower case.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np

from .common import mix64

#: Bytes of text that are hashed at once.
HASHED_BYTES = 1 << 20
#: Longer words are hashed one by one.
LONG_WORD = 64

BLANK_BYTES = bytes([0x20, *range(0x09, 0x0E)])
_blank = np.zeros(256, dtype=bool)
_blank[list(BLANK_BYTES)] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_masks = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_next_blank = re.compile(b"[" + re.escape(BLANK_BYTES) + b"]")
_odd = np.uint64(0x9E3779B97F4A7C15)


def pieces(texts: list[bytes]) -> Iterator[tuple[list[bytes], int]]:
    """Parts of the texts of about HASHED_BYTES, cut between words, and the number of the first part's text."""
    group, size, first = [], 0, 0
    for n, t in enumerate(texts):
        if group and size + len(t) > HASHED_BYTES:
            yield group, first
            group, size = [], 0
        if len(t) <= HASHED_BYTES:
            first = first if group else n
            group.append(t)
            size += len(t) + 1
            continue
        at = 0
        while at < len(t):
            found = _next_blank.search(t, at + HASHED_BYTES)
            end = found.start() if found else len(t)
            yield [t[at:end]], n
            at = end
    if group:
        yield group, first


def _hashed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b" ".join([b"", *parts, b" " * 8]), dtype=np.uint8)
    blank = _blank[raw]
    edges = np.flatnonzero(blank[:-1] != blank[1:])
    starts, size = edges[0::2] + 1, edges[1::2] - edges[0::2]
    low = _lower[raw]
    eight = np.ndarray((len(low) - 7,), dtype="<u8", buffer=low, strides=(1,))
    h = mix64(size.astype(np.uint64) * _odd) ^ (eight[starts] & _masks[np.minimum(size, 8)])
    h = mix64(h * _odd)
    more, done = np.flatnonzero(size > 8), 8
    while len(more) and done < LONG_WORD:
        rest = np.minimum(size[more] - done, 8)
        h[more] = mix64((h[more] ^ (eight[starts[more] + done] & _masks[rest])) * _odd + np.uint64(done))
        done += 8
        more = more[size[more] > done]
    for i in more.tolist():
        word = low[starts[i] : starts[i] + size[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    borders = np.cumsum([0] + [len(p) + 1 for p in parts])
    return h, np.diff(np.searchsorted(starts, borders + 1))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of every text, in order, and each text's number of words."""
    found, counts = [np.zeros(0, dtype=np.uint64)], np.zeros(len(texts), dtype=np.int64)
    for parts, first in pieces(texts):
        h, n = _hashed(parts)
        found.append(h)
        counts[first : first + len(n)] += n
    return np.concatenate(found), counts
