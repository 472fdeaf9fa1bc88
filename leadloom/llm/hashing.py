"""Vectorised hashing of words, lines and word windows over a batch of texts.

A batch of texts is laid out as one UTF-8 buffer, one byte of separator after each text.  Words are maximal runs of
bytes outside 0x20 and 0x09-0x0D.  A range of bytes is hashed eight bytes at a time, all ranges at once, so no Python
string is made per word; every step is a bijective mix of the state and the next eight bytes, so ranges of up to eight
bytes and equal length never share a hash.  Ranges over LONG_RANGE bytes are hashed by BLAKE2b.  A hash depends only on
the bytes: it is the same in every process.  Where different bytes must never be taken for equal, `ranges_hash` is asked
for 128 bits.  Memory is about 15 bytes for each byte of a batch, so a text of 100 MB needs some 1.5 GB in its task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

#: Longer ranges are hashed one by one.
LONG_RANGE = 256
#: Bytes of an eight-byte word that belong to a range which ends inside it.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64).copy()
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-dependent hash of two hashes."""
    with np.errstate(over="ignore"):
        return mix(np.asarray(a, np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.asarray(b, np.uint64))


def ranges_hash(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, both: bool = False):
    """The 64-bit hash of buffer[start:end] for each pair of positions; with `both` a second, independent one as well."""
    size = end - start
    seeds = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))[: 1 + both]
    out = [combine(np.full(len(size), seed), size.astype(np.uint64)) for seed in seeds]
    padded = np.append(buffer, np.zeros(8, np.uint8))
    eight = np.ndarray((len(buffer) + 1,), np.dtype("<u8"), padded, 0, (1,))
    now, at = np.arange(len(size)), start
    left = np.where(size > LONG_RANGE, 0, size)
    while True:
        some = np.flatnonzero(left > 0)
        if not len(some):
            break
        if len(some) < len(left):
            now, at, left = now[some], at[some], left[some]
        part = eight[at] & _MASK[np.minimum(left, 8)]
        for h in out:
            h[now] = combine(h[now], part)
        at, left = at + 8, left - 8
    for k in np.flatnonzero(size > LONG_RANGE).tolist():
        found = np.frombuffer(hashlib.blake2b(buffer[start[k] : end[k]].tobytes(), digest_size=16).digest(), "<u8")
        for h, value in zip(out, found):
            h[k] = value
    return tuple(out) if both else out[0]


@dataclass
class Batch:
    """Texts in one buffer: the bytes of text i are buffer[offset[i]:offset[i + 1] - 1]."""

    buffer: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, texts, lower: bool = False) -> "Batch":
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        buffer = np.frombuffer(b"\n".join(raw) + b"\n" if raw else b"", np.uint8)
        return cls(LOWER[buffer] if lower else buffer, np.concatenate([[0], np.cumsum(sizes)]))

    def words(self) -> "Words":
        gap = np.ones(len(self.buffer) + 2, bool)
        gap[1:-1] = IS_SPACE[self.buffer]
        start = np.flatnonzero(gap[:-2] & ~gap[1:-1])
        end = np.flatnonzero(~gap[1:-1] & gap[2:]) + 1
        first = np.searchsorted(start, self.offset)
        return Words(ranges_hash(self.buffer, start, end), start, end, first)


@dataclass
class Words:
    """Words of a batch; those of text i are at first[i]:first[i + 1]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_index(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, position of the first word, text index) of every run of n words inside one text."""
        total = len(self.hash)
        if total < n:
            empty = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), empty, empty
        h = self.hash[: total - n + 1]
        for k in range(1, n):
            h = combine(h, self.hash[k : total - n + 1 + k])
        text = self.text_index()
        at = np.flatnonzero(text[: total - n + 1] == text[n - 1 :])
        return h[at] if n > 1 else h, at, text[at]
