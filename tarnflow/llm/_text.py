"""Vectorised text primitives shared by the corpus operators.

Everything here works on one Arrow batch at a time, in numpy, on UTF-8 bytes.  Words are maximal
runs of bytes other than the six ASCII blanks (space, tab, newline, vertical tab, form feed, return),
the same runs that ``bytes.split()`` yields.
"""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)  # the bytes of a word among eight
_LONG_WORD = 64  # bytes; longer words are hashed one by one


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays, so that all bits of a hash are usable."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n + 1 of each."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        tables = []
        for base in (_BASE, _BASE_INV):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            tables.append(np.multiply.accumulate(step))
        _powers[:] = tables
    return _powers[0], _powers[1]


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, by its length and its bytes, eight at a time.

    Every eight bytes are mixed by a bijection of their own before they are added, so words of up to eight bytes and the same
    length never hash alike, and no pattern of repeated letters (as with sums of powers) makes longer ones do so.
    """
    length = end - start
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((buf, np.zeros(8, dtype=np.uint8))), 8)

    def load(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return eight[at].view("<u8").ravel() & _KEEP[np.minimum(left, 8)]

    out = mix64(mix64(load(start, length)) + length.astype(np.uint64) * _BASE)
    rest, at = np.flatnonzero((length > 8) & (length <= _LONG_WORD)), 8
    while len(rest):
        out[rest] = mix64(out[rest] * _GRAM + mix64(load(start[rest] + at, length[rest] - at)))
        at += 8
        rest = rest[length[rest] > at]
    for i in np.flatnonzero(length > _LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[start[i] : end[i]])
    return out


class Words:
    """The words of a batch of texts.

    ``buf`` holds the texts, each followed by a newline; ``start``/``end`` are byte offsets of the words in it,
    ``first[d]:first[d + 1]`` are the words of text d, and ``hash`` is a 64-bit hash of each word.
    """

    def __init__(self, texts: list[bytes], fold: bool = False):
        self.data = b"\n".join(texts) + b"\n"
        self.buf = buf = np.frombuffer(self.data, dtype=np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offset = np.concatenate(([0], np.cumsum(lengths)))
        blank = _BLANK[buf]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(buf) and not blank[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.offset)
        if fold:
            buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
        self.hash = word_hashes(buf, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)


def grams(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k symbols; one for each start, so k - 1 fewer than symbols."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(31))) * _GRAM + symbols[j : j + n]
    return mix64(out)


def byte_grams(buf: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k bytes, in time that does not depend on k: sums of powers, good for choosing where texts meet,
    not for telling whether they are equal."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    power, inverse = _power_tables(len(buf))
    sums = np.empty(len(buf) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=sums[1:])
    return mix64((sums[k:] - sums[:n]) * inverse[:n])


def window_anchor(gram_hash: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams, the index of the one whose hash is least in its upper half (the first of equals).

    Equal windows choose the gram at the same place, wherever they stand: the choice depends on what is in the
    window alone.
    """
    n = len(gram_hash)
    if n < width:
        return np.empty(0, dtype=np.int64)
    if n >> 32:
        raise ValueError("a batch of texts has over 2**32 symbols")
    low = np.uint64((1 << 32) - 1)
    least = (gram_hash & ~low) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if rest := width - span:
        least = np.minimum(least[:-rest], least[rest:])
    return (least & low).astype(np.int64)


def slice_hashes(data: memoryview, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the content of each slice."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), dtype=np.uint64, count=len(start))
