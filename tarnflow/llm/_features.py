"""Hashed n-gram features of texts, a batch at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ._text import Words, mix64

PART_BYTES, PART_TEXTS = 1 << 20, 256  # texts are handled in parts of about this size, which bounds memory


try:
    _malloc_trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library, which has no such call
    _malloc_trim = None


def release_memory() -> None:
    """Gives freed memory back to the system.  Workers live on after a task, and what their allocators hold back counts
    against the executor while the next stage runs."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Consecutive texts, of about PART_BYTES together and PART_TEXTS at most; releases memory after the last."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= PART_BYTES or len(held) >= PART_TEXTS:
            yield held
            held, size = [], 0
    if held:
        yield held
    release_memory()


def character_counts(texts: list[bytes], orders: tuple[int, ...], buckets: int) -> np.ndarray:
    """How often each bucket's runs of bytes occur in each text; a text counts as standing between blanks.

    The length of a run is part of its hash.  Runs do not cross from one text to the next.
    """
    buf = np.frombuffer(b"".join(b" " + t + b" " for t in texts), dtype=np.uint8)
    length = np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), length)
    total = np.zeros(len(texts) * buckets, dtype=np.int64)
    for n in orders:
        code = np.full(max(0, len(buf) - n + 1), n, dtype=np.uint64)
        for j in range(n):
            code = (code << np.uint64(8)) | buf[j : j + len(code)]
        bucket = (mix64(code) % np.uint64(buckets)).astype(np.int64)
        inside = owner[: len(code)] == owner[n - 1 :]
        total += np.bincount((owner[: len(code)] * buckets + bucket)[inside], minlength=len(total))
    return total.reshape(len(texts), buckets)


class SubwordFeatures:
    """The words of some texts, the runs of characters within each word, and the pairs of neighbouring words, as buckets.

    ``bucket[begin[v]:begin[v + 1]]`` are the features of distinct word v: the word itself, then its runs;
    ``word[first[d]:first[d + 1]]`` are the words of text d; ``pair`` is of each word the bucket of the word before it and
    itself, and ``paired`` whether there is one before it in its text.  Words and runs have buckets from 0, pairs from ``buckets``.
    """

    def __init__(self, texts: list[bytes], orders: tuple[int, ...], buckets: int):
        w = Words(texts)
        distinct, at, self.word = np.unique(w.hash, return_index=True, return_inverse=True)
        self.first = w.first
        self.paired = np.ones(len(w), dtype=bool)
        self.paired[w.first[:-1][w.first[:-1] < len(w)]] = False
        before = np.concatenate((w.hash[:1], w.hash[:-1]))
        # The difference of two hashes stands for a pair, so that a word and the same word again is one pair, whatever the word.
        self.pair = buckets + (mix64(w.hash - before) % np.uint64(buckets)).astype(np.int64)
        words = [f"<{w.data[w.start[i] : w.end[i]].decode('utf-8', 'replace')}>" for i in at]
        buf = np.frombuffer("".join(words).encode("utf-32-le", "replace"), dtype="<u4")
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        end = np.cumsum(length)
        owner = np.repeat(np.arange(len(words)), length)
        codes, owners = [mix64(distinct + np.uint64(1))], [np.arange(len(words))]
        for n in orders:
            code = np.full(max(0, len(buf) - n + 1), n, dtype=np.uint64)
            for j in range(n):
                code = mix64(code) + buf[j : j + len(code)]
            own = owner[: len(code)]
            inside = np.flatnonzero(np.arange(len(code)) + n <= end[own]) if len(code) else np.empty(0, dtype=np.int64)
            codes.append(mix64(code[inside]))
            owners.append(own[inside])
        code, own = np.concatenate(codes), np.concatenate(owners)
        order = np.argsort(own, kind="stable")
        self.bucket = (code[order] % np.uint64(buckets)).astype(np.int64)
        self.begin = np.searchsorted(own[order], np.arange(len(words) + 1))
