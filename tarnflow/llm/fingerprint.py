"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is the multiset of its paragraphs: its lines, empty ones among them, and where a line is long, parts of it.  A line is
cut behind words that their own hash chooses (one of PART_WORDS), so that a change moves only the cuts next to it.  Paragraphs
hold all of a text's bytes.  Each paragraph's 64-bit digest goes to one cell in each of three subtables; a cell holds a
count, the sum of its digests and the sum of their checks.  The sketches of two versions subtract cell by cell, and what
is left are the digests in which they differ: cells with a single digest give it away, it is taken out of its other cells, and
so on.  If digests remain that no cell shows alone, both sketches are made anew, GROWTH times as large.

Likeness is the number of paragraphs that two texts share over the number that either has, and is exact: it is
computed from the sketches' sizes and the recovered differences.  The fingerprint that is returned is the sketch of the first
size, behind a digest of the whole text, which tells texts of the same paragraphs in another order apart (their likeness
is 1).  How many cells it took to recover the differences is returned beside each likeness; beyond CELLS, that is not
to be had from the two fingerprints alone.

Documents are compared with the next one, in order of their ids, in one shuffle: ranges of ids go to tasks, the first
document of each range also goes to the task before it.  Only the ranges' bounds reach the driver, one id a task.  Where ids
repeat, documents are numbered first, so that many rows of one id, or without one, are spread over tasks, too.

Defined cases.  A null text is empty; two texts without paragraphs have likeness 1.  Null ids come first.  Rows of the
same id are ordered by a hash of their text.  The next of the last document is the first; a single document is its own next.  An
empty table gives no rows.  Texts of any length are read whole.  Other columns are not part of the result, whatever their
names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._features import PART_BYTES, PART_TEXTS, release_memory
from ._tables import keyed
from ._text import Words, mix64, slice_hashes

PART_WORDS = 4  # words that a part of a line has, on average
CELLS, GROWTH = 24, 4
_SALTS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0))  # one for each subtable
_CHECK = np.uint64(0x082EFA98EC4E6C89)


def paragraphs(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words, and of each paragraph: its text, its first byte and its end in the words' buffer."""
    w = Words(texts)
    chosen = w.hash % np.uint64(PART_WORDS) == 0
    chosen[w.first[1:][w.first[1:] > 0] - 1] = False  # the last word of each text
    lines = np.flatnonzero(w.buf == 10) + 1
    cuts = np.unique(np.concatenate((w.offset, lines, w.start[np.flatnonzero(chosen) + 1])))
    begin, text = cuts[:-1], np.searchsorted(w.offset, cuts[:-1], side="right") - 1
    end = np.minimum(cuts[1:], w.offset[text + 1] - 1)  # without the line end that the buffer has behind each text
    held = end > begin
    return w, text[held], begin[held], end[held]


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The digests of all texts' paragraphs, and which text each is of; the second, third... occurrence of a paragraph within a
    text has a digest of its own."""
    w, text, begin, end = paragraphs(texts)
    out = slice_hashes(memoryview(w.data), begin, end)
    order = np.lexsort((out, text))
    ordered, of = out[order], text[order]
    head = np.flatnonzero(np.concatenate(([True], (ordered[1:] != ordered[:-1]) | (of[1:] != of[:-1])))) if len(out) else np.empty(0, dtype=np.int64)
    nth = np.arange(len(out)) - np.repeat(head, np.diff(np.append(head, len(out))))
    out[order] = np.where(nth > 0, mix64(ordered + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), ordered)
    return out, text


class Sketches:
    """The sketches of several texts, a row for each; cells must be a multiple of three.

    Digests come as one array, with the row of each beside them.
    """

    def __init__(self, keys: np.ndarray, row: np.ndarray, rows: int, cells: int = CELLS):
        self.cells = cells
        self.count = np.zeros((rows, cells), dtype=np.int64)
        self.keys = np.zeros((rows, cells), dtype=np.uint64)
        self.checks = np.zeros((rows, cells), dtype=np.uint64)
        self._add(keys, row, np.ones(len(keys), dtype=np.int64))

    def _add(self, keys: np.ndarray, row: np.ndarray, sign: np.ndarray) -> None:
        width, factor = self.cells // 3, sign.astype(np.uint64)  # -1 wraps around, as the sums do
        checks = mix64(keys ^ _CHECK) * factor
        signed = keys * factor
        for i in range(3):
            at = row * self.cells + (mix64(keys ^ _SALTS[i]) % np.uint64(width)).astype(np.int64) + i * width
            np.add.at(self.count.reshape(-1), at, sign)
            np.add.at(self.keys.reshape(-1), at, signed)
            np.add.at(self.checks.reshape(-1), at, checks)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches.__new__(Sketches)
        out.cells, out.count, out.keys, out.checks = self.cells, self.count - other.count, self.keys - other.keys, self.checks - other.checks
        return out

    def least_difference(self) -> np.ndarray:
        """Of each row of a difference, at least how many digests it holds: each is in one cell of each subtable."""
        return np.abs(self.count).reshape(len(self.count), 3, -1).sum(axis=2).max(axis=1, initial=0)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Empties a difference.  Returns row, digest and sign of what it held, and which rows were recovered whole."""
        rows, found, signs = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
        look = np.flatnonzero(np.abs(self.count.reshape(-1)) == 1)
        while len(look):
            sign = self.count.reshape(-1)[look]
            factor = sign.astype(np.uint64)
            keys = self.keys.reshape(-1)[look] * factor
            pure = mix64(keys ^ _CHECK) * factor == self.checks.reshape(-1)[look]
            if not pure.any():
                break
            row, keys, sign = look[pure] // self.cells, keys[pure], sign[pure]
            by = np.lexsort((keys, row))
            row, keys, sign = row[by], keys[by], sign[by]
            fresh = np.ones(len(row), dtype=bool)
            fresh[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
            row, keys, sign = row[fresh], keys[fresh], sign[fresh]
            self._add(keys, row, -sign)
            rows.append(row)
            found.append(keys)
            signs.append(sign)
            look = np.flatnonzero(np.abs(self.count.reshape(-1)) == 1)
        whole = ~(self.count.any(axis=1) | self.keys.any(axis=1) | self.checks.any(axis=1))
        return np.concatenate(rows), np.concatenate(found), np.concatenate(signs), whole

    def texts(self) -> list[str]:
        """Each sketch as printable text; equal texts have equal sketches."""
        parts = (self.count.astype("<i4"), self.keys.astype("<u8"), self.checks.astype("<u8"))
        return [base64.b64encode(b"".join(p[i].tobytes() for p in parts)).decode() for i in range(len(self.count))]


class Texts:
    """The digests of some texts, and their sketches of the first size."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        self.keys, self.row = digests(raw)
        self.size = np.bincount(self.row, minlength=len(texts))
        self.whole = [xxhash.xxh3_64_intdigest(t) for t in raw]
        self.sketches = Sketches(self.keys, self.row, len(texts))

    def fingerprints(self) -> list[str]:
        """Of each text: the digest of all of it, and its sketch."""
        return [f"{d:016x}:{s}" for d, s in zip(self.whole, self.sketches.texts(), strict=True)]

    def rows(self, which: np.ndarray) -> Texts:
        """Some of the texts, in the order asked for; their digests are not made again."""
        out = Texts.__new__(Texts)
        begin = np.cumsum(self.size) - self.size
        out.size = self.size[which]
        out.whole = [self.whole[i] for i in which.tolist()]
        out.row = np.repeat(np.arange(len(which)), out.size)
        out.keys = self.keys[np.arange(len(out.row)) - np.repeat(np.cumsum(out.size) - out.size, out.size) + begin[which][out.row]]
        out.sketches = Sketches.__new__(Sketches)
        out.sketches.cells, out.sketches.count, out.sketches.keys, out.sketches.checks = self.sketches.cells, self.sketches.count[which], self.sketches.keys[which], self.sketches.checks[which]
        return out

    def grown(self, cells: int) -> Texts:
        out = Texts.__new__(Texts)
        out.size, out.keys, out.row, out.whole = self.size, self.keys, self.row, self.whole
        out.sketches = Sketches(self.keys, self.row, len(self.size), cells)
        return out


def differences(a: Texts, b: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, digest and sign (1: only a has it, -1: only b) of all digests in which rows of a and b differ, recovered from
    their sketches; rows whose sketches can't be peeled are tried again with larger ones.  And of each row, the cells it took."""
    found, which, cells, taken = [], np.arange(len(a.size)), CELLS, np.zeros(len(a.size), dtype=np.int64)
    while len(which):
        left = a.sketches.minus(b.sketches)
        least = left.least_difference()
        # A row with more digests than cells can't be peeled: that failure needs no attempt.
        tried = least <= left.cells
        for table in (left.count, left.keys, left.checks):
            table[~tried] = 0
        row, keys, sign, whole = left.peel()
        good = tried & whole
        taken[which[good]] = cells
        found.append((which[row[good[row]]], keys[good[row]], sign[good[row]]))
        again = np.flatnonzero(~good)
        which, least = which[again], least[again]
        a, b = a.rows(again), b.rows(again)
        cells *= GROWTH
        while len(least) and cells < least.min():
            cells *= GROWTH
        if len(which):
            a, b = a.grown(cells), b.grown(cells)
    none = np.empty(0, dtype=np.int64)
    row, keys, sign = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (none, none.astype(np.uint64), none)
    return row, keys, sign, taken


def likeness(a: Texts, b: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: the paragraphs that both have over those that either has, and the cells it took to tell."""
    row, _, sign, cells = differences(a, b)
    only = np.bincount(row[sign > 0], minlength=len(a.size))
    others = np.bincount(row[sign < 0], minlength=len(a.size))
    either = a.size + others
    return np.where(either > 0, (a.size - only) / np.maximum(either, 1), 1.0), cells


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as much of the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(pairs: list[tuple[int, str, str]]) -> pa.RecordBatch:
    """The result rows of (id, text, following text)."""
    ids, own, following = zip(*pairs, strict=True)
    changed = [edited(t, n) for t, n in zip(own, following, strict=True)]
    # Most following texts are the next pair's own; they are digested once.
    every: dict[str, int] = {}
    for t in (*own, *following):
        every.setdefault(t, len(every))
    texts, changes = Texts(list(every)), Texts(changed)
    release_memory()
    mine = texts.rows(np.array([every[t] for t in own]))
    theirs = texts.rows(np.array([every[t] for t in following]))
    (near_edited, edited_cells), (near_next, next_cells) = likeness(mine, changes), likeness(mine, theirs)
    columns = {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in own], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        "fingerprint": pa.array(mine.fingerprints(), pa.string()),
        "edited_fingerprint": pa.array(changes.fingerprints(), pa.string()),
        "near_edited": pa.array(near_edited, pa.float64()),
        "near_next": pa.array(near_next, pa.float64()),
        "edited_cells": pa.array(edited_cells, pa.int64()),
        "next_cells": pa.array(next_cells, pa.int64()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: its fingerprint, that of its edited text, and their likeness to each other and to the next."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs, id_col, text_col)[0].select("doc", "id", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.agg(F.min("doc"), F.percentile_approx("doc", [i / tasks for i in range(1, tasks)] or [0.5], 10 * tasks)).first()
    least = found[0] if found[0] is not None else 0
    bounds = np.array(sorted({b for b in found[1] or [] if b > least}), dtype=np.int64)  # each is the first document of a range

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["place", "doc", "id", "text", "follows"]
        for batch in batches:
            docs = np.asarray(batch.column(0))
            place = np.searchsorted(bounds, docs, side="right")
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), *batch.columns, pa.array(np.zeros(len(docs)), pa.int32())], names)
            begins = np.flatnonzero(np.isin(docs, np.append(bounds, least)))
            if len(begins):
                before = np.where(docs[begins] == least, len(bounds), place[begins] - 1)
                copies = batch.take(pa.array(begins))
                yield pa.RecordBatch.from_arrays([pa.array(before, pa.int32()), *copies.columns, pa.array(np.ones(len(begins)), pa.int32())], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the document that waits for its next: place, id, text
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for place, doc_id, text, follows in zip(*(batch.column(n).to_pylist() for n in ("place", "id", "text", "follows")), strict=True):
                if waiting is not None:
                    if place != waiting[0]:
                        raise ValueError("a range lacks its following document")
                    held.append((*waiting[1:], text))
                    size += len(text)
                    if size >= PART_BYTES or len(held) >= PART_TEXTS:
                        yield _compared(held)
                        held, size = [], 0
                    waiting = None
                if not follows:
                    waiting = (place, doc_id, text)
        if held:
            yield _compared(held)

    dealt = rows.mapInArrow(deal, "place int, doc long, id long, text string, follows int")
    ordered = dealt.repartitionById(len(bounds) + 1, "place").sortWithinPartitions("place", "follows", "doc")
    return ordered.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_cells long, next_cells long")
