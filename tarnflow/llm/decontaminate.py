"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as sequences of normalised words (lower case, ASCII punctuation counts as blank).  An item of n words
may differ from a passage by an error budget of n * ERROR_PERCENT // 100 words (edited, missing or extra).  It is cut
into budget + 1 pieces; an error spoils one piece at most, so at least one piece occurs exactly wherever the item does
within its budget.  Documents are searched for the pieces, and around the hits the distance of the whole item is
verified with Myers' bit-parallel algorithm, a bit for each word of the item.  Hits whose surroundings overlap are verified
together, so a text is read at most once for each item that it may hold, however often a piece occurs.

Documents are read once for each block of items, without a shuffle; a block has BLOCK_BYTES of item text at most, which
bounds what is broadcast.  A benchmark of usual size is one block.  If there are several, each block's findings are written and
its broadcast is given up before the next one's.

Defined cases.  Null texts and texts without words hold no items; texts of any length are read whole.  Items without words
match nothing; items whose budget is 0, those of less than 7 words, must match exactly.  Repeated items and documents are each
reported, null ids too.  Of several places where a document holds an item, the one of least distance is reported: the one that
ends first, and of those the shortest.  Empty tables give no findings.  Other columns are no part of the findings, and stay
as they are in what ``clean`` returns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._features import parts
from ._tables import bound_batches, written
from ._text import Words, grams

ERROR_PERCENT = 15
BLOCK_BYTES = 4 << 20
_PUNCTUATION = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def normalise(text: str | None) -> bytes:
    return (text or "").lower().encode().translate(_PUNCTUATION)


def budget(words: int) -> int:
    return words * ERROR_PERCENT // 100


def cut_pieces(words: int, count: int) -> list[tuple[int, int]]:
    """(start, end) of count pieces of about the same length."""
    return [(words * i // count, words * (i + 1) // count) for i in range(count)]


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """The least edit distance between the item and any part of the text, and where the first such part ends (Myers)."""
    places: dict[int, int] = {}
    for i, word in enumerate(item):
        places[word] = places.get(word, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, distance = full, 0, len(item)  # vertical differences of +1 and -1, a bit for each row
    best, end = distance, 0
    for at, word in enumerate(text):
        equal = places.get(word, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        if distance < best:
            best, end = distance, at + 1
    return best, end


def matches(item: list[int], text: list[int], places: list[tuple[int, int]]) -> tuple[int, int, int]:
    """The least distance between the item and a part of the text within one of the places (start, end), and that part's
    start and end: of several the one that ends first, of those the shortest."""
    merged: list[list[int]] = []
    for start, end in sorted(places):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    found = (len(item) + 1, 0, 0)
    for start, end in merged:
        distance, length = best_match(item, text[start:end])
        if distance < found[0]:
            found = (distance, start, start + length)
    distance, start, end = found
    return distance, end - best_match(item[::-1], text[start:end][::-1])[1], end


class Items:
    """Some items, and where their pieces are found: by the hash of a piece's first words.  Items of the same words are one."""

    def __init__(self, items: list[tuple[int, str]]):
        same: dict[tuple[int, ...], list[int]] = {}
        for item_id, text in items:
            same.setdefault(tuple(Words([normalise(text)]).hash.tolist()), []).append(item_id)
        same.pop((), None)
        self.words, self.ids = [list(w) for w in same], list(same.values())
        by_length: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
        for n, words in enumerate(self.words):
            for start, end in cut_pieces(len(words), budget(len(words)) + 1):
                length = min(end - start, 5)
                head = int(grams(np.array(words[start : start + length], dtype=np.uint64), length)[0])
                by_length.setdefault(length, {}).setdefault(head, []).append((n, start, end))
        self.heads = {length: (np.array(sorted(found), dtype=np.uint64), found) for length, found in by_length.items()}

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item's id, distance, first word, end) of the items that texts hold."""
        w = Words(texts)
        hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for length, (heads, found) in self.heads.items():
            runs = grams(w.hash, length)
            at = np.minimum(np.searchsorted(heads, runs), len(heads) - 1)
            for place in np.flatnonzero(heads[at] == runs).tolist():
                text = int(np.searchsorted(w.first, place, side="right")) - 1
                begin, stop = int(w.first[text]), int(w.first[text + 1])
                for n, start, end in found[int(runs[place])]:
                    item = self.words[n]
                    if place + end - start <= stop and w.hash[place : place + end - start].tolist() == item[start:end]:
                        allowed = budget(len(item))
                        hits.setdefault((text, n), []).append((max(begin, place - start - allowed) - begin, min(stop, place - start + len(item) + allowed) - begin))
        for (text, n), places in sorted(hits.items()):
            distance, start, end = matches(self.words[n], w.hash[w.first[text] : w.first[text + 1]].tolist(), places)
            if distance <= budget(len(self.words[n])):
                for item_id in self.ids[n]:
                    yield text, item_id, distance, start, end


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[Items, bool]]:
    """The blocks, and whether each is the only one."""
    held, size, made = [], 0, 0
    for item_id, text in items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        if size >= BLOCK_BYTES:
            yield Items(held), False
            held, size, made = [], 0, made + 1
        held.append((item_id, text))
        size += len(text)
    if held:
        yield Items(held), not made


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, first_word, end_word: which documents hold which items, and where."""
    bound_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, distance int, first_word long, end_word long"

    def searcher(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index: Items = shared.value
            for batch in batches:
                ids, at, out = batch.column(0).to_pylist(), 0, []
                for part in parts([normalise(t) for t in batch.column(1).to_pylist()]):
                    out += [(ids[at + text], item_id, distance, start, end) for text, item_id, distance, start, end in index.search(part)]
                    at += len(part)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "distance", "first_word", "end_word"])

        return run

    found = None
    for index, alone in _blocks(items, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        one = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(searcher(shared), schema)
        if not alone:
            one = written(one, "leaks")
            shared.unpersist()
        found = one if found is None else found.unionAll(one)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Those of docs, with all their columns, that hold none of the items."""

    def filterer(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index: Items = shared.value
            for batch in batches:
                stays, at = np.ones(batch.num_rows, dtype=bool), 0
                for part in parts([normalise(t) for t in batch.column(text_col).to_pylist()]):
                    stays[[at + text for text, *_ in index.search(part)]] = False
                    at += len(part)
                yield batch.filter(pa.array(stays))

        return run

    bound_batches(docs.sparkSession)
    for index, alone in _blocks(items, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.mapInArrow(filterer(shared), docs.schema)
        if not alone:
            docs = written(docs, "without-leaks")
            shared.unpersist()
    return docs
