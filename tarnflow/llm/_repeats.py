"""Where texts share windows of a fixed length: the frame of the operators that remove repeated passages.

Symbols are words or bytes; a window is ``window`` consecutive symbols of one text.  Each window has an anchor: of the
runs of ``gram`` symbols in it, the one with the least hash.  Equal windows have equal anchors, so texts need to meet
only by anchor.  A piece is a run of consecutive windows with the same anchor; it has ``window + window - gram`` symbols
at most, and each window belongs to one piece.

1.  Pieces are listed by the hashes of their anchor and of their content, without the text.  Anchors that occur once
    are dropped by a semi join with the (pre-aggregated) counts.
2.  Pieces of equal content collapse to the first of them and a count, pre-aggregated before the shuffle; so a passage with
    any number of copies is one entry, whose text is fetched once.
3.  The entries of an anchor meet in one task, where the operator's own index is built from them and read by them.  It decides
    for every entry which of its windows go where the content stands first, and which in its copies.
4.  An anchor with more than CROWD entries is split by more context: its entries are cut again, by two anchors from near either
    end of a window, and go through steps 2 and 3 once more; and then by anchors from still nearer.  A common passage has many
    surroundings, and a window that holds some of them has them at an end.  Where even that leaves more than CROWD entries,
    windows meet by their own content, and are counted: all that meet are equal, so there is nothing left for an index to
    compare.  What comes back to the entries is which windows stay, each from the one place where it stands first.
5.  Every piece gets its content's decision in a join, every document its pieces', and is cut.

Anchors only decide where texts meet.  Content is compared by the index, symbol by symbol; what collapses in step 2 is
known by two hashes of 64 bits, its anchor's and its content's, which are made by different functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._features import parts, release_memory
from ._tables import keyed, written
from ._text import Words, byte_grams, grams, mix64, slice_hashes, window_anchor

CROWD = 256  # entries of an anchor that one task gets at most
LAST = 3  # the level at which a piece is a single window; before it, each level has anchors from nearer the windows' ends


@dataclass(frozen=True)
class Frame:
    """What a symbol is, the length of a window and that of an anchor."""

    symbol: str  # "word" or "byte"
    window: int
    gram: int

    def __post_init__(self):
        if not (0 < self.gram <= self.window and self.window - self.gram < 255):
            raise ValueError("an anchor must be at most as long as a window, and shorter by less than 255 symbols")

    def split(self, text: bytes):
        """The symbols of a text, as something that can be sliced."""
        return text.split() if self.symbol == "word" else text

    def content(self, symbols, start: int, length: int) -> bytes:
        return b" ".join(symbols[start : start + length]) if self.symbol == "word" else symbols[start : start + length]

    def pieces(self, texts: list[bytes], level: int = 0) -> tuple[np.ndarray, ...]:
        """Of each piece: which text, anchor hash, content hash, place (start << 16 | anchor's offset << 8 | windows).

        Anchors differ between levels; at the last one every window is a piece, and its own anchor.
        """
        if self.symbol == "word":
            w = Words(texts)
            symbols, begin, end = w.hash, w.first[:-1], w.first[1:]
            gram, data, size = grams(symbols, self.gram), memoryview(symbols.tobytes()), 8
        else:
            symbols = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
            begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
            gram, begin, end = byte_grams(symbols, self.gram), begin[:-1], begin[1:] - 1
            data, size = memoryview(symbols), 1
        windows = np.arange(max(0, len(symbols) - self.window + 1))
        owner = np.searchsorted(begin, windows, side="right") - 1
        inside = windows[windows + self.window <= end[owner]]
        if level == LAST:
            first, n = inside, np.ones(len(inside), dtype=np.int64)
            at = first
        else:
            span = self.window - self.gram + 1
            width = max(1, span >> 2 * level)  # grams at either end of a window that may be an anchor; at first, all
            least = window_anchor(gram, width)
            anchor, other = least[inside], least[inside + span - width]
            fresh = np.ones(len(inside), dtype=bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (other[1:] != other[:-1]) | (inside[1:] != inside[:-1] + 1)
            head = np.flatnonzero(fresh)
            first, n, at = inside[head], np.diff(np.append(head, len(inside))), anchor[head]
            known = gram[at] if not level else mix64(gram[at] * np.uint64(0x9E3779B97F4A7C15) + gram[other[head]])
        content = slice_hashes(data, first * size, (first + n + self.window - 1) * size)
        return owner[first], content if level == LAST else known, content, (first - begin[owner[first]]) << 16 | (at - first) << 8 | n


#: Decides for the entries of some anchors, one after the other, each anchor's in order of (doc, place): gets (place, copies,
#: content) of each, copies being 1 or 2 (or more); returns for each the runs (offset of the first window, windows) to remove
#: where it stands first, and those to remove in its copies.
Runs = list[tuple[int, int]]
Decide = Callable[[list[tuple[int, int, bytes]]], list[tuple[Runs, Runs]]]
CHUNK_SYMBOLS = 60_000  # symbols of pieces that one index is built for, a whole anchor at least

_LONG = pa.int64()
_ENTRY = "key long, content long, doc long, place long, copies int, piece binary"
_DECISION = "key long, content long, doc long, place long, first array<int>, again array<int>"


def repeated(docs: DataFrame, frame: Frame, decide: Decide, keep_first: bool, cut: Callable, schema: str, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Applies ``cut(id, symbols, spans)`` to every document and returns its rows.

    spans: sorted, disjoint (start, end) of the symbols to remove: those that a window covers for which ``decide`` says so.
    keep_first: whether of equal windows the first stays, which ``decide`` must say, too.  With carry, the struct ``rest`` has
    the document's other columns.
    """
    rows, _ = keyed(docs, id_col, text_col, carry)
    rest = ["rest"] if carry else []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, at = np.asarray(batch.column(0)), [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()], 0
            for part in parts(texts):
                text, anchor, content, place = frame.pieces(part)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64), _LONG), pa.array(content.view(np.int64), _LONG), pa.array(ids[at + text], _LONG), pa.array(place, _LONG)], ["key", "content", "doc", "place"])
                at += len(part)

    pieces = rows.select("doc", "text").mapInArrow(scan, "key long not null, content long not null, doc long not null, place long not null")
    # Written, so that the join below has an exchange on either side, which adaptive execution can split at a hot anchor.
    often = written(pieces.groupBy("key").count().where("count > 1").select("key"), "anchors")
    shared = written(pieces.join(often, "key", "left_semi"), "pieces")  # read twice

    contents = written(shared.groupBy("key", "content").agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("copies")), "contents")
    marks = contents.groupBy("first.doc").agg(F.collect_list(F.struct("first.place", "key", "content", F.least("copies", F.lit(2)).cast("int").alias("copies"))).alias("marks"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of the entries."""
        for batch in batches:
            out = []
            for doc, text, marks in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "marks")), strict=True):
                symbols = frame.split(text.encode())
                for m in marks:
                    out.append((m["key"], m["content"], doc, m["place"], m["copies"], frame.content(symbols, m["place"] >> 16, (m["place"] & 255) + frame.window - 1)))
                if len(out) > 4000:
                    yield _entry_batch(out)
                    out = []
            if out:
                yield _entry_batch(out)
            release_memory()

    entries = written(rows.select("doc", "text").join(marks, "doc").mapInArrow(extract, _ENTRY), "entries")
    decisions = _decided(entries, frame, decide, keep_first)

    # A run is start << 8 | windows.
    mine = (F.col("d.doc") == F.col("p.doc")) & (F.col("d.place") == F.col("p.place"))
    start = F.shiftright("p.place", 16)
    found = shared.alias("p").join(decisions.alias("d"), ["key", "content"]).select(F.col("p.doc").alias("doc"), F.transform(F.when(mine, F.col("first")).otherwise(F.col("again")), lambda r: F.shiftleft(start + F.shiftright(r, 8), 8).bitwiseOR(r.bitwiseAND(F.lit(255)))).alias("runs"))
    runs = found.where(F.size("runs") > 0).groupBy("doc").agg(F.flatten(F.collect_list("runs")).alias("runs"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, runs in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "runs")), strict=True):
                symbols = frame.split((text or "").encode())
                out.append(cut(doc_id, text, symbols, _spans(len(symbols), frame.window, runs)))
            made = pa.RecordBatch.from_pylist(out, schema=arrow_schema)
            release_memory()
            yield pa.RecordBatch.from_arrays([*made.columns, *(batch.column(c) for c in rest)], [*made.schema.names, *rest])

    returned = StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(returned)
    full = StructType(returned.fields + [f for f in rows.schema.fields if f.name in rest])
    return rows.join(runs, "doc", "left").select("id", "text", *rest, "runs").mapInArrow(finish, full)


def _decided(entries: DataFrame, frame: Frame, decide: Decide, keep_first: bool) -> DataFrame:
    """The decisions for a written table of entries, one for each key and content, in which something is to be removed."""

    def settle(held: list[tuple]) -> Iterator[tuple]:
        for (key, content, doc, place, _, _), (first, again) in zip(held, decide([e[3:] for e in held]), strict=True):
            if first or again:
                yield key, content, doc, place, [at << 8 | n for at, n in first], [at << 8 | n for at, n in again]

    def crowded(some: DataFrame) -> DataFrame | None:
        found = written(some.groupBy("key").count().where(F.col("count") > CROWD).select("key"), "crowded")
        return None if found.isEmpty() else found

    def settled(some: DataFrame, function: Callable, batch_of: Callable, schema: str) -> DataFrame:
        return some.repartition(F.col("key")).sortWithinPartitions("key", "doc", "place").mapInArrow(_by_anchor(frame, function, batch_of), schema)

    keys = crowded(entries)
    if keys is None:
        return settled(entries, settle, _decision_batch, _DECISION)

    def split(level: int):
        """The function that cuts entries into pieces by the anchors of a level; of holds the entry, and the place in it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, at = batch.column("piece").to_pylist(), 0
                old = {c: np.asarray(batch.column(c)) for c in ("key", "doc", "place", "copies")}
                of = batch.column("of") if level > 1 else pa.StructArray.from_arrays([batch.column("key"), batch.column("content"), pa.array(np.zeros(len(texts)), pa.int32())], ["key", "content", "at"])
                for part in parts(texts):
                    text, anchor, content, place = frame.pieces(part, level)
                    source = at + text
                    key = mix64(anchor ^ mix64(old["key"][source].view(np.uint64)))
                    at_entry = (place >> 16) + np.asarray(of.field("at"))[source]
                    owner = of.take(pa.array(source))
                    columns = {"key": pa.array(key.view(np.int64), _LONG), "content": pa.array(content.view(np.int64), _LONG), "doc": pa.array(old["doc"][source], _LONG), "place": pa.array(place + (old["place"][source] >> 16 << 16), _LONG), "copies": pa.array(old["copies"][source], pa.int32())}
                    if level < LAST:
                        symbols = [frame.split(t) for t in part]
                        inner = [frame.content(symbols[t], p >> 16, (p & 255) + frame.window - 1) for t, p in zip(text.tolist(), place.tolist(), strict=True)]
                        columns["piece"] = pa.array(inner, pa.binary())
                    columns["of"] = pa.StructArray.from_arrays([owner.field("key"), owner.field("content"), pa.array(at_entry, pa.int32())], ["key", "content", "at"])
                    yield pa.RecordBatch.from_pydict(columns)
                    at += len(part)

        return run

    def stays(held: list[tuple]) -> Iterator[tuple]:
        """The windows that stay where they stand first: the owner's key and content, and runs in it."""
        for (_, _, _, place, _, _, of), (first, _) in zip(held, decide([e[3:6] for e in held]), strict=True):
            kept = _others(place & 255, first)
            if kept:
                yield of["key"], of["content"], [of["at"] + at << 8 | n for at, n in kept]

    owner = "of struct<key: long, content: long, at: int>"
    base = "key long, content long, doc long, place long, copies int"
    total = F.least(F.sum("copies"), F.lit(2)).cast("int").alias("copies")
    some = many = entries.join(keys, "key", "left_semi").select("key", "content", "doc", "place", "copies", "piece")
    found = []
    for level in range(1, LAST):
        inner = some.mapInArrow(split(level), f"{base}, piece binary, {owner}").groupBy("key", "content").agg(F.min(F.struct("doc", "place", "piece", "of")).alias("first"), total)
        inner = written(inner.select("key", "content", "first.doc", "first.place", "copies", "first.piece", "first.of"), "inner-entries")
        deeper = crowded(inner)
        few = inner if deeper is None else inner.join(deeper, "key", "left_anti").select(*inner.columns)
        found.append(settled(few, stays, _kept_batch, "key long, content long, kept array<int>"))
        if deeper is None:
            break
        some = inner.join(deeper, "key", "left_semi").select(*inner.columns)
    else:
        single = some.mapInArrow(split(LAST), f"{base}, {owner}").groupBy("key", "content").agg(F.min(F.struct("doc", "place", "of")).alias("first"), total)
        found.append(single.where(F.lit(keep_first) | (F.col("copies") == 1)).select("first.of.key", "first.of.content", F.array(F.shiftleft("first.of.at", 8) + 1).alias("kept")))
    kept = found[0]
    for more in found[1:]:
        kept = kept.unionAll(more)
    kept = kept.groupBy("key", "content").agg(F.flatten(F.collect_list("kept")).alias("kept"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each entry: all windows but those that stay; and all of its copies'."""
        for batch in batches:
            out = []
            for key, content, doc, place, copies, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = place & 255
                first = [at << 8 | m for at, m in _others(n, [(r >> 8, r & 255) for r in runs or ()])]
                if first or copies > 1:
                    out.append((key, content, doc, place, first, [n] if copies > 1 else []))
            if out:
                yield _decision_batch(out)

    split_up = many.drop("piece").join(kept, ["key", "content"], "left").select("key", "content", "doc", "place", "copies", "kept").mapInArrow(rest, _DECISION)
    return settled(entries.join(keys, "key", "left_anti").select(*entries.columns), settle, _decision_batch, _DECISION).unionAll(split_up)


def _by_anchor(frame: Frame, function: Callable, batch_of: Callable):
    """Runs a function on whole anchors, several at a time.  Rows come sorted by key, doc and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key = [], 0, None
        for batch in batches:
            found = []
            for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if entry[0] != key and size >= CHUNK_SYMBOLS:
                    found += function(held)
                    held, size = [], 0
                key = entry[0]
                held.append(entry)
                size += (entry[3] & 255) + frame.window
            if found:
                yield batch_of(found)
        if held and (found := list(function(held))):
            yield batch_of(found)

    return run


def _others(n: int, runs: Runs) -> Runs:
    """The runs of windows, of n, that are in none of some runs."""
    inside = np.zeros(n + 2, dtype=bool)
    for at, m in runs:
        inside[at + 1 : at + 1 + m] = True
    inside[0] = inside[n + 1] = True
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return [(int(a), int(b - a)) for a, b in zip(edge[0::2], edge[1::2], strict=True)]


def _entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [_LONG, _LONG, _LONG, _LONG, pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "content", "doc", "place", "copies", "piece"])


def _decision_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [_LONG, _LONG, _LONG, _LONG, pa.list_(pa.int32()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "content", "doc", "place", "first", "again"])


def _kept_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [_LONG, _LONG, pa.list_(pa.int32())], strict=True)], ["key", "content", "kept"])


def _spans(size: int, window: int, runs) -> list[tuple[int, int]]:
    """The spans of symbols that the windows of some runs cover."""
    if not runs:
        return []
    gone = np.zeros(size + 2, dtype=np.int32)  # +1 where a run of windows begins, -1 after its last
    for run in runs:
        gone[run >> 8] += 1
        gone[(run >> 8) + (run & 255)] -= 1
    at = np.flatnonzero(np.cumsum(gone[:size]) > 0)
    split = np.flatnonzero(np.diff(at) > window) + 1  # windows that overlap or touch make one span
    heads, tails = np.concatenate(([0], split)), np.concatenate((split, [len(at)])) - 1
    return [(int(at[h]), int(at[t]) + window) for h, t in zip(heads, tails, strict=True)]
