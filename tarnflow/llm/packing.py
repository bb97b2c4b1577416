"""Best-fit packing of documents into sequences, by hierarchical residual packing.

Every document is tokenized once, where it is read, and cut into pieces.  Pieces that fill a sequence are done.  The
others are dealt evenly over tasks of about NODE_ITEMS pieces, whatever partition they come from, so that each task sees
the lengths of the whole corpus.  A task packs its pieces longest first, each into the fullest sequence that still has
room, and settles the sequences that have become full to the last token.  The pieces of all others are its residual.

Best fit asks for nothing but lengths, and there are fewer of them than tokens in a sequence.  Tasks therefore hand on how
many pieces of each length their residual has; the sums are packed once, all the pieces of a length at a time, with
the result that best fit has for the residual of the whole corpus, piece by piece.  What is gathered is one row a length,
whatever the size of the corpus.  A piece finds its sequence by its number among all pieces of its length.

Pieces and residuals are written to the shared folder, so tokens are made once and a lost executor costs one stage's tasks.

Defined cases.  A null text is empty; an empty document is its end token.  Repeated rows are packed each for itself.  A
document longer than a sequence is cut into full sequences, and its first piece is what is left over; documents that
fit are never cut.  Texts of any length are tokenized whole; those with a very long run of blanks or of other characters by the
vocabulary's own library, which is slower.  An empty table gives no rows.  Other columns are not part of the result,
whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._features import release_memory
from ._tables import bound_batches, written

CAPACITY = 1024
END_ID = 2
NODE_ITEMS = 10_000  # pieces that a task packs at once
#: Fixed value: the published pattern that splits texts before byte-level pair encoding.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PIECES = "source long, number long, doc_id long, piece int, start long, length long, ids_crc32 long"
_RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_vocabularies: dict[str, Vocabulary] = {}
#: Bytes of a run of blanks, or of anything else, beyond which a text goes to the file's own library: the faster one takes its
#: pattern recursively and its merges in quadratic time, which does for words but not for runs of any length.
LONG_RUN = 1024
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def has_long_run(raw: bytes) -> bool:
    """Whether a text may have a run of blanks, or of what is not blank, of over LONG_RUN bytes.

    Bytes of other characters than ASCII may be either, so they count as both.
    """
    if len(raw) <= LONG_RUN:
        return False
    buf = np.frombuffer(raw, dtype=np.uint8)
    blank = _BLANK[buf]
    return any(np.diff(np.flatnonzero(np.concatenate(([True], ends, [True])))).max() - 1 > LONG_RUN for ends in (blank, ~blank & (buf < 128)))


class Vocabulary:
    """A byte-level BPE file as an encoder: the ids that its own library gives, by a faster one wherever that can."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splitter = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
            raise ValueError(f"{path} isn't a byte-level vocabulary with the published pattern")
        # Such files write bytes as printable characters: the printable ones as they are, the others from 256 up, in order.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.path, self.own = path, None
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> list[int]:
        if not has_long_run(text.encode()):
            return self.fast.encode(text, allowed_special="all")
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path)
        return self.own.encode(text, add_special_tokens=False).ids


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of items (by number): the largest first, each into the fullest bin with room for it."""
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    occupied, bins = 0, []  # occupied: bit r is set where a bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fitting = occupied >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                occupied ^= 1 << room
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        with_room[room - size].append(b)
        occupied |= 1 << (room - size)
    return bins


def best_fit_counts(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """best_fit of counts[size] items of each size: runs (size, first item, first bin, items a bin, offset in the bin), and the number of bins.

    The items of a run are the next of its size, and fill bins that follow each other.  A bin that is the fullest with
    room for an item stays so for the next of that size, so bins of the same room can be filled together.
    """
    with_room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # first bin and number of bins
    occupied, bins, runs = 0, 0, []

    def put(room: int, first: int, n: int) -> None:
        nonlocal occupied
        if n:
            with_room[room].append((first, n))
            occupied |= 1 << room

    for size in sorted(counts, reverse=True):
        item, left = 0, counts[size]
        while left:
            fitting = occupied >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                first, n = with_room[room].pop()
                if not with_room[room]:
                    occupied ^= 1 << room
            else:
                room, first, n = capacity, bins, -(-left // (capacity // size))
                bins += n
            each = room // size
            whole = min(n, left // each)
            if whole:
                runs.append((size, item, first, each, capacity - room))
                put(room - each * size, first, whole)
                item, left = item + whole * each, left - whole * each
            first, n = first + whole, n - whole
            if n and left:  # fewer than a bin takes
                runs.append((size, item, first, left, capacity - room))
                put(room - left * size, first, 1)
                first, n, left = first + 1, n - 1, 0
            put(room, first, n)
    return runs, bins


def _packer(capacity: int):
    """The function that packs the pieces of one task: full sequences have an id, the residual a rank among its length."""

    def local(key, held):
        sizes, node = held.column("length").to_pylist(), key[0].as_py()
        sequence, offset, rank = [None] * len(sizes), [0] * len(sizes), [None] * len(sizes)
        seen: Counter = Counter()
        for n, chosen in enumerate(best_fit(sizes, capacity)):
            at, full = 0, sum(sizes[i] for i in chosen) == capacity
            for i in chosen:
                if full:
                    sequence[i], offset[i] = 1 << 56 | node << 32 | n, at
                    at += sizes[i]
                else:
                    rank[i] = seen[sizes[i]]
                    seen[sizes[i]] += 1
        out = {c: held.column(c) for c in ("node", "doc_id", "piece", "start", "length", "ids_crc32")}
        return pa.table(out | {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64()), "rank": pa.array(rank, pa.int64())})

    return local


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, source, made = vocabulary(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(words.encode(text or ""), end_id).astype("<u4")
                for piece, (start, length) in enumerate(pieces(len(ids), capacity)):
                    rows.append((source, made + len(rows), doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            release_memory()
            made += len(rows)
            if rows:
                columns = zip(("source", "number", "doc_id", "piece", "start", "length", "ids_crc32"), zip(*rows, strict=True), strict=True)
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32() if c == "piece" else pa.int64()) for c, v in columns})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, item, first, each, offset = shared.value
        keys = size << 40 | item
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            turn = rank - item[run]
            found = [2 << 56 | first[run] + turn // each[run], offset[run] + turn % each[run] * length]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(f, pa.int64()) for f in found)], [*kept, "sequence_id", "offset"])

    spark, kept = docs.sparkSession, ["doc_id", "piece", "start", "length", "ids_crc32"]
    bound_batches(spark)
    made = written(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, _PIECES), "packing-pieces")
    whole = made.where(F.col("length") == capacity).select(*kept, F.shiftleft("source", 32).bitwiseOR(F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = made.where(F.col("length") < capacity)
    nodes = -(-parts.count() // NODE_ITEMS)
    if not nodes:
        return whole
    dealt = parts.withColumn("node", F.pmod(F.xxhash64("source", "number"), F.lit(nodes)))
    packed = written(dealt.groupBy("node").applyInArrow(_packer(capacity), f"node long, {_RESULT}, rank long"), "packing-local")
    settled, residual = packed.where("rank is null").select(*kept, "sequence_id", "offset"), packed.where("rank is not null")
    # How many pieces of each length the tasks before a task hand on, and how many there are in all.
    counts = written(residual.groupBy("node", "length").count(), "packing-counts")
    before = counts.select(F.col("node").alias("of_node"), F.col("length").alias("of_length"), F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    runs, _ = best_fit_counts({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    shared = spark.sparkContext.broadcast(tuple(np.array(sorted(runs), dtype=np.int64).reshape(-1, 5).T.copy()))
    ranked = residual.join(before, (F.col("node") == F.col("of_node")) & (F.col("length") == F.col("of_length"))).select(*kept, (F.col("rank") + F.col("before")).alias("rank"))
    return whole.unionAll(settled).unionAll(ranked.mapInArrow(place, _RESULT))
