"""Near-duplicate documents by b-bit MinHash and a multi-index Hamming join.

A document is the set of its word shingles.  Documents with the same set are one class from the start, whatever their
number.  Each class has a signature of minima of BITS bits, cut into chunks; two signatures that differ in at most
2 * chunks - 1 symbols have, by the pigeonhole principle, a chunk with at most one error.  All ways in which a chunk may have
one error are enumerated (each symbol left out in turn), so that every pair under the distance threshold shares a key.
``layout`` chooses the numbers of symbols and chunks by the similarity that is asked for, so that a pair right at it is beyond
the threshold with a chance of MISSED at most, one above it with less: at 80 percent, 64 symbols in 14 chunks, which finds
every pair that differs in up to 27 symbols and misses 1 in 70,000.

Links are confirmed on full sets of 64-bit shingle hashes.  What is wanted is connectivity, so pairs are not enumerated
within groups of copies: first each class is held against the least class of the bucket it shares most keys with, and
joined to it if similar.  Then every large bucket that still holds several components gets a centre, drawn anew in each round,
and its members of other components are held against that, for as long as a round settles a tenth of what is open.  What large
buckets still hold is split by elements of the full sets, which loses no similar pair: first by the rarest ones of each set, then, where a
bucket stays large, by the rarest ones in which a set and a central member of the bucket differ, for as long as a round halves the pairs.  Only then
pairs within a bucket that are in different components are compared: bounds that are exact (sizes, and counts of hashes by their first byte, which bound the
intersection from above) rule out most, full sets decide the rest.  Buckets that are large even then are split into blocks, each held
against each other, which takes rows by the square of their size.

Defined cases.  Null texts and texts without words have an empty set, are linked with nothing, and are kept.  Texts with
fewer words than a shingle have their word sequence as the only element; texts of any length are read whole.  Rows of one id
are ordered by a hash of their text, and one of equal rows is kept; null ids come first.  Other columns are kept as they are,
whatever their names.  An empty table gives no rows.  A ``percent`` too low for any layout is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._features import parts, release_memory
from ._tables import NULL_ID, keyed, written
from ._text import Words, grams, mix64
from .components import components, merged

BITS = 16
MISSED = 2e-5  # chance that a pair right at the similarity asked for is beyond the signatures' threshold
LAYOUTS = (64, 128, 256)  # numbers of symbols that a signature may have
BLOCK = 1024  # members of a bucket that are compared with as many others in one piece
DRAWN = 64  # members of a large bucket of which its centre is the most central one
_LONG = pa.int64()
_FULL = 255  # a count of a histogram that may be larger


def layout(percent: int) -> tuple[int, int]:
    """The numbers of symbols and of chunks of signatures for a similarity; chunks have three symbols at least."""
    differ = 1 - percent / 100
    for symbols in LAYOUTS:
        beyond = 1.0  # chance that more than n symbols differ
        for n in range(2 * (symbols // 3)):
            beyond -= math.comb(symbols, n) * differ**n * (1 - differ) ** (symbols - n)
            if n % 2 and beyond <= MISSED:
                return symbols, (n + 1) // 2
    raise ValueError(f"{percent} percent is too low for the signatures")


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z count as a-z."""
    w = Words(texts, fold=True)
    runs = grams(w.hash, size)
    out = []
    for first, end in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if end - first >= size:
            out.append(np.unique(runs[first : end - size + 1]))
        elif end > first:  # the sequence is shorter than a shingle, and hashed with its length
            out.append(mix64(grams(w.hash[first:end], end - first) + np.uint64(end - first)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


_draw = np.random.default_rng(11)
_FACTORS = _draw.integers(1, 1 << 63, LAYOUTS[-1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _draw.integers(0, 1 << 63, LAYOUTS[-1], dtype=np.uint64)


def signatures(sets: list[np.ndarray], symbols: int) -> np.ndarray:
    """Texts x symbols; rows of empty sets are 0."""
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    out = np.zeros((len(sets), symbols), dtype=np.uint16)
    full = np.flatnonzero(size)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        begin = np.cumsum(size[full]) - size[full]
        for i in range(symbols):
            x = flat * _FACTORS[i] + _ADDENDS[i]
            x ^= x >> np.uint64(29)
            out[full, i] = (mix64(np.minimum.reduceat(x * _FACTORS[-1 - i], begin)) & np.uint64((1 << BITS) - 1)).astype(np.uint16)
    return out


def chunk_keys(signature: np.ndarray, chunks: int) -> np.ndarray:
    """Texts x symbols keys: of each chunk, and each symbol of it that may be wrong, a hash of the other symbols."""
    keys = np.empty(signature.shape, dtype=np.uint64)
    for chunk in np.array_split(np.arange(signature.shape[1]), chunks):
        for wrong in chunk:
            key = np.full(len(signature), wrong + 1, dtype=np.uint64)
            for i in chunk[chunk != wrong]:
                key = mix64(key * np.uint64(0x100000001B3) + signature[:, i].astype(np.uint64))
            keys[:, wrong] = key
    return keys


def _histogram(sets: list[np.ndarray]) -> np.ndarray:
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    owner = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate([np.empty(0, dtype=np.uint64), *sets])
    return np.minimum(np.bincount(owner * 256 + (flat >> np.uint64(56)).astype(np.int64), minlength=256 * len(sets)), _FULL).reshape(-1, 256).astype(np.uint8)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: whether the document is the one of its component that stays.

    Two documents are linked if 100 * |both| >= percent * |either|.
    """
    rows, plain = keyed(docs, id_col, text_col)
    return _judged(rows, plain, shingle, percent).drop("doc")


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Those of docs, with all their columns, that are the one of their component that stays."""
    rows, plain = keyed(docs, id_col, text_col, carry=True)
    stay = _judged(rows, plain, shingle, percent).where("kept").select("doc")
    own = {id_col: "id", text_col: "text"}
    return rows.join(stay, "doc", "left_semi").select(*[F.col(own.get(c, f"rest.`{c}`")).alias(c) for c in docs.columns])


def _judged(rows: DataFrame, plain: bool, shingle: int, percent: int) -> DataFrame:
    """The result of near_duplicates, and doc."""
    symbols, chunks = layout(percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in parts([x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]):
                sets = shingle_sets(part, shingle)
                low, high = (np.fromiter((int((mix64(s ^ np.uint64(salt))).sum(dtype=np.uint64)) for s in sets), dtype=np.uint64, count=len(sets)) for salt in (1, 2))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc").slice(at, len(part)), pa.array([len(s) for s in sets], _LONG), pa.array(low.view(np.int64), _LONG), pa.array(high.view(np.int64), _LONG),
                    pa.array([s.tobytes() for s in signatures(sets, symbols)], pa.binary()), pa.array([h.tobytes() for h in _histogram(sets)], pa.binary()),
                ], ["doc", "n", "low", "high", "signature", "histogram"])
                at += len(part)

    signed = written(rows.select("doc", "text").mapInArrow(sign, "doc long not null, n long, low long, high long, signature binary, histogram binary"), "signatures")
    # Classes: equal sets have equal sizes and equal 128-bit sums of hashes.
    # Aggregates that are joined with what they come from are written first: then the join has an exchange on either
    # side, which adaptive execution splits where a class or a bucket is large.
    classes = written(signed.where("n > 0").groupBy("n", "low", "high").agg(F.min("doc").alias("rep")), "classes")
    member = signed.select("doc", "n", "low", "high").join(classes, ["n", "low", "high"], "left").select("doc", "n", F.coalesce("rep", "doc").alias("rep"))
    reps = classes.select(F.col("rep").alias("doc")).join(signed, "doc")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint16).reshape(-1, symbols)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("doc")), symbols), _LONG), pa.array(chunk_keys(signature, chunks).ravel().view(np.int64), _LONG)], ["rep", "key"])

    keys = reps.select("doc", "signature").mapInArrow(index, "rep long not null, key long not null")
    buckets = written(keys.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("size")).where("size > 1").drop("size"), "buckets")
    shared = written(keys.join(buckets, "key"), "bucket-members")  # key, rep, least

    # The texts of all classes that share a key with another, as sets; written once, read by both rounds.
    involved = shared.select("rep").distinct()

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in parts([x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]):
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(at, len(part)), pa.array([s.tobytes() for s in shingle_sets(part, shingle)], pa.binary())], ["doc", "shingles"])
                at += len(part)

    sets = written(rows.select("doc", "text").join(involved.withColumnRenamed("rep", "doc"), "doc", "left_semi").select("doc", "text").mapInArrow(sets_of, "doc long not null, shingles binary"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) whose full sets are similar enough."""

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                    # Both are sorted and have no repetitions, so a value that occurs twice in the two is in both.
                    every = np.sort(np.concatenate((x, y)), kind="stable")
                    both = int((every[1:] == every[:-1]).sum())
                    good.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")], ["a", "b"])
                release_memory()

        with_a = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), "a")
        return with_a.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")

    centres = shared.where("rep <> least").groupBy("rep", "least").count()
    nearest = centres.groupBy("rep").agg(F.max_by("least", F.struct("count", -F.col("least"))).alias("b")).select(F.col("rep").alias("a"), "b")
    bounds = written(reps.select("doc", "n", "signature", "histogram"), "bounds")

    def possible(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) that no exact bound rules out."""

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = {c: batch.column(c) for c in batch.schema.names}
                n = [np.asarray(columns[f"n_{e}"]) for e in "ab"]
                signature = [np.frombuffer(b"".join(columns[f"signature_{e}"].to_pylist()), dtype=np.uint16).reshape(-1, symbols) for e in "ab"]
                histogram = [np.frombuffer(b"".join(columns[f"histogram_{e}"].to_pylist()), dtype=np.uint8).reshape(-1, 256) for e in "ab"]
                good = pa.array(_may_be_near(*n, *signature, *histogram, percent, chunks), pa.bool_())
                yield pa.RecordBatch.from_arrays([columns[e].filter(good) for e in "ab"], ["a", "b"])

        for e in "ab":
            pairs = pairs.join(bounds.select(*[F.col(c).alias(e if c == "doc" else f"{c}_{e}") for c in bounds.columns]), e)
        return pairs.mapInArrow(compare, "a long, b long")

    def still_open(rows: DataFrame) -> DataFrame:
        """key, rep, short and component of the members of buckets that are in several components, and n, their bucket's size.  Of
        buckets that have the same members, as neighbouring keys often do, one is left."""
        placed = rows.select("key", "rep", "short").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "short", F.coalesce("component", "rep").alias("component"))
        members = [F.bit_xor(F.xxhash64("rep", "short", F.lit(salt))).alias(f"members_{salt}") for salt in (1, 2)]
        several = placed.groupBy("key").agg(F.min("component").alias("lowest"), F.max("component").alias("highest"), F.max("short").alias("any_short"), F.count("*").alias("n"), *members)
        several = several.where("lowest <> highest and any_short").groupBy("n", "members_1", "members_2").agg(F.min("key").alias("key"))
        return written(placed.join(written(several.select("key", "n"), "several"), "key"), "open")

    def set_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each row's set, x, the elements that it or its centre's set, y, has alone, and the lengths of prefixes; and where the two
        are similar but in different components, their link (a, b)."""
        for batch in batches:
            elements, short, long, a = [], [], [], []
            for rep, x, y, other in zip(batch.column("rep").to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist(), (batch.column("component").to_numpy() != batch.column("of_b").to_numpy()).tolist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                alone = np.setxor1d(x, y, assume_unique=True)
                both = (len(x) + len(y) - len(alone)) // 2
                near = 100 * both >= percent * (both + len(alone))
                elements.append(alone.tobytes())
                # Similar sets differ in (1 - s) / s of either's size at most, and so do these differences; the smaller difference has at most
                # half of that alone.  One that is similar to the centre is only held against others, which are farther from the centre.
                long.append((len(alone) * (100 + percent) + (len(x) - len(y)) * (100 - percent)) // (2 * (100 + percent)) if near else len(x) * (100 - percent) // percent)
                short.append(long[-1] if near else len(x) * (100 - percent) // (2 * percent))
                a.append(rep if near and other else None)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("rep"), pa.array(elements, pa.binary()), *(pa.array(x, _LONG) for x in (short, long, a)), batch.column("b")], ["key", "rep", "elements", "short", "long", "a", "b"])
            release_memory()

    groups = components(written(confirmed(nearest), "near-1"))
    open_rows = still_open(shared.withColumn("short", F.lit(True)))
    turn, before = 0, 0
    while left := (crowd := open_rows.where(F.col("n") > BLOCK)).count():
        # Large buckets get a centre each, and each of their members the centre that most of its buckets have, if it is of another
        # component.
        turn += 1
        if turn > 1 and 10 * left > 9 * before:
            break  # the last round settled too little for another one
        centre = written(crowd.groupBy("key").agg(F.min_by(F.struct("rep", "component"), F.xxhash64("rep", F.lit(turn))).alias("centre")), "centres")
        votes = crowd.join(centre, "key").where("component <> centre.component").groupBy("rep", F.col("centre.rep").alias("centre")).count()
        chosen = votes.groupBy("rep").agg(F.max_by("centre", F.struct("count", "centre")).alias("other")).select(F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b")).distinct()
        more = written(confirmed(possible(chosen)), "near-2")
        if more.isEmpty():
            break
        before, groups = left, merged(groups, more)
        open_rows = still_open(open_rows)

    # What is left of large buckets is split by elements of the full sets: see ``_prefixes``.
    rest = open_rows.where(F.col("n") > BLOCK)
    if weight := _weight(rest):
        done, own = [open_rows.where(F.col("n") <= BLOCK)], sets.withColumnRenamed("doc", "rep")
        whole = rest.select("rep").distinct().join(own, "rep").select(F.lit(0).cast("long").alias("key"), "rep", F.col("shingles").alias("elements"))
        size = F.expr("length(elements) div 8")
        # Of similar full sets, the smaller has at most (1 - s) / (1 + s) of its size alone, either one 1 - s.
        held = whole.withColumn("short", F.floor(size * (100 - percent) / (100 + percent))).withColumn("long", F.floor(size * (100 - percent) / 100))
        finer = still_open(_prefixes(written(held, "whole-sets")))
        if (least := _weight(finer.where(F.col("n") > BLOCK))) < weight:
            done.append(finer.where(F.col("n") <= BLOCK))
            rest, weight = finer.where(F.col("n") > BLOCK), least
        while weight:
            # Large buckets with many members in common are one, as far as the member with the least hash tells.  Each gets a centre
            # again, and its members are known by what sets them apart from it.
            name = written(rest.groupBy("key").agg(F.min_by("rep", F.xxhash64("rep")).alias("name")), "names")
            wide = written(rest.join(name, "key").groupBy(F.col("name").alias("key"), "rep").agg(F.first("component").alias("component")), "wide")
            drawn = wide.withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("key", "rep"), "rep"))).where(F.col("turn") <= DRAWN)
            centre = written(drawn.select("key", "rep", "component").join(own, "rep").groupBy("key").applyInArrow(_most_central, "key long, b long, of_b long, y binary"), "centres")
            apart = wide.join(own.withColumnRenamed("shingles", "x"), "rep").join(centre, "key")
            apart = written(apart.mapInArrow(set_apart, "key long, rep long, elements binary, short long, long long, a long, b long"), "apart")
            more = written(apart.where("a is not null").select("a", "b").distinct(), "near-4")
            if not more.isEmpty():
                groups = merged(groups, more)
            finer = still_open(_prefixes(apart))
            if 2 * (least := _weight(finer.where(F.col("n") > BLOCK))) > weight:
                break  # the round split too little for another one: the rest is compared in blocks
            done.append(finer.where(F.col("n") <= BLOCK))
            rest, weight = finer.where(F.col("n") > BLOCK), least
        if weight:
            done.append(rest)
        open_rows = still_open(reduce(DataFrame.unionAll, done))

    # The pairs of buckets whose members are in several components still.
    small = open_rows.where(F.col("n") <= BLOCK).select("key", "rep", "short", "component", F.struct(F.lit(0).alias("block"), F.lit(0).alias("other")).alias("piece"))
    large = open_rows.where(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # A bucket of several blocks: each row goes to the pairs of its own block and every other one.
    other = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grid = small.unionAll(other.select("key", "rep", "short", "component", F.struct(F.least("block", "other").alias("block"), F.greatest("block", "other").alias("other")).alias("piece")))
    cells = grid.join(bounds.withColumnRenamed("doc", "rep"), "rep").select("key", F.xxhash64("key", "piece").alias("piece"), "rep", "short", "component", "n", "signature", "histogram")

    def enumerate_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "rep", "short", "component", "n", "signature", "histogram")), strict=True):
                if held and row[:2] != held[0][:2]:
                    found |= open_pairs(held, percent, symbols, chunks)
                    held = []
                held.append(row)
            if found:
                yield _pair_batch(found)
        if held and (found := open_pairs(held, percent, symbols, chunks)):
            yield _pair_batch(found)

    pairs = cells.repartition(F.col("piece")).sortWithinPartitions("piece", "key", "rep").mapInArrow(enumerate_cells, "a long, b long").distinct()
    last = written(confirmed(pairs), "near-3")
    final = (groups if last.isEmpty() else merged(groups, last)).select(F.col("node").alias("rep"), F.col("component"))
    result = member.join(final, "rep", "left").select("doc", "n", F.coalesce("component", "rep").alias("component"))
    if plain:
        named = result.select(F.nullif("doc", F.lit(NULL_ID)).alias("doc_id"), "n", "doc", F.nullif("component", F.lit(NULL_ID)).alias("component_id"), "component")  # the id is never NULL_ID here
    else:
        ids = rows.select("doc", F.col("id").alias("doc_id"))
        named = result.join(ids, "doc").join(ids.select(F.col("doc").alias("component"), F.col("doc_id").alias("component_id")), "component")
    return named.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc") == F.col("component")).alias("kept"), "doc")


def _weight(rows: DataFrame) -> int:
    """How many pairs the members of open buckets make, of each that is short with all."""
    return rows.where("short").agg(F.sum("n")).first()[0] or 0


def _prefixes(held: DataFrame) -> DataFrame:
    """key, rep, short: of large buckets, smaller ones, such that any two similar members that are not in one component yet share one
    in which one of them is short.

    held has key, rep, elements (its full set, or what either that or the set of the bucket's centre has alone), and how many elements a
    similar member may lack of these: long for any such member, short for one of whose elements there are as many or more.  Two
    differences from a centre differ in just the elements in which the full sets differ.  If two members have elements in common, then in any order of
    the elements the first in common is among the first short + 1 of the one with fewer, and the first long + 1 of the other.  Similar
    full sets always have some; differences have some unless both sets are similar to the centre, and so in its component.
    Elements that more than BLOCK members of a bucket have come last, the most frequent ones at the end.
    """

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements = [np.frombuffer(x, dtype=np.int64) for x in batch.column("elements").to_pylist()]
            key = np.repeat(np.asarray(batch.column("key")), [len(x) for x in elements])
            yield pa.RecordBatch.from_arrays([pa.array(key, _LONG), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *elements]), _LONG)], ["key", "element"])

    # One row for every BLOCK elements at most.
    counts: dict[int, dict[int, int]] = {}
    for row in held.select("key", "elements").mapInArrow(single, "key long, element long").groupBy("key", "element").count().where(F.col("count") > BLOCK).collect():
        counts.setdefault(row["key"], {})[row["element"]] = row["count"]
    frequent = {key: tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(of.items()), strict=True)) for key, of in counts.items()}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, is_short = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=bool)]
            for key, elements, short, long in zip(*(batch.column(c).to_pylist() for c in ("key", "elements", "short", "long")), strict=True):
                elements = np.sort(np.frombuffer(elements, dtype=np.int64))
                if key in frequent:
                    names, count = frequent[key]
                    at = np.minimum(np.searchsorted(names, elements), len(names) - 1)
                    elements = elements[np.argsort(np.where(names[at] == elements, count[at], 0), kind="stable")]
                chosen.append(elements[: max(short, long) + 1])
                is_short.append(np.arange(len(chosen[-1])) <= short)
            times = list(map(len, chosen[1:]))
            columns = [pa.array(np.repeat(np.asarray(batch.column(c)), times), _LONG) for c in ("key", "rep")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(chosen), _LONG), pa.array(np.concatenate(is_short))], ["key", "rep", "element", "short"])

    rows = written(held.select("key", "rep", "elements", "short", "long").mapInArrow(first, "key long, rep long, element long, short boolean").select(F.xxhash64("key", "element").alias("key"), "rep", "short"), "prefixes")
    # Most elements are of one member only.
    return rows.join(written(rows.groupBy("key").count().where("count > 1").select("key"), "prefix-keys"), "key")


def _most_central(held: pa.Table) -> pa.Table:
    """Of members of a bucket, the one that differs least from the set of what more than half of them have."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in held.column("shingles").to_pylist()]
    names, count = np.unique(np.concatenate(sets), return_counts=True)
    usual = names[2 * count > len(sets)]
    rep = held.column("rep").to_pylist()
    least = min(range(len(sets)), key=lambda i: (len(sets[i]) - 2 * int(np.isin(sets[i], usual, assume_unique=True).sum()), rep[i]))
    return held.slice(least, 1).select(["key", "rep", "component", "shingles"]).rename_columns(["key", "b", "of_b", "y"])


def _may_be_near(n_a, n_b, signature_a, signature_b, histogram_a, histogram_b, percent: int, chunks: int) -> np.ndarray:
    """Of each pair, whether its sizes, signatures and counts of hashes allow it to be similar enough.  All arguments have a row for
    each pair, or one for all."""
    good = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    good &= (signature_a != signature_b).sum(axis=1) <= 2 * chunks - 1
    both = np.minimum(histogram_a, histogram_b)
    # A count that is full on both sides may be any larger.
    return good & ((100 * both.sum(axis=1, dtype=np.int64) >= percent * (n_a + n_b - both.sum(axis=1, dtype=np.int64))) | (both == _FULL).any(axis=1))


def open_pairs(held: list[tuple], percent: int, symbols: int, chunks: int) -> set[tuple[int, int]]:
    """Pairs (greater, less) of a bucket's rows in different components, one of them short, that no exact bound rules out."""
    _, _, rep, short, component, n, signature, histogram = zip(*held, strict=True)
    rep, short, component, n = np.array(rep), np.array(short), np.array(component), np.array(n)
    signature = np.frombuffer(b"".join(signature), dtype=np.uint16).reshape(-1, symbols)
    histogram = np.frombuffer(b"".join(histogram), dtype=np.uint8).reshape(-1, 256)
    names, sizes = np.unique(component, return_counts=True)
    # Every open pair has a member outside the largest component.
    outside = np.flatnonzero(component != names[sizes.argmax()])
    found: set[tuple[int, int]] = set()
    for i in outside.tolist():
        j = np.flatnonzero((component != component[i]) & (short | short[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        j = j[_may_be_near(n[j], n[i], signature[j], signature[i : i + 1], histogram[j], histogram[i : i + 1], percent, chunks)]
        found.update((max(a, b), min(a, b)) for a, b in ((int(rep[i]), int(rep[k])) for k in j))
    return found


def _pair_batch(found: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*sorted(found), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, _LONG), pa.array(b, _LONG)], ["a", "b"])
