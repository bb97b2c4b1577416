"""Splitting, cloning and joining streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import merge
from ..plans.scan import Scan, scan
from ..stream import EPOCH, EPOCH_BEFORE, RANGE, SEQ, Stream


def split(stream: Stream, *flags: Column | str) -> list[Stream]:
    """A stream for each flag.  A record goes wherever its flag holds: to several streams, or to none.

    Each branch is a filter, which reaches the source by itself; nothing is cached.
    """
    return [replace(stream, df=stream.df.filter(F.coalesce(F.expr(f) if isinstance(f, str) else f, F.lit(False)))) for f in flags]


def const_split(stream: Stream, *flags: Column | str) -> tuple[Stream, ...]:
    return tuple(split(stream, *flags))


def split_tagged(stream: Stream, branch: str = "branch", **flags: Column) -> Stream:
    """All branches in one pass: each record once for each of its branches, named in a column."""
    found = F.filter(F.array(*[F.when(F.coalesce(flag, F.lit(False)), F.lit(name)) for name, flag in flags.items()]), lambda b: b.isNotNull())
    return replace(stream, df=stream.df.withColumn(branch, F.explode(found)))


def cloned(stream: Stream, count: int) -> list[Stream]:
    """The same stream several times."""
    return [stream] * count


def const_cloned(stream: Stream, count: int) -> tuple[Stream, ...]:
    return tuple(cloned(stream, count))


def union(stream: Stream, *others: Stream) -> Stream:
    """All records of all streams.  Their mutual order is not defined, unless they share an order of arrival.

    Epochs merge: the frontier after a record is the least of the last epochs of all streams, and null until each has sent one.
    So a stream without epochs holds all back.  Branches of one stream have the same epochs, and keep them.  What streams of
    different epochs have in common must be said by ``_seq``, their order of arrival across all of them.
    """
    streams = [stream, *others]
    names = frozenset().union(*[s.names for s in streams])
    stamped = [EPOCH in s.df.columns for s in streams]
    alike = not any(stamped) or all(s.clock is not None and s.clock is stream.clock for s in streams)
    source = "__source"
    parts = [s.df.drop(RANGE) for s in streams]  # each stream has ranges of its own
    if not alike:
        kind = next(s.df.schema[EPOCH].dataType for s, yes in zip(streams, stamped, strict=True) if yes)
        parts = [p.withColumn(source, F.lit(i)) if yes else p.withColumns({source: F.lit(i), EPOCH_BEFORE: F.lit(None).cast(kind), EPOCH: F.lit(None).cast(kind)}) for i, (p, yes) in enumerate(zip(parts, stamped, strict=True))]
    df: DataFrame = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    if alike:
        return Stream(df, names, stream.clock)
    Stream(df).need(SEQ)
    if not all(stamped):
        return Stream(df.drop(source).withColumns({c: F.lit(None).cast(kind) for c in (EPOCH_BEFORE, EPOCH)}), names)
    latest = {f"__{when}_{i}": Scan("max", F.when(F.col(source) == i, F.col(EPOCH)), exclusive=when == "before") for i in range(len(parts)) for when in ("before", "after")}
    # A record that has an epoch before it says that its own stream has sent that.
    known = F.when(F.col(EPOCH_BEFORE).isNotNull(), F.col(EPOCH_BEFORE))
    met = scan(df, SEQ, latest | {f"__had_{i}": Scan("max", F.when(F.col(source) == i, known)) for i in range(len(parts))})
    after = merge(*[F.col(f"__after_{i}") for i in range(len(parts))])
    before = merge(*[F.greatest(f"__before_{i}", f"__had_{i}") for i in range(len(parts))])
    return Stream(met.withColumns({EPOCH_BEFORE: before, EPOCH: after}).drop(source, *latest, *[f"__had_{i}" for i in range(len(parts))]), names, object())


def union_frontier(arrivals: DataFrame, source: str, epoch: str, sources: list, order: str = SEQ) -> DataFrame:
    """The frontier after each arrival, when several sources' epochs meet: the least of the sources' last epochs, null until
    every source has sent one.

    arrivals: the order in which records (or epochs) of all sources come in, which source each is from, its epoch.
    """
    latest = {f"__of_{i}": Scan("max", F.when(F.col(source) == s, F.col(epoch))) for i, s in enumerate(sources)}
    return scan(arrivals, order, latest).withColumn("frontier", merge(*[F.col(n) for n in latest])).drop(*latest)
