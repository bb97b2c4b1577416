"""Keyed state whose entries expire in event time.

An entry written at time t with a time to live of d is there for a later record if t + d is greater than the epoch before
that record.  Without epochs nothing expires.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.places import written
from ..plans.scan import Scan, ranges, scan
from ..stream import EPOCH_BEFORE, KEY, RANGE, SEQ, TS, Stream
from .stateful import stateful_map


def ttl_running(stream: Stream, ttl: Column, **scans: Scan) -> Stream:
    """Running aggregates of each key that start anew once the key's last entry has expired."""
    stream.need(KEY, SEQ, TS, EPOCH_BEFORE)
    # The key's last timestamp by arrival, as a scan, so that a hot key's rows need not meet in one task.
    df = stream.df if RANGE in stream.df.columns else ranges(stream.df, SEQ)
    df = scan(df, SEQ, {"__last": Scan("max", F.struct(SEQ, TS), exclusive=True)}, (KEY,))
    last = F.col("__last")[TS]
    lives = F.coalesce((last + ttl > F.col(EPOCH_BEFORE)) | (last.isNotNull() & F.col(EPOCH_BEFORE).isNull()), F.lit(False))
    islands = scan(df.withColumn("__fresh", F.when(lives, 0).otherwise(1)), SEQ, {"__island": Scan("sum", F.col("__fresh"))}, (KEY,))
    return replace(stream, df=scan(islands, SEQ, scans, (KEY, "__island")).drop("__fresh", "__island", "__last"))


def ttl_fold(stream: Stream, ttl, function: Callable[[object, dict, dict], tuple[dict, dict]], schema: str) -> Stream:
    """function(key, record, entries) -> (result, entries), for any state: a dict whose values are (value, timestamp).

    Entries are pruned before each record; ``ttl`` is a number or a timedelta.
    """
    stream.need(KEY, SEQ, TS, EPOCH_BEFORE)
    return stateful_map(stream, expiring(ttl, function), schema, dict)


def expiring(ttl, function: Callable[[object, dict, dict], tuple[dict, dict | None]]) -> Callable:
    """The step of a stateful map whose state is a dict of (value, timestamp): entries that have expired are gone before it."""

    def step(key, record, entries):
        epoch = record[EPOCH_BEFORE]
        if epoch is not None:
            entries = {k: e for k, e in entries.items() if e[1] + ttl > epoch}
        result, entries = function(key, record, entries)
        return result, entries or None

    return step


def ttl_window(stream: Stream, ttl_seconds: float, horizon_seconds: float | None = None, slack_seconds: float | None = None, entry: Column | None = None, **aggregates: Callable[[Column, Column], Column]) -> Stream:
    """Adds aggregates over what is alive of each key's entries at each record, the record's own entry included.

    Of the key's records up to this one, those count that have not expired; with ``horizon_seconds`` only those that are at
    most so much older than the record, with ``slack_seconds`` only those at most so much younger.  An aggregate is a
    function of the entry and its arrival.  Records meet entries by buckets of an eighth of the time to live, from the
    oldest that may be alive to the youngest so far: what is compared is in proportion to what is alive, and a hot key's
    work is spread over its buckets.  Records before the first epoch meet all of their key's, unless there is a horizon.
    """
    stream.need(KEY, SEQ, TS, EPOCH_BEFORE)
    # Written, since it is read as records, as entries and for the result.
    stream = replace(stream, df=written(stream.df if RANGE in stream.df.columns else ranges(stream.df, SEQ), "ttl-input"))
    width = max(1.0, ttl_seconds / 8)
    second = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    time, epoch = second(F.col(TS)), second(F.col(EPOCH_BEFORE))
    df = scan(stream.df, SEQ, {"__youngest": Scan("max", F.col(TS), exclusive=True)}, (KEY,))
    entries = stream.df.select(F.col(KEY).alias("__k"), F.floor(time / width).alias("__place"), time.alias("__t"), F.col(SEQ).alias("__s"), (F.lit(1) if entry is None else entry).alias("__v"))
    oldest, youngest = epoch - ttl_seconds, second(F.col("__youngest"))
    within = F.col("__s") <= F.col(SEQ)
    if horizon_seconds is not None:
        oldest = F.greatest(time - horizon_seconds, oldest)  # the greatest of what is not null
        within &= F.col("__t") >= F.col("__time") - horizon_seconds
    if slack_seconds is not None:
        youngest = F.when(youngest.isNotNull(), F.least(youngest, time + slack_seconds))
        within &= F.col("__t") <= F.col("__time") + slack_seconds
    # The own entry's bucket is apart: a late record's can be far from those that may be alive.
    near = F.array_union(F.array(F.floor(time / width)), F.when(oldest <= youngest, F.sequence(F.floor(oldest / width), F.floor(youngest / width))).otherwise(F.array().cast("array<bigint>")))
    alive = (F.col("__s") == F.col(SEQ)) | F.col("__epoch").isNull() | (F.col("__t") + ttl_seconds > F.col("__epoch"))
    same = F.col(KEY).eqNullSafe(F.col("__k"))
    bucketed = df if horizon_seconds is not None else df.where(F.col(EPOCH_BEFORE).isNotNull())
    met = bucketed.select(KEY, SEQ, time.alias("__time"), epoch.alias("__epoch"), F.explode(near).alias("__near")).join(entries, same & (F.col("__near") == F.col("__place")) & within & alive).select(SEQ, "__v", "__s")
    if horizon_seconds is None:
        first = stream.df.where(F.col(EPOCH_BEFORE).isNull()).select(KEY, SEQ, time.alias("__time"))
        met = met.unionAll(first.join(entries, same & within).select(SEQ, "__v", "__s"))
    found = met.groupBy(F.col(SEQ).alias("__of")).agg(*[f(F.col("__v"), F.col("__s")).alias(n) for n, f in aggregates.items()])
    return replace(stream, df=stream.df.join(found, F.col(SEQ) == F.col("__of")).drop("__of"))
