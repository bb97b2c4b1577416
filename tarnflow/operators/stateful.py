"""Keyed state.

Aggregates that a window function can say (sum, count, min, max) are two-phase scans, which no hot key can hold up.
Folds that only Python can say run key by key, in the order of arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans.places import written
from ..plans.scan import Scan, numbered, scan
from ..stream import EPOCH, EPOCH_BEFORE, KEY, SEQ, TS, Stream


def running(stream: Stream, then: tuple[str, ...] = (), **scans: Scan) -> Stream:
    """Adds running aggregates of each key, in the order of arrival."""
    stream.need(KEY, SEQ)
    return replace(stream, df=scan(stream.df, SEQ, scans, (KEY,), then=then))


def fold(stream: Stream, function: Callable[[object, dict, object], tuple[dict | None, object | None]], schema: str | StructType, default: Callable[[], object] = lambda: None, flush: Callable[[object, object], dict | None] | None = None) -> Stream:
    """A state machine for each key: function(key, record, state) -> (result, state).

    A key that has no state starts from the default; a state of None is dropped.  A result of None emits nothing.  At the end of a bounded stream flush(key, state) may emit
    what a key still holds.  A key's records are streamed through its task batch by batch; only its state is held.
    """
    stream.need(KEY, SEQ)
    returned = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(returned)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        key, state = nothing, None
        for part in parts:
            out: list[dict] = []
            for record in part.to_pylist():
                own = record[KEY]
                if key is nothing or own != key:
                    if flush is not None and state is not None and (last := flush(key, state)) is not None:
                        out.append(last)
                    key, state = own, None
                result, state = function(key, record, default() if state is None else state)
                if result is not None:
                    out.append(result)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if flush is not None and state is not None and (last := flush(key, state)) is not None:
            yield pa.RecordBatch.from_pylist([last], schema=arrow)

    return replace(stream, df=stream.df.repartition(KEY).sortWithinPartitions(KEY, SEQ).mapInArrow(run, returned))


def stateful_map(stream: Stream, function: Callable, schema: str | StructType, default: Callable[[], object] = lambda: None) -> Stream:
    """One result for each record: function(key, record, state) -> (result, state); the record's envelope is kept."""

    def keep(key, record, state):
        result, state = function(key, record, state)
        return {c: record[c] for c in record if c in (KEY, TS, SEQ, EPOCH_BEFORE, EPOCH)} | result, state

    returned = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    envelope = [f for f in stream.df.schema.fields if f.name in (KEY, TS, SEQ, EPOCH_BEFORE, EPOCH)]
    return fold(stream, keep, StructType(envelope + returned.fields), default)


def batches(stream: Stream, size: int, *aggregates: Column) -> DataFrame:
    """Groups each key's records by ``size`` in the order of arrival: _key, batch, n, closed_at and the aggregates.

    closed_at is the arrival of the record that completed the batch, null if only the end of the stream did.
    """
    stream.need(KEY, SEQ)
    placed = numbered(stream.df, SEQ, "__nth", keys=(KEY,)).withColumn("batch", F.floor(F.col("__nth") / size).cast("long"))
    return placed.groupBy(KEY, "batch").agg(F.count("*").alias("n"), F.when(F.count("*") == size, F.max(SEQ)).alias("closed_at"), *aggregates)


def close_on_epoch(on_time: Stream, all_records: Stream, bucket: Callable[[Column], Column], *aggregates: Column) -> DataFrame:
    """Groups each key's records by a time bucket, and closes groups by epochs: _key, bucket, closed_at and the aggregates.

    An emitted epoch closes all open groups whose bucket is at most its own; a record of a bucket that was closed
    opens it again, for a second result.  closed_at is the epoch, null if only the end of the stream closed the group.
    ``all_records`` is the stream with its late records, since those move epochs too; it is written to the shared folder, as it
    is read for the epochs, for the buckets and for the records.  What each bucket's first epoch is takes a row a bucket.
    """
    on_time.need(KEY, SEQ, TS, EPOCH)
    stamped = written(all_records.df, "stamped")
    moved = F.col(EPOCH).isNotNull() & (F.col(EPOCH_BEFORE).isNull() | (F.col(EPOCH) > F.col(EPOCH_BEFORE)))
    emission = F.struct(F.col(SEQ).alias("at"), F.col(EPOCH).alias("epoch"))
    late = F.coalesce(F.col(TS) <= F.col(EPOCH_BEFORE), F.lit(False))
    # The next emitted epoch at or after each record.  Epochs increase, so it is the first that could close the record ...
    nexts = scan(stamped, SEQ, {"__next": Scan("min", F.when(moved, emission))}, reverse=True)
    # ... if its bucket reaches the record's; else it is the first epoch whose bucket does.
    firsts = stamped.filter(moved).groupBy(bucket(F.col(EPOCH)).alias("bucket")).agg(F.min(emission).alias("__first"))
    buckets = stamped.filter(~late).select(bucket(F.col(TS)).alias("bucket")).distinct()
    reach = buckets.join(firsts, "bucket", "full").select("bucket", F.min("__first").over(Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)).alias("__reach"))
    records = nexts.filter(~late).withColumn("bucket", bucket(F.col(TS))).join(reach, "bucket")
    close = F.when(F.col("__reach.at") >= F.col(SEQ), F.col("__reach")).when(F.col("__reach").isNotNull(), F.col("__next"))
    grouped = records.withColumn("__close", close).groupBy(KEY, "bucket", "__close").agg(*aggregates)
    return grouped.withColumn("closed_at", F.col("__close.epoch")).drop("__close")
