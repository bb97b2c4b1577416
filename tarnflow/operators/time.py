"""Event time: timestamps, epochs, and what is late.

An epoch t promises that nothing with a timestamp up to t follows.  A record is on time if there is no epoch yet, or if
the epoch in force when it arrives is less than its timestamp; equality is late.  A candidate epoch counts only if it is
greater than all before it, and holds from the next record on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..plans.scan import Scan, scan
from ..stream import EPOCH, EPOCH_BEFORE, SEQ, TS, Stream


@dataclass(frozen=True)
class NeedsEpochs:
    """A stream whose timestamps are new and that has no epochs; it must be given some before anything else."""

    stream: Stream

    def generate_epochs(self, candidate: Column) -> tuple[Stream, Stream]:
        """(on time, late), for a generator that looks at the record alone: its candidates' running maximum is the epoch."""
        split = epochs(self.stream, candidate)
        late = F.coalesce(F.col(TS) <= F.col(EPOCH_BEFORE), F.lit(False))
        return replace(split, df=split.df.filter(~late)), replace(split, df=split.df.filter(late))

    def limit_out_of_orderness(self, bound) -> tuple[Stream, Stream]:
        """Epochs that stay ``bound`` behind the greatest timestamp so far."""
        return self.generate_epochs(limit_out_of_orderness(bound))

    def generate_epochs_by(self, generator: Callable[[dict, object], object | None]) -> tuple[Stream, Stream]:
        """For a generator (record, epoch before) -> candidate that looks at the last epoch.

        Every record depends on the one before, so this is one sequential pass over the whole stream, in one task; only
        the epoch is held.  Where a candidate can be said without the last epoch, use generate_epochs.
        """
        self.stream.need(SEQ, TS)
        kind = self.stream.df.schema[TS].dataType
        schema = StructType([*self.stream.df.schema.fields, StructField(EPOCH_BEFORE, kind), StructField(EPOCH, kind)])

        arrow = to_arrow_schema(schema)

        def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            epoch = None
            for part in parts:
                out = []
                for record in part.to_pylist():
                    before, candidate = epoch, generator(record, epoch)
                    if candidate is not None and (epoch is None or candidate > epoch):
                        epoch = candidate
                    out.append(record | {EPOCH_BEFORE: before, EPOCH: epoch})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

        df = self.stream.df.repartition(1).sortWithinPartitions(SEQ).mapInArrow(fold, schema)
        late, clock = F.coalesce(F.col(TS) <= F.col(EPOCH_BEFORE), F.lit(False)), object()
        return replace(self.stream, df=df.filter(~late), clock=clock), replace(self.stream, df=df.filter(late), clock=clock)


def assign_timestamps(stream: Stream, timestamp: Column) -> NeedsEpochs:
    """New timestamps; epochs of the old ones are dropped."""
    stream.need(SEQ)
    return NeedsEpochs(replace(stream, clock=None, df=stream.df.drop(EPOCH_BEFORE, EPOCH).withColumn(TS, timestamp)))


def limit_out_of_orderness(bound) -> Column:
    """A record's candidate epoch: its timestamp less the bound, a number or an interval column."""
    return F.col(TS) - (bound if isinstance(bound, Column) else F.lit(bound))


def epochs(stream: Stream, candidate: Column) -> Stream:
    """The stream with the epoch before and after each record, late ones included."""
    stream.need(SEQ, TS)
    return replace(stream, clock=object(), df=scan(stream.df, SEQ, {EPOCH_BEFORE: Scan("max", candidate, exclusive=True), EPOCH: Scan("max", candidate)}))


def frontier(stream: Stream) -> DataFrame:
    """Where epochs are emitted: the records' _seq and the epoch that is in force from then on."""
    stream.need(SEQ, EPOCH)
    moved = F.col(EPOCH).isNotNull() & (F.col(EPOCH_BEFORE).isNull() | (F.col(EPOCH) > F.col(EPOCH_BEFORE)))
    return stream.df.filter(moved).select(SEQ, F.col(EPOCH).alias("epoch"))


def inspect_frontier(stream: Stream) -> DataFrame:
    """The epochs that a stream sees, each once.  The closing epoch of a bounded stream, the greatest timestamp of its type,
    is not a row."""
    return frontier(stream).select("epoch").distinct()
