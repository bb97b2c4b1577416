"""Operators with a callback for each kind of message: records, epochs, and being scheduled.

A worker is a partition.  It gets its keys' records and all epochs, in the order of arrival, an epoch behind the record that
caused it, and at the end of a bounded stream the greatest timestamp of its type as the last epoch.  A stateful logic sees
all states of its worker's keys at each epoch, as keys share nothing else; they are held in memory, one value a key.

Epochs go to all workers, so a stream of many epochs costs workers times epochs; that is so by the callback's nature.  Records
go to one worker, in one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.context import OperatorContext
from ..functions.times import maximum
from ..stream import EPOCH, EPOCH_BEFORE, KEY, RANGE, SEQ, TS, Stream

ROUTE, KIND = "__route", "__kind"
DATA, EPOCH_MESSAGE = 0, 1


@dataclass(frozen=True)
class BuildContext:
    """What a logic knows when it is built on a worker: where it is, who else there is, and the state it is to begin with."""

    worker_id: int
    workers: int
    operator: str
    state: object = None

    def worker_ids(self) -> range:
        return range(self.workers)

    def load_state(self):
        """The state of this worker from an earlier snapshot, or None."""
        return self.state


class StatelessLogic:
    """Any number of records for each record or epoch."""

    def build(self, context: BuildContext) -> None:
        pass

    def on_data(self, record: dict, context: OperatorContext) -> Iterable[dict]:
        return ()

    def on_epoch(self, epoch, context: OperatorContext) -> Iterable[dict]:
        return ()

    def on_schedule(self, context: OperatorContext) -> Iterable[dict]:
        """Called before each batch of messages."""
        return ()


class StatefulLogic:
    """Any number of records for each record, epoch or schedule, with a state for each key.

    ``on_data`` returns (records, state); a key without a state starts from the default, a state of None is dropped.
    ``on_epoch`` and ``on_schedule`` get all of the worker's states and may change or delete them.
    """

    def default(self):
        return None

    def build(self, context: BuildContext) -> None:
        pass

    def on_data(self, key, record: dict, state) -> tuple[Iterable[dict], object]:
        raise NotImplementedError

    def on_epoch(self, epoch, states) -> Iterable[dict]:
        return ()

    def on_schedule(self, states) -> Iterable[dict]:
        return ()


def deliver(logic: StatefulLogic, message: dict, states) -> Iterable[dict]:
    """What a logic makes of one message, which changes states."""
    kind = message.pop(KIND)
    message.pop(ROUTE, None)
    if kind == EPOCH_MESSAGE:
        return logic.on_epoch(message[EPOCH], states)
    key = message[KEY]
    state = states.pop(key, None)
    records, state = logic.on_data(key, message, logic.default() if state is None else state)
    if state is not None:
        states[key] = state
    return records


def messages(stream: Stream, route: Column, workers: int) -> DataFrame:
    """The stream's records, each with its worker, and its epochs, each once for every worker; one pass."""
    df = stream.df.drop(RANGE)
    own = F.struct(route.cast("int").alias("to"), F.lit(DATA).alias("kind"))
    to = F.array(own)
    if EPOCH in df.columns:
        moved = F.col(EPOCH).isNotNull() & (F.col(EPOCH_BEFORE).isNull() | (F.col(EPOCH) > F.col(EPOCH_BEFORE)))
        every = F.transform(F.sequence(F.lit(0), F.lit(workers - 1)), lambda w: F.struct(w.alias("to"), F.lit(EPOCH_MESSAGE).alias("kind")))
        to = F.when(moved, F.concat(to, every)).otherwise(to)
    is_data = F.col("__to.kind") == DATA
    kept = [F.when(is_data, F.col(f"`{c}`")).alias(c) if c not in (SEQ, EPOCH) else F.col(c) for c in df.columns]
    return df.withColumn("__to", F.explode(to)).select(*kept, F.col("__to.to").alias(ROUTE), F.col("__to.kind").alias(KIND))


def _run(stream: Stream, workers: int | None, route: Callable[[int], Column], function: Callable, schema: str | StructType) -> Stream:
    """Applies function(batches, last epoch) to each worker's messages, in order."""
    stream.need(SEQ)
    n = workers or int(stream.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    returned = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow, last = to_arrow_schema(returned), maximum(stream.df.schema[TS].dataType) if stream.timed else None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in function((part.to_pylist() for part in parts), last, n):
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    dealt = messages(stream, route(n), n).repartitionById(n, ROUTE).sortWithinPartitions(SEQ, KIND)
    return replace(stream, df=dealt.mapInArrow(run, returned))


def stateful_op(stream: Stream, logic: StatefulLogic, schema: str | StructType, workers: int | None = None, name: str = "stateful_op", states: dict[int, dict] | None = None) -> Stream:
    """Runs a stateful logic on a bounded keyed stream.  states: of each worker, the states to begin with, by key."""
    stream.need(KEY)

    def run(batches, last, n):
        worker = TaskContext.get().partitionId()
        held = dict((states or {}).get(worker) or {})
        logic.build(BuildContext(worker, n, name, held or None))
        for batch in batches:
            out = list(logic.on_schedule(held))
            for message in batch:
                out.extend(deliver(logic, message, held))
            yield out
        if last is not None:
            yield list(logic.on_epoch(last, held))

    return _run(stream, workers, lambda n: F.pmod(F.xxhash64(KEY), F.lit(n)), run, schema)


def stateless_logic(stream: Stream, logic: StatelessLogic, schema: str | StructType, workers: int | None = None, name: str = "stateless_op", state: object = None) -> Stream:
    """Runs a stateless logic on a bounded stream: records by key if there is one, else dealt out evenly."""

    def run(batches, last, n):
        worker = TaskContext.get().partitionId()
        context = OperatorContext(worker, TaskContext.get().stageId(), TaskContext.get().attemptNumber(), name)
        logic.build(BuildContext(worker, n, name, state))
        for batch in batches:
            out = list(logic.on_schedule(context))
            for message in batch:
                kind = message.pop(KIND)
                message.pop(ROUTE)
                out.extend(logic.on_epoch(message[EPOCH], context) if kind == EPOCH_MESSAGE else logic.on_data(message, context))
            yield out
        if last is not None:
            yield list(logic.on_epoch(last, context))

    return _run(stream, workers, lambda n: F.pmod(F.xxhash64(KEY if stream.keyed else SEQ), F.lit(n)), run, schema)


def built_by(stream: Stream, name: str, build: Callable[[BuildContext], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]], schema: str | StructType, state: object = None) -> Stream:
    """Appends an operator that is built on each worker: ``build(context)`` returns a function over the worker's batches."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        yield from build(BuildContext(task.partitionId(), task.numPartitions() if hasattr(task, "numPartitions") else 0, name, state))(parts)

    return stream.then(name, lambda df: df.mapInArrow(run, schema))
