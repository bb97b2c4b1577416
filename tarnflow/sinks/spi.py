"""Sinks written in Python: a call for each record, with or without a state for each part.

Tasks that are tried again call anew, so what a sink does outside should bear repetition; states are kept only if the run ends.
"""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.context import OperatorContext, operator_context
from ..persistence import STATES, NoPersistence, PersistenceClient, carried, with_states
from ..plans.places import written
from ..stream import RANGE, SEQ, Stream


class StreamSink(ABC):
    """Anything that takes a whole stream."""

    @abstractmethod
    def consume_stream(self, name: str, stream: Stream, client: PersistenceClient) -> None: ...


class StatelessSink(StreamSink):
    """A call for each record, in the order of arrival within each task."""

    def open(self, context: OperatorContext) -> None:
        pass

    @abstractmethod
    def sink(self, record: dict) -> None: ...

    def close(self) -> None:
        pass

    def consume_stream(self, name: str, stream: Stream, client: PersistenceClient | None = None) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            self.open(operator_context())
            n = 0
            for batch in batches:
                for record in batch.to_pylist():
                    self.sink(record)
                n += batch.num_rows
            self.close()
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

        df = stream.df.drop(RANGE)
        (df.sortWithinPartitions(SEQ) if SEQ in df.columns else df).mapInArrow(run, "n long").agg(F.sum("n")).collect()


class StatefulSinkPartition(ABC):
    """One part: takes its records in the order of arrival, and says what to begin with next time."""

    @abstractmethod
    def sink(self, record: dict) -> None: ...

    @abstractmethod
    def snapshot(self): ...

    def close(self) -> None:
        pass


class StatefulSink(StreamSink):
    """Deals records to parts, each of which one task holds, with a state that lasts from run to run."""

    @abstractmethod
    def assign_part(self) -> Column:
        """A record's part, a text."""

    @abstractmethod
    def build_part(self, part: str, state) -> StatefulSinkPartition:
        """state: what the part's last snapshot was, or None."""

    def consume_stream(self, name: str, stream: Stream, client: PersistenceClient | None = None) -> None:
        client = client or NoPersistence().next()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, held = None, None

            def finished() -> pa.RecordBatch:
                held.close()
                return pa.RecordBatch.from_pydict({"part": [part], "state": pa.array([pickle.dumps(held.snapshot())], pa.binary())})

            for batch in batches:
                for record in batch.to_pylist():
                    own, state = record.pop("__part"), record.pop("state")
                    if held is None or own != part:
                        if held is not None:
                            yield finished()
                        part, held = own, self.build_part(own, None if state is None else pickle.loads(state))
                    held.sink(record)
            if held is not None:
                yield finished()

        placed = stream.df.drop(RANGE).withColumn("__part", self.assign_part())
        order = ["__part", SEQ] if SEQ in placed.columns else ["__part"]
        rows = with_states(placed, "__part", client, name)
        made = written(rows.repartition("__part").sortWithinPartitions(*order).mapInArrow(run, STATES), f"sink-{name}")
        client.persist(name, carried(client, name, made))


class NumberedFiles(StatefulSink):
    """Text files of numbered lines, one for each part and run; numbers go on where the last run's ended.

    ``part`` is an SQL expression.  A file is written under its run's name and replaced by a task that is tried again.
    """

    def __init__(self, folder: str, part: str, value: str = "value", run: str = "0"):
        self.folder, self.part, self.value, self.run = folder.rstrip("/"), part, value, run

    def assign_part(self) -> Column:
        return F.expr(self.part).cast("string")

    def build_part(self, part: str, state) -> StatefulSinkPartition:
        return _NumberedFile(f"{self.folder}/{part}", self.run, self.value, state or 0)


class _NumberedFile(StatefulSinkPartition):
    def __init__(self, folder: str, run: str, value: str, number: int):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        self.out, self.value, self.number = fs.open_output_stream(f"{base}/{run}.txt"), value, number

    def sink(self, record: dict) -> None:
        self.out.write(f"{self.number} {record[self.value]}\n".encode())
        self.number += 1

    def snapshot(self) -> int:
        return self.number

    def close(self) -> None:
        self.out.close()
