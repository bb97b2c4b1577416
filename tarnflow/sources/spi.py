"""Sources written in Python whose parts have a state of any kind, from which the next run goes on.

A run polls each part, in a task of its own, until it has nothing more for now; records and new states are written together and
count once the run's version is committed.  A part that is finished isn't polled again.
"""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..persistence import STATES, NoPersistence, PersistenceClient, carried, with_states
from ..plans.places import written
from ..stream import KEY, TS, Stream


class StreamSource(ABC):
    """Anything that becomes a stream."""

    @abstractmethod
    def into_stream(self, name: str, spark: SparkSession, client: PersistenceClient) -> Stream: ...


class StatefulSourcePartition(ABC):
    @abstractmethod
    def poll(self) -> tuple | None:
        """The next record, its timestamp (a long) first; or None if there is none for now."""

    @abstractmethod
    def snapshot(self):
        """The state from which the next run goes on."""

    def is_finished(self) -> bool:
        """Whether there will never be another record."""
        return False

    def suspend(self) -> None:
        """Called at the end of a run."""


class StatefulSource(StreamSource):
    """``schema`` describes the values; records get the part as _key and what poll says first as _ts."""

    schema = "value string"

    @abstractmethod
    def list_parts(self) -> list[str]: ...

    @abstractmethod
    def build_part(self, part: str, state) -> StatefulSourcePartition:
        """state: the part's last snapshot, or None."""

    def into_stream(self, name: str, spark: SparkSession, client: PersistenceClient | None = None) -> Stream:
        """The records that are there now."""
        client = client or NoPersistence().next()
        full = f"{KEY} string, {TS} long, {self.schema}"
        fields = [f.name for f in StructType.fromDDL(full).fields]
        arrow = to_arrow_schema(StructType.fromDDL(f"{full}, state binary"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, state in zip(batch.column("part").to_pylist(), batch.column("state").to_pylist(), strict=True):
                    finished, state = (False, None) if state is None else pickle.loads(state)
                    out = []
                    if not finished:
                        part = self.build_part(name, state)
                        while (record := part.poll()) is not None:
                            out.append(dict(zip(fields, (name, *record), strict=True)))
                            if len(out) == 4096:
                                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                                out = []
                        finished, state = part.is_finished(), part.snapshot()
                        part.suspend()
                    out.append({KEY: name, "state": pickle.dumps((finished, state))})
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

        names = self.list_parts()
        parts = spark.createDataFrame([(i, p) for i, p in enumerate(names)], "place int, part string")
        dealt = with_states(parts, "part", client, name).repartitionById(max(1, len(names)), "place")
        made = written(dealt.select("part", "state").mapInArrow(run, f"{full}, state binary"), f"source-{name}")
        states = made.where("state is not null").select(F.col(KEY).alias("part"), "state")
        client.persist(name, carried(client, name, states))
        return Stream(made.where("state is null").drop("state"))


class LinesOfFiles(StatefulSource):
    """Lines of text files that may grow: a file is a part, a line's number its timestamp.

    The state is the byte and the number of the next line.  A last line without an end is read only with ``closed``,
    which says that files don't grow any more.
    """

    def __init__(self, *paths: str, closed: bool = False):
        self.paths, self.closed = paths, closed

    def list_parts(self) -> list[str]:
        return list(self.paths)

    def build_part(self, part: str, state) -> StatefulSourcePartition:
        return _Lines(part, state or (0, 0), self.closed)


class _Lines(StatefulSourcePartition):
    def __init__(self, path: str, state: tuple[int, int], closed: bool):
        fs, base = pafs.FileSystem.from_uri(path)
        (self.at, self.number), self.closed = state, closed
        self.source = fs.open_input_file(base)
        self.source.seek(self.at)
        self.rest, self.lines = b"", iter(())

    def poll(self) -> tuple | None:
        while True:
            line = next(self.lines, None)
            if line is not None:
                self.at += len(line)
                self.number += 1
                return self.number - 1, line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
            chunk = self.source.read(1 << 20)
            if chunk:
                whole, end, self.rest = (self.rest + chunk).rpartition(b"\n")
                self.lines = iter((whole + end).splitlines(keepends=True) if b"\r" not in whole else [x + b"\n" for x in whole.split(b"\n")] if end else [])
            elif self.rest and self.closed:
                self.lines, self.rest = iter([self.rest]), b""
            else:
                return None

    def snapshot(self) -> tuple[int, int]:
        return self.at, self.number

    def is_finished(self) -> bool:
        return self.closed

    def suspend(self) -> None:
        self.source.close()


__all__ = ["STATES", "LinesOfFiles", "StatefulSource", "StatefulSourcePartition", "StreamSource"]
