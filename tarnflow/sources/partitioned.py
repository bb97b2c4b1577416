"""Sources written in Python: partitions that are polled, with or without a state to resume from.

A ``PartitionedSource`` lists partitions and reads each; it is a batch source.  A ``StatefulPartitionedSource`` also says
how far each partition has come, and reads between two such states; it is a streaming source, whose states are the
offsets that the query's checkpoint keeps.  The key of a record is its partition.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class PartitionedSource(ABC):
    """Bounded.  ``schema`` describes the values; records get the partition's name as _key and their place in it as _ts."""

    schema: str = "value string"

    @abstractmethod
    def partitions(self) -> list[str]: ...

    @abstractmethod
    def read(self, partition: str) -> Iterator[tuple]: ...


class StatefulPartitionedSource(ABC):
    """Unbounded.  A partition's state is a number: how many of its records were read."""

    schema: str = "value long"

    @abstractmethod
    def partitions(self) -> list[str]: ...

    @abstractmethod
    def available(self, partition: str) -> int:
        """How many records the partition has by now."""

    @abstractmethod
    def read_between(self, partition: str, start: int, end: int) -> Iterator[tuple]: ...

    def committed(self, states: dict[str, int]) -> None:
        """Everything before these states is durable."""


class _Part(InputPartition):
    def __init__(self, name: str, start: int = 0, end: int = 0):
        super().__init__(name)
        self.name, self.start, self.end = name, start, end


class _Reader(DataSourceReader):
    def __init__(self, source: PartitionedSource):
        self.source = source

    def partitions(self):
        return [_Part(p) for p in self.source.partitions()]

    def read(self, partition):
        for i, record in enumerate(self.source.read(partition.name)):
            yield (partition.name, i, *record)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, source: StatefulPartitionedSource):
        self.source = source

    def initialOffset(self):
        return {p: 0 for p in self.source.partitions()}

    def latestOffset(self):
        return {p: self.source.available(p) for p in self.source.partitions()}

    def partitions(self, start, end):
        return [_Part(p, start.get(p, 0), e) for p, e in end.items() if e > start.get(p, 0)]

    def read(self, partition):
        for i, record in enumerate(self.source.read_between(partition.name, partition.start, partition.end)):
            yield (partition.name, partition.start + i, *record)

    def commit(self, end):
        self.source.committed(end)


def register(spark: SparkSession, name: str, source: PartitionedSource | StatefulPartitionedSource) -> None:
    """Makes the source known as a format: ``spark.read.format(name)`` or ``spark.readStream.format(name)``."""
    full = f"_key string, _ts long, {source.schema}"

    class Registered(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return full

        def reader(self, schema):
            if not isinstance(source, PartitionedSource):
                raise TypeError(f"{name} is a streaming source")
            return _Reader(source)

        def streamReader(self, schema):
            if not isinstance(source, StatefulPartitionedSource):
                raise TypeError(f"{name} is a bounded source")
            return _StreamReader(source)

    spark.dataSource.register(Registered)


class CounterSource(StatefulPartitionedSource):
    """Counts up to a limit that a file holds, so that it can be moved between runs."""

    schema = "value long"

    def __init__(self, limit_file: str, parts: int = 1):
        self.limit_file, self.parts = limit_file, parts

    def partitions(self):
        return [str(i) for i in range(self.parts)]

    def available(self, partition):
        with open(self.limit_file) as f:
            return int(json.load(f))

    def read_between(self, partition, start, end):
        for i in range(start, end):
            yield (i,)
