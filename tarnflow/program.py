"""Programs: sources, streams and sinks under names, which run together and begin where the last run was committed."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .persistence import NoPersistence, PersistenceBackend
from .sinks.spi import StreamSink
from .sources.spi import StreamSource
from .stream import Stream


class Program:
    """Every name is that of one source or sink.  A run is one version: it is committed once all sinks have taken their streams,
    so a run that fails begins again where the last committed one ended."""

    def __init__(self, spark: SparkSession, backend: PersistenceBackend | None = None):
        self.spark, self.backend = spark, backend or NoPersistence()
        self.client = self.backend.next()
        self.names: set[str] = set()
        self.streams: list[Stream] = []
        self.sinks: list[tuple[str, Stream, StreamSink]] = []

    def _new(self, name: str) -> None:
        if name in self.names:
            raise ValueError(f"there is an operator {name!r} already")
        self.names.add(name)

    def new_stream(self) -> EmptyStream:
        return EmptyStream(self)

    def sink(self, name: str, stream: Stream, sink: StreamSink) -> None:
        """Ends a stream in a sink, when the program runs.  A stream may have several, or none."""
        self._new(name)
        self.sinks.append((name, stream, sink))

    def run(self) -> int | None:
        """Runs all sinks; streams that were finished without one are run, too, and what they give is discarded.  Returns the
        version that was committed."""
        for name, stream, sink in self.sinks:
            sink.consume_stream(name, stream, self.client)
        for stream in self.streams:
            stream.df.write.format("noop").mode("overwrite").save()
        self.backend.commit_version(self.client.version)
        return self.backend.last_committed()

    def finish(self, stream: Stream) -> None:
        """Has a stream run though it has no sink."""
        self.streams.append(stream)


class EmptyStream:
    """A stream without records or operators, to which one source is attached."""

    def __init__(self, program: Program):
        self.program, self.used = program, False

    def source(self, name: str, source: StreamSource) -> Stream:
        if self.used:
            raise ValueError("the stream has a source already")
        self.program._new(name)
        self.used = True
        return source.into_stream(name, self.program.spark, self.program.client)
