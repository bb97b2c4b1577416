"""A sink for tests: records in a list."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Row

from ..stream import RANGE, SEQ, Stream


class VecSink:
    """Holds the records given to it; iterating or draining takes them out."""

    def __init__(self):
        self.rows: deque[Row] = deque()

    def give(self, *rows: Row) -> None:
        self.rows.extend(rows)

    def collect(self, stream: Stream) -> VecSink:
        """Takes a bounded stream's records, in order of arrival if it has one."""
        df = stream.df.orderBy(SEQ) if SEQ in stream.df.columns else stream.df
        self.give(*df.drop(RANGE).toLocalIterator())
        return self

    def drain_vec(self, start: int = 0, stop: int | None = None) -> list[Row]:
        rows = list(self.rows)
        taken = rows[start:stop]
        del rows[start:stop]
        self.rows = deque(rows)
        return taken

    def consume_stream(self, name: str, stream: Stream, client: object = None) -> None:
        self.collect(stream)

    def __iter__(self):
        while self.rows:
            yield self.rows.popleft()

    def __len__(self) -> int:
        return len(self.rows)
