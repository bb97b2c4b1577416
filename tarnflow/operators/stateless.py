"""Record-at-a-time operators.  Keys, timestamps and the order of arrival stay as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.context import OperatorContext, operator_context
from ..stream import EPOCH, EPOCH_BEFORE, KEY, RANGE, SEQ, TS, Stream

_ENVELOPE = (KEY, TS, SEQ, EPOCH_BEFORE, EPOCH, RANGE)


def _envelope(stream: Stream) -> list[str]:
    return [c for c in _ENVELOPE if c in stream.df.columns]


def map_values(stream: Stream, *columns: Column | str, **named: Column) -> Stream:
    """New values for each record: exactly the columns given."""
    return replace(stream, df=stream.df.select(*_envelope(stream), *columns, *[c.alias(n) for n, c in named.items()]))


def filter_rows(stream: Stream, predicate: Column | str) -> Stream:
    """The records for which the predicate holds; null drops the record."""
    return replace(stream, df=stream.df.filter(predicate))


def filter_map(stream: Stream, *columns: Column | str, **named: Column) -> Stream:
    """New values for each record, unless one of the named ones is null."""
    out = map_values(stream, *columns, **named)
    return replace(out, df=out.df.dropna(subset=list(named)) if named else out.df)


def flatten(stream: Stream, array: Column | str, name: str = "value", keep: tuple[str, ...] = ()) -> Stream:
    """A record for each element of an array, with the array's key and time; empty arrays and nulls give none.

    The elements' order within a record goes to ``_at`` if there is an order of arrival.
    """
    column = F.col(array) if isinstance(array, str) else array
    if SEQ in stream.df.columns:
        return replace(stream, df=stream.df.select(*_envelope(stream), *keep, F.posexplode(column).alias("_at", name)))
    return replace(stream, df=stream.df.select(*_envelope(stream), *keep, F.explode(column).alias(name)))


def inspect(stream: Stream, observation: Observation | str, *metrics: Column) -> Stream:
    """Measures what passes, and passes it on unchanged.  A plan that reads the stream twice, as a global sort does to find
    its ranges, measures it twice."""
    return replace(stream, df=stream.df.observe(observation, *(metrics or (F.count(F.lit(1)).alias("records"),))))


def inspect_each(stream: Stream, function: Callable[[dict, OperatorContext], None]) -> Stream:
    """Calls a Python function with each record, on the executors, and passes all on unchanged.

    A retried task calls it again, as does each action; for counts use inspect.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = operator_context()
        for part in parts:
            for record in part.to_pylist():
                function(record, context)
            yield part

    return replace(stream, df=stream.df.mapInArrow(run, stream.df.schema))


def stateless_op(stream: Stream, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | StructType) -> Stream:
    """Any number of records for each, by a Python function over Arrow batches, for what columns can't express.

    The function gets all columns of the stream and gives those of the schema, which should keep the envelope's.
    """
    return replace(stream, df=stream.df.mapInPandas(function, schema))
