"""Bounded sources: tables in a declared order of arrival, and Python iterables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scan import numbered, ranges
from ..stream import SEQ, TS, Stream


def from_iterable(spark: SparkSession, values: Iterable, schema: str = "value long") -> Stream:
    """A record for each value (or tuple), without a key; timestamps are the 0-based places."""
    rows = [(i, i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    return Stream(spark.createDataFrame(rows, f"{SEQ} long, {TS} long, {schema}"))


def from_table(df: DataFrame, order: Column | str | None = None, then: tuple[str, ...] = (), dense: bool = True) -> Stream:
    """A table as a bounded stream, arriving in the order given (and by ``then`` where that is equal).

    With ``dense`` arrival numbers are consecutive from 0 and are the timestamps until others are assigned; it takes a
    scan.  Otherwise the order column, which must then be unique, is the arrival number itself.
    """
    if order is None:
        return Stream(df)
    column = F.col(order) if isinstance(order, str) else order
    if not dense:
        return Stream(ranges(df.withColumn(SEQ, column.cast("long")), SEQ))
    placed = ranges(df.withColumn("__order", column), "__order")  # ranges of the order are ranges of the numbers, too
    return Stream(numbered(placed, "__order", SEQ, then).drop("__order").withColumn(TS, F.col(SEQ)))
