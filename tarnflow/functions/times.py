"""Bounds and merging of timestamps, for every type that orders records."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _bounds(kind: T.DataType) -> tuple:
    for integer, bits in _BITS.items():
        if isinstance(kind, integer):
            return -(1 << bits - 1), (1 << bits - 1) - 1
    if isinstance(kind, T.DecimalType) and kind.scale == 0:
        return -(10**kind.precision) + 1, 10**kind.precision - 1
    if isinstance(kind, T.DateType):
        return datetime.date.min, datetime.date.max
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return datetime.datetime.min, datetime.datetime.max
    raise TypeError(f"{kind.simpleString()} can't be a timestamp")


def minimum(kind: T.DataType):
    """The least timestamp of a type."""
    return _bounds(kind)[0]


def maximum(kind: T.DataType):
    """The greatest timestamp of a type: the epoch that ends a bounded stream."""
    return _bounds(kind)[1]


def merge(*epochs: Column) -> Column:
    """The frontier of several inputs: the least of their epochs, and null until each has one."""
    known = epochs[0].isNotNull()
    for e in epochs[1:]:
        known = known & e.isNotNull()
    return F.when(known, F.least(*epochs) if len(epochs) > 1 else epochs[0])


def try_int(text: Column) -> Column:
    """The integer that a text is, or null."""
    return text.try_cast("int")
