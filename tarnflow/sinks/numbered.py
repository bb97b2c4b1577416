"""A sink with a state for each part: its line counter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..plans.scan import numbered
from ..stream import SEQ, Stream


def line_numbers(stream: Stream, part: Column, name: str = "line_no") -> DataFrame:
    """The records with their part and their 0-based place among its records, in the order of arrival."""
    stream.need(SEQ)
    return numbered(stream.df.withColumn("part", part), SEQ, name, keys=("part",))
