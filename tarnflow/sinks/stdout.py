"""Records as printed lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..stream import KEY, SEQ, TS, Stream


def formatted(stream: Stream, value: Column | str = "value") -> Column:
    """``{ key: .., value: .., timestamp: .. }``; text values are quoted, a stream without keys has ``NoKey``."""
    column = F.col(value) if isinstance(value, str) else value
    kind = stream.df.select(column.alias("v")).schema["v"].dataType.simpleString()
    shown = F.concat(F.lit('"'), column, F.lit('"')) if kind == "string" else column.cast("string")
    key = F.col(KEY).cast("string") if stream.keyed else F.lit("NoKey")
    time = F.col(TS).cast("string") if stream.timed else F.lit("NoTime")
    return F.concat(F.lit("{ key: "), F.coalesce(key, F.lit("null")), F.lit(", value: "), F.coalesce(shown, F.lit("null")), F.lit(", timestamp: "), F.coalesce(time, F.lit("null")), F.lit(" }"))


def print_records(stream: Stream, value: Column | str = "value") -> None:
    """Prints a bounded stream, in order of arrival."""
    lines = stream.df.withColumn("__line", formatted(stream, value))
    for row in (lines.orderBy(SEQ) if SEQ in lines.columns else lines).select("__line").toLocalIterator():
        print(row[0])


class StdOutSink:
    """``print_records`` as a sink of programs."""

    def __init__(self, value: Column | str = "value"):
        self.value = value

    def consume_stream(self, name: str, stream: Stream, client: object = None) -> None:
        print_records(stream, self.value)
