"""Text files, a folder for each key."""

from __future__ import annotations

from pyspark.sql import Column

from ..stream import KEY, SEQ, Stream


def write_by_key(stream: Stream, path: str, line: Column, mode: str = "errorifexists", one_file: bool = False) -> None:
    """Writes each record as a line below ``path/_key=...``, in order of arrival within a file.

    A key has a file for each task that holds its records; with ``one_file`` a single one, which one task writes.
    """
    stream.need(KEY)
    df = stream.df.withColumn("line", line)
    df = df.repartition(KEY) if one_file else df
    df = df.sortWithinPartitions(KEY, SEQ) if SEQ in df.columns else df
    df.select(KEY, "line").write.partitionBy(KEY).mode(mode).text(path)
