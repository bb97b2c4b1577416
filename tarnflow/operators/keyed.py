"""Keys, and how keys are dealt out to workers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..stream import KEY, Stream


def key_local(stream: Stream, key: Column) -> Stream:
    """Sets the key; records stay where they are."""
    return replace(stream, df=stream.df.withColumn(KEY, key))


def key_distribute(stream: Stream, key: Column, workers: int | None = None, partitioner: Column | None = None) -> Stream:
    """Sets the key and sends each record to its key's partition.

    Without a partitioner the hash of the key decides; a partitioner is a column with the partition's number.  Operators
    that need a key together shuffle by themselves, so this is for sinks and for functions over whole partitions.
    """
    out = stream.df.withColumn(KEY, key)
    if partitioner is not None:
        if workers is None:
            raise ValueError("a partitioner needs the number of workers")
        return replace(stream, df=out.withColumn("__worker", partitioner.cast("int")).repartitionById(workers, "__worker").drop("__worker"))
    return replace(stream, df=out.repartition(workers, KEY) if workers else out.repartition(KEY))


def distribute(stream: Stream, workers: int | None = None, partitioner: Column | None = None) -> Stream:
    """Sends each record to the partition of the key that it has."""
    stream.need(KEY)
    return key_distribute(stream, F.col(KEY), workers, partitioner)


def unkey(stream: Stream) -> Stream:
    """Takes the key off."""
    return replace(stream, df=stream.df.drop(KEY))
