"""Functions that choose a worker for a key, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_select(key: Column, workers: int) -> Column:
    """The key's remainder; keys must be integers."""
    return F.pmod(key.cast("long"), F.lit(workers).cast("long"))


def rendezvous_select(key: Column, workers: list[int] | int) -> Column:
    """Highest random weight: of all workers, the one whose hash with the key is greatest.

    If a worker comes or goes, only keys that it gains or held move.
    """
    names = list(range(workers)) if isinstance(workers, int) else workers
    weights = F.array(*[F.struct(F.xxhash64(key, F.lit(w).cast("long")).alias("weight"), F.lit(w).cast("long").alias("worker")) for w in names])
    return F.array_max(weights)["worker"]


def isolate_hot(key: Column, hot: list, workers: int) -> Column:
    """Each hot key gets a worker of its own, the first ones; the other keys share the rest by remainder."""
    rest = workers - len(hot)
    if rest < 1:
        raise ValueError("there must be more workers than hot keys")
    out = F.lit(len(hot)).cast("long") + F.pmod(key.cast("long"), F.lit(rest).cast("long"))
    for i, k in reversed(list(enumerate(hot))):
        out = F.when(key == k, F.lit(i).cast("long")).otherwise(out)
    return out
