"""Snapshots of programs: versions of their operators' states, which count once they are committed.

A version is begun for each run, its number is the last committed one's and one, and what an earlier run left of it uncommitted
is overwritten.  States are tables of (part, state), a row a part, the state pickled.
"""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = "part string, state binary"


class PersistenceClient(ABC):
    """One version: what operators load from the version before, and persist in this one."""

    version: int

    @abstractmethod
    def load(self, operator: str) -> DataFrame | None: ...

    @abstractmethod
    def persist(self, operator: str, states: DataFrame) -> DataFrame:
        """Keeps the states; returns them as kept."""


class PersistenceBackend(ABC):
    @abstractmethod
    def last_committed(self) -> int | None: ...

    @abstractmethod
    def for_version(self, version: int) -> PersistenceClient: ...

    @abstractmethod
    def commit_version(self, version: int) -> None: ...

    def next(self) -> PersistenceClient:
        last = self.last_committed()
        return self.for_version(0 if last is None else last + 1)


class NoPersistence(PersistenceBackend):
    """Keeps nothing: every run begins anew."""

    class _Nothing(PersistenceClient):
        version = 0

        def load(self, operator: str) -> None:
            return None

        def persist(self, operator: str, states: DataFrame) -> DataFrame:
            return states

    def last_committed(self) -> None:
        return None

    def for_version(self, version: int) -> PersistenceClient:
        return self._Nothing()

    def commit_version(self, version: int) -> None:
        pass


class FolderBackend(PersistenceBackend):
    """Versions as folders below one that the driver and all executors share, in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def last_committed(self) -> int | None:
        path, fs = self._path("commits")
        return max((int(s.getPath().getName()) for s in fs.listStatus(path)), default=None) if fs.exists(path) else None

    def for_version(self, version: int) -> PersistenceClient:
        return _FolderVersion(self, version)

    def commit_version(self, version: int) -> None:
        path, fs = self._path(f"commits/{version}")
        fs.create(path, True).close()


class _FolderVersion(PersistenceClient):
    def __init__(self, backend: FolderBackend, version: int):
        self.backend, self.version = backend, version

    def load(self, operator: str) -> DataFrame | None:
        last = self.backend.last_committed()
        path, fs = self.backend._path(f"versions/{last}/{operator}")
        return self.backend.spark.read.schema(STATES).parquet(path.toString()) if last is not None and fs.exists(path) else None

    def persist(self, operator: str, states: DataFrame) -> DataFrame:
        path = f"{self.backend.folder}/versions/{self.version}/{operator}"
        states.write.mode("overwrite").parquet(path)
        return self.backend.spark.read.schema(STATES).parquet(path)


def with_states(df: DataFrame, part: str, client: PersistenceClient, operator: str) -> DataFrame:
    """df with the state that its part had, in ``state``; null where it had none."""
    known = client.load(operator)
    if known is None:
        return df.withColumn("state", F.lit(None).cast("binary"))
    return df.join(known.withColumnRenamed("part", "__known"), F.col(part) == F.col("__known"), "left").drop("__known")


def carried(client: PersistenceClient, operator: str, states: DataFrame) -> DataFrame:
    """states, and those of parts that had one and are not among them."""
    known = client.load(operator)
    return states if known is None else states.unionByName(known.join(states.select("part"), "part", "left_anti"))


def unpickled(states: DataFrame) -> dict:
    """The states of a table of few parts, on the driver."""
    rows: Iterable = states.collect()
    return {r["part"]: pickle.loads(bytes(r["state"])) for r in rows}
