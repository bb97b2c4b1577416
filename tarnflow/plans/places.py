"""Where intermediate tables, checkpoints and results of unbounded runs go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []  # the folder of a session that runs within one process and has none
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.  Where that is unset, a session that runs
    within one process (as tests do) gets a temporary folder; on a cluster that is an error."""
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _local:
            _local.append(f"file://{tempfile.mkdtemp(prefix='tarnflow-')}")
        place = _local[0]
    return place.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for this application; all of them can be deleted with their parent once the application has ended."""
    return f"{shared_dir(spark)}/tarnflow/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read back: cuts the lineage and survives lost executors.

    The shuffle files of the job are deleted when it ends, since nothing reads them after that.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
