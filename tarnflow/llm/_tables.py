"""Reading tables, numbering documents, and where intermediate results are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.places import shared_dir, work_dir, written

__all__ = ["NULL_ID", "bound_batches", "discard", "keyed", "shared_dir", "table", "work_dir", "written"]

NULL_ID = -(1 << 63)  # stands for a null document id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes that Spark hands to Python at once.  Spark's own default is 10,000 rows, whatever their size: of long
#: texts that is too much for an executor's memory, once on either side.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, unless they are smaller already.  Every operator calls this."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, most)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tarnflow/" in path:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> tuple[DataFrame, bool]:
    """doc (a unique long in the order of the ids), id, text; and whether doc is the id itself (NULL_ID where that is null).

    The ids themselves, where they are unique, which one pass over the id column tells.  Otherwise documents are
    numbered in order of id, of a hash of the text, and of their place in the input, and written, so that the numbers stay.
    Rows of one id, and even equal rows, may so go to several tasks.  With carry, the other columns come along as a struct,
    rest.
    """
    bound_batches(docs.sparkSession)
    others = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)] or [F.lit(None).cast("int").alias("none")]).alias("rest")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *others)
    key = F.coalesce("id", F.lit(NULL_ID))
    rows = rows.withColumn("doc", key)
    if rows.groupBy("doc").agg(F.count("*").alias("n"), F.count("id").alias("named")).where(f"n > 1 or (doc = {NULL_ID} and named > 0)").isEmpty():
        return rows, True
    # Only these three columns are sampled for the ranges' bounds.
    order = ["id", "__hash", "__place"]
    ordered = rows.withColumns({"__hash": F.xxhash64("text"), "__place": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order).drop("__hash", "__place")
    return written(ordered.withColumn("doc", F.monotonically_increasing_id()), "numbered"), False
