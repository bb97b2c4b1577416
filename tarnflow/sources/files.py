"""Lines of text files: a file is a partition, a line's number its timestamp."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..stream import KEY, SEQ, TS, Stream


def file_lines(spark: SparkSession, *paths: str) -> Stream:
    """_key: the file; _ts and _seq: the 0-based line; value: the text.

    Large files are read in blocks, by many tasks.  Lines are numbered within their block, and blocks by what comes before them in
    their file, which takes a row a block.
    """
    read = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias(KEY), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__place"), "value")
    before = Window.partitionBy("__file").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    blocks = read.groupBy(F.col(KEY).alias("__file"), F.col("__block").alias("__of")).count().select("__file", "__of", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(KEY, "__block").orderBy("__place")) - 1
    lines = read.withColumn("__nth", nth).join(blocks, (F.col(KEY) == F.col("__file")) & (F.col("__block") == F.col("__of")))
    return Stream(lines.select(KEY, (F.col("__nth") + F.col("__before")).cast("long").alias(TS), "value").withColumn(SEQ, F.col(TS)))


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> Stream:
    """New files of a folder as an unbounded stream of lines; which files were read is kept in the query's checkpoint."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return Stream(reader.load(path).withColumn(KEY, F.input_file_name()))


def numbered_within(df, order: str):
    """Lines numbered within their file, for sources that have an order column."""
    return df.withColumn(TS, F.row_number().over(Window.partitionBy(KEY).orderBy(order)) - 1)
