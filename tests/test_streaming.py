"""Unbounded runs agree with bounded ones, and resume where they stopped."""

import json

import pytest
from pyspark.sql import functions as F

from tarnflow import operators as ops
from tarnflow.sources import KafkaSource, PartitionedSource, file_lines, from_iterable, register
from tarnflow.sources.partitioned import CounterSource
from tarnflow.sinks import KafkaSink, write_by_key
from tarnflow.stream import EPOCH, EPOCH_BEFORE, KEY, SEQ, TS, Stream
from tarnflow.streaming import committed_version, keyed_fold, run_available, stamp_epochs, state_of, versions
from tarnflow.streaming.operators import count_batches, open_state, split_late


def _arrivals(spark, folder):
    return Stream(spark.readStream.schema("_seq long, _ts long, _key long, value long").option("maxFilesPerTrigger", 1).parquet(folder))


def _write(spark, folder, rows):
    spark.createDataFrame(rows, "_seq long, _ts long, _key long, value long").coalesce(1).write.mode("append").parquet(folder)


def test_fold_resumes_and_agrees_with_bounded(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    rows = [(i, i, i % 3, i * i % 17) for i in range(40)]
    step = lambda key, record, state: ({"_key": key, "_seq": record["_seq"], "total": state + record["value"]}, state + record["value"])
    schema = "_key long, _seq long, total long"
    for part in (rows[:15], rows[15:40]):
        _write(spark, source, part)
        run_available(keyed_fold(_arrivals(spark, source), step, schema, int), checkpoint, out)
    got = sorted(map(tuple, spark.read.parquet(out).select("_key", "_seq", "total").collect()))
    bounded = ops.fold(Stream(spark.createDataFrame(rows, "_seq long, _ts long, _key long, value long")), step, schema, int)
    assert got == sorted(map(tuple, bounded.df.collect()))
    assert committed_version(spark, checkpoint) == max(versions(spark, checkpoint)) >= 1
    assert state_of(spark, checkpoint).count() == 3


def test_epochs_are_stamped_record_by_record(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    times = [1, 5, 12, 18, 9, 25, 44, 24, 40, 45]
    rows = [(i, t, 0, t) for i, t in enumerate(times)]
    for part in (rows[:3], rows[3:6], rows[6:]):
        _write(spark, source, part)
        run_available(stamp_epochs(_arrivals(spark, source), lambda r, epoch: r["_ts"] - 5), checkpoint, out)
    stamped = spark.read.parquet(out)
    bounded = ops.epochs(Stream(spark.createDataFrame(rows, "_seq long, _ts long, _key long, value long")), F.col(TS) - 5)
    columns = [SEQ, TS, EPOCH_BEFORE, EPOCH]
    assert sorted(map(tuple, stamped.select(*columns).collect()), key=str) == sorted(map(tuple, bounded.df.select(*columns).collect()), key=str)
    on_time, late = split_late(Stream(stamped))
    assert sorted(r[TS] for r in late.df.collect()) == [9, 24] and on_time.df.count() == 8


def test_open_batches_are_in_the_state(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    _write(spark, source, [(i, i, i % 2, i) for i in range(7)])
    run_available(count_batches(_arrivals(spark, source), 3, "value"), checkpoint, out)
    assert sorted(r["values"] for r in spark.read.parquet(out).collect()) == [[0, 2, 4], [1, 3, 5]]
    left = open_state(state_of(spark, checkpoint).select(F.col("key.*"), F.col("value.value").alias("state"))).collect()
    assert [r["state"] for r in left] == ["[6]"]


def test_counter_source_resumes(spark, tmp_path):
    limit, out, checkpoint = tmp_path / "limit", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    register(spark, "counter_for_tests", CounterSource(str(limit), 2))
    seen = []
    for n in (11, 16):
        limit.write_text(json.dumps(n))
        run_available(Stream(spark.readStream.format("counter_for_tests").load()), checkpoint, out)
        seen.append(sorted(r["value"] for r in spark.read.parquet(out).where("_key = '0'").collect()))
    assert seen == [list(range(11)), list(range(16))]


def test_bounded_partitions(spark):
    class Letters(PartitionedSource):  # here, so that it is sent along: executors don't have this module
        schema = "value string"

        def partitions(self):
            return ["ab", "cde"]

        def read(self, partition):
            for letter in partition:
                yield (letter,)

    register(spark, "letters_for_tests", Letters())
    rows = spark.read.format("letters_for_tests").load().collect()
    assert sorted((r[KEY], r[TS], r["value"]) for r in rows) == [("ab", 0, "a"), ("ab", 1, "b"), ("cde", 0, "c"), ("cde", 1, "d"), ("cde", 2, "e")]


def test_file_lines_and_files_by_key(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("three")
    rows = file_lines(spark, f"{tmp_path}/a.txt", f"{tmp_path}/b.txt").df.collect()
    assert sorted((r[KEY].rsplit("/", 1)[1], r[TS], r["value"]) for r in rows) == [("a.txt", 0, "one"), ("a.txt", 1, "two"), ("b.txt", 0, "three")]
    write_by_key(from_iterable(spark, range(10)).key_local(F.col("value") % 2), f"{tmp_path}/out", F.col("value").cast("string"))
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/out/_key=1").collect()) == ["1", "3", "5", "7", "9"]


def test_kafka_options():
    source = KafkaSource().broker("a:1").broker("b:2").topic("t").group_id("g").auto_offset_reset("earliest").conf("fetch.min.bytes", "9")
    options = source.options()
    assert options["kafka.bootstrap.servers"] == "a:1,b:2" and options["startingOffsets"] == "earliest" and options["kafka.fetch.min.bytes"] == "9"
    for lacking in (KafkaSource(), KafkaSource().broker("a"), KafkaSource().broker("a").topic("t")):
        with pytest.raises(ValueError, match="lacking"):
            lacking.options()
    with pytest.raises(ValueError):
        KafkaSink().options()
    assert KafkaSink().broker("a:1").group_id("g").conf("acks", "all").options()["kafka.acks"] == "all"
