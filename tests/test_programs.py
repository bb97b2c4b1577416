"""Logics that see epochs, unions that merge them, and programs whose sources and sinks go on where they were committed."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tarnflow import operators as ops
from tarnflow.operators import BuildContext, StatefulLogic, StatelessLogic
from tarnflow.operators.logic import EPOCH_MESSAGE, KIND, deliver
from tarnflow.persistence import FolderBackend, NoPersistence, unpickled
from tarnflow.program import Program
from tarnflow.sinks import NumberedFiles, StatelessSink, VecSink
from tarnflow.sources import LinesOfFiles, StatefulSource, StatefulSourcePartition, from_iterable
from tarnflow.stream import EPOCH, EPOCH_BEFORE, KEY, SEQ, TS, Stream
from tarnflow.streaming import ended, run_available, stamp_epochs, stateful_op, ttl_fold

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors don't have this module
TIMES = [1, 5, 12, 18, 9, 25, 44, 24, 40, 45]


def _stream(spark, rows=None):
    rows = rows or [(i, t, t % 3, t) for i, t in enumerate(TIMES)]
    return Stream(spark.createDataFrame(rows, f"{SEQ} long, {TS} long, {KEY} long, value long"))


class _Open(StatefulLogic):
    """Collects values by key; an epoch gives those up to it, and the number of keys that are open; the first of each key is echoed."""

    def default(self):
        return []

    def on_data(self, key, record, state):
        return [] if state else [{"key": key, "what": "first", "value": record["value"]}], [*state, record["value"]]

    def on_epoch(self, epoch, states):
        out = []
        for key in list(states):
            out += [{"key": key, "what": "closed", "value": v} for v in states[key] if v <= epoch]
            states[key] = [v for v in states[key] if v > epoch]
            if not states[key]:
                del states[key]
        return out


def _expected(rows, workers_share_epochs=True):
    logic, states, out, epoch = _Open(), {}, [], None
    for seq, ts, key, value in rows:
        if epoch is None or ts > epoch:
            out += deliver(logic, {KEY: key, "value": value, KIND: 0}, states)
        if epoch is None or ts - 5 > epoch:
            epoch = ts - 5
            out += deliver(logic, {EPOCH: epoch, KIND: EPOCH_MESSAGE}, states)
    out += logic.on_epoch((1 << 63) - 1, states)
    return sorted((r["key"], r["what"], r["value"]) for r in out)


def test_a_stateful_logic_sees_records_and_epochs_in_order(spark):
    rows = [(i, t, t % 3, t) for i, t in enumerate(TIMES)]
    on_time, _ = ops.assign_timestamps(_stream(spark), F.col(TS)).limit_out_of_orderness(5)
    for workers in (1, 3):
        out = on_time.stateful_op(_Open(), "key long, what string, value long", workers).df.collect()
        assert sorted(map(tuple, out)) == _expected(rows)


def test_a_stateful_logic_on_an_unbounded_stream(spark, tmp_path):
    rows = [(i, t, t % 3, t) for i, t in enumerate(TIMES)]
    source, out, checkpoint, schema = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint", "key long, what string, value long"
    on_time, _ = ops.assign_timestamps(_stream(spark), F.col(TS)).limit_out_of_orderness(5)
    for part in (F.col(SEQ) < 4, F.col(SEQ) >= 4):
        on_time.df.drop("__range").where(part).coalesce(1).write.mode("append").parquet(source)
        read = spark.readStream.schema(on_time.df.drop("__range").schema).parquet(source)
        run_available(stateful_op(Stream(read), _Open(), schema, 2), checkpoint, out)
    got = spark.read.schema(schema).parquet(out).unionAll(ended(spark, checkpoint, _Open(), schema, (1 << 63) - 1))
    assert sorted(map(tuple, got.collect())) == _expected(rows)


def test_generators_see_the_last_epoch_on_unbounded_streams(spark, tmp_path):
    """Epochs that only ever go up by tens."""
    _stream(spark).df.coalesce(1).write.parquet(f"{tmp_path}/in")
    generator = lambda record, epoch: record[TS] if epoch is None or record[TS] >= epoch + 10 else None
    read = Stream(spark.readStream.schema(_stream(spark).df.schema).parquet(f"{tmp_path}/in"))
    run_available(stamp_epochs(read, generator), f"{tmp_path}/checkpoint", f"{tmp_path}/out")
    columns = [SEQ, EPOCH_BEFORE, EPOCH]
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*columns).collect()))
    on_time, late = ops.assign_timestamps(_stream(spark), F.col(TS)).generate_epochs_by(generator)
    assert got == sorted(map(tuple, on_time.df.select(*columns).unionAll(late.df.select(*columns)).collect()))
    assert [e for _, _, e in got] == [1, 1, 12, 12, 12, 25, 44, 44, 44, 44]


def test_expiring_state_on_unbounded_streams(spark, tmp_path):
    words = ["foo", "bar", "hello", "world", "baz"]

    def step(key, record, entries):
        entries = entries | {record[SEQ]: (record["value"], record[TS])}
        return {"joined": "|".join(v for _, (v, _) in sorted(entries.items()))}, entries

    stream = from_iterable(spark, words, "value string").key_local(F.lit(1).cast("long"))
    stamped = ops.epochs(stream.assign_timestamps(F.col(SEQ)).stream, F.col(TS))
    bounded = sorted((r[SEQ], r["joined"]) for r in stamped.ttl_fold(2, step, "joined string").df.collect())
    df = stamped.df.drop("__range")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    run_available(ttl_fold(Stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), 2, step, "joined string"), f"{tmp_path}/checkpoint", f"{tmp_path}/out")
    assert sorted((r[SEQ], r["joined"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == bounded
    assert bounded[-1][1] == "hello|world|baz"


class _Marks(StatelessLogic):
    def build(self, context: BuildContext):
        self.n = context.load_state() or 0

    def on_data(self, record, context):
        return [{"what": "data", "n": record["value"]}] * 2

    def on_epoch(self, epoch, context):
        self.n += 1
        return [{"what": f"epoch of {context.operator_id}", "n": self.n}]

    def on_schedule(self, context):
        return [{"what": "scheduled", "n": 0}]


def test_a_stateless_logic(spark):
    on_time, _ = ops.assign_timestamps(_stream(spark), F.col(TS)).limit_out_of_orderness(5)
    out = [tuple(r) for r in on_time.stateless_logic(_Marks(), "what string, n long", 1, "marks", 100).df.collect()]
    assert sorted(n for what, n in out if what == "data") == sorted(2 * [t for t in TIMES if t not in (9, 24)])
    assert [n for what, n in out if what == "epoch of marks"] == list(range(101, 109)) and ("scheduled", 0) in out


def test_operators_are_built_on_their_workers(spark):
    def build(context):
        assert context.load_state() == "kept" and context.operator == "tens"
        return lambda batches: (b.set_column(b.schema.get_field_index("value"), "value", b.column("value").cast("int64")) for b in batches)

    stream = _stream(spark)
    out = stream.built_by("tens", build, stream.df.schema, "kept")
    assert sorted(r["value"] for r in out.df.collect()) == sorted(TIMES)
    with pytest.raises(ValueError, match="already"):
        out.built_by("tens", build, stream.df.schema)


def test_unions_merge_epochs(spark):
    arrivals = [(0, 0, 10), (1, 1, 4), (2, 1, 12), (3, 0, 11), (4, 1, 20), (5, 0, 30)]
    parts = [ops.epochs(Stream(spark.createDataFrame([(s, t, t) for s, of, t in arrivals if of == i], f"{SEQ} long, {TS} long, value long")), F.col(TS)) for i in (0, 1)]
    met = parts[0].union(parts[1])
    assert [tuple(r) for r in met.df.select(EPOCH_BEFORE, EPOCH).orderBy(SEQ).collect()] == [(None, None), (None, 4), (4, 10), (10, 11), (11, 11), (11, 20)]
    assert sorted(r["epoch"] for r in met.inspect_frontier().collect()) == [4, 10, 11, 20]
    one, other = parts[0].const_split(F.col("value") > 10, F.col("value") <= 10)
    assert {(r[SEQ], r[EPOCH]) for r in one.union(other).df.collect()} == {(0, 10), (3, 11), (5, 30)}  # branches keep their epochs
    bare = Stream(spark.createDataFrame([(9, 9, 9)], f"{SEQ} long, {TS} long, value long"))
    assert {r[EPOCH] for r in parts[0].union(bare).df.collect()} == {None}
    assert parts[0].union(parts[1], parts[0].filter("value > 99")).df.count() == 6


def test_distribute_deals_by_the_key_there_is(spark):
    out = _stream(spark).distribute(3, F.col(KEY)).df.select(KEY, F.spark_partition_id().alias("p")).distinct().collect()
    assert sorted(map(tuple, out)) == [(0, 0), (1, 1), (2, 2)]


def test_lines_of_files_go_on_at_the_line(spark, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_bytes(b"one\r\ntwo\nthr")
    b.write_bytes(b"")
    backend, source = FolderBackend(spark, f"file://{tmp_path}/snapshots"), LinesOfFiles(f"file://{a}", f"file://{b}")

    def run(source, commit=True):
        client = backend.next()
        rows = source.into_stream("lines", spark, client).df.collect()
        if commit:
            backend.commit_version(client.version)
        return sorted((r[KEY].rsplit("/", 1)[1], r[TS], r["value"]) for r in rows)

    assert run(source) == [("a.txt", 0, "one"), ("a.txt", 1, "two")]
    a.write_bytes(b"one\r\ntwo\nthree\n\nfive\x0bsix")
    b.write_bytes(b"x\n")
    assert run(source, False) == run(source) == [("a.txt", 2, "three"), ("a.txt", 3, ""), ("b.txt", 0, "x")]
    closed = LinesOfFiles(f"file://{a}", f"file://{b}", closed=True)
    assert run(closed) == [("a.txt", 4, "five\x0bsix")]
    assert run(closed) == [] and backend.last_committed() == 3


class _Letters(StatefulSource):
    def list_parts(self):
        return ["ab", "c"]

    def build_part(self, part, state):
        return _LettersPart(part, state or 0)


class _LettersPart(StatefulSourcePartition):
    def __init__(self, part, at):
        self.part, self.at = part, at

    def poll(self):
        if self.at == len(self.part):
            return None
        self.at += 1
        return self.at - 1, self.part[self.at - 1]

    def snapshot(self):
        return self.at

    def is_finished(self):
        return self.at == len(self.part)


class _Folder(StatelessSink):
    def __init__(self, folder):
        self.folder = folder

    def sink(self, record):
        with open(f"{self.folder}/{record['value']}", "w") as f:
            f.write("x")


def test_programs(spark, tmp_path):
    (tmp_path / "seen").mkdir()
    backend = FolderBackend(spark, f"file://{tmp_path}/snapshots")
    for run in range(2):
        program, kept = Program(spark, backend), VecSink()
        empty = program.new_stream()
        letters = empty.source("letters", _Letters())
        with pytest.raises(ValueError, match="source already"):
            empty.source("more", _Letters())
        numbers = program.new_stream().source("again", _Letters())
        program.sink("kept", letters, kept)
        program.sink("files", letters, _Folder(str(tmp_path / "seen")))
        program.sink("numbered", numbers, NumberedFiles(f"file://{tmp_path}/numbered", KEY, "value", str(run)))
        program.finish(letters.filter("value = 'a'"))
        with pytest.raises(ValueError, match="already"):
            program.sink("kept", letters, kept)
        assert program.run() == run
        assert sorted(r["value"] for r in kept) == ([] if run else ["a", "b", "c"])  # the parts are finished
    assert sorted(p.name for p in (tmp_path / "seen").iterdir()) == ["a", "b", "c"]
    assert (tmp_path / "numbered" / "ab" / "0.txt").read_text() == "0 a\n1 b\n"
    assert unpickled(backend.for_version(2).load("numbered")) == {"ab": 2, "c": 1}
    nothing = NoPersistence()
    nothing.commit_version(3)
    assert nothing.last_committed() is None and nothing.next().load("numbered") is None


def test_numbers_go_on_in_the_next_run(spark, tmp_path):
    backend, stream = FolderBackend(spark, f"file://{tmp_path}/snapshots"), from_iterable(spark, range(5))
    for run in range(2):
        program = Program(spark, backend)
        program.sink("numbered", stream.filter("value <> 4" if run else "value < 4"), NumberedFiles(f"file://{tmp_path}/out", "if(value % 2 = 0, 'even', 'odd')", "value", str(run)))
        program.run()
    assert (tmp_path / "out" / "even" / "1.txt").read_text() == "2 0\n3 2\n" and (tmp_path / "out" / "odd" / "1.txt").read_text() == "2 1\n3 3\n"
