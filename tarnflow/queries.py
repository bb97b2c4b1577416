"""The registered queries: one for each operator or derived dataflow, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import functions as fn
from . import operators  # noqa: F401  attaches the operators to Stream
from .operators import StatefulLogic, StatelessLogic, epochs, limit_out_of_orderness, union_frontier
from .persistence import FolderBackend
from .plans.places import work_dir
from .plans.scan import Scan
from .program import Program
from .sinks import NumberedFiles, formatted, kafka_columns, line_numbers, write_by_key
from .sources import StatefulSource, StatefulSourcePartition, file_lines, from_iterable, from_table, kafka_records
from .stream import EPOCH_BEFORE, KEY, SEQ, TS, Stream
from .streaming import count_batches, ended, keyed_fold, run_available, stamp_epochs, stateful_op, ttl_fold
from .streaming.operators import split_late


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir, permuted: bool = False, *columns: str, dense: bool = False) -> Stream:
    """The events, arriving in order of their ids; permuted: every seventh comes 20 places late, before what then has its place.

    dense: arrival numbers are consecutive from 0 and are the timestamps; otherwise they only order the events.
    """
    df = _table(spark, sf_dir, "events").select(*(columns or ("event_id", "ts", "user_id", "event_type", "value", "props")))
    order = F.when(F.col("event_id") % 7 == 0, 2 * F.col("event_id") + 40).otherwise(2 * F.col("event_id") + 1) if permuted else F.col("event_id")
    return from_table(df, order, dense=dense)


def _unordered(spark, sf_dir, name: str, *columns: str) -> Stream:
    df = _table(spark, sf_dir, name)
    return from_table(df.select(*columns) if columns else df)


def _cents(column: str = "value") -> Column:
    return (F.col(column) * 100).cast("decimal(18,0)").cast("long")


_day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
_hours = lambda n: F.make_dt_interval(hours=F.lit(n))
_days = lambda n: F.make_dt_interval(days=F.lit(n))


# -- sources --------------------------------------------------------------------------------------------------------
def src_iter(spark, sf_dir):
    return _events(spark, sf_dir, False, "event_id", dense=True).df.select(F.col(TS).alias("ts"), F.col("event_id").alias("value"))


def src_lines(spark, sf_dir):
    docs = _unordered(spark, sf_dir, "documents", "doc_id", "text").key_local(F.col("doc_id"))
    lines = docs.map(lines=F.split("text", "\n", -1)).df
    return lines.select(F.col(KEY).alias("k"), F.posexplode("lines").alias("ts", "value")).withColumn("ts", F.col("ts").cast("long"))


def kafka_map(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(
        F.lit("events").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.when(F.col("event_id") % 5 != 0, F.col("props").cast("binary")).alias("value"),
        F.col("event_type").cast("binary").alias("key"), F.col("ts").alias("timestamp"),
    )
    stream = kafka_records(rows)
    sent = kafka_columns(stream)
    return sent.select("topic", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("payload"), F.col("partition"))


# -- stateless ------------------------------------------------------------------------------------------------------
def map_double(spark, sf_dir):
    return _unordered(spark, sf_dir, "events", "event_id").map(k=F.col("event_id"), value=F.col("event_id") * 2).df


def map_upper(spark, sf_dir):
    return _unordered(spark, sf_dir, "events", "event_id", "event_type").map(k=F.col("event_id"), value=F.upper("event_type")).df


def filter_lt(spark, sf_dir):
    return _unordered(spark, sf_dir, "events", "event_id").filter(F.col("event_id") < 42).map(value=F.col("event_id")).df


def filter_map_parse(spark, sf_dir):
    number = fn.try_int(F.nullif(F.regexp_extract("props", "([0-9]+)", 1), F.lit("")))
    return _unordered(spark, sf_dir, "events", "event_id", "props").filter_map("event_id", value=F.when(number < 42, number * 2)).df


def flatten_words(spark, sf_dir):
    return _unordered(spark, sf_dir, "documents", "doc_id", "text").key_local(F.col("doc_id")).flatten(F.split("text", " ", -1)).map(F.col(KEY).alias("k"), "value").unkey().df


def flatten_keyed(spark, sf_dir):
    """Elements keep the key and the time of the record they come from."""
    stream = _events(spark, sf_dir, False, "event_id", "event_type", dense=True).key_local(F.length("event_type"))
    return stream.flatten(F.split("event_type", "", -1), keep=("event_id",)).df.select(F.col(KEY).alias("k"), F.col(TS).alias("ts"), "value")


def custom_flatten(spark, sf_dir):
    """The same words as flatten_words, by a Python function over batches."""

    def words(parts):
        for part in parts:
            part = part.assign(value=part["text"].str.split(" ", regex=False)).explode("value")
            yield part[["doc_id", "value"]].rename(columns={"doc_id": "k"})

    return _unordered(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null").stateless_op(words, "k long, value string").df


def inspect_metrics(spark, sf_dir):
    return _unordered(spark, sf_dir, "events", "event_id").inspect("events", F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last")).map(value=F.col("event_id")).df


# -- routing --------------------------------------------------------------------------------------------------------
def split_flags(spark, sf_dir):
    return _unordered(spark, sf_dir, "events", "event_id").split_tagged(even=F.col("event_id") % 2 == 0, all=F.lit(True)).map("branch", F.col("event_id").alias("value")).df


def split_even_odd(spark, sf_dir):
    even, odd = _unordered(spark, sf_dir, "events", "event_id").const_split(F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1)
    return even.map(branch=F.lit("even"), value=F.col("event_id")).union(odd.map(branch=F.lit("odd"), value=F.col("event_id"))).df


def cloned_two(spark, sf_dir):
    first, second = _unordered(spark, sf_dir, "events", "event_id").const_cloned(2)
    return first.map(branch=F.lit(0), value=F.col("event_id")).union(second.map(branch=F.lit(1), value=F.col("event_id"))).df


def union_all(spark, sf_dir):
    orders = _unordered(spark, sf_dir, "orders", "o_orderkey").map(value=F.col("o_orderkey"))
    return orders.union(_unordered(spark, sf_dir, "lineitem", "l_orderkey").map(value=F.col("l_orderkey"))).df


def union_frontier_q(spark, sf_dir):
    """Odd and even events as two inputs with epochs of their own, each the event's time."""
    arrivals = _events(spark, sf_dir, False, "event_id", "ts").df.withColumn("src", F.col("event_id") % 2)
    met = union_frontier(arrivals, "src", "ts", [0, 1])
    return met.filter("frontier is not null").select(F.col("frontier").alias("epoch")).distinct()


def union_epochs(spark, sf_dir):
    """The same, as a union of two streams."""
    parts = [_events(spark, sf_dir, False, "event_id", "ts").filter(F.col("event_id") % 2 == r).assign_timestamps(F.col("ts")).stream for r in (0, 1)]
    one, other = (epochs(p, F.col(TS)) for p in parts)
    return one.union(other).inspect_frontier()


# -- keys -----------------------------------------------------------------------------------------------------------
def key_local(spark, sf_dir):
    return _unordered(spark, sf_dir, "events", "event_id", "user_id").key_local(F.col("user_id") % 2 == 0).df.select("event_id", F.col(KEY).alias("k"))


def key_counts(spark, sf_dir):
    """Counts by a sink's own aggregation, which needs no exchange but the keys'."""
    return _unordered(spark, sf_dir, "events", "user_id").key_distribute(F.col("user_id")).df.groupBy(F.col(KEY).alias("k")).agg(F.count("*").alias("n"))


def index_select(spark, sf_dir):
    return _unordered(spark, sf_dir, "events", "event_id", "user_id").map("event_id", worker=fn.index_select(F.col("user_id"), 4)).df


def skew_route(spark, sf_dir):
    return _unordered(spark, sf_dir, "events", "event_id", "user_id").map("event_id", worker=fn.isolate_hot(F.col("user_id"), [0], 4)).df


def rendezvous_stable(spark, sf_dir):
    """Keys by the workers of five and of six; only keys of the new worker differ."""
    stream = _unordered(spark, sf_dir, "events", "user_id")
    df = stream.df.distinct().select(F.col("user_id").alias("k"), fn.rendezvous_select(F.col("user_id"), 5).alias("before"), fn.rendezvous_select(F.col("user_id"), 6).alias("after"))
    return df.groupBy((F.col("before") == F.col("after")).alias("stayed"), (F.col("after") == 5).alias("to_new")).agg(F.count("*").alias("n"))


# -- state ----------------------------------------------------------------------------------------------------------
def running_sum(spark, sf_dir):
    stream = _events(spark, sf_dir, False, "event_id", "user_id", "value").key_local(F.col("user_id"))
    return stream.running(total_cents=Scan("sum", _cents())).df.select("event_id", F.col(KEY).alias("k"), "total_cents")


def running_sum_parity(spark, sf_dir):
    stream = _events(spark, sf_dir, False, "event_id").key_local(F.col("event_id") % 2 == 1)
    return stream.running(total=Scan("sum", F.col("event_id"))).df.select("event_id", F.col(KEY).alias("odd"), "total")


def running_extremes(spark, sf_dir):
    stream = _events(spark, sf_dir, False, "event_id", "event_type", "value").key_local(F.col("event_type"))
    out = stream.running(least=Scan("min", _cents()), greatest=Scan("max", _cents()), nth=Scan("count"))
    return out.df.select("event_id", "least", "greatest", "nth")


def concat_reset(spark, sf_dir):
    """Concatenates each user's event types; a text of 20 characters or more is let go of."""

    def step(key, record, state):
        text = state + record["event_type"]
        return {"event_id": record["event_id"], "value": text}, None if len(text) >= 20 else text

    stream = _events(spark, sf_dir, False, "event_id", "user_id", "event_type").key_local(F.col("user_id"))
    return stream.stateful_map(step, "event_id long, value string", str).df.select("event_id", "value")


def batch_n(spark, sf_dir):
    stream = _events(spark, sf_dir, False, "event_id", "user_id", dense=True).key_local(F.col("user_id"))
    return stream.batches(3, F.sum("event_id").alias("id_sum")).select(F.col(KEY).alias("k"), F.col("batch").alias("b"), "n", "id_sum", "closed_at")


def flush_max(spark, sf_dir):
    stream = _events(spark, sf_dir, False, "event_id", "user_id").key_local(F.col("user_id"))
    return stream.batches(3).filter("closed_at is null").select(F.col(KEY).alias("k"), "n")


# -- time -----------------------------------------------------------------------------------------------------------
def assign_ts(spark, sf_dir):
    return _events(spark, sf_dir, False, "event_id", "ts").assign_timestamps(F.col("ts")).stream.df.select("event_id", F.col(TS).alias("ts"))


def epochs_monotonic(spark, sf_dir):
    timed = _events(spark, sf_dir, True, "event_id", "ts", dense=True).assign_timestamps(F.col("ts")).stream
    return epochs(timed, F.col(TS)).frontier().select(F.col(SEQ).alias("seq"), "epoch")


def _late_split(spark, sf_dir):
    return _events(spark, sf_dir, True, "event_id", "ts").assign_timestamps(F.col("ts")).limit_out_of_orderness(_hours(1))


def late_split_on_time(spark, sf_dir):
    return _late_split(spark, sf_dir)[0].df.select("event_id", "ts")


def late_split_late(spark, sf_dir):
    return _late_split(spark, sf_dir)[1].df.select("event_id", "ts")


def late_orders_365d(spark, sf_dir):
    orders = from_table(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", dense=False)
    stamped = epochs(orders.assign_timestamps(F.col("o_orderdate")).stream, limit_out_of_orderness(_days(365)))
    return stamped.df.select("o_orderkey", F.coalesce(F.col(TS) <= F.col(EPOCH_BEFORE), F.lit(False)).alias("is_late"))


def frontier(spark, sf_dir):
    timed = _events(spark, sf_dir, True, "event_id", "ts").assign_timestamps(F.col("ts")).stream
    return epochs(timed, limit_out_of_orderness(_hours(1))).inspect_frontier()


def _daily(spark, sf_dir, permuted: bool, candidate: Column) -> DataFrame:
    timed = _events(spark, sf_dir, permuted, "event_id", "ts", "user_id", "value").key_local(F.col("user_id")).assign_timestamps(F.col("ts"))
    stamped = epochs(timed.stream, candidate)
    closed = stamped.close_on_epoch(stamped, _day, F.sum(_cents()).alias("cents"))
    return closed.select(F.col(KEY).alias("user_id"), F.col("bucket").alias("day"), "cents", "closed_at")


def daily_balance(spark, sf_dir):
    return _daily(spark, sf_dir, False, _day(F.col(TS)) - F.expr("interval 1 microsecond"))


def daily_balance_ooo(spark, sf_dir):
    return _daily(spark, sf_dir, True, limit_out_of_orderness(_days(2)))


def daily_balance_late(spark, sf_dir):
    return _daily(spark, sf_dir, True, limit_out_of_orderness(_hours(1)))


def monthly_orders(spark, sf_dir):
    """Orders by customer and month, closed by epochs 365 days behind: far out of order, most of it late."""
    orders = from_table(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey", dense=False).key_local(F.col("o_custkey"))
    stamped = epochs(orders.assign_timestamps(F.col("o_orderdate")).stream, limit_out_of_orderness(_days(365)))
    closed = stamped.close_on_epoch(stamped, lambda c: F.date_trunc("month", c).cast("timestamp_ntz"), F.count("*").alias("n"))
    return closed.select(F.col(KEY).alias("custkey"), F.col("bucket").alias("month"), "n", "closed_at")


# -- time to live ---------------------------------------------------------------------------------------------------
def ttl_count(spark, sf_dir):
    timed = _events(spark, sf_dir, False, "event_id", "ts", "event_type").key_local(F.col("event_type")).assign_timestamps(F.col("ts")).stream
    stamped = epochs(timed, F.col(TS))
    return stamped.ttl_window(6 * 3600, 86_400, live=lambda entry, arrival: F.count(entry)).df.select("event_id", "live")


def ttl_running_total(spark, sf_dir):
    timed = _events(spark, sf_dir, False, "event_id", "ts", "user_id", "value").key_local(F.col("user_id")).assign_timestamps(F.col("ts")).stream
    return epochs(timed, F.col(TS)).ttl_running(_hours(2), total_cents=Scan("sum", _cents())).df.select("event_id", "total_cents")


# -- sinks ----------------------------------------------------------------------------------------------------------
def sink_line_numbers(spark, sf_dir):
    return line_numbers(_events(spark, sf_dir, False, "event_id", "event_type"), F.col("event_type")).select("part", "line_no", F.col("event_id").alias("value"))


def sink_stdout_fmt(spark, sf_dir):
    stream = _events(spark, sf_dir, False, "event_id", "event_type", dense=True).map("event_id", value=F.upper("event_type"))
    return stream.df.select("event_id", formatted(stream).alias("line"))


# -- unbounded runs: the same dataflows over a stream of files, run until all is read -----------------------------------
def _streamed_events(spark, sf_dir) -> Stream:
    columns = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    # A pattern, though it fits one path only: a plain path must be a folder.
    df = spark.readStream.schema(columns).parquet(f"{sf_dir}/events.[p]arquet")
    return Stream(df.select(F.col("event_id").alias(SEQ), F.unix_micros(F.col("ts").cast("timestamp")).alias(TS), F.col("user_id").alias(KEY), "event_id", _cents().alias("cents")))


def _ran(spark, stream: Stream, name: str) -> DataFrame:
    folder = work_dir(spark, name)
    run_available(stream, f"{folder}/checkpoint", f"{folder}/out")
    return spark.read.schema(stream.df.schema).parquet(f"{folder}/out")


def stream_running_sum(spark, sf_dir):
    def step(key, record, state):
        return {"event_id": record["event_id"], "k": key, "total_cents": state + record["cents"]}, state + record["cents"]

    return _ran(spark, keyed_fold(_streamed_events(spark, sf_dir), step, "event_id long, k long, total_cents long", int), "running-sum")


def stream_batch_n(spark, sf_dir):
    """The batches that are full; what is open stays in the state."""
    full = _ran(spark, count_batches(_streamed_events(spark, sf_dir), 3, "event_id"), "batches")
    return full.select(F.col(KEY).alias("k"), F.aggregate("values", F.lit(0).cast("long"), lambda a, v: a + v).alias("id_sum"), "closed_at")


def stream_late(spark, sf_dir):
    """Late events, when every seventh arrives 20 places late."""
    events = _streamed_events(spark, sf_dir)
    permuted = Stream(events.df.withColumn(SEQ, (F.col("event_id") + F.when(F.col("event_id") % 7 == 0, 20).otherwise(0)) * 1_000_000 + F.col("event_id") % 1_000_000))
    stamped = _ran(spark, stamp_epochs(permuted, lambda record, epoch: record[TS] - 3_600_000_000), "late")
    return split_late(Stream(stamped))[1].df.select("event_id")


def _stamped(spark, sf_dir, generator) -> Stream:
    """The unbounded events with epochs, as another unbounded stream; those that are late have gone."""
    events = _streamed_events(spark, sf_dir)
    done = _ran(spark, stamp_epochs(events, generator), "stamped")
    folder = done.inputFiles()[0].rsplit("/", 1)[0]
    return split_late(Stream(spark.readStream.schema(done.schema).parquet(folder)))[0]


def stream_ttl_running_total(spark, sf_dir):
    """As ttl_running_total, by an expiring map that holds a key's total."""

    def step(key, record, entries):
        total = (entries["total"][0] if entries else 0) + record["cents"]
        return {"event_id": record["event_id"], "total_cents": total}, {"total": (total, record[TS])}

    events = _streamed_events(spark, sf_dir)
    done = _ran(spark, stamp_epochs(events, lambda record, epoch: record[TS]), "stamped")
    folder = done.inputFiles()[0].rsplit("/", 1)[0]
    stamped = Stream(spark.readStream.schema(done.schema).parquet(folder))
    return _ran(spark, ttl_fold(stamped, 7_200_000_000, step, "event_id long, total_cents long"), "ttl-total").select("event_id", "total_cents")


class _DailyBalance(StatefulLogic):
    """Sums each user's cents by day; an epoch closes the days up to its own, the last one all."""

    def __init__(self, last: int):
        self.last = last

    def default(self):
        return {}

    def on_data(self, key, record, state):
        day = record[TS] // 86_400_000_000
        state[day] = state.get(day, 0) + record["cents"]
        return (), state

    def on_epoch(self, epoch, states):
        out, closed_at = [], None if epoch == self.last else epoch
        for user in list(states):
            days = states[user]
            for day in [d for d in days if d <= epoch // 86_400_000_000]:
                out.append({"user_id": user, "day": day * 86_400_000_000, "cents": days.pop(day), "closed_at": closed_at})
            if not days:
                del states[user]
        return out


_BALANCE = "user_id long, day long, cents long, closed_at long"
_as_times = lambda df: df.select("user_id", F.timestamp_micros("day").cast("timestamp_ntz").alias("day"), "cents", F.timestamp_micros("closed_at").cast("timestamp_ntz").alias("closed_at"))


def _before_the_day(record, epoch):
    return record[TS] // 86_400_000_000 * 86_400_000_000 - 1


def stream_daily_balance(spark, sf_dir):
    """As daily_balance, by a logic that sees the epochs; what is open at the end is closed by the last epoch of all."""
    stamped = _stamped(spark, sf_dir, _before_the_day)
    last = fn.maximum(LongType())
    folder, logic = work_dir(spark, "daily-balance"), _DailyBalance(last)
    run_available(stateful_op(stamped, logic, _BALANCE, 4), f"{folder}/checkpoint", f"{folder}/out")
    closed = spark.read.schema(_BALANCE).parquet(f"{folder}/out")
    return _as_times(closed.unionAll(ended(spark, f"{folder}/checkpoint", logic, _BALANCE, last)))


def stateful_daily_balance(spark, sf_dir):
    """The same logic on the bounded stream."""
    events = _events(spark, sf_dir, False, "event_id", "ts", "user_id", "value").map("event_id", user=F.col("user_id"), cents=_cents(), micros=F.unix_micros(F.col("ts").cast("timestamp"))).key_local(F.col("user"))
    on_time, _ = events.assign_timestamps(F.col("micros")).generate_epochs(F.floor(F.col(TS) / 86_400_000_000) * 86_400_000_000 - 1)
    return _as_times(on_time.stateful_op(_DailyBalance(fn.maximum(LongType())), _BALANCE).df)


class _EpochMarks(StatelessLogic):
    """Passes ids on, and with each epoch how many came since the one before; workers each count their own."""

    def build(self, context):
        self.since = 0

    def on_data(self, record, context):
        self.since += 1
        return [{"event_id": record["event_id"], "since": None}]

    def on_epoch(self, epoch, context):
        since, self.since = self.since, 0
        return [{"event_id": None, "since": since}]


def stateless_epochs(spark, sf_dir):
    """What stateless callbacks of records and epochs give: each on-time event once, and counts that sum up to as many."""
    on_time, _ = _late_split(spark, sf_dir)
    out = on_time.stateless_logic(_EpochMarks(), "event_id long, since long").df
    return out.agg(F.count("event_id").alias("events"), F.countDistinct("event_id").alias("different"), F.sum("since").alias("counted"))


# -- programs: sources and sinks with states, run twice -------------------------------------------------------------------
class _Counter(StatefulSource):
    """Counts up to a limit in each of some parts, and goes on from there in the next run."""

    schema = "value long"

    def __init__(self, parts: int, limit: int):
        self.parts, self.limit = parts, limit

    def list_parts(self):
        return [str(i) for i in range(self.parts)]

    def build_part(self, part, state):
        return _CounterPart(state or 0, self.limit)


class _CounterPart(StatefulSourcePartition):
    def __init__(self, at: int, limit: int):
        self.at, self.limit = at, limit

    def poll(self):
        if self.at >= self.limit:
            return None
        self.at += 1
        return self.at - 1, self.at - 1

    def snapshot(self):
        return self.at


def src_resume(spark, sf_dir):
    """Three counters in two runs, the second of which goes on where the first was committed; one that fails in between."""
    backend, seen = FolderBackend(spark, work_dir(spark, "resume")), []
    for limit, commits in ((10, True), (17, False), (25, True)):
        client = backend.next()
        stream = _Counter(3, limit).into_stream("counter", spark, client)
        if commits:
            backend.commit_version(client.version)
            seen.append(stream.df)
    return seen[0].unionAll(seen[1]).select(F.col(KEY).alias("k"), "value")


def src_file_lines(spark, sf_dir):
    """The ids of the events of each type, written to a file of its own and read as numbered lines."""
    folder = work_dir(spark, "lines")
    write_by_key(_events(spark, sf_dir, False, "event_id", "event_type").key_local(F.col("event_type")), folder, F.col("event_id").cast("string"), one_file=True)
    lines = file_lines(spark, folder).df
    return lines.select(F.regexp_extract(KEY, "_key=([^/]*)/", 1).alias("k"), F.col(TS).alias("ts"), F.col("value"))


def sink_numbered_files(spark, sf_dir):
    """Files of numbered lines by event type, written in two runs; the second goes on counting."""
    folder = work_dir(spark, "numbered")
    backend = FolderBackend(spark, f"{folder}/snapshots")
    halves = _events(spark, sf_dir, False, "event_id", "event_type").const_split(F.col("event_id") < 400, F.col("event_id") >= 400)
    for run, half in enumerate(halves):
        program = Program(spark, backend)
        program.sink("files", half, NumberedFiles(f"{folder}/out", "event_type", "event_id", str(run)))
        program.run()
    lines = spark.read.text(f"{folder}/out/*").select(F.regexp_extract(F.col("_metadata.file_path"), "/out/([^/]*)/", 1).alias("part"), F.split("value", " ").alias("words"))
    return lines.select("part", F.col("words")[0].cast("long").alias("line_no"), F.col("words")[1].cast("long").alias("value"))


# -- literal inputs -----------------------------------------------------------------------------------------------------
#: Ten transactions of a public example of event time, in order of their dates and out of order.
_AMOUNTS = (
    ("2025-01-01", 1000), ("2025-01-05", -20), ("2025-01-17", -150), ("2025-02-04", -300), ("2025-02-16", 60), ("2025-02-25", 75), ("2025-03-16", -55), ("2025-03-31", 200), ("2025-04-05", -10), ("2025-04-19", -5),
)
_OUT_OF_ORDER = (
    ("2025-01-01", 1000), ("2025-01-05", -20), ("2025-02-04", -300), ("2025-01-17", -150), ("2025-02-16", 60), ("2025-03-16", -55), ("2025-02-25", 75), ("2025-04-05", -10), ("2025-03-31", 200), ("2025-04-19", -5),
)
#: Five words of a public example of expiring state.
_WORDS = ("foo", "bar", "hello", "world", "baz")


def _monthly(spark, rows, candidate: Column) -> DataFrame:
    stream = from_iterable(spark, rows, "day string, amount long").map(day=F.to_date("day"), amount=F.col("amount"))
    stream = stream.key_local(F.struct(F.year("day").alias("year"), F.month("day").alias("month"))).assign_timestamps(F.col("day")).stream
    stamped = epochs(stream, candidate)
    closed = stamped.close_on_epoch(stamped, lambda c: F.trunc(c, "month"), F.sum("amount").alias("balance"))
    return closed.select(F.col(KEY)["year"].alias("year"), F.col(KEY)["month"].alias("month"), "balance", "closed_at")


def monthly_balance(spark, sf_dir):
    return _monthly(spark, _AMOUNTS, F.date_sub(F.trunc(TS, "month"), 1))


def monthly_balance_ooo(spark, sf_dir):
    return _monthly(spark, _OUT_OF_ORDER, F.date_sub(F.col(TS), 62))


def ttl_concat(spark, sf_dir):
    stream = from_iterable(spark, _WORDS, "value string").key_local(F.lit(True))

    def step(key, record, entries):
        entries = entries | {record[SEQ]: (record["value"], record[TS])}
        return {"value": "|".join(v for _, (v, _) in sorted(entries.items()))}, entries

    return epochs(stream.assign_timestamps(F.col(SEQ)).stream, F.col(TS)).ttl_fold(2, step, "value string").df.select(F.col(SEQ).alias("seq"), "value")


QUERIES = {
    f.__name__.removesuffix("_q"): f
    for f in (
        src_iter, src_lines, kafka_map, map_double, map_upper, filter_lt, filter_map_parse, flatten_words, flatten_keyed, custom_flatten, inspect_metrics, split_flags, split_even_odd, cloned_two, union_all,
        union_frontier_q, union_epochs, key_local, key_counts, index_select, skew_route, rendezvous_stable, running_sum, running_sum_parity, running_extremes, concat_reset, batch_n, flush_max, assign_ts, epochs_monotonic,
        late_split_on_time, late_split_late, late_orders_365d, frontier, daily_balance, daily_balance_ooo, daily_balance_late, monthly_orders, ttl_count, ttl_running_total, sink_line_numbers, sink_stdout_fmt,
        stream_running_sum, stream_batch_n, stream_late, stream_ttl_running_total, stream_daily_balance, stateful_daily_balance, stateless_epochs, src_resume, src_file_lines, sink_numbered_files, monthly_balance, monthly_balance_ooo, ttl_concat,
    )
}
