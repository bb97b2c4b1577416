"""The operators on literal inputs: one test for each rule of the dataflow model."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnflow import operators as ops
from tarnflow.functions import maximum, merge, minimum, rendezvous_select, try_int
from tarnflow.plans.scan import Scan
from tarnflow.sinks import VecSink, formatted, line_numbers
from tarnflow.sources import from_iterable
from tarnflow.stream import EPOCH, EPOCH_BEFORE, KEY, SEQ, TS


def values(stream, column="value"):
    return [r[column] for r in stream.df.orderBy(SEQ).collect()]


def timed(spark, items, candidate=None, schema="value long"):
    stream = from_iterable(spark, items, schema).assign_timestamps(F.col("value")).stream
    return ops.epochs(stream, F.col(TS) if candidate is None else candidate)


def test_iterator_source_numbers_its_records(spark):
    rows = VecSink().collect(from_iterable(spark, range(42, 52))).drain_vec()
    assert [(r["value"], r[TS]) for r in rows] == [(v, i) for i, v in enumerate(range(42, 52))]


def test_map_filter_and_filter_map(spark):
    words = from_iterable(spark, ["hello", "world", "foo", "bar"], "value string")
    assert values(words.map(value=F.length("value"))) == [5, 5, 3, 3]
    numbers = from_iterable(spark, range(100))
    assert values(numbers.filter(F.col("value") < 42)) == list(range(42))
    assert values(numbers.filter_map(value=F.when(F.col("value") < 42, F.col("value") * 2))) == list(range(0, 84, 2))
    parsed = from_iterable(spark, ["0", "one", "2", "3", "four"], "value string").filter_map(value=try_int(F.col("value")))
    assert values(parsed) == [0, 2, 3]


def test_filter_drops_null_predicates(spark):
    assert values(from_iterable(spark, [1, None, 3]).filter(F.col("value") > 0)) == [1, 3]


def test_flatten_keeps_key_and_time(spark):
    arrays = from_iterable(spark, [([1, 2],), ([3, 4, 5],), ([],), ([6],)], "value array<int>").key_local(F.size("value"))
    rows = arrays.flatten("value").df.orderBy(SEQ, "_at").collect()
    assert [(r["value"], r[KEY], r[TS]) for r in rows] == [(1, 2, 0), (2, 2, 0), (3, 3, 1), (4, 3, 1), (5, 3, 1), (6, 1, 3)]


def test_inspect_changes_nothing_and_measures(spark):
    from pyspark.sql import Observation

    seen = Observation("seen")
    stream = from_iterable(spark, range(5)).inspect(seen, F.sum("value").alias("total"))
    assert sorted(r["value"] for r in stream.df.collect()) == [0, 1, 2, 3, 4]
    assert seen.get == {"total": 10}


def test_inspect_each_record(spark, tmp_path):
    folder = str(tmp_path)

    def note(record, context):
        with open(f"{folder}/{context.worker_id}", "a") as f:
            f.write(f"{record['value']}\n")

    stream = from_iterable(spark, range(9)).inspect_each(note)
    assert sorted(r["value"] for r in stream.df.collect()) == list(range(9))
    assert sorted(int(x) for p in tmp_path.iterdir() for x in p.read_text().split()) == list(range(9))


def test_split_routes_to_several_or_none(spark):
    numbers = from_iterable(spark, range(101))
    even, every = numbers.const_split(F.col("value") % 2 == 0, F.lit(True))
    assert (even.df.count(), every.df.count()) == (51, 101)
    (none,) = numbers.split(F.lit(None).cast("boolean"))
    assert none.df.count() == 0
    tagged = numbers.split_tagged(even=F.col("value") % 2 == 0, big=F.col("value") > 90).df.groupBy("branch").count().collect()
    assert {r["branch"]: r["count"] for r in tagged} == {"even": 51, "big": 10}


def test_union_and_clone(spark):
    first, second = from_iterable(spark, range(101)).const_cloned(2)
    assert sorted(r["value"] for r in first.union(second).df.collect()) == sorted([*range(101)] * 2)


def test_operator_names_are_unique(spark):
    stream = from_iterable(spark, [1]).then("a", lambda df: df)
    with pytest.raises(ValueError, match="already"):
        stream.then("a", lambda df: df)


def test_running_sums(spark):
    numbers = from_iterable(spark, range(10)).key_local(F.lit(0))
    assert values(numbers.running(total=Scan("sum", F.col("value"))), "total") == [0, 1, 3, 6, 10, 15, 21, 28, 36, 45]
    parity = from_iterable(spark, range(100)).key_local(F.col("value") % 2)
    sums, expected = [0, 0], []
    for v in range(100):
        sums[v % 2] += v
        expected.append(sums[v % 2])
    assert values(parity.running(total=Scan("sum", F.col("value"))), "total") == expected


def test_null_keys_are_a_key(spark):
    stream = from_iterable(spark, [(None, 1), ("a", 2), (None, 3)], "k string, value long").key_local(F.col("k"))
    assert values(stream.running(total=Scan("sum", F.col("value"))), "total") == [1, 2, 4]
    folded = stream.stateful_map(lambda k, r, s: ({"total": s + r["value"]}, s + r["value"]), "total long", int)
    assert values(folded, "total") == [1, 2, 4]


def test_state_can_be_dropped(spark):
    words = from_iterable(spark, ["foo", "bar", "hello", "world", "baz"], "value string").key_local(F.length("value"))

    def step(key, record, state):
        text = state + record["value"]
        return {"value": text}, None if len(text) >= 6 else text

    assert values(words.stateful_map(step, "value string", str)) == ["foo", "foobar", "hello", "helloworld", "baz"]


def test_folds_see_nulls_and_large_integers_as_they_are(spark):
    stream = from_iterable(spark, [(1, 2**62 + 1), (1, None), (1, 2**62 + 3)], "k long, value long").key_local(F.struct("k"))
    out = stream.stateful_map(lambda key, record, state: ({"value": record["value"], "nulls": state + (record["value"] is None), "k": key["k"]}, state + (record["value"] is None)), "value long, nulls int, k long", int)
    assert [(r["value"], r["nulls"], r["k"]) for r in out.df.orderBy(SEQ).collect()] == [(2**62 + 1, 0, 1), (None, 1, 1), (2**62 + 3, 1, 1)]


def test_fold_flushes_what_is_left(spark):
    def step(key, record, state):
        state = [*state, record["value"]]
        return ({"k": key, "values": state}, None) if len(state) == 5 else (None, state)

    stream = from_iterable(spark, range(12)).key_local(F.lit("k"))
    rows = ops.fold(stream, step, "k string, values array<long>", list, lambda key, state: {"k": key, "values": state}).df.collect()
    assert sorted(r["values"] for r in rows) == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [10, 11]]


def test_batches_close_by_count_or_end(spark):
    rows = from_iterable(spark, range(101)).key_local(F.lit(0)).batches(5).orderBy("batch").collect()
    assert len(rows) == 21
    assert [r["closed_at"] for r in rows] == [*range(4, 100, 5), None]
    assert rows[-1]["n"] == 1


def test_epochs_hold_from_the_next_record(spark):
    rows = timed(spark, [1, 2, 3, 4]).df.orderBy(SEQ).collect()
    assert [(r[EPOCH_BEFORE], r[EPOCH]) for r in rows] == [(None, 1), (1, 2), (2, 3), (3, 4)]


def test_equality_is_late(spark):
    on_time, late = from_iterable(spark, [5, 5, 6]).assign_timestamps(F.col("value")).generate_epochs(F.col(TS))
    assert (values(on_time), values(late)) == ([5, 6], [5])


def test_on_time_and_late(spark):
    on_time, late = from_iterable(spark, [*range(5, 10), *range(5)]).assign_timestamps(F.col("value")).generate_epochs(F.col(TS))
    assert (values(on_time), values(late)) == ([5, 6, 7, 8, 9], [0, 1, 2, 3, 4])


def test_candidates_that_do_not_increase_are_not_epochs(spark):
    candidate = F.when(F.col("value") == 3, 2).when(F.col("value") == 1, None).otherwise(F.col("value"))
    assert [r["epoch"] for r in timed(spark, range(6), candidate).frontier().orderBy(SEQ).collect()] == [0, 2, 4, 5]


def test_generator_that_looks_at_the_last_epoch(spark):
    stream = from_iterable(spark, range(10)).assign_timestamps(F.col("value"))
    on_time, late = stream.generate_epochs_by(lambda record, epoch: record["value"] + (epoch or 0))
    both = sorted(on_time.union(late).df.select(SEQ, EPOCH).collect())
    assert [r[EPOCH] for r in both] == [0, 1, 3, 6, 10, 15, 21, 28, 36, 45]


def test_without_epochs_nothing_is_late(spark):
    on_time, late = from_iterable(spark, [3, 1, 2]).assign_timestamps(F.col("value") * 2).generate_epochs(F.lit(None).cast("long"))
    assert (values(on_time), values(late)) == ([3, 1, 2], [])
    assert [r[TS] for r in on_time.df.orderBy(SEQ).collect()] == [6, 2, 4]


def test_new_timestamps_drop_epochs(spark):
    again = timed(spark, range(10)).assign_timestamps(F.col("value")).stream
    assert EPOCH not in again.df.columns


def test_out_of_order_bound(spark):
    on_time, late = from_iterable(spark, [10, 4, 5, 20, 14, 15, 16]).assign_timestamps(F.col("value")).limit_out_of_orderness(5)
    assert (values(on_time), values(late)) == ([10, 20, 16], [4, 5, 14, 15])


def test_frontier_of_several_inputs(spark):
    arrivals = spark.createDataFrame([(0, 0, 42), (1, 1, 15), (2, 1, 78), (3, 0, 1337), (4, 1, 1337)], "_seq long, src int, epoch long")
    rows = ops.union_frontier(arrivals, "src", "epoch", [0, 1]).orderBy(SEQ).collect()
    assert [r["frontier"] for r in rows] == [None, 15, 42, 78, 1337]
    merged = spark.createDataFrame([(None, 43), (42, 43), (None, None)], "a long, b long").select(merge(F.col("a"), F.col("b")).alias("m"))
    assert [r["m"] for r in merged.collect()] == [None, 42, None]


def _transactions(spark, days, amounts):
    rows = [(dt.date.fromisoformat(f"2025-{d}"), float(a)) for d, a in zip(days, amounts, strict=True)]
    return from_iterable(spark, rows, "day date, amount double").key_local(F.struct(F.year("day").alias("y"), F.month("day").alias("m"))).assign_timestamps(F.col("day")).stream


_month = lambda c: F.trunc(c, "month")


def _balances(stream, candidate):
    stamped = ops.epochs(stream, candidate)
    rows = stamped.close_on_epoch(stamped, _month, F.sum("amount").alias("total")).collect()
    return sorted((r[KEY]["m"], r["total"], r["closed_at"]) for r in rows)


def test_monthly_balance(spark):
    days = ["01-01", "01-05", "01-17", "02-04", "02-16", "02-25", "03-16", "03-31", "04-05", "04-19"]
    stream = _transactions(spark, days, [1000, -20, -150, -300, 60, 75, -55, 200, -10, -5])
    found = _balances(stream, F.date_sub(F.trunc(TS, "month"), 1))
    assert found == [(1, 830.0, dt.date(2025, 1, 31)), (2, -165.0, dt.date(2025, 2, 28)), (3, 145.0, dt.date(2025, 3, 31)), (4, -15.0, None)]


def test_monthly_balance_out_of_order(spark):
    days = ["01-01", "01-05", "02-04", "01-17", "02-16", "03-16", "02-25", "04-05", "03-31", "04-19"]
    stream = _transactions(spark, days, [1000, -20, -300, -150, 60, -55, 75, -10, 200, -5])
    found = _balances(stream, F.date_sub(F.col(TS), 62))
    assert found == [(1, 830.0, dt.date(2025, 1, 13)), (2, -165.0, dt.date(2025, 2, 2)), (3, 145.0, None), (4, -15.0, None)]


def test_ttl_entries_expire(spark):
    stream = from_iterable(spark, ["foo", "bar", "hello", "world", "baz"], "value string").key_local(F.lit(True))
    stamped = ops.epochs(stream.assign_timestamps(F.col(SEQ)).stream, F.col(TS))

    def step(key, record, entries):
        entries = entries | {record[SEQ]: (record["value"], record[TS])}
        return {"value": "|".join(v for _, (v, _) in sorted(entries.items()))}, entries

    assert values(stamped.ttl_fold(2, step, "value string")) == ["foo", "foo|bar", "foo|bar|hello", "bar|hello|world", "hello|world|baz"]


def test_ttl_window_says_the_same_in_columns(spark):
    stream = from_iterable(spark, ["foo", "bar", "hello", "world", "baz"], "value string").key_local(F.lit(True))
    stamped = ops.epochs(stream.assign_timestamps(F.col(SEQ)).stream, F.col(TS))
    joined = lambda entry, arrival: F.concat_ws("|", F.transform(F.sort_array(F.collect_list(F.struct(arrival, entry))), lambda e: e["__v"]))
    out = stamped.ttl_window(2, 100, entry=F.col("value"), live=joined)
    assert values(out, "live") == ["foo", "foo|bar", "foo|bar|hello", "bar|hello|world", "hello|world|baz"]


@pytest.mark.parametrize("lag", [0, 7, None])
def test_ttl_window_counts_late_and_old_entries_as_the_fold_does(spark, lag):
    times = [100, 90, 95, 93, 500, 97, 494, 496, 9000, 495, 501, 8999, 8998, 120, 9001, 9003, 9002]
    stream = from_iterable(spark, times).key_local(F.col(SEQ) % 2)
    candidate = F.lit(None).cast("long") if lag is None else F.col(TS) - lag
    stamped = ops.epochs(stream.assign_timestamps(F.col("value")).stream, candidate)

    def step(key, record, entries):
        entries = entries | {record[SEQ]: (1, record[TS])}
        return {"live": len(entries)}, entries

    assert values(stamped.ttl_window(10, live=lambda entry, arrival: F.count(entry)), "live") == values(stamped.ttl_fold(10, step, "live long"), "live")


def test_ttl_without_epochs_keeps_all(spark):
    stream = from_iterable(spark, range(100)).key_local(F.col("value") % 2)
    stamped = ops.epochs(stream.assign_timestamps(F.col("value")).stream, F.lit(None).cast("long"))
    out = stamped.ttl_running(F.lit(15), total=Scan("sum", F.col("value")))
    assert values(out, "total") == values(stream.running(total=Scan("sum", F.col("value"))), "total")


def test_stdout_format(spark):
    stream = from_iterable(spark, ["look", "ma'"], "value string").map(value=F.upper("value"))
    lines = stream.df.select(SEQ, formatted(stream).alias("line")).orderBy(SEQ).collect()
    assert [r["line"] for r in lines] == ['{ key: NoKey, value: "LOOK", timestamp: 0 }', '{ key: NoKey, value: "MA\'", timestamp: 1 }']


def test_numbered_sink(spark):
    rows = line_numbers(from_iterable(spark, range(50)), F.col("value") % 5).collect()
    assert all(r["value"] == r["line_no"] * 5 + r["part"] for r in rows) and len(rows) == 50


def test_vec_sink_drains():
    sink = VecSink()
    sink.give(1, 2, 3, 4)
    assert sink.drain_vec(1, 3) == [2, 3]
    assert list(sink) == [1, 4] and len(sink) == 0


def test_rendezvous_moves_only_to_the_new_worker(spark):
    df = spark.range(2000).select(rendezvous_select(F.col("id"), 4).alias("a"), rendezvous_select(F.col("id"), 5).alias("b"))
    moved = df.filter("a <> b").collect()
    assert 250 < len(moved) < 550 and all(r["b"] == 4 for r in moved)


def test_key_distribute_puts_a_key_in_one_partition(spark):
    stream = from_iterable(spark, range(100))
    placed = stream.key_distribute(F.col("value") % 7, 3, F.col("_key") % 3).df.select(KEY, F.spark_partition_id().alias("p")).distinct().collect()
    assert sorted((r[KEY], r["p"]) for r in placed) == [(k, k % 3) for k in range(7)]
    with pytest.raises(ValueError, match="workers"):
        stream.key_distribute(F.col("value"), None, F.lit(0))


def test_bounds_of_timestamp_types(spark):
    schema = spark.createDataFrame([], "a long, b date, c timestamp, d decimal(20,0), e tinyint").schema
    assert maximum(schema["a"].dataType) == 2**63 - 1 and minimum(schema["e"].dataType) == -128
    assert maximum(schema["b"].dataType) == dt.date.max and maximum(schema["d"].dataType) == 10**20 - 1
    with pytest.raises(TypeError):
        maximum(spark.createDataFrame([], "x string").schema["x"].dataType)


def test_empty_and_single(spark):
    empty = from_iterable(spark, [], "value long").key_local(F.col("value"))
    assert values(empty.running(total=Scan("sum", F.col("value"))), "total") == []
    stamped = timed(spark, [7])
    assert [(r[EPOCH_BEFORE], r[EPOCH]) for r in stamped.df.collect()] == [(None, 7)]
