"""Every registered query of the engine against its SQL, run by DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from tarnflow.oracle import ORACLE_SQL
from tarnflow.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    found = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def test_scan_is_the_same_for_any_ranges(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st
    from pyspark.sql import functions as F

    from tarnflow.plans.scan import Scan, scan

    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(-50, 50))), max_size=30), st.integers(1, 6))
    def check(rows, count):
        df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "o long, k long, v long")
        out = scan(df, "o", {"s": Scan("sum", F.col("v")), "m": Scan("max", F.col("v"), exclusive=True), "n": Scan("count")}, ("k",), count=count).orderBy("o").collect()
        for r in out:
            upto = [v for i, (k, v) in enumerate(rows) if k == r["k"] and i <= r["o"]]
            before = [v for i, (k, v) in enumerate(rows) if k == r["k"] and i < r["o"] and v is not None]
            known = [v for v in upto if v is not None]
            assert (r["s"], r["m"], r["n"]) == (sum(known) if known else None, max(before, default=None), len(upto))

    check()


def test_entry_module_works_without_the_corpus_operators(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and e.entry(spark).columns
