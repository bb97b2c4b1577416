"""Prefix scans over a total order, in two phases.

``Window.orderBy(seq)`` without a partition sorts everything in one task, and one with a hot key sorts that key's rows in
one task.  Here rows are cut into ranges of the order; each range (of each key) is scanned by itself, and what comes
before it is added from a small table with one row for each range of each key.  Rows are dealt to tasks by their range, once:
windows over keys and ranges need no other exchange, so scans that follow each other share it, however many there are and
whatever their keys.  No task gets more than a few ranges, however hot a key is.

The small table is made when the scan is, by a job of its own: a scan's plan then holds its input once, and plans of chained
scans grow with their number.  Without keys the table has a row a range, which the driver holds; with keys it is
written to the shared folder.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .places import written

RANGE = "__range"


@dataclass(frozen=True)
class Scan:
    """A running aggregate: sum, count, min or max of a column, up to the row, or up to the one before it."""

    kind: str
    column: Column | None = None
    exclusive: bool = False

    def aggregate(self) -> Column:
        if self.kind == "count":
            return F.count("*")
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](self.column)

    def combine(self, before: Column, here: Column) -> Column:
        if self.kind == "count":
            return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
        if self.kind == "sum":
            return F.coalesce(before + here, before, here)
        return (F.least if self.kind == "min" else F.greatest)(before, here)


def ranges(df: DataFrame, order: str, count: int | None = None) -> DataFrame:
    """df with the number of its range of the order column; ranges are about equally large, and tasks get whole ranges.

    One pass over that column finds the bounds, so scans that follow each other should share the column of ranges; ``count`` of them at most reach the driver.
    """
    n = count or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(df.select(F.percentile_approx(order, [i / n for i in range(1, n)], 20 * n)).first()[0] or [])) if n > 1 else []
    if not bounds:
        return df.withColumn(RANGE, F.lit(0))
    # Two lookups in lists of about sqrt(n) bounds each.
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    literal = lambda x: F.lit(x)
    coarse = F.array(*[literal(g[0]) for g in groups])
    fine = F.array(*[F.array(*map(literal, g)) for g in groups])
    group = F.size(F.filter(coarse, lambda b: b <= F.col(order)))
    inner = F.size(F.filter(F.get(fine, group - 1), lambda b: b <= F.col(order)))
    return df.withColumn(RANGE, F.when(group > 0, (group - 1) * step + inner).otherwise(0).cast("int"))


def dealt(df: DataFrame) -> DataFrame:
    """df with whole ranges in its tasks.  The column says so itself, so that this is done once for scans in a row."""
    if df.schema[RANGE].metadata.get("dealt"):
        return df
    return df.repartition(RANGE).withMetadata(RANGE, {"dealt": True})


def scan(df: DataFrame, order: str, scans: dict[str, Scan], keys: tuple[str, ...] = (), reverse: bool = False, then: tuple[str, ...] = (), count: int | None = None) -> DataFrame:
    """df with a column for each scan.

    A column of ranges that df has already (see ``ranges``) is used, and kept; it must be of the same order.
    ``then`` names columns that order rows of equal ``order``.  With ``reverse`` scans run from the end.  Null keys are a key.
    """
    cut = dealt(df if RANGE in df.columns else ranges(df, order, count))
    direction = (lambda c: F.col(c).desc_nulls_last()) if reverse else (lambda c: F.col(c).asc_nulls_first())
    window = Window.partitionBy(*keys, RANGE).orderBy(*[direction(c) for c in (order, *then)])
    here = {f"__here_{n}": s.aggregate().over(window.rowsBetween(Window.unboundedPreceding, -1 if s.exclusive else 0)) for n, s in scans.items()}
    before = _before(cut, scans, keys, direction)
    match = F.col(RANGE) == F.col("__at")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    joined = cut.withColumns(here).join(before, match)
    return joined.select(*(df.columns if RANGE in df.columns else cut.columns), *[s.combine(F.col(f"__before_{n}"), F.col(f"__here_{n}")).alias(n) for n, s in scans.items()])


def _before(cut: DataFrame, scans: dict[str, Scan], keys: tuple[str, ...], direction) -> DataFrame:
    """What comes before each range of each key: __key_..., __at, __before_..."""
    totals = cut.groupBy(*keys, RANGE).agg(*[s.aggregate().alias(f"__before_{n}") for n, s in scans.items()])
    if not keys:
        totals = totals.sparkSession.createDataFrame(totals.collect(), totals.schema)
    earlier = Window.partitionBy(*keys).orderBy(direction(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    folded = {n: F.sum if s.kind in ("sum", "count") else F.min if s.kind == "min" else F.max for n, s in scans.items()}
    before = totals.select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.col(RANGE).alias("__at"), *[folded[n](f"__before_{n}").over(earlier).alias(f"__before_{n}") for n in scans])
    if keys:
        return written(before, "scan")
    return F.broadcast(before)


def numbered(df: DataFrame, order: str, name: str = "_seq", then: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """df with 0-based consecutive numbers in the order, within each key."""
    return scan(df, order, {name: Scan("count")}, keys, then=then).withColumn(name, F.col(name) - 1)
