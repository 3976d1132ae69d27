"""References to records that do not exist (problem 4).

Rows of a child table refer to a parent table by one or several key columns.  The rows are grouped by
their *null mask* (which key columns are null); each mask is anti-joined on its non-null columns
alone, under the declared match rule:

* ``simple``:  a row with any null key is no reference and never an orphan;
* ``partial``: a row must match some parent on its non-null columns; a row of nulls is no reference;
* ``full``:    a row of nulls is no reference, one that is partly null is an orphan by itself.

Parents may be valid for a period only, ``[start, end)``, with a null end for "still".  Before the join
the periods of each key are reduced to disjoint ones: open periods fold into the earliest start by a
map-side aggregate, closed ones are merged as islands, so a parent key repeated a million times costs
one row.  The islands are broadcast if a count proves them small; otherwise the join is shuffled, and
keys that hold more than their share of the child's rows are salted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.skew import salted
from lattica.session import BROADCAST_BYTES, colname, small_enough, written

MATCH = ("simple", "partial", "full")


def disjoint_periods(parent: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Per key the union of its periods ``[start, end)`` as disjoint rows.  A null start never begins,
    a null end never ends, and a period with ``end <= start`` is empty.  Rows with a null key go."""
    known = parent.where(F.col(start).isNotNull() & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    opened = known.where(F.col(end).isNull()).groupBy(*keys).agg(F.min(start).alias(start))
    opened = opened.withColumn(end, F.lit(None).cast(parent.schema[end].dataType))
    # of equal starts the latest end holds all; what begins on one day is joined first, so that the last step sees a
    # row per key and day unless its periods are apart within days
    closed = known.where(F.col(end) > F.col(start)).groupBy(*keys, start).agg(F.max(end).alias(end))
    daily = _islands(closed.withColumn("_day", F.to_date(start)), [*keys, "_day"], start, end).drop("_day")
    return _islands(opened.unionByName(daily), keys, start, end)


def _islands(periods: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Periods that overlap or meet joined into one, per key."""
    by = Window.partitionBy(*keys).orderBy(F.col(start), F.col(end).desc_nulls_first())
    so_far = F.max(F.coalesce(F.col(end).cast("timestamp"), F.lit("9999-12-31 00:00:00").cast("timestamp"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return (
        periods.withColumn("_new", (so_far.isNull() | (F.col(start).cast("timestamp") > so_far)).cast("int"))
        .withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_island")
        .agg(F.min(start).alias(start), F.max(F.col(end).isNull()).alias("_open"), F.max(end).alias(end))
        .select(*keys, start, F.when(~F.col("_open"), F.col(end)).alias(end))
    )


def find_orphans(
    child: DataFrame,
    parent: DataFrame,
    keys: Sequence[tuple[Column, Column]],
    *,
    at: str | None = None,
    start: str | None = None,
    end: str | None = None,
    match: str = "simple",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The rows of ``child``, all columns kept and repeated rows kept, that refer to no parent.

    ``keys`` holds pairs (child expression, parent expression).  With ``at``, ``start`` and ``end`` a
    parent counts only if ``start <= at < end`` (null ``end``: for ever); a child whose ``at`` is null
    is then matched by no parent.  An empty parent makes every reference an orphan, an empty child gives
    an empty result.  Columns of the two sides may share names."""
    if match not in MATCH:
        raise ValueError(f"match is one of {MATCH}, not {match!r}")
    n = len(keys)
    base = colname(child.columns, parent.columns, base="_ref")
    kid, par = [f"{base}c{i}" for i in range(n)], [f"{base}p{i}" for i in range(n)]
    mask, at_name, s_name, e_name = f"{base}m", f"{base}t", f"{base}s", f"{base}e"
    rows = child.withColumns({k: expr for k, (expr, _) in zip(kid, keys)})
    rows = rows.withColumn(mask, sum((F.col(k).isNull().cast("int") * (1 << i) for i, k in enumerate(kid)), F.lit(0)))
    dated = at is not None and start is not None
    if dated:
        rows = rows.withColumn(at_name, F.col(at))
    stop = F.col(end) if end else F.lit(None).cast("timestamp")
    side = parent.select(*[expr.alias(p) for p, (_, expr) in zip(par, keys)], *([F.col(start).alias(s_name), stop.alias(e_name)] if dated else []))
    everything = (1 << n) - 1
    masks = [0] if match == "simple" or n == 1 else [m for m in range(everything) if match == "partial" or m == 0]
    found = []
    for m in masks:
        live = [i for i in range(n) if not m >> i & 1]
        on = [par[i] for i in live]
        if dated:
            there = disjoint_periods(side, on, s_name, e_name)
        else:
            there = side.select(*on).dropna().distinct()
        there, small = small_enough(written(there, "parents"), broadcast_bytes)
        mine = rows.where(F.col(mask) == m)
        when = [F.col(kid[i]) == F.col(par[i]) for i in live]
        salt = None
        if not small:
            mine, there, salt = salted(mine, there, [kid[i] for i in live], on, base)
            when.append(F.col(f"{salt}l") == F.col(f"{salt}r"))
        if dated:
            when.append(F.col(at_name) >= F.col(s_name))
            when.append(F.col(e_name).isNull() | (F.col(at_name) < F.col(e_name)))
        found.append(mine.join(there, reduce(lambda a, b: a & b, when), "left_anti").select(*child.columns))
    if match == "full" and n > 1:
        found.append(rows.where((F.col(mask) != 0) & (F.col(mask) != everything)).select(*child.columns))
    return reduce(DataFrame.unionByName, found)


def orphans_by_month(orphans: DataFrame, table: str = "child_table", field: str = "child_field", at: str = "loaded_at") -> DataFrame:
    """Counts per table, field and month of ``at``; rows without a time are counted under a null month."""
    month = F.date_format(F.col(at), "yyyy-MM")
    return orphans.groupBy(table, field, month.alias("month")).agg(F.count("*").alias("orphans"))
