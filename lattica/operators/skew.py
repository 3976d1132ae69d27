"""Joins and running states that hold when one key has any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import BROADCAST_BYTES, colname, parallelism, q, small_enough, written


def matches(left: Sequence[str], right: Sequence[str], null_safe: bool = True) -> Column:
    """That every column of ``left`` equals its partner of ``right``, nulls too if ``null_safe``."""
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & (q(a).eqNullSafe(q(b)) if null_safe else q(a) == q(b))
    return cond


def join_keys(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` where all of ``on`` are equal, nulls too."""
    tags = [colname(left.columns, right.columns, base=f"_on{i}") for i in range(len(on))]
    side = right.withColumnsRenamed(dict(zip(on, tags)))
    return left.join(side, matches(on, tags), how).drop(*tags)


def salted(left: DataFrame, right: DataFrame, lk: Sequence[str], rk: Sequence[str], base: str) -> tuple[DataFrame, DataFrame, str]:
    """Spread keys that hold more than a partition's share of ``left`` over as many salts as their share
    needs, equal rows too; ``right`` has those keys' rows once per salt.  The sides then also match on
    ``{slot}l = {slot}r``.  At most as many keys as partitions can be hot, which bounds the list that is
    broadcast.  Null keys are spread like others.  Salts follow the place of a row in its partition: ``left`` should
    be read from files, so that a task run again finds the same places."""
    parts = parallelism(left.sparkSession)
    counts = written(left.groupBy(*[q(k) for k in lk]).agg(F.count("*").alias(f"{base}c")), "key_counts")
    share = max(1, (counts.agg(F.sum(f"{base}c")).first()[0] or 0) // parts)
    tags = [f"{base}h{i}" for i in range(len(lk))]
    hot = counts.where(F.col(f"{base}c") > share).select(*[q(k).alias(t) for k, t in zip(lk, tags)], F.ceil(F.col(f"{base}c") / share).cast("int").alias(f"{base}n"))
    slot = f"{base}z"
    place = F.monotonically_increasing_id()
    spread = F.when(F.col(f"{base}n").isNotNull(), F.pmod(F.col(f"{base}p"), F.col(f"{base}n"))).otherwise(F.lit(0)).cast("int")
    left = left.withColumn(f"{base}p", place).join(F.broadcast(hot), matches(lk, tags), "left").withColumn(f"{slot}l", spread)
    right = right.join(F.broadcast(hot), matches(rk, tags), "left").withColumn(f"{slot}r", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"{base}n"), F.lit(1)) - 1)))
    return left.drop(f"{base}n", f"{base}p", *tags), right.drop(f"{base}n", *tags), slot


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", limit: int = BROADCAST_BYTES, null_safe: bool = False, counted: DataFrame | None = None, small: bool | None = None) -> DataFrame:
    """``left`` with the other columns of ``right``, which has one row per ``on``: by broadcast if ``right`` is counted
    small, else shuffled with hot keys of ``left`` salted.  ``how``: left or inner.  Null keys find nothing, or
    each other with ``null_safe``.  ``right`` should be written, as it is counted first; or else ``counted`` be written and
    have as many rows as it, or ``small`` tell what a count of at least its rows said."""
    base = colname(left.columns, right.columns, base="_lk")
    tags = [f"{base}k{i}" for i in range(len(on))]
    side = right.select(*[q(c).alias(t) for c, t in zip(on, tags)], *[q(c) for c in right.columns if c not in on])
    if small is None:
        side, small = small_enough(side, limit, counted)
    elif small:
        side = F.broadcast(side)
    cond, drop = F.lit(True), list(tags)
    if not small:
        left, side, slot = salted(left, side, on, tags, base)
        cond, drop = F.col(f"{slot}l") == F.col(f"{slot}r"), [*drop, f"{slot}l", f"{slot}r"]
    for c, t in zip(on, tags):
        cond = cond & (left[c].eqNullSafe(F.col(t)) if null_safe else left[c] == F.col(t))
    return left.join(side, cond, how).drop(*drop)


def ordered_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` range-partitioned by keys and order and written with ``_block``, its partition: blocks of a key
    follow its order, and none holds more than a partition, however large the key."""
    cols = [q(c) for c in [*keys, *order]]
    return written(df.repartitionByRange(parallelism(df.sparkSession), *cols).withColumn("_block", F.spark_partition_id()), "blocks")


def carried_last(blocks: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    """``blocks`` (of :func:`ordered_blocks`) with ``out``: the last value that is not null up to each row in the
    order of its key.  Windows run inside blocks; the blocks' last values are carried on in order."""
    ks = [q(c) for c in keys]
    inside = Window.partitionBy(*ks, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocks.withColumn("_own", F.last(q(value), ignorenulls=True).over(inside))
    ends = blocks.where(q(value).isNotNull()).groupBy(*ks, "_block").agg(F.max_by(q(value), F.struct(*order)).alias("_end"))
    every = join_keys(blocks.select(*ks, "_block").distinct(), ends, [*keys, "_block"], "left")
    before = Window.partitionBy(*ks).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = every.withColumn("_in", F.last("_end", ignorenulls=True).over(before)).where("_in IS NOT NULL").select(*ks, "_block", "_in")
    return join_keys(local, carry, [*keys, "_block"], "left").withColumn(out, F.coalesce("_own", "_in")).drop("_own", "_in")


def carried_sum(blocks: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    """``blocks`` with ``out``: the running sum of ``value`` in the order of the key, this row included."""
    ks = [q(c) for c in keys]
    inside = Window.partitionBy(*ks, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocks.withColumn("_own", F.sum(q(value)).over(inside))
    sums = blocks.groupBy(*ks, "_block").agg(F.sum(q(value)).alias("_sum"))
    before = Window.partitionBy(*ks).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.withColumn("_in", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    return join_keys(local, carry, [*keys, "_block"]).withColumn(out, F.col("_own") + F.col("_in")).drop("_own", "_in")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``df`` with ``out``: the place of each row, from 0, in the order of its key.  ``order`` must not tie."""
    one = colname(df.columns, base="_one")
    blocks = ordered_blocks(df.withColumn(one, F.lit(1)), keys, order)
    return carried_sum(blocks, keys, [q(c) for c in order], one, out).withColumn(out, F.col(out) - 1).drop(one, "_block")
