"""Splits that keep related records together (problem 1).

Components.  The parent array is a table (node, parent).  Each round hooks: across every link whose
ends hang under different roots, the larger root is put under the smaller; and shortcuts: every node
moves to its grandparent until the trees are stars.  Rounds are joins of written tables; only nodes that
occur in a link take part, all others are components by themselves.

Proportions.  Components matter only through their sizes, so the choice of components for each split is
made on the table (size, number of components of that size), which has at most sqrt(2 * rows) rows.
Bitsets of reachable totals, multiplicities split in binary, give the total closest to each target.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.keys import leading_tokens
from lattica.operators.hotkeys import number_rows
from lattica.operators.skew import lookup
from lattica.session import q, small_enough, written

#: Totals are held in units so that a bitset has at most this many bits.
MOST_BITS = 1 << 20


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """(node, root) of every node in ``links``; the root is the smallest node of its component.  Null ends
    and self links join nobody; repeated and reversed links count once.  No links, no rows."""
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = written(ends.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "edges")
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    parent = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("parent")), "parent")
    _, small = small_enough(parent.withColumn("grand", F.col("parent")))  # there are as many nodes in every round, and no more hooks
    for _ in range(rounds):
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        ru = parent.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        rv = parent.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        # hook: the larger of two roots that a link connects goes under the smallest root it meets
        tied = lookup(lookup(edges, ru, ["u"], "inner", small=small), rv, ["v"], "inner", small=small)
        hooks = tied.where("pu <> pv").groupBy(F.greatest("pu", "pv").alias("parent")).agg(F.min(F.least("pu", "pv")).alias("hooked"))
        moved = lookup(lookup(parent, up, ["parent"], small=small), hooks if small else written(hooks, "hooks"), ["parent"], small=small)
        # shortcut: to the grandparent, or to what the parent was hooked to
        step = moved.select("node", F.least(F.coalesce("grand", "parent"), F.coalesce("hooked", "parent")).alias("to"), (F.col("parent")).alias("was"))
        step = written(step, "parent")
        parent = step.select("node", F.col("to").alias("parent"))
        if step.where("to <> was").limit(1).count() == 0:
            return parent.select("node", F.col("parent").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def grouped(rows: DataFrame, entity: Column, links: DataFrame, a: str, b: str) -> DataFrame:
    """``rows`` with ``_group``: the root of each row's entity (the entity itself if nothing links it, null
    if it is null).  The roots are broadcast if counted small; else they are joined by shuffle with the rows of
    large entities salted."""
    roots = components(links, a, b)
    roots = roots.select(F.col("node").alias("_entity"), "root")
    tagged = lookup(rows.withColumn("_entity", entity), roots, ["_entity"])
    return tagged.withColumn("_group", F.coalesce("root", "_entity")).drop("_entity", "root")


def _reach(sizes: list[tuple[int, int]], goal: int, unit: int = 1) -> dict[int, int]:
    """How many of each size to take so that their total, sizes counted in whole ``unit``s, is closest to ``goal``
    units (the smaller of two equally close totals).  One bitset of reachable totals; multiplicities are
    split in binary."""
    parts: list[tuple[int, int, int]] = []
    for s, m in sizes:
        k = 1
        while m > 0:
            n = min(k, m)
            parts.append((s, n, s * n // unit))
            m, k = m - n, k * 2
    parts.sort(key=lambda p: -p[2])
    # no total beyond twice the goal is closer than none at all
    bits = min(2 * goal, goal + max((p[2] for p in parts), default=0)) + 1
    mask, reach = (1 << bits) - 1, 1
    first = np.full(bits, -1, np.int32)  # the part by which a total was first reached
    for i, (_, _, w) in enumerate(parts):
        if w == 0 or w >= bits:
            continue
        new = (reach << w) & mask & ~reach
        if new:
            raw = np.frombuffer(new.to_bytes((bits + 7) // 8, "little"), np.uint8)
            first[np.flatnonzero(np.unpackbits(raw, bitorder="little")[:bits])] = i
            reach |= new
            if first[goal] >= 0:
                break
    sums = np.concatenate([[0], np.flatnonzero(first >= 0)])
    at = int(sums[np.argmin(np.abs(sums - goal))])
    got: dict[int, int] = {}
    while at > 0:
        s, n, w = parts[first[at]]
        got[s] = got.get(s, 0) + n
        at -= w
    return got


def _closest(sizes: list[tuple[int, int]], target: int) -> dict[int, int]:
    """How many of each size to take so that their total is closest to ``target`` (the smaller of two equally close
    totals).  Exact while twice the target fits MOST_BITS.  Beyond that, the large groups are taken first, largest
    first and also in units by a bitset, and what is then missing is filled exactly by a bitset over the
    small ones, of at most 1/16 of MOST_BITS rows: no total is missed by more than the rows of the smallest
    group as long as the small groups have as many rows as are missing."""
    total = sum(s * m for s, m in sizes)
    target = max(0, min(target, total))
    if target == 0:
        return {}
    if 2 * target < MOST_BITS:
        return _reach(sizes, target)
    small = max(1, MOST_BITS // 16)
    large = [(s, m) for s, m in sizes if s > small]
    rest = [(s, m) for s, m in sizes if s <= small]
    unit = -(-2 * target // MOST_BITS)
    starts = [{}]
    if large:
        greedy, left = {}, target
        for s, m in sorted(large, reverse=True):
            if n := min(m, left // s):
                greedy[s], left = n, left - n * s
        # units round down: goals below the target by what rounding may hide
        most = sum(min(m, target // s) for s, m in large)
        starts = [greedy, *[_reach(large, max(0, target - back) // unit, unit) for back in sorted({0, sum(s * m for s, m in rest), unit * min(most, MOST_BITS) // 2})]]
    best: tuple[int, dict[int, int]] | None = None
    for start in starts:
        take = dict(start)
        left = target - sum(s * n for s, n in take.items())
        # the largest of the small ones as long as more is missing than a bitset of the others should hold
        for s, m in sorted(rest, reverse=True):
            if left <= 4 * small:
                break
            if n := min(m, (left - 2 * small) // s):
                take[s], left = n, left - n * s
        if left > 0:
            for s, n in _reach([(s, m - take.get(s, 0)) for s, m in rest if m > take.get(s, 0)], left).items():
                take[s] = take.get(s, 0) + n
                left -= s * n
        if best is None or abs(left) < best[0]:
            best = abs(left), take
    return best[1]


def choose(sizes: list[tuple[int, int]], shares: dict[str, float], rest: str) -> dict[int, list[tuple[str, int]]]:
    """Per size the splits and how many groups each takes, in the order of ``shares``; ``rest`` gets what
    is left."""
    total = sum(s * m for s, m in sizes)
    left = dict(sizes)
    out: dict[int, list[tuple[str, int]]] = {s: [] for s in left}
    for name, share in sorted(shares.items(), key=lambda x: x[1]):
        take = _closest([(s, m) for s, m in left.items() if m], round(share * total))
        for s, n in take.items():
            out[s].append((name, n))
            left[s] -= n
    for s, m in left.items():
        out[s].append((rest, m))
    return out


def assign_splits(groups: DataFrame, shares: dict[str, float], rest: str = "train", seed: int = 0) -> DataFrame:
    """(group, size, split) from (group, size): whole groups, totals as close to the shares as sizes
    allow.  Which of equally large groups goes where is decided by a hash of the group's key and the seed.
    Groups without rows have none; an empty table gives an empty one."""
    placed = groups.withColumn("_block", F.pmod(F.xxhash64("group", F.lit(seed)), F.lit(4096)).cast("int")).withColumn("_at", F.struct(F.xxhash64("group", F.lit(seed)), F.col("group")))
    placed = written(number_rows(placed, "size").select("group", "size", "_no"), "groups")
    sizes = [(int(r[0]), int(r[1])) for r in placed.groupBy("size").agg(F.count("*")).collect()]  # at most sqrt(2 * rows) rows
    plan = []
    for size, splits in choose(sorted(sizes), shares, rest).items():
        at = 0
        for name, n in splits:
            if n:
                plan.append((size, at, at + n, name))
                at += n
    spark = groups.sparkSession
    table = spark.createDataFrame(plan or [(0, 0, 0, rest)], "size long, lo long, hi long, split string")
    table = table.withColumn("size", F.col("size").cast(groups.schema["size"].dataType))
    return placed.join(F.broadcast(table), "size").where("_no >= lo AND _no < hi").select("group", "size", "split")


def record_splits(rows: DataFrame, row_id: str, splits: DataFrame) -> DataFrame:
    """(row_id, split) of every row of ``rows`` (with ``_group``) under the splits of its group.  Rows without a group
    are groups of their own (:func:`own_group`).  The splits go to the rows by broadcast if counted small, else by a
    join in which large groups are salted."""
    tagged = rows.select(q(row_id), own_group(row_id).alias("_own"))
    table = written(splits.select(F.col("group").alias("_own"), "split"), "splits")
    return lookup(tagged, table, ["_own"], "inner").select(q(row_id), "split")


def own_group(row_id: str) -> Column:
    """The group of a row; a name of its own for a row without one."""
    return F.coalesce(F.concat(F.lit("g "), F.col("_group")), F.concat(F.lit("row "), q(row_id).cast("string")))


def donor(sample: Column) -> Column:
    return leading_tokens(sample, 2)


def first_of_group(rows: DataFrame, row_id: str) -> DataFrame:
    """(first_row_id, row_id) of every row that is not the first of its ``_group``.  Rows of no group are
    left out.  The smallest ids come from map-side minima; they go back to the rows by broadcast if
    counted small, else by a join in which groups larger than a partition's share are salted."""
    known = rows.where(F.col("_group").isNotNull()).select("_group", F.col(row_id).alias("row_id"))
    firsts = written(known.groupBy("_group").agg(F.min("row_id").alias("first_row_id")), "firsts")
    return lookup(known, firsts, ["_group"], "inner").where("row_id <> first_row_id").select("first_row_id", "row_id")


__all__ = ["assign_splits", "choose", "components", "donor", "first_of_group", "grouped", "own_group", "record_splits"]
