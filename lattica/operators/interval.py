"""Interval, as-of, range, overlap and rank-neighbour joins.

A join on ``part = part AND p BETWEEN lo AND hi`` alone piles a part into one task.  Here both sides also
get *bins* of a given width: an interval is copied to the bins it touches, a point has one bin, and the
join runs on (part, bin) with the exact test on top.  Work per task is bounded by the bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.skew import carried_last, carried_sum, numbered, ordered_blocks, salted
from lattica.session import colname, q, small_enough, written


def _binned(df: DataFrame, lo: Column, hi: Column, width: float, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))


def _in_bins(left: DataFrame, right: DataFrame, lk: Sequence[str], rk: Sequence[str]) -> tuple[DataFrame, DataFrame, Column, list[str]]:
    """The sides of a join on bins, its condition and the columns to drop after it.  ``right`` is broadcast if counted
    small; else bins that hold more than a partition's share of ``left`` are salted."""
    right, small = small_enough(written(right, "binned"))
    cond, drop = F.lit(True), list(rk)
    if not small:
        left, right, slot = salted(left, right, lk, rk, "_pi")
        cond, drop = F.col(f"{slot}l") == F.col(f"{slot}r"), [*drop, f"{slot}l", f"{slot}r"]
    for a, b in zip(lk, rk):
        cond = cond & (left[a] == F.col(b))
    return left, right, cond, drop


def points_in_intervals(points: DataFrame, intervals: DataFrame, on: Sequence[str], at: str, start: str, end: str, width: float, how: str = "inner", closed: str = "both") -> DataFrame:
    """Every point with every interval of the same ``on`` that holds it.  ``closed``: both ends, or
    'neither'.  Points without a place, empty and null intervals match nothing; ``how='left'`` keeps
    points without a match."""
    lo, hi, p = q(start), q(end), q(at)
    side = intervals.where(lo.isNotNull() & hi.isNotNull() & (lo <= hi))
    side = _binned(side, lo, hi, width, "_bin")
    keys = [f"_k{i}" for i in range(len(on))]
    side = side.select(*[q(c).alias(k) for c, k in zip(on, keys)], "_bin", *[q(c) for c in side.columns if c not in on and c != "_bin"])
    pts = points.withColumn("_pbin", F.floor(p / width))
    pts, side, cond, drop = _in_bins(pts, side, [*on, "_pbin"], [*keys, "_bin"])
    inside = (p >= side[start]) & (p <= side[end]) if closed == "both" else (p > side[start]) & (p < side[end])
    return pts.join(side, cond & inside, how).drop("_pbin", *drop)


def as_of(points: DataFrame, events: DataFrame, on: Sequence[str], at: str, start: str, fields: Sequence[str], tie: Sequence[str] = (), until: str | None = None) -> DataFrame:
    """``points`` with the ``fields`` of the latest event whose ``start <= at`` (ties in ``start``: the last by
    ``tie``), null without one; with ``until``, null also if ``at`` lies beyond that event's end.  Points and events
    are put in one order and cut into blocks; the last event of a block is carried to the next, so no key
    is drawn into one task.  Points without a place get nulls."""
    ev = events.where(q(start).isNotNull())
    keep = [*fields, *([until] if until else [])]
    row = points.select(F.struct(*[q(c) for c in points.columns])).schema[0].dataType
    e = ev.select(*[q(c) for c in on], q(start).alias("_at"), F.lit(0).alias("_kind"), F.struct(*[q(c) for c in (tie or fields)]).alias("_tie"), F.struct(*[q(c).alias(f"f{i}") for i, c in enumerate(keep)]).alias("_f"), F.lit(None).cast(row).alias("_row"))
    p = points.select(*[q(c) for c in on], q(at).cast(ev.schema[start].dataType).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(e.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(e.schema["_f"].dataType).alias("_f"), F.struct(*[q(c) for c in points.columns]).alias("_row"))
    blocks = ordered_blocks(e.unionByName(p), on, ["_at", "_kind", "_tie"])
    both = carried_last(blocks, on, [F.col("_at"), F.col("_kind"), F.col("_tie")], "_f", "_last").where("_kind = 1")
    ok = F.col("_row")[at].isNotNull()
    if until:
        ok = ok & (F.col("_row")[at] <= F.col("_last")[f"f{len(keep) - 1}"])
    return both.select(*[F.col("_row")[c].alias(c) for c in points.columns], *[F.when(ok, F.col("_last")[f"f{i}"]).alias(c) for i, c in enumerate(fields)])


def events_before(points: DataFrame, events: DataFrame, on: Sequence[str], at: str, place: str, out: str = "before") -> DataFrame:
    """``points`` with the number of events of the same ``on`` strictly before them, by running sums over ordered
    blocks; null for points without a place."""
    row = points.select(F.struct(*[q(c) for c in points.columns])).schema[0].dataType
    e = events.where(q(place).isNotNull()).select(*[q(c) for c in on], q(place).cast("double").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(row).alias("_row"))
    p = points.select(*[q(c) for c in on], q(at).cast("double").alias("_at"), F.lit(0).alias("_kind"), F.struct(*[q(c) for c in points.columns]).alias("_row"))
    blocks = ordered_blocks(e.unionByName(p), on, ["_at", "_kind"])
    both = carried_sum(blocks, on, [F.col("_at"), F.col("_kind")], "_kind", out).where("_kind = 0")
    return both.select(*[F.col("_row")[c].alias(c) for c in points.columns], F.when(F.col("_row")[at].isNotNull(), F.col(out)).alias(out))


def strongest_between(pairs: DataFrame, points: DataFrame, on: Sequence[str], lo: str, hi: str, place: str, value: str, width: float, key: Sequence[str], out: str = "strongest") -> DataFrame:
    """``pairs`` with the largest ``value`` of the points strictly between ``lo`` and ``hi``; null without any.
    ``key`` identifies a pair."""
    spans = pairs.select(*[q(c) for c in key], *[q(c) for c in on if c not in key], q(lo).alias("_lo"), q(hi).alias("_hi"))
    hits = points_in_intervals(points.select(*[q(c) for c in on], q(place).alias("_p"), q(value).alias("_v")), spans, on, "_p", "_lo", "_hi", width, closed="neither")
    best = hits.groupBy(*[q(c) for c in key]).agg(F.max("_v").alias(out))
    return pairs.join(best, list(key), "left")


def contained_and_crossed(pairs: DataFrame, spans: DataFrame, on: Sequence[str], a: str, b: str, start: str, end: str, width: float, key: Sequence[str]) -> DataFrame:
    """``pairs`` with ``same`` (some span holds both places) and ``crossed`` (spans that hold exactly one).
    Each place is located on its own, so work follows the hits, not pairs times spans."""
    ids = spans.select(*[q(c) for c in on], q(start), q(end)).withColumn("_sid", F.monotonically_increasing_id())
    ids = written(ids, "spans")  # ids must not change between the two uses
    one = lambda col, name: points_in_intervals(pairs.select(*[q(c) for c in key], *[q(c) for c in on if c not in key], q(col).alias("_p")), ids, on, "_p", start, end, width).select(*[q(c) for c in key], "_sid", F.lit(1).alias(name))
    both = one(a, "_a").join(one(b, "_b"), [*key, "_sid"], "full")
    got = both.groupBy(*[q(c) for c in key]).agg(F.bool_or(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("same"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("crossed"))
    return pairs.join(got, list(key), "left").withColumns({"same": F.coalesce("same", F.lit(False)), "crossed": F.coalesce("crossed", F.lit(0))})


def range_pairs(points: DataFrame, on: Sequence[str], at: str, key: str, reach: float, fields: Sequence[str] = ()) -> DataFrame:
    """Every two points of the same ``on`` with ``0 <= at2 - at1 <= reach``, the earlier first (ties: the
    smaller key): key1, key2, at1, at2 and fields.  Bins are ``reach`` wide, a point looks into its own and
    the next."""
    cols = [key, at, *fields]
    known = points.where(q(at).isNotNull())
    a = known.select(*[q(c).alias(f"_a{i}") for i, c in enumerate(on)], *[q(c).alias(f"{c}1") for c in cols]).withColumn("_bin", F.explode(F.array(F.floor(F.col(f"{at}1") / reach), F.floor(F.col(f"{at}1") / reach) + 1)))
    b = known.select(*[q(c).alias(f"_b{i}") for i, c in enumerate(on)], *[q(c).alias(f"{c}2") for c in cols]).withColumn("_bin2", F.floor(F.col(f"{at}2") / reach))
    a, b, cond, _ = _in_bins(a, b, [*[f"_a{i}" for i in range(len(on))], "_bin"], [*[f"_b{i}" for i in range(len(on))], "_bin2"])
    gap = F.col(f"{at}2") - F.col(f"{at}1")
    cond = cond & (gap <= reach) & ((gap > 0) | ((gap == 0) & (F.col(f"{key}1") < F.col(f"{key}2"))))
    return a.join(b, cond).select(*[F.col(f"_a{i}").alias(c) for i, c in enumerate(on)], *[f"{c}1" for c in cols], *[f"{c}2" for c in cols])


def rank_neighbours(points: DataFrame, on: Sequence[str], rank: str, reach: int, fields: Sequence[str]) -> DataFrame:
    """Each row with the rows of the same ``on`` up to ``reach`` ranks away on either side: fields suffixed 1
    and 2, and ``steps``.  An equi-join on the rank, one copy per step."""
    a = points.select(*[q(c) for c in on], q(rank).alias("_r"), *[q(c).alias(f"{c}1") for c in fields]).withColumn("steps", F.explode(F.array(*[F.lit(s) for s in range(-reach, reach + 1) if s])))
    b = points.select(*[q(c) for c in on], q(rank).alias("_to"), *[q(c).alias(f"{c}2") for c in fields])
    return a.withColumn("_to", F.col("_r") + F.col("steps")).join(b, [*on, "_to"]).select(*on, "steps", *[f"{c}1" for c in fields], *[f"{c}2" for c in fields])


def overlap_unique(a: DataFrame, b: DataFrame, on: Sequence[str], start: str, end: str, key: str, width: float, fields: Sequence[str]) -> DataFrame:
    """``a`` with the ``fields`` of the one interval of ``b`` that overlaps it (ends included); rows with none or
    several go.  Both have columns ``on``, ``start`` and ``end``."""
    left = _binned(a.where(q(start) <= q(end)), q(start), q(end), width, "_bin")
    right = b.where(q(start) <= q(end)).select(*[q(c).alias(f"_k{i}") for i, c in enumerate(on)], q(start).alias("_s"), q(end).alias("_e"), *[q(c).alias(f"_f{i}") for i, c in enumerate(fields)])
    right = _binned(right, F.col("_s"), F.col("_e"), width, "_bin2")
    left, right, cond, _ = _in_bins(left, right, [*on, "_bin"], [*[f"_k{i}" for i in range(len(on))], "_bin2"])
    cond = cond & (left[start] <= F.col("_e")) & (left[end] >= F.col("_s"))
    # an overlap is seen in each bin that both touch: the first such bin counts
    cond = cond & (F.col("_bin") == F.greatest(F.floor(left[start] / width), F.floor(F.col("_s") / width)))
    met = left.join(right, cond)
    hits = met.groupBy(left[key]).agg(F.count("*").alias("_n"), F.first(F.struct(*[f"_f{i}" for i in range(len(fields))])).alias("_one")).where("_n = 1")
    return a.join(hits.select(q(key), *[F.col("_one")[f"_f{i}"].alias(c) for i, c in enumerate(fields)]), key)


def density(points: DataFrame, on: Sequence[str], at: str, reach: int, out: str = "density") -> DataFrame:
    """``points`` with the number of points of the same ``on`` at most ``reach`` away, itself included.  ``at`` is
    a whole number (double a half-integer place first).  Both ends are counted by running sums over ordered
    blocks, so a part of any size is no single task."""
    lo, hi, below, upto = (colname(points.columns, base=x) for x in ("_lo", "_hi", "_below", "_upto"))
    known = points.where(q(at).isNotNull()).withColumns({lo: q(at).cast("bigint") - reach, hi: q(at).cast("bigint") + reach + 1})
    places = known.select(*[q(c) for c in on], q(at).cast("bigint").alias("_place"))
    both = events_before(events_before(known, places, on, lo, "_place", below), places, on, hi, "_place", upto)
    return both.withColumn(out, q(upto) - q(below)).drop(lo, hi, below, upto)


def nearest_tolerance(a: DataFrame, b: DataFrame, on: Sequence[str], place: str, other: str, tolerance: int, out: str) -> DataFrame:
    """``a`` with ``out``: the smallest ``other`` of ``b`` within ``tolerance`` of ``place``; null without one.  Equality
    on each offset, no range join."""
    near = a.select(*[q(c) for c in on], q(place)).distinct().withColumn("_o", F.explode(F.sequence(q(place) - tolerance, q(place) + tolerance)))
    hit = near.join(b.select(*[q(c) for c in on], q(other).alias("_o")).distinct(), [*on, "_o"]).groupBy(*[q(c) for c in on], q(place)).agg(F.min("_o").alias(out))
    return a.join(hit, [*on, place], "left")


def cell_lookup(pairs: DataFrame, cells: DataFrame, on: Sequence[str], bin1: str, bin2: str, default: float = 0.0) -> DataFrame:
    """``pairs`` with ``observed`` and ``expected`` of the sparse cell (lower bin, distance in bins); an absent
    cell has ``default`` and the median expected value of its distance."""
    base = pairs.withColumn("lo", F.least(q(bin1), q(bin2))).withColumn("k", F.abs(q(bin1) - q(bin2)))
    medians = cells.groupBy("k").agg(F.median("expected").alias("_median"))
    out = base.join(cells.select(*on, "lo", "k", "observed", "expected"), [*on, "lo", "k"], "left").join(medians, "k", "left")
    return out.withColumns({"observed": F.coalesce("observed", F.lit(default)), "expected": F.coalesce("expected", "_median")}).drop("_median")


def random_partners(pairs: DataFrame, pool: DataFrame, stratum: Sequence[str], key: Sequence[str], rank: str, apart: int, tries: int = 20, seed: int = 0) -> DataFrame:
    """For each pair (columns s1, s2: the strata of its members) two random members of those strata more
    than ``apart`` ranks from each other: u, v.  Draws are hashes of (seed, pair, try); the first valid of
    ``tries`` counts, pairs without one go."""
    pool = numbered(pool.withColumn("_h", F.xxhash64(F.lit(seed), *[q(c) for c in key])), stratum, ["_h", *key], "_n")
    sizes = pool.groupBy(*stratum).agg(F.count("*").alias("_of"))
    s = F.struct(*stratum)
    draws = pairs.withColumn("_try", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    for k in (1, 2):
        size = sizes.select(s.alias(f"s{k}"), F.col("_of").alias(f"_of{k}"))
        draws = draws.join(size, f"s{k}").withColumn(f"_n{k}", F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("_try"), *[q(c) for c in pairs.columns]), F.col(f"_of{k}")))
    for k, name in ((1, "u"), (2, "v")):
        side = pool.select(s.alias(f"s{k}"), F.col("_n").cast("bigint").alias(f"_n{k}"), F.struct(*[q(c) for c in key]).alias(name), q(rank).alias(f"_r{k}"))
        draws = draws.join(side, [f"s{k}", f"_n{k}"])
    valid = draws.where(F.abs(F.col("_r1") - F.col("_r2")) > apart)
    first = valid.groupBy(*[q(c) for c in pairs.columns]).agg(F.min_by(F.struct("u", "v"), "_try").alias("_p"))
    return first.select(*[q(c) for c in pairs.columns], F.col("_p.u").alias("u"), F.col("_p.v").alias("v"))
