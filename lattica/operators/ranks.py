"""Ranks over any number of rows without a window that draws a group into one task.

Values are counted.  Where the counts themselves are few they are sorted by group; else they are
range-partitioned by (group, value), and each range numbers its own values on top of the totals of the
ranges before it.  Tied values share their average rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.bins import pearson
from lattica.operators.skew import join_keys, lookup
from lattica.session import colname, parallelism, q, written


#: Up to so many distinct values of all groups are sorted by group; more are cut into ranges.
MOST_SORTED = 500_000


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, n, before, total): of each distinct value its rows, the rows below it and all rows of
    its group.  Null and NaN values have no rank."""
    return _ranks(df, value, by)[0]


def _ranks(df: DataFrame, value: str, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """:func:`value_ranks`, and the written table behind it, which has as many rows."""
    keys = [q(c) for c in by]
    known = df.where(q(value).isNotNull() & ~F.isnan(q(value).cast("double")))
    counts = known.groupBy(*keys, q(value)).agg(F.count("*").alias("n"))
    counts = written(counts, "counts")
    if counts.limit(MOST_SORTED + 1).count() <= MOST_SORTED:
        along = Window.partitionBy(*keys).orderBy(q(value)).rowsBetween(Window.unboundedPreceding, -1)  # bounded by the count
        return counts.select(*keys, q(value), "n", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(*keys)).alias("total")), counts
    ranged = written(counts.repartitionByRange(parallelism(df.sparkSession), *keys, q(value)).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("n").alias("_in"))
    up = Window.partitionBy(*keys).orderBy("_range")  # as many rows as ranges
    totals = totals.withColumn("_offset", F.coalesce(F.sum("_in").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = totals.withColumn("total", F.sum("_in").over(Window.partitionBy(*keys))).drop("_in")
    inside = Window.partitionBy(*keys, "_range").orderBy(q(value)).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    joined = join_keys(local, totals, [*by, "_range"])
    return joined.select(*keys, q(value), "n", (F.col("_offset") + F.col("_local")).alias("before"), "total"), ranged


def _attached(df: DataFrame, scores: DataFrame, value: str, by: Sequence[str], counted: DataFrame) -> DataFrame:
    """``df`` with the scores of its values; a value that most rows share is no burden."""
    return lookup(df, scores, [*by, value], null_safe=True, counted=counted)


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """``df`` with ``out``, the rank from 1 with ties averaged; null for null and NaN."""
    r, ranged = _ranks(df, value, by)
    return _attached(df, r.select(*[q(c) for c in by], q(value), (F.col("before") + (F.col("n") + 1) / 2).alias(out)), value, by, ranged)


def pct_rank(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "pct") -> DataFrame:
    """Average rank divided by the rows of the group (not ``percent_rank``)."""
    r, ranged = _ranks(df, value, by)
    return _attached(df, r.select(*[q(c) for c in by], q(value), ((F.col("before") + (F.col("n") + 1) / 2) / F.col("total")).alias(out)), value, by, ranged)


def pct_bin(pct: Column, bins: int = 5) -> Column:
    """The bin, from 0, of a percent rank: ``floor(min(bins * pct, bins - 0.001))``."""
    return F.floor(F.least(pct * bins, F.lit(bins - 0.001))).cast("int")


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., rho, n): the rank correlation of complete pairs; null for constant input.  Both columns are ranked in
    one pass over their values."""
    which, keys = colname(list(by), base="_which"), [q(c) for c in by]
    both = df.where(q(x).isNotNull() & q(y).isNotNull() & ~F.isnan(q(x).cast("double")) & ~F.isnan(q(y).cast("double"))).select(*keys, q(x).cast("double").alias("_x"), q(y).cast("double").alias("_y"))
    values = both.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias(which), F.col(c).alias("_v")) for c in ("_x", "_y")])).alias("_c")).select(*keys, "_c.*")
    r, ranged = _ranks(values, "_v", [*by, which])
    rank = (F.col("before") + (F.col("n") + 1) / 2).alias("_r")
    for c in ("_x", "_y"):
        both = _attached(both, r.where(F.col(which) == c).select(*keys, F.col("_v").alias(c), rank.alias(f"_r{c}")), c, by, ranged)
    return both.groupBy(*keys).agg(pearson(F.col("_r_x"), F.col("_r_y")).alias("rho"), F.count("*").alias("n"))


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str] = (), out: str = "q") -> DataFrame:
    """``df`` with ``out``: the smallest ``p * m / rank`` of this and all larger p values.  Null p values
    count for nothing.  Works on the distinct p values, range by range from the top."""
    r = value_ranks(df, p, by)
    # the rank of a tied value is the place of its last row
    scored = r.select(*[q(c) for c in by], q(p), (q(p) * F.col("total") / (F.col("before") + F.col("n"))).alias("_raw"))
    ranged = written(scored.repartitionByRange(parallelism(df.sparkSession), *[q(c) for c in by], q(p)).withColumn("_range", F.spark_partition_id()), "ranges")
    keys = [q(c) for c in by]
    above = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    tops = ranged.groupBy(*keys, "_range").agg(F.min("_raw").alias("_least")).withColumn("_above", F.min("_least").over(above)).drop("_least")
    inside = Window.partitionBy(*keys, "_range").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    final = join_keys(ranged.withColumn("_own", F.min("_raw").over(inside)), tops, [*by, "_range"]).select(*keys, q(p), F.least(F.col("_own"), F.col("_above"), F.lit(1.0)).alias(out))
    return _attached(df, final, p, by, ranged)


def mann_whitney(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n1, n2, u, z): the statistic of rows with ``group`` true against false, tie-corrected, with
    the normal approximation's z (continuity corrected)."""
    r = value_ranks(df, value, by)
    ties = r.groupBy(*[q(c) for c in by]).agg(F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("_ties"))
    ranked = average_rank(df.select(*[q(c) for c in by], q(value), q(group)), value, by, "_r").where(F.col("_r").isNotNull() & q(group).isNotNull())
    sums = ranked.groupBy(*[q(c) for c in by]).agg(F.count_if(q(group)).alias("n1"), F.count_if(~q(group)).alias("n2"), F.sum(F.when(q(group), F.col("_r"))).alias("_s"))
    both = join_keys(sums, ties, list(by)) if by else sums.crossJoin(ties)  # one row each
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("_s") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1)))
    gap = u - n1 * n2 / 2
    z = F.try_divide(F.signum(gap) * F.greatest(F.abs(gap) - 0.5, F.lit(0.0)), F.sqrt(F.when(var > 0, var)))
    return both.select(*[q(c) for c in by], "n1", "n2", u.alias("u"), z.alias("z"))
