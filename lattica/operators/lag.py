"""Lags along an ordered signal: pairs, triples, circular and linear covariance profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.signal import POSITION, zscore
from lattica.session import q


def as_arrays(signal: DataFrame, value: str = "value", keys: Sequence[str] = ("unit", "sample", "part")) -> DataFrame:
    """One row per ``keys`` with ``x``, the values in rank order.  A part is a chromosome, so arrays are
    bounded."""
    packed = signal.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", q(value).alias("v")))).alias("_a"))
    return packed.select(*keys, F.transform("_a", lambda s: s["v"]).alias("x"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def adjacent_pairs(genes: DataFrame, part: Sequence[str], order: Sequence[str], fields: Sequence[str], lag: int = 1) -> DataFrame:
    """Each row with the ``lag``-th next one of its part: fields suffixed 1 and 2.  Rows without one go."""
    w = Window.partitionBy(*[q(c) for c in part]).orderBy(*[q(c) for c in order])
    nxt = genes.withColumn("_next", F.lead(F.struct(*[q(c) for c in fields]), lag).over(w))
    return nxt.where("_next IS NOT NULL").select(*[q(c) for c in part], *[q(c).alias(f"{c}1") for c in fields], *[F.col("_next")[c].alias(f"{c}2") for c in fields])


def triples(genes: DataFrame, part: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Each row with the next two of its part: fields suffixed 1, 2 (between) and 3."""
    w = Window.partitionBy(*[q(c) for c in part]).orderBy(*[q(c) for c in order])
    s = F.struct(*[q(c) for c in fields])
    both = genes.withColumn("_b", F.lead(s, 1).over(w)).withColumn("_c", F.lead(s, 2).over(w)).where("_c IS NOT NULL")
    return both.select(*[q(c) for c in part], *[q(c).alias(f"{c}1") for c in fields], *[F.col("_b")[c].alias(f"{c}2") for c in fields], *[F.col("_c")[c].alias(f"{c}3") for c in fields])


def lag_products(arrays: DataFrame, lags: Sequence[int], min_extra: int = 0) -> DataFrame:
    """One row per array and lag: ``total``, the sum of products that far apart, and ``pairs``.  Lags
    need more than ``lag + min_extra`` values.  Nothing is shuffled."""
    n = F.size("x")
    keys = [c for c in arrays.columns if c != "x"]
    wide = arrays.withColumn("lag", F.explode(F.array(*[F.lit(int(k)) for k in lags]))).where(n > F.col("lag") + min_extra)
    head, tail = F.slice("x", F.lit(1), n - F.col("lag")), F.slice("x", F.col("lag") + 1, n - F.col("lag"))
    return wide.select(*keys, "lag", dot(head, tail).alias("total"), (n - F.col("lag")).alias("pairs"))


def lag_profile(signal: DataFrame, max_lag: int, by: Sequence[str] = ("unit",), eps: float = 1e-12, min_extra: int = 0, lags: Sequence[int] | None = None) -> DataFrame:
    """(by..., lag, correlation, pairs): the mean product of z values (per position, over samples) ``lag``
    apart in the same part, over samples and parts, weighted by pairs.  Lags without pairs are null."""
    z = zscore(signal, "value", POSITION, "z", eps=eps)
    lags = list(lags) if lags is not None else list(range(max_lag + 1))
    prods = lag_products(as_arrays(z, "z"), lags, min_extra)
    got = prods.groupBy(*by, "lag").agg((F.sum("total") / F.sum("pairs")).alias("correlation"), F.sum("pairs").alias("pairs"))
    grid = signal.select(*by).distinct().withColumn("lag", F.explode(F.array(*[F.lit(int(k)) for k in lags])))
    return grid.join(got, [*by, "lag"], "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))


def gapped_arrays(signal: DataFrame, value: str = "z") -> DataFrame:
    """(unit, sample, part, x, mask, present): the values of every position of the unit in rank order, 0 where
    the sample has none; ``mask`` is 1 where it has one, and ``present`` their number."""
    grid = signal.select(*POSITION).distinct().join(signal.select("unit", "sample").distinct(), "unit")
    full = grid.join(signal.select("unit", "sample", "part", "rank", q(value).alias("_v")), ["unit", "sample", "part", "rank"], "left")
    packed = full.groupBy("unit", "sample", "part").agg(F.sort_array(F.collect_list(F.struct("rank", "_v"))).alias("_a"), F.count("_v").alias("present"))
    x, mask = F.transform("_a", lambda s: F.coalesce(s["_v"], F.lit(0.0))), F.transform("_a", lambda s: s["_v"].isNotNull().cast("double"))
    return packed.select("unit", "sample", "part", x.alias("x"), mask.alias("mask"), "present")


def gapped_profile(arrays: DataFrame, lags: Sequence[int], min_extra: int = 0) -> DataFrame:
    """(unit, lag, correlation, pairs) from :func:`gapped_arrays` of z values: a value that a sample lacks keeps
    its place, and no pair is made of it.  Lags without pairs are left out."""
    keys = ["unit", "sample", "part"]
    total = lag_products(arrays.select(*keys, "x"), lags, min_extra).groupBy("unit", "lag").agg(F.sum("total").alias("_total"))
    pairs = lag_products(arrays.select(*keys, F.col("mask").alias("x")), lags, min_extra).groupBy("unit", "lag").agg(F.sum("total").cast("bigint").alias("pairs"))
    return total.join(pairs, ["unit", "lag"]).where("pairs > 0").select("unit", "lag", (F.col("_total") / F.col("pairs")).alias("correlation"), "pairs")


def lag_covariance(signal: DataFrame, max_lag: int, value: str = "dev", by: Sequence[str] = ("unit", "part")) -> DataFrame:
    """(by..., lag, covariance): circular, the sum over positions of products ``lag`` apart with
    wrap-around, averaged over samples."""
    arrays = as_arrays(signal, value)
    n = F.size("x")
    wide = arrays.withColumn("lag", F.explode(F.sequence(F.lit(0), F.least(F.lit(max_lag), n) - 1)))
    shifted = F.concat(F.slice("x", F.col("lag") + 1, n), F.slice("x", F.lit(1), F.col("lag")))
    return wide.select(*by, "lag", dot(F.col("x"), shifted).alias("_c")).groupBy(*by, "lag").agg(F.avg("_c").alias("covariance"))


def shuffle_order(signal: DataFrame, seed: int) -> DataFrame:
    """``rank`` replaced by a random order of the part's positions, the same for all samples; decided by a
    hash, so independent of partitioning."""
    places = signal.select(*POSITION).distinct()
    w = Window.partitionBy("unit", "part").orderBy(F.xxhash64(F.lit(seed), "unit", "part", "rank"), "rank")
    places = places.withColumn("_new", F.row_number().over(w) - 1)
    return signal.join(places, POSITION).drop("rank").withColumnRenamed("_new", "rank")


def lag_excess(signal: DataFrame, lags: Sequence[int], seed: int = 3, eps: float = 1e-9) -> DataFrame:
    """(unit, lag, observed, shuffled, excess): the lag profile minus that of a shuffled order."""
    keep = lambda df, name: df.select("unit", "lag", F.col("correlation").alias(name))
    a = keep(lag_profile(signal, 0, eps=eps, min_extra=5, lags=lags), "observed")
    b = keep(lag_profile(shuffle_order(signal, seed), 0, eps=eps, min_extra=5, lags=lags), "shuffled")
    return a.join(b, ["unit", "lag"]).withColumn("excess", F.col("observed") - F.col("shuffled"))


def lag_scores(signal: DataFrame, near: Sequence[int] = (1, 2, 3), far: Sequence[int] = (20, 30), eps: float = 1e-9) -> DataFrame:
    """(unit, sample, near, far, cis_excess): per sample the mean lagged product of z values, averaged over
    the near and over the far lags, and their difference."""
    z = zscore(signal, "value", POSITION, "z", eps=eps)
    prods = lag_products(as_arrays(z, "z"), sorted({*near, *far}), 5)
    per_lag = prods.groupBy("unit", "sample", "lag").agg((F.sum("total") / F.sum("pairs")).alias("m"))
    part = lambda lags: F.avg(F.when(F.col("lag").isin(*lags), F.col("m")))
    return per_lag.groupBy("unit", "sample").agg(part(near).alias("near"), part(far).alias("far"), (part(near) - part(far)).alias("cis_excess"))


def decay_length(profile: DataFrame, by: Sequence[str], lag: str, value: str, floor: Column, max_lag: int, least: int) -> DataFrame:
    """(by..., decay_length, n): -1 / slope of ln(value) on the lag over lags 1..max_lag with the value
    above ``floor``; null with fewer than ``least`` such lags."""
    kept = profile.where((q(lag) >= 1) & (q(lag) <= max_lag) & (q(value) > floor) & (q(value) > 0))
    slope = F.regr_slope(F.ln(q(value)), q(lag).cast("double"))
    return kept.groupBy(*by).agg(F.when(F.count("*") >= least, F.try_divide(F.lit(-1.0), slope)).alias("decay_length"), F.count("*").alias("n"))


def neighbour_correlations(signal: DataFrame, eps: float = 1e-9) -> DataFrame:
    """(unit, part, rank1, rank2, r, n_samples): the correlation of every position with the next rank, over the samples
    that have both; none where no sample has.  Each sample's values meet in the order of its positions, and
    only products are summed by position."""
    place = Window.partitionBy(*POSITION)
    z = F.try_divide(F.col("value") - F.avg("value").over(place), F.stddev_pop("value").over(place) + eps)
    along = Window.partitionBy("unit", "sample", "part").orderBy("rank")  # the positions of a part
    met = signal.withColumn("_z", z).withColumns({"_next": F.lead("rank").over(along), "_z2": F.lead("_z").over(along)}).where(F.col("_next") == F.col("rank") + 1)
    sums = met.groupBy("unit", "part", F.col("rank").alias("rank1")).agg(F.avg(F.col("_z") * F.col("_z2")).alias("r"), F.count("_z2").alias("n_samples"))
    return sums.select("unit", "part", "rank1", (F.col("rank1") + 1).alias("rank2"), "r", "n_samples").where("n_samples > 0")


def pair_correlations(signal: DataFrame, pairs: DataFrame, eps: float = 1e-9) -> DataFrame:
    """``pairs`` (unit, part, rank1, rank2, ...) with ``r``: the correlation of the two positions over the
    samples that have both, and ``n_samples``.  Each position travels as one array over all samples of its
    unit, with nulls where it was not measured, so two positions meet element by element."""
    z = zscore(signal, "value", POSITION, "z", eps=eps).select("unit", "sample", "part", "rank", "z")
    grid = z.select(*POSITION).distinct().join(z.select("unit", "sample").distinct(), "unit").join(z, ["unit", "sample", "part", "rank"], "left")
    packed = grid.groupBy(*POSITION).agg(F.sort_array(F.collect_list(F.struct("sample", "z"))).alias("_s")).select(*POSITION, F.transform("_s", lambda s: s["z"]).alias("_z"))
    a = packed.select("unit", "part", F.col("rank").alias("rank1"), F.col("_z").alias("_a"))
    b = packed.select("unit", "part", F.col("rank").alias("rank2"), F.col("_z").alias("_b"))
    j = pairs.join(a, ["unit", "part", "rank1"]).join(b, ["unit", "part", "rank2"])
    both = F.aggregate(
        F.zip_with("_a", "_b", lambda x, y: x * y),
        F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda acc, v: F.when(v.isNull(), acc).otherwise(F.struct((acc["s"] + v).alias("s"), (acc["n"] + 1).alias("n"))),
    )
    j = j.withColumn("_p", both)
    return j.withColumn("r", F.try_divide(F.col("_p.s"), F.col("_p.n").cast("double"))).withColumn("n_samples", F.col("_p.n")).drop("_a", "_b", "_p")
