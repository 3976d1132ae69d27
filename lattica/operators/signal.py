"""Signals: samples measured over ordered positions, in long form
``(unit, sample, part, rank, value)``; normalisation by rows and by columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import q

POSITION = ["unit", "part", "rank"]


def eligible_samples(signal: DataFrame, attributes: DataFrame, key: str, required: Sequence[str], least: int = 40) -> DataFrame:
    """Rows of samples that have attributes with all ``required`` present, in units with at least ``least``
    such samples."""
    have = attributes.where(" AND ".join(f"`{c}` IS NOT NULL" for c in required)).select(q(key).alias("sample")).distinct()
    kept = signal.join(have, "sample", "left_semi")
    units = kept.groupBy("unit").agg(F.count_distinct("sample").alias("_n")).where(F.col("_n") >= least).select("unit")
    return kept.join(units, "unit", "left_semi")


def _known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with all ``keys``: others have no place."""
    return df.dropna(subset=list(keys))


def expressed(signal: DataFrame, least: float = 10.0) -> DataFrame:
    """Rows of positions whose median over samples is at least ``least``.  A window holds the samples of one
    position; rows are shuffled once and not joined."""
    over = F.median("value").over(Window.partitionBy(*POSITION))
    return _known(signal, POSITION).withColumn("_m", over).where(F.col("_m") >= least).drop("_m")


def log2_cpm(signal: DataFrame, out: str = "value") -> DataFrame:
    """``log2(count / library * 1e6 + 1)``, the library being the sample's sum over the rows given; a
    sample without counts gets null.  A window holds the positions of one sample."""
    library = F.sum("value").over(Window.partitionBy("unit", "sample"))
    scaled = F.log2(F.try_divide(F.col("value"), F.col("_lib")) * 1e6 + 1)
    return _known(signal, ["unit", "sample"]).withColumn("_lib", library).withColumn(out, scaled).drop("_lib")


def from_log2(x: Column) -> Column:
    """The counts of a log2(count + 1): not below zero."""
    return F.greatest(F.pow(F.lit(2.0), x) - 1, F.lit(0.0))


def two_way_center(signal: DataFrame) -> DataFrame:
    """``centered`` (the sample's mean removed), ``mean`` (of the position, over samples, after that) and
    ``dev`` (what is left)."""
    c = _known(signal, ["sample", *POSITION]).withColumn("centered", F.col("value") - F.avg("value").over(Window.partitionBy("unit", "sample")))
    return c.withColumn("mean", F.avg("centered").over(Window.partitionBy(*POSITION))).withColumn("dev", F.col("centered") - F.col("mean"))


def zscore(df: DataFrame, value: str, by: Sequence[str], out: str = "z", ddof: int = 0, eps: float = 1e-9) -> DataFrame:
    """``(x - mean) / (sd + eps)`` per group; ``ddof`` 0 or 1.  A single value has a null sd for ddof 1."""
    sd = F.stddev_pop(q(value)) if ddof == 0 else F.stddev_samp(q(value))
    stats = df.groupBy(*[q(c) for c in by]).agg(F.avg(q(value)).alias("_mean"), sd.alias("_sd"))
    joined = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumn(out, F.try_divide(q(value) - F.col("_mean"), F.col("_sd") + eps)).drop("_mean", "_sd")


def robust_scale(df: DataFrame, value: str, by: Sequence[str], out: str = "scaled", eps: float = 1e-6) -> DataFrame:
    """``(x - median) / (1.4826 * MAD + eps)`` per group, in two passes."""
    med = df.groupBy(*[q(c) for c in by]).agg(F.median(q(value)).alias("_med"))
    one = df.join(med, list(by))
    mad = one.groupBy(*[q(c) for c in by]).agg(F.median(F.abs(q(value) - F.col("_med"))).alias("_mad"))
    return one.join(mad, list(by)).withColumn(out, (q(value) - F.col("_med")) / (F.col("_mad") * 1.4826 + eps)).drop("_med", "_mad")


def number_positions(genes: DataFrame, part: str, start: str, key: str, out: str = "rank") -> DataFrame:
    """Genes with a place, numbered from 0 along their part in order of (start, key).  Genes without a
    part or a start have no number.  A part is a chromosome: bounded."""
    w = Window.partitionBy(q(part)).orderBy(q(start), q(key))
    return genes.where(q(part).isNotNull() & q(start).isNotNull()).withColumn(out, F.row_number().over(w) - 1)


def moving_average(df: DataFrame, by: Sequence[str], order: str, value: str, width: int, out: str) -> DataFrame:
    """``df`` with the mean of ``value`` over up to ``width`` (odd) neighbours in the order of its group, fewer at the
    ends.  A group is a run of positions: bounded."""
    half = width // 2
    return df.withColumn(out, F.avg(q(value)).over(Window.partitionBy(*[q(c) for c in by]).orderBy(q(order)).rowsBetween(-half, half)))


def covered(df: DataFrame, by: Sequence[str], value: str, share: float = 0.5) -> DataFrame:
    """(by...) of the groups in which more than ``share`` of the values are known."""
    return df.groupBy(*[q(c) for c in by]).agg(F.avg(q(value).isNotNull().cast("double")).alias("_c")).where(F.col("_c") > share).drop("_c")


def odd_part(part: Column) -> Column:
    """1 for chromosomes of odd number, 0 for even ones, null for others."""
    return F.pmod(part.try_cast("int"), F.lit(2))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order``; by an aggregate, so a key of many rows is no burden."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*[q(c) for c in keys]).agg(F.min_by(F.struct(*[q(c) for c in rest]), F.struct(*[q(c) for c in order])).alias("_row"))
    return picked.select(*[q(c) for c in keys], *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def design_matrix(attributes: DataFrame, numeric: Sequence[str], squared: Sequence[str] = (), impute: Sequence[str] = (), categories: dict[str, list[str]] | None = None) -> DataFrame:
    """Technical covariates per sample: numbers, squares, median-imputed numbers (0 if all are missing)
    and indicators of each category but the first.  ``categories`` lists the levels, in order; null counts
    as the level 'nan'."""
    medians = attributes.agg(*[F.coalesce(F.median(q(c)), F.lit(0.0)).alias(f"_m_{c}") for c in impute]) if impute else None
    df = attributes.crossJoin(F.broadcast(medians)) if medians is not None else attributes  # one row
    cols = [*[q(c).cast("double").alias(c) for c in numeric], *[(q(c) * q(c)).cast("double").alias(f"{c}_sq") for c in squared], *[F.coalesce(q(c).cast("double"), F.col(f"_m_{c}")).alias(f"{c}_imp") for c in impute]]
    for c, levels in (categories or {}).items():
        cols += [(F.coalesce(q(c).cast("string"), F.lit("nan")) == v).cast("double").alias(f"{c}={v}") for v in levels[1:]]
    return df.select("sample", *cols)


def covariates_fit(n_columns: int, n_samples: int, spare: int = 10) -> bool:
    """Whether a design of so many columns may be removed from so many samples."""
    return n_columns < n_samples - spare


def signature_score(signal: DataFrame, names: DataFrame, up: Sequence[str], down: Sequence[str] = (), eps: float = 1e-9) -> DataFrame:
    """(unit, sample, score): the mean over the listed genes of their z over samples; with ``down``, minus
    that of those.  Genes that are not measured are skipped.  ``names``: (unit, part, rank, name)."""
    listed = signal.join(names.where(F.col("name").isin(*up, *down)).select("unit", "part", "rank", "name"), POSITION)
    z = zscore(listed, "value", POSITION, "_z", eps=eps)
    part = lambda genes: F.avg(F.when(F.col("name").isin(*genes), F.col("_z")))
    score = part(up) - part(down) if down else part(up)
    return z.groupBy("unit", "sample").agg(score.alias("score"))


def remove_group_means(df: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """``value`` minus the mean of its group: stratum adjustment and per-level correction alike.  Means are
    joined rather than windowed, so one group may hold any share of the rows."""
    means = df.groupBy(*[q(c) for c in by]).agg(F.avg(q(value)).alias("_mean"))
    tags = {c: f"_k{i}" for i, c in enumerate(by)}
    side = means.select(*[q(c).alias(t) for c, t in tags.items()], "_mean")
    match = None
    for c, t in tags.items():
        m = q(c).eqNullSafe(F.col(t))
        match = m if match is None else match & m
    return df.join(side, match).withColumn(out, q(value) - F.col("_mean")).drop("_mean", *tags.values())


def sample_type(sample: Column, codes: Sequence[str]) -> Column:
    """Whether the sample's type, characters 14 and 15 of its barcode, is one of ``codes``."""
    return F.substring(sample, 14, 2).isin(*codes)


def strand_start(start: Column, end: Column, strand: Column, plus: Sequence[str] = ("+", "1")) -> Column:
    """The transcription start: ``start`` on the plus strand, else ``end``."""
    return F.when(strand.isin(*plus), start).otherwise(end)
