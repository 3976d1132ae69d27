"""Power spectra of ordered signals: periodograms, their exact decomposition, whitening and peaks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.lag import as_arrays
from lattica.session import q

EULER_GAMMA = 0.5772156649015329


def periodogram(arrays: DataFrame, drop_zero: bool = False) -> DataFrame:
    """One row per array and frequency ``k``: ``power = |DFT|^2`` and ``n``, the array's length.  Real
    transform: k = 0 .. n // 2.  Fourier transforms run in numpy on Arrow batches, no row moves.  Arrays
    with missing values get null powers; empty arrays give no rows."""
    keys = [c for c in arrays.columns if c != "x"]
    schema = ", ".join([*[f"`{c}` {arrays.schema[c].dataType.simpleString()}" for c in keys], "k int, power double, n int"])
    first = 1 if drop_zero else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.schema.names.index("x"))
            offsets = x.offsets.to_numpy()
            flat = x.values.to_numpy(zero_copy_only=False).astype(float)
            sizes = np.diff(offsets)
            rows, ks, powers, ns = [], [], [], []
            for n in np.unique(sizes[sizes > 0]):
                mine = np.flatnonzero(sizes == n)
                m = flat[offsets[mine][:, None] + np.arange(n)]
                p = np.abs(np.fft.rfft(m, axis=1)) ** 2
                p = p[:, first:]
                rows.append(np.repeat(mine, p.shape[1]))
                ks.append(np.tile(np.arange(first, first + p.shape[1]), len(mine)))
                powers.append(p.ravel())
                ns.append(np.full(p.size, n))
            if rows:
                at = pa.array(np.concatenate(rows))
                power = np.concatenate(powers)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(b.schema.names.index(c)).take(at) for c in keys], pa.array(np.concatenate(ks), pa.int32()), pa.array(power, mask=np.isnan(power)), pa.array(np.concatenate(ns), pa.int32())],
                    names=[*keys, "k", "power", "n"],
                )

    return arrays.select(*[q(c) for c in keys], F.transform("x", lambda v: v.cast("double")).alias("x")).mapInArrow(run, schema)


def dft(arrays: DataFrame) -> DataFrame:
    """As :func:`periodogram`, in expressions alone: for short arrays, where it stays in one stage."""
    keys = [c for c in arrays.columns if c != "x"]
    n = F.size("x")
    wide = arrays.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(n / 2).cast("int"))))
    angle = F.lit(-2 * math.pi) * F.col("k") / n
    turn = lambda f: F.aggregate(F.transform("x", lambda v, j: v * f(angle * j)), F.lit(0.0), lambda a, v: a + v)
    return wide.select(*keys, "k", (F.pow(turn(F.cos), F.lit(2)) + F.pow(turn(F.sin), F.lit(2))).alias("power"), n.alias("n"))


def periodogram_identity(signal: DataFrame) -> DataFrame:
    """(unit, part, k, mean_periodogram, landscape, covariance, relative_error): the mean power over samples
    equals that of the mean profile plus that of the deviations, exactly."""
    mean = signal.groupBy("unit", "part", "rank").agg(F.avg("value").alias("m"))
    both = signal.join(mean, ["unit", "part", "rank"]).withColumn("dev", F.col("value") - F.col("m"))
    avg = lambda df, name: periodogram(df).groupBy("unit", "part", "k").agg(F.avg("power").alias(name))
    a = avg(as_arrays(both), "mean_periodogram")
    b = avg(as_arrays(mean.withColumn("sample", F.lit("mean")).withColumnRenamed("m", "value")), "landscape")
    c = avg(as_arrays(both, "dev"), "covariance")
    out = a.join(b, ["unit", "part", "k"]).join(c, ["unit", "part", "k"])
    err = F.abs(F.col("mean_periodogram") - F.col("landscape") - F.col("covariance")) / (F.abs("mean_periodogram") + 1e-12)
    return out.withColumn("relative_error", err)


def landscape_share(signal: DataFrame, by: tuple[str, ...] = ("unit",)) -> DataFrame:
    """(by..., share): the part of a sample's sum of squares that the mean profile carries."""
    pos = signal.groupBy("unit", "part", "rank").agg(F.avg("value").alias("m"), F.count("value").alias("n"), F.var_pop("value").alias("v"))
    land, rest = F.sum(F.col("n") * F.col("m") * F.col("m")), F.sum(F.col("n") * F.col("v"))
    return pos.groupBy(*by).agg(F.try_divide(land, land + rest).alias("share"))


def whiten(spectra: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Periodograms (k >= 1) divided by their own log-log line over k / n and then by their mean: ``white``."""
    keys = [c for c in spectra.columns if c not in ("k", "power", "n")]
    own = spectra.where("k >= 1").withColumn("_x", F.log10(F.col("k") / F.col("n"))).withColumn("_y", F.log10(F.col("power") + eps))
    line = own.groupBy(*keys).agg(F.regr_slope("_y", "_x").alias("_b"), F.regr_intercept("_y", "_x").alias("_a"))
    flat = own.join(line, keys).withColumn("_w", F.col("power") / F.pow(F.lit(10.0), F.col("_b") * F.col("_x") + F.col("_a")))
    mean = flat.groupBy(*keys).agg(F.avg("_w").alias("_m"))
    return flat.join(mean, keys).withColumn("white", F.try_divide(F.col("_w"), F.col("_m"))).select(*spectra.columns, "white")


def universal_peaks(white: DataFrame, above: float = 3.0, share_tenths: int = 9) -> DataFrame:
    """(unit, part, k, samples, hits, universal): frequencies whose whitened power is above ``above`` in at
    least ``share_tenths`` tenths of the samples; compared in whole numbers."""
    got = white.groupBy("unit", "part", "k").agg(F.count("white").alias("samples"), F.count_if(F.col("white") > above).alias("hits"))
    return got.withColumn("universal", 10 * F.col("hits") >= share_tenths * F.col("samples"))


def consensus(white: DataFrame) -> DataFrame:
    """(unit, part, k, consensus): ``exp(mean(ln w) + gamma)`` over samples, the log-mean corrected for an
    exponential ordinate."""
    return white.where("white > 0").groupBy("unit", "part", "k").agg(F.exp(F.avg(F.ln("white")) + EULER_GAMMA).alias("consensus"))


def red_noise_peaks(series: DataFrame, value: str = "x", alpha: float = 0.05) -> DataFrame:
    """Frequencies of each array whose power exceeds the AR(1) red-noise spectrum's exponential quantile at
    ``alpha`` divided by the number of frequencies: (keys, k, power, threshold, peak)."""
    keys = [c for c in series.columns if c != value]
    n = F.size(value)
    head, tail = F.slice(value, F.lit(1), n - 1), F.slice(value, F.lit(2), n - 1)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    arr = series.withColumn("_mean", total(F.col(value)) / n).withColumn("_c", F.transform(value, lambda v: v - F.col("_mean")))
    sq = F.aggregate("_c", F.lit(0.0), lambda acc, v: acc + v * v)
    head, tail = F.slice("_c", F.lit(1), n - 1), F.slice("_c", F.lit(2), n - 1)
    phi = F.try_divide(F.aggregate(F.zip_with(head, tail, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v), sq)
    arr = arr.withColumn("_phi", phi).withColumn("_sq", sq)
    stats = arr.select(*keys, "_phi", "_sq")
    spec = periodogram(arr.select(*keys, F.col("_c").alias("x")), drop_zero=True)
    count = F.floor(F.col("n") / 2)
    # a variance of sq / n spread over the red-noise shape; an ordinate is exponential around it
    shape = (1 - F.col("_phi") * F.col("_phi")) / (1 + F.col("_phi") * F.col("_phi") - 2 * F.col("_phi") * F.cos(2 * math.pi * F.col("k") / F.col("n")))
    threshold = F.col("_sq") * shape * -F.ln(F.lit(alpha) / count)
    return spec.join(stats, keys).withColumn("threshold", threshold).withColumn("peak", F.col("power") > F.col("threshold")).select(*keys, "k", "power", "threshold", "peak")
