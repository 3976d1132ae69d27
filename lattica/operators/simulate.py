"""Seeded simulations of an ordered signal with known layers.

The model, for sample s and position i of a part:

    value(s, i) = landscape(i) + slope(s) * track(i) + local(s, i) + noise(s, i)

``landscape`` is gamma distributed, ``track`` a first-order autoregression scaled to mean 0 and variance 1 in each
part, ``slope`` normal.  ``local`` is stationary, normal with a given standard deviation, and its correlation over k
positions is exp(-k / decay_len): that too is a first-order autoregression, with the coefficient
exp(-1 / decay_len).  Both come from one vectorised filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "unit string, sample string, part string, rank int, value double, gc double, landscape double, cis double, gc_slope double"
# fixed values of the model: shape and scale of the landscape
LANDSCAPE_SHAPE, LANDSCAPE_SCALE = 1.3, 3.0
#: Samples made by one task.
SAMPLES = 64


def autoregression(start: np.ndarray, steps: np.ndarray, phi: float) -> np.ndarray:
    """``x[0] = start``, ``x[i] = phi * x[i - 1] + steps[i - 1]`` along the last axis.  Sums over the past double their
    reach in every round, so there are log2(length) rounds of whole arrays."""
    x = np.concatenate([start[..., None], steps], axis=-1)
    reach, weight = 1, phi
    while reach < x.shape[-1] and weight != 0:
        later = x[..., reach:] + weight * x[..., :-reach]
        x = np.concatenate([x[..., :reach], later], axis=-1)
        reach, weight = 2 * reach, weight * weight
    return x


def _scaled(x: np.ndarray) -> np.ndarray:
    sd = x.std()
    return (x - x.mean()) / sd if sd > 0 else np.zeros_like(x)


def _stream(*key: int) -> np.random.Generator:
    return np.random.default_rng(list(key))


def simulate_genome(spark: SparkSession, n_genes: int = 1000, n_chrom: int = 4, n_samples: int = 200, decay_len: float = 5.0, gc_phi: float = 0.97, gc_bias_sd: float = 0.25, cis_sd: float = 0.6, noise_sd: float = 0.4, seed: int = 0, unit: str = "simulated") -> DataFrame:
    """A long table of samples by positions with every layer of the model beside its sum.  A task makes one part of
    SAMPLES samples; what samples share is drawn again from its own stream.  The same seed gives the same
    table anywhere."""
    blocks = max(1, -(-n_samples // SAMPLES))
    rank = np.arange(n_genes, dtype="int32")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for no in (int(x) for f in frames for x in f["id"]):
            part, block = divmod(no, blocks)
            mine = range(block * SAMPLES, min(n_samples, (block + 1) * SAMPLES))
            shared, own = _stream(seed, 2, part), _stream(seed, 3, part, block)
            land = LANDSCAPE_SCALE * shared.gamma(LANDSCAPE_SHAPE, size=n_genes)
            track = _scaled(autoregression(shared.normal(size=()), shared.normal(size=max(0, n_genes - 1)), gc_phi))
            slope = gc_bias_sd * _stream(seed, 1).normal(size=n_samples)[mine.start : mine.stop]
            phi = np.exp(-1 / decay_len) if decay_len > 0 else 0.0
            local = cis_sd * autoregression(own.normal(size=len(mine)), np.sqrt(1 - phi**2) * own.normal(size=(len(mine), max(0, n_genes - 1))), phi)
            value = land + slope[:, None] * track + local + noise_sd * own.normal(size=local.shape)
            names = [f"s{s:05d}" for s in mine]
            yield pd.DataFrame(
                {
                    "unit": unit,
                    "sample": np.repeat(names, n_genes),
                    "part": str(part + 1),
                    "rank": np.tile(rank, len(mine)),
                    "value": value.ravel(),
                    "gc": np.tile(track, len(mine)),
                    "landscape": np.tile(land, len(mine)),
                    "cis": local.ravel(),
                    "gc_slope": np.repeat(slope, n_genes),
                }
            )

    tasks = n_chrom * blocks
    return spark.range(0, tasks, 1, tasks).mapInPandas(run, SCHEMA)


def mixture_with_covariate(spark: SparkSession, share: float, seed: int = 0, smooth: int = 25, **sizes) -> DataFrame:
    """A simulated signal of which the local layer follows the track by ``share`` of its variance: a slope of the
    sample's own on the track's running mean over ``smooth`` positions takes the place of that share.  For tests of
    what the removal of a trend costs."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    base = simulate_genome(spark, gc_bias_sd=0.0, seed=seed, **sizes)
    row = Window.partitionBy("sample", "part")  # positions of a part
    level = F.avg("gc").over(row.orderBy("rank").rowsBetween(-(smooth // 2), smooth // 2))
    scaled = (F.col("_level") - F.avg("_level").over(row)) / F.nullif(F.stddev_pop("_level").over(row), F.lit(0.0))
    # two hashes of the sample to one normal number
    u1, u2 = ((F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("sample")), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40)) for k in (1, 2))
    slope = F.sqrt(-2 * F.log(u1)) * F.cos(2 * F.pi() * u2)
    mixed = F.sqrt(F.lit(1.0 - share)) * F.col("cis") + F.sqrt(F.lit(float(share))) * F.lit(sizes.get("cis_sd", 0.6)) * slope * F.coalesce(F.col("_track"), F.lit(0.0))
    return base.withColumn("_level", level).withColumn("_track", scaled).withColumn("value", F.col("value") - F.col("cis") + mixed).drop("_level", "_track")
