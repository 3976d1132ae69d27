"""A demonstration on simulated data: ``python -m lattica.demo [--genes N] [--samples N] [--decay L] [--seed S]``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import lag, resid, simulate, spectral
from lattica.session import local_session


def summary(spark: SparkSession, genes: int = 300, parts: int = 2, samples: int = 60, decay: float = 5.0, seed: int = 7) -> DataFrame:
    """(quantity, value): how far the mean periodogram is from landscape plus covariance, the landscape's share, and the
    decay length as it stands and once the covariate's trend is removed."""
    x = simulate.simulate_genome(spark, genes, parts, samples, decay, seed=seed)
    track = x.select("part", "rank", F.col("gc").alias("covariate")).distinct()
    s = x.select("unit", "sample", "part", "rank", "value")
    whole = spectral.periodogram_identity(s).agg(F.max(F.abs(F.col("mean_periodogram") - F.col("landscape") - F.col("covariance")) / (F.abs("mean_periodogram") + 1e-12)).alias("v"))
    out = [("identity error", whole.first()["v"]), ("landscape share", spectral.landscape_share(s).agg(F.avg("share")).first()[0])]
    for name, signal in (("naive decay length", s), ("corrected decay length", resid.remove_trend(s, resid.trend_basis(s, track)))):
        profile = lag.lag_profile(signal, 40)
        first = profile.where("lag = 1").select("unit", (F.col("correlation") * 0.05).alias("floor"))
        out.append((name, lag.decay_length(profile.join(F.broadcast(first), "unit"), ["unit"], "lag", "correlation", F.col("floor"), 40, 4).first()["decay_length"]))
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in [*out, ("true decay length", decay)]], "quantity string, value double")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name, kind, default in (("genes", int, 300), ("parts", int, 2), ("samples", int, 60), ("decay", float, 5.0), ("seed", int, 7)):
        parser.add_argument(f"--{name}", type=kind, default=default)
    summary(local_session("demo"), **vars(parser.parse_args())).show(truncate=False)


if __name__ == "__main__":
    main()
