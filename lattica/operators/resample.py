"""Resampling inference: bootstraps over blocks from sufficient statistics, permutation tests, halves.

A bootstrap replicate draws blocks, and a regression sees a block only through its moments.  So the rows
are aggregated once into per-block moments, and replicates weight those: the rows are not read again.
Draws are hashes of (seed, replicate, block), the same for any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.tails import normal_sf
from lattica.operators.ranks import value_ranks
from lattica.operators.regress import moments, solve
from lattica.operators.skew import numbered
from lattica.session import q

#: Blocks (positions over block size) are bounded; a table of more is refused rather than sent to tasks.
MOST_BLOCKS = 200_000


def position_block(part: Column, start: Column, size: float, own: Column) -> Column:
    """``part:floor(start / size)``; a row without a place is a block of its own, named by ``own``."""
    return F.when(part.isNotNull() & start.isNotNull(), F.concat_ws(":", part, F.floor(start / size).cast("string"))).otherwise(F.concat(F.lit("unplaced:"), own.cast("string")))


def hash_order(seed: int, *cols: Column) -> Column:
    """A random order that depends on the seed and the row alone."""
    return F.xxhash64(F.lit(seed), *cols)


def hash_half(seed: int, key: Column) -> Column:
    """0 or 1 for each key: halves by key."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2)).cast("int")


def ranked_halves(df: DataFrame, key: str, by: Sequence[str], seed: int, out: str = "half") -> DataFrame:
    """Keys of each group in two halves that differ by one key at most."""
    keys = df.select(*[q(c) for c in by], q(key)).distinct().withColumn("_h", hash_order(seed, q(key)))
    keys = numbered(keys, by, ["_h", key], "_r")
    sizes = keys.groupBy(*[q(c) for c in by]).agg(F.count("*").alias("_n"))
    sized = keys.join(sizes, list(by)) if by else keys.crossJoin(F.broadcast(sizes))  # one row
    halves = sized.withColumn(out, (F.col("_r") + 1 > F.col("_n") / 2).cast("int")).drop("_r", "_n", "_h")
    return df.join(halves, [*by, key])


def _weights(rng: np.random.Generator, strata: np.ndarray) -> np.ndarray:
    """How often each block is drawn, as many draws as blocks, within strata."""
    w = np.zeros(len(strata))
    for s in np.unique(strata):
        at = np.flatnonzero(strata == s)
        np.add.at(w, at[rng.integers(0, len(at), len(at))], 1)
    return w


def _replicates(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(0, n, 1, max(1, min(n // 50, spark.sparkContext.defaultParallelism)))


def block_bootstrap(df: DataFrame, y: str, xs: Sequence[str], block: str, replicates: int = 300, seed: int = 0, stratum: str | None = None) -> DataFrame:
    """(term, est, ci_low, ci_high, boot_se, p, blocks): least squares with an intercept; percentile interval
    over resamples of whole blocks (within ``stratum`` if given), its standard error, and the normal p of
    estimate over error.  Equal, draw by draw, to refitting on the resampled rows."""
    spark = df.sparkSession
    keys = [block, *([stratum] if stratum else [])]
    per = moments(df, y, xs, keys).limit(MOST_BLOCKS + 1).collect()
    if len(per) > MOST_BLOCKS:
        raise ValueError("too many blocks; choose larger ones")
    schema = "term string, est double, ci_low double, ci_high double, boot_se double, p double, blocks bigint"
    terms = ["intercept", *xs]
    if not per:
        return spark.createDataFrame([], schema)
    per.sort(key=lambda r: (str(r[stratum]) if stratum else "", str(r[block])))
    p = len(terms)
    a = np.array([r["xtx"] for r in per], float)
    b = np.array([r["xty"] for r in per], float)
    strata = np.array([str(r[stratum]) if stratum else "" for r in per])
    est = solve(a.sum(0).reshape(p, p), b.sum(0))
    shared = spark.sparkContext.broadcast((a, b, strata))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, strata = shared.value
        for f in frames:
            rows = []
            for rep in f["id"]:
                w = _weights(np.random.default_rng([seed, int(rep)]), strata)
                rows.append(solve((w @ a).reshape(p, p), w @ b))
            yield pd.DataFrame(rows, columns=[f"c{i}" for i in range(p)])

    draws = _replicates(spark, replicates).mapInPandas(run, ", ".join(f"c{i} double" for i in range(p))).toPandas().to_numpy()  # replicates x terms
    se = draws.std(0)
    out = [
        (t, float(est[i]), float(np.percentile(draws[:, i], 2.5)), float(np.percentile(draws[:, i], 97.5)), float(se[i]), float(2 * normal_sf(abs(est[i] / se[i]))) if se[i] > 0 else None, len(per))
        for i, t in enumerate(terms)
    ]
    return spark.createDataFrame(out, schema)


def block_means(df: DataFrame, value: str, level: str, block: str, replicates: int = 200, seed: int = 23, relative_to: str | None = None) -> DataFrame:
    """(level, mean, ci_low, ci_high, relative, relative_ci_low, relative_ci_high): means per level over
    resamples of blocks, and their ratio to the level ``relative_to`` in the same resample."""
    spark = df.sparkSession
    sums = df.where(q(value).isNotNull()).groupBy(q(block).alias("b"), q(level).alias("l")).agg(F.sum(q(value)).alias("s"), F.count("*").alias("n")).limit(MOST_BLOCKS + 1).toPandas()
    if len(sums) > MOST_BLOCKS:
        raise ValueError("too many blocks; choose larger ones")
    schema = "level string, mean double, ci_low double, ci_high double, relative double, relative_ci_low double, relative_ci_high double"
    if sums.empty:
        return spark.createDataFrame([], schema)
    sums["l"] = sums["l"].astype(str)
    s = sums.pivot_table(index="b", columns="l", values="s", aggfunc="sum", fill_value=0).sort_index()
    n = sums.pivot_table(index="b", columns="l", values="n", aggfunc="sum", fill_value=0).sort_index()
    rng = np.random.default_rng(seed)
    w = np.vstack([_weights(rng, np.zeros(len(s))) for _ in range(replicates)])
    with np.errstate(all="ignore"):
        point, draws = s.sum().to_numpy() / n.sum().to_numpy(), (w @ s.to_numpy()) / (w @ n.to_numpy())
        base = list(s.columns).index(str(relative_to)) if relative_to is not None else 0
        rp, rd = point / point[base], draws / draws[:, [base]]
    ends = lambda x: [float(v) for v in np.nanpercentile(x, [2.5, 97.5])]
    return spark.createDataFrame([(lv, float(point[i]), *ends(draws[:, i]), float(rp[i]), *ends(rd[:, i])) for i, lv in enumerate(s.columns)], schema)


def _middle_places(rng: np.random.Generator, n: int, replicates: int) -> np.ndarray:
    """Per replicate the places, from 0 in the order of ``n`` values, of the two middle values of a resample of ``n`` (of
    the middle one twice, if ``n`` is odd).  A resample takes the values at the places ``floor(n * u)`` of uniform draws u;
    the k-th smallest of n draws is Beta(k, n + 1 - k), the next one the least of n - k draws above it."""
    k = (n + 1) // 2
    low = rng.beta(k, n + 1 - k, replicates)
    high = low if n % 2 else low + (1 - low) * rng.beta(1, n - k, replicates)
    return np.minimum(np.floor(n * np.column_stack([low, high])).astype(np.int64), n - 1)


def median_contrast(df: DataFrame, value: str, group: str, key: str | None = None, replicates: int = 5000, seed: int = 4) -> dict[str, float]:
    """The difference of the medians of two groups (true minus false), its percentile interval over resamples within
    groups and the two-sided bootstrap p, at least one over the replicates.  The values are counted and ranked where they
    are; the places of the resamples' middle values are drawn on the driver, which gets the values between the first and
    the last of them: about four times the square root of the rows.  ``key`` is not needed."""
    x = q(value).cast("double")
    known = df.where(x.isNotNull() & ~F.isnan(x) & q(group).isNotNull()).select(x.alias("v"), q(group).cast("boolean").alias("g"))
    ranked = value_ranks(known, "v", ["g"])
    totals = {r["g"]: r["total"] for r in ranked.groupBy("g").agg(F.max("total").alias("total")).collect()}
    if len(totals) < 2:
        return {"difference": float("nan"), "ci_low": float("nan"), "ci_high": float("nan"), "p": float("nan")}
    rng = np.random.default_rng(seed)
    places = {g: np.vstack([[(totals[g] - 1) // 2, totals[g] // 2], _middle_places(rng, totals[g], replicates)]) for g in (True, False)}  # first the groups' own
    wanted = [(F.col("g") == g) & (F.col("before") + F.col("n") > int(at.min())) & (F.col("before") <= int(at.max())) for g, at in places.items()]
    found = ranked.where(wanted[0] | wanted[1]).select("g", "v", "before").toPandas().sort_values("before")

    def medians(g: bool) -> np.ndarray:
        own = found[found["g"] == g]
        return own["v"].to_numpy(float)[np.searchsorted(own["before"].to_numpy(), places[g], "right") - 1].mean(1)

    difference, *d = medians(True) - medians(False)
    d = np.array(d)
    p = max(2 * min((d <= 0).mean(), (d >= 0).mean()), 1 / replicates)
    return {"difference": float(difference), "ci_low": float(np.percentile(d, 2.5)), "ci_high": float(np.percentile(d, 97.5)), "p": float(min(p, 1.0))}


def _hc3_t(design: np.ndarray, y: np.ndarray, col: int) -> np.ndarray:
    """The HC3 t of one coefficient for every column of ``y``."""
    inv = np.linalg.pinv(design.T @ design)
    beta = inv @ design.T @ y
    e = y - design @ beta
    h = np.einsum("ij,jk,ik->i", design, inv, design)
    a = (design @ inv[:, col]) / np.maximum(1 - h, 1e-12)
    return beta[col] / np.sqrt(np.maximum(((a[:, None] * e) ** 2).sum(0), 1e-300))


def freedman_lane(samples: pd.DataFrame, y: str, tested: str, covariates: Sequence[str], spark: SparkSession, replicates: int = 2000, seed: int = 1) -> dict[str, float]:
    """Permutes the residuals of the model without ``tested``, adds its fit back, refits the full model and
    compares |t| (HC3).  One row per sample; replicates are spread over tasks.  p = (hits + 1) / (B + 1)."""
    z = np.column_stack([np.ones(len(samples)), *[samples[c].to_numpy(float) for c in covariates]])
    full = np.column_stack([z, samples[tested].to_numpy(float)])
    v = samples[y].to_numpy(float)
    fit = z @ (np.linalg.pinv(z) @ v)
    res = v - fit
    t = float(_hc3_t(full, v[:, None], full.shape[1] - 1)[0])
    shared = spark.sparkContext.broadcast((full, fit, res))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full, fit, res = shared.value
        for f in frames:
            cols = np.column_stack([fit + res[np.random.default_rng([seed, int(i)]).permutation(len(res))] for i in f["id"]]) if len(f) else np.zeros((len(res), 0))
            yield pd.DataFrame({"hit": (np.abs(_hc3_t(full, cols, full.shape[1] - 1)) >= abs(t)).astype(int)})

    hits = _replicates(spark, replicates).mapInPandas(run, "hit int").agg(F.sum("hit")).first()[0] or 0
    beta = np.linalg.pinv(full) @ v
    return {"effect": float(beta[-1]), "t": t, "p": (hits + 1) / (replicates + 1)}


def label_permutation(values: np.ndarray, labels: np.ndarray, spark: SparkSession, replicates: int = 10_000, seed: int = 0) -> dict[str, float]:
    """The mean difference of labelled against other values, and the share of random labellings at least as
    large in absolute value, (hits + 1) / (B + 1).  Values are residuals of covariates, one per sample."""
    values, labels = np.asarray(values, float), np.asarray(labels, bool)
    obs = values[labels].mean() - values[~labels].mean()
    shared = spark.sparkContext.broadcast((values, int(labels.sum())))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, k = shared.value
        for f in frames:
            out = []
            for i in f["id"]:
                pick = np.random.default_rng([seed, int(i)]).permutation(len(v))[:k]
                s = v[pick].sum()
                out.append(int(abs(s / k - (v.sum() - s) / (len(v) - k)) >= abs(obs) - 1e-12))
            yield pd.DataFrame({"hit": out})

    hits = _replicates(spark, replicates).mapInPandas(run, "hit int").agg(F.sum("hit")).first()[0] or 0
    return {"difference": float(obs), "p": (hits + 1) / (replicates + 1)}


def block_permutation_peak(x: np.ndarray, block: int, replicates: int = 200, seed: int = 11, quantile: float = 0.95) -> float:
    """The quantile, over shuffles of whole blocks of a series, of its largest periodogram ordinate."""
    x = np.asarray(x, float) - np.mean(x)
    pieces = [x[i : i + block] for i in range(0, len(x), block)]
    rng = np.random.default_rng(seed)
    tops = [(np.abs(np.fft.rfft(np.concatenate([pieces[i] for i in rng.permutation(len(pieces))]))[1:]) ** 2).max() for _ in range(replicates)]
    return float(np.quantile(tops, quantile))


def window_mean_null(values: np.ndarray, width: int, spark: SparkSession, replicates: int = 20_000, seed: int = 0) -> np.ndarray:
    """The means of ``replicates`` random windows of ``width`` consecutive values."""
    shared = spark.sparkContext.broadcast(np.cumsum(np.r_[0.0, np.asarray(values, float)]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for f in frames:
            at = np.array([np.random.default_rng([seed, int(i)]).integers(0, len(c) - width) for i in f["id"]], int)
            yield pd.DataFrame({"id": f["id"].to_numpy(), "m": (c[at + width] - c[at]) / width if len(at) else np.zeros(0)})

    return _replicates(spark, replicates).mapInPandas(run, "id bigint, m double").orderBy("id").toPandas()["m"].to_numpy()


def double_bootstrap(pairs: pd.DataFrame, z: np.ndarray, donors: np.ndarray, fit, replicates: int, seed: int, spark: SparkSession) -> pd.DataFrame:
    """Donor and block bootstrap.  ``pairs``: columns i, j (rows of ``z``) and block; ``z``: positions x samples;
    ``donors``: of each sample; ``fit(pairs, r, weights)`` gives a dict of statistics.  Replicate -1 is the point
    estimate.  Each replicate draws donors, weights the samples, standardises again, recomputes every
    pair's correlation and fits it with the weights of drawn blocks."""
    names, who = np.unique(donors, return_inverse=True)
    blocks, which = np.unique(pairs["block"].astype(str), return_inverse=True)
    shared = spark.sparkContext.broadcast((pairs, z, who, which, len(names), len(blocks)))

    def one(rep: int) -> dict[str, float]:
        pairs, z, who, which, nd, nb = shared.value
        rng = np.random.default_rng([seed, rep + 1])
        wd = np.bincount(rng.integers(0, nd, nd), minlength=nd) if rep >= 0 else np.ones(nd)
        wb = np.bincount(rng.integers(0, nb, nb), minlength=nb) if rep >= 0 else np.ones(nb)
        w = wd[who].astype(float)
        w /= w.sum()
        c = z - (z @ w)[:, None]
        s = c / (np.sqrt((c * c) @ w)[:, None] + 1e-9)
        r = ((s[pairs["i"].to_numpy()] * s[pairs["j"].to_numpy()]) @ w)
        return {"rep": rep, **fit(pairs, r, wb[which])}

    first = one(-1)
    cols = list(first)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([one(int(i)) for i in f["id"]], columns=cols)

    schema = ", ".join(f"`{c}` {'bigint' if c == 'rep' else 'double'}" for c in cols)
    rest = _replicates(spark, replicates).mapInPandas(run, schema).toPandas()
    return pd.concat([pd.DataFrame([first]), rest.sort_values("rep")], ignore_index=True)


def replicate_summary(log: DataFrame, by: Sequence[str], value: str, rep: str = "rep") -> DataFrame:
    """(by..., estimate, ci_low, ci_high, boot_se, replicates) of a replicate log whose rep -1 is the point."""
    point, draw = F.when(q(rep) == -1, q(value)), F.when(q(rep) >= 0, q(value))
    return log.groupBy(*[q(c) for c in by]).agg(F.max(point).alias("estimate"), F.percentile(draw, 0.025).alias("ci_low"), F.percentile(draw, 0.975).alias("ci_high"), F.stddev_pop(draw).alias("boot_se"), F.count(draw).alias("replicates"))


def gene_set_null(active: DataFrame, candidates: DataFrame, by: Sequence[str], segment: str, key: str, replicates: int = 200, seed: int = 11) -> DataFrame:
    """(by..., observed, expected, sd, z): segments with two or more active members, against as many random
    candidates.  Draws are the candidates with the smallest hashes; ``candidates`` and ``active`` have by,
    segment, key.  z is null without spread."""
    keys = [q(c) for c in by]
    clustered = lambda df, extra: df.where(q(segment).isNotNull()).groupBy(*keys, *extra, q(segment)).agg(F.count("*").alias("_m")).groupBy(*keys, *extra).agg(F.count_if(F.col("_m") >= 2).alias("_c"))
    obs = clustered(active, []).withColumnRenamed("_c", "observed")
    sizes = active.groupBy(*keys).agg(F.count("*").alias("_k"))
    reps = candidates.join(sizes, list(by)).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = Window.partitionBy(*keys, "rep").orderBy(F.xxhash64(F.lit(seed), "rep", *keys, q(key)), q(key))
    drawn = reps.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.col("_k"))
    null = clustered(drawn, [F.col("rep")]).groupBy(*keys).agg(F.avg("_c").alias("expected"), F.stddev_pop("_c").alias("sd"))
    return obs.join(null, list(by)).withColumn("z", F.try_divide(F.col("observed") - F.col("expected"), F.col("sd")))
