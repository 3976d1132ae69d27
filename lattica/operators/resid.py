"""Removal of layers from a signal: covariate trends by rows and by columns, principal components, own
dosage; and the balancing of contact matrices.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.signal import POSITION
from lattica.session import q, small_enough, written


def _orthonormal(gram: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """Coefficients (sets, k, i), zero for i > k, of functions sum_i c[k, i] f_i that are orthonormal where the
    f_i have the inner products ``gram`` (sets, i, j).  Functions that depend on those before them are 0."""
    sets, p, _ = gram.shape
    made = np.zeros((sets, p, p))
    for k in range(p):
        v = np.zeros((sets, p))
        v[:, k] = 1
        for _ in range(2):  # again, for what rounding left
            v -= np.einsum("ski,sij,sj,skl->sl", made, gram, v, made)
        norm = np.einsum("si,sij,sj->s", v, gram, v)
        ok = norm > least * np.maximum(gram[:, k, k], 0)
        made[ok, k] = v[ok] / np.sqrt(norm[ok])[:, None]
    return made


def _basis(rows: DataFrame, by: Sequence[str], functions: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """``rows`` (columns ``keep``) with q0, q1, ..: functions of the rows, orthonormal over the rows of each ``by``, spanning
    the given ones in their order.  The inner products are summed where the rows are; only these few numbers per
    group are worked on in Python."""
    p, keys = len(functions), list(by)
    f = rows.select(*[q(c) for c in dict.fromkeys([*keys, *keep])], *[x.alias(f"_f{i}") for i, x in enumerate(functions)])
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = f.groupBy(*keys).agg(F.array(*[F.sum(F.col(f"_f{i}") * F.col(f"_f{j}")) for i, j in pairs]).alias("_g"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in frames:
            gram = np.zeros((len(t), p, p))
            for at, (i, j) in enumerate(pairs):
                gram[:, i, j] = gram[:, j, i] = [g[at] for g in t["_g"]]
            yield t[keys].assign(_c=list(_orthonormal(gram).reshape(len(t), p * p)))

    kind = lambda c: rows.schema[c].dataType.simpleString()
    table, _ = small_enough(written(sums.mapInPandas(run, ", ".join([*[f"`{c}` {kind(c)}" for c in keys], "_c array<double>"])), "basis"))
    made = [sum((F.col("_c")[k * p + i] * F.col(f"_f{i}") for i in range(1, k + 1)), F.col("_c")[k * p] * F.col("_f0")).alias(f"q{k}") for k in range(p)]
    return f.join(table, keys).select(*[q(c) for c in keep], *made)


def _scaled(rows: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``rows`` with the columns ``names`` scaled to mean 0 and variance 1 in each ``by``; constant ones become 0."""
    stats = rows.groupBy(*by).agg(*[x for c in names for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    z = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.lit(0.0)) for c in names}
    return rows.join(stats, list(by)).withColumns(z).select(*rows.columns)


def trend_basis(signal: DataFrame, covariate: DataFrame, degree: int = 2, by: Sequence[str] = ("unit",)) -> DataFrame:
    """(unit, part, rank, q0, q1, ..): an orthonormal basis of the covariate's powers over the positions of
    each unit; directions that the values do not span are 0."""
    on = [*(["unit"] if "unit" in covariate.columns else []), "part", "rank"]
    known = covariate.select(*on, F.col("covariate").cast("double").alias("g")).where("g IS NOT NULL AND NOT isnan(g)")
    places = _scaled(signal.select(*POSITION).distinct().join(known, on).select(*POSITION, "g"), by, ["g"])
    return _basis(places, by, [F.lit(1.0), *[F.pow("g", F.lit(k)) for k in range(1, degree + 1)]], POSITION)


def remove_trend(signal: DataFrame, basis: DataFrame, out: str = "value") -> DataFrame:
    """Every sample's projection on the basis taken off.  Positions without a covariate are left out."""
    names = [c for c in basis.columns if c.startswith("q")]
    basis, _ = small_enough(written(basis, "basis"))
    x = signal.join(basis, POSITION)
    coef = x.groupBy("unit", "sample").agg(*[F.sum(F.col("value") * F.col(c)).alias(f"_{c}") for c in names])
    fit = sum((F.col(f"_{c}") * F.col(c) for c in names[1:]), F.col(f"_{names[0]}") * F.col(names[0]))
    return x.join(coef, ["unit", "sample"]).withColumn(out, F.col("value") - fit).drop(*names, *[f"_{c}" for c in names])


def covariate_slopes(signal: DataFrame, covariate: DataFrame) -> DataFrame:
    """(unit, sample, slope): of the value on the covariate standardised over the unit's positions (population
    sd); 0 where the covariate is constant."""
    x = signal.join(covariate.select("part", "rank", F.col("covariate").cast("double").alias("_g")), ["part", "rank"]).where("_g IS NOT NULL")
    sd = x.select(*POSITION, "_g").distinct().groupBy("unit").agg(F.stddev_pop("_g").alias("_sd"))
    slope = F.coalesce(F.regr_slope("value", "_g"), F.lit(0.0))
    return x.groupBy("unit", "sample").agg(slope.alias("_b")).join(sd, "unit").select("unit", "sample", (F.col("_b") * F.coalesce("_sd", F.lit(0.0))).alias("slope"))


def remove_sample_factors(signal: DataFrame, factors: DataFrame, names: Sequence[str], out: str = "value") -> DataFrame:
    """Every position's least-squares fit on sample factors (and a constant) taken off.  The factors'
    orthonormal basis over a unit's samples comes from their summed products."""
    known = factors.select("sample", *[F.col(c).cast("double").alias(c) for c in names]).dropna()
    samples = _scaled(signal.select("unit", "sample").distinct().join(known, "sample"), ["unit"], names)
    p = len(names) + 1
    basis, _ = small_enough(written(_basis(samples, ["unit"], [F.lit(1.0), *[F.col(c) for c in names]], ["unit", "sample"]), "basis"))
    x = signal.join(basis, ["unit", "sample"])
    coef = x.groupBy(*POSITION).agg(*[F.sum(F.col("value") * F.col(f"q{k}")).alias(f"_q{k}") for k in range(p)])
    fit = sum((F.col(f"_q{k}") * F.col(f"q{k}") for k in range(1, p)), F.col("_q0") * F.col("q0"))
    return x.join(coef, POSITION).withColumn(out, F.col("value") - fit).drop(*[f"q{k}" for k in range(p)], *[f"_q{k}" for k in range(p)])


def remove_components(signal: DataFrame, components: int, most_samples: int = 5000) -> DataFrame:
    """The leading principal components over samples taken off, per unit.  The samples' Gram matrix is
    summed over positions in the executors; only it (samples squared, bounded) is decomposed."""
    arrays = signal.groupBy(*POSITION).agg(F.sort_array(F.collect_list(F.struct("sample", "value"))).alias("a"))
    n = signal.groupBy("unit").agg(F.count_distinct("sample").alias("n"))
    if n.where(F.col("n") > most_samples).limit(1).count():
        raise ValueError("too many samples for a Gram matrix")
    kind = lambda c: signal.schema[c].dataType.simpleString()
    full = arrays.join(n, "unit").where(F.size("a") == F.col("n"))

    def gram(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, tuple[list, np.ndarray]] = {}
        for f in frames:
            for unit, part in f.groupby("unit"):
                names = [s["sample"] for s in part["a"].iloc[0]]
                m = np.array([[s["value"] for s in a] for a in part["a"]], float)
                g = m.T @ m
                sums[unit] = (names, sums[unit][1] + g if unit in sums else g)
        for unit, (names, g) in sums.items():
            yield pd.DataFrame({"unit": [unit] * len(names), "i": range(len(names)), "sample": names, "row": list(g)})

    rows = full.select("unit", "a").mapInPandas(gram, f"unit {kind('unit')}, i int, sample {kind('sample')}, row array<double>")
    total = rows.select("unit", "i", "sample", F.posexplode("row").alias("j", "v")).groupBy("unit", "i", "sample", "j").agg(F.sum("v").alias("v"))

    def decompose(key, f: pd.DataFrame) -> pd.DataFrame:
        size = int(f["i"].max()) + 1
        g = np.zeros((size, size))
        g[f["i"], f["j"]] = f["v"]
        _, vec = np.linalg.eigh(g)
        top = vec[:, ::-1][:, :components]
        names = f.drop_duplicates("i").sort_values("i")["sample"].tolist()
        return pd.DataFrame({"unit": [key[0]] * size, "sample": names, "u": list(top)})

    vectors, _ = small_enough(written(total.groupBy("unit").applyInPandas(decompose, f"unit {kind('unit')}, sample {kind('sample')}, u array<double>"), "vectors"))
    x = signal.join(vectors, ["unit", "sample"])
    k = components
    coef = x.groupBy(*POSITION).agg(*[F.sum(F.col("value") * F.element_at("u", i + 1)).alias(f"_c{i}") for i in range(k)])
    fit = sum((F.col(f"_c{i}") * F.element_at("u", i + 1) for i in range(1, k)), F.col("_c0") * F.element_at("u", 1)) if k else F.lit(0.0)
    return x.join(coef, POSITION).withColumn("value", F.col("value") - fit).select(*signal.columns)


def own_dosage(signal: DataFrame, dosage: DataFrame, degree: int = 2, flat: float = 1e-6, ridge: float = 0.0) -> DataFrame:
    """(unit, part, rank, b0, b1, ..): per position the least-squares polynomial of the value on the position's
    own dosage over samples, from summed moments; positions whose dosage has a smaller sd than ``flat``
    have zeros.  ``dosage``: (unit, sample, part, rank, dose); absent doses are 0."""
    x = signal.join(dosage, ["unit", "sample", "part", "rank"], "left").withColumn("dose", F.coalesce("dose", F.lit(0.0)))
    p = degree + 1
    power = lambda k: F.pow(F.col("dose"), F.lit(k)) if k else F.lit(1.0)
    m = x.groupBy(*POSITION).agg(*[F.sum(power(k)).alias(f"s{k}") for k in range(2 * degree + 1)], *[F.sum(power(k) * F.col("value")).alias(f"t{k}") for k in range(p)], F.stddev_pop("dose").alias("sd"))
    kind = lambda c: signal.schema[c].dataType.simpleString()
    schema = ", ".join([*[f"{c} {kind(c)}" for c in POSITION], *[f"b{k} double" for k in range(p)]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = f[[f"s{k}" for k in range(2 * degree + 1)]].to_numpy(float)
            t = f[[f"t{k}" for k in range(p)]].to_numpy(float)
            a = np.stack([np.stack([s[:, i + j] for j in range(p)], 1) for i in range(p)], 1) + ridge * np.eye(p)
            b = np.zeros((len(f), p))
            on = f["sd"].to_numpy(float) >= flat
            if on.any():
                b[on] = (np.linalg.pinv(a[on], hermitian=True) @ t[on][:, :, None])[:, :, 0]
            yield pd.concat([f[POSITION].reset_index(drop=True), pd.DataFrame(b, columns=[f"b{k}" for k in range(p)])], axis=1)

    return m.mapInPandas(run, schema)


def apply_dosage(signal: DataFrame, dosage: DataFrame, coefficients: DataFrame) -> DataFrame:
    """``signal`` with ``fitted`` and ``residual`` under the coefficients of :func:`own_dosage` (fitted on these or
    on other samples)."""
    names = [c for c in coefficients.columns if c.startswith("b")]
    x = signal.join(dosage, ["unit", "sample", "part", "rank"], "left").withColumn("dose", F.coalesce("dose", F.lit(0.0))).join(coefficients, POSITION)
    fit = sum((F.col(c) * F.pow(F.col("dose"), F.lit(k + 1)) for k, c in enumerate(names[1:])), F.col(names[0]))
    return x.withColumn("fitted", fit).withColumn("residual", F.col("value") - F.col("fitted")).drop("dose", *names)


#: A part of at most this many cells is balanced in one task; larger ones by joins.
MOST_CELLS = 2_000_000


def balance(cells: DataFrame, part: str = "part", rounds: int = 30, most_cells: int = MOST_CELLS) -> DataFrame:
    """Sparse symmetric matrices (part, i, j, v; one triangle) balanced by dividing rows and columns by the
    square root of their mean-scaled sums, ``rounds`` times.  Cells that are not positive are left out.
    Parts within ``most_cells`` run in numpy, part by part; if any is larger, all run as joins."""
    cur = cells.where("v > 0").select(q(part).alias("part"), "i", "j", F.col("v").cast("double").alias("v"))
    cur = written(cur, "cells")
    if cur.groupBy("part").count().where(F.col("count") > most_cells).limit(1).count() == 0:
        kind = cur.schema["part"].dataType.simpleString()

        def run(key, f: pd.DataFrame) -> pd.DataFrame:
            names, at = np.unique(np.concatenate([f["i"], f["j"]]), return_inverse=True)
            i, j = at[: len(f)], at[len(f) :]
            v, off = f["v"].to_numpy(float), i != j
            for _ in range(rounds):
                s = np.bincount(i, v, len(names)) + np.bincount(j[off], v[off], len(names))
                x = np.sqrt(s / s.mean())
                v = v / (x[i] * x[j])
            return f.assign(v=v)

        return cur.groupBy("part").applyInPandas(run, f"part {kind}, i {cur.schema['i'].dataType.simpleString()}, j {cur.schema['j'].dataType.simpleString()}, v double")
    for _ in range(rounds):
        halves = cur.select("part", F.col("i").alias("n"), "v").unionByName(cur.where("i <> j").select("part", F.col("j").alias("n"), "v"))
        sums = halves.groupBy("part", "n").agg(F.sum("v").alias("s"))
        mean = sums.groupBy("part").agg(F.avg("s").alias("m"))
        f = written(sums.join(mean, "part").select("part", "n", F.sqrt(F.col("s") / F.col("m")).alias("f")), "factors")
        cur = cur.join(f.select("part", F.col("n").alias("i"), F.col("f").alias("fi")), ["part", "i"]).join(f.select("part", F.col("n").alias("j"), F.col("f").alias("fj")), ["part", "j"])
        cur = written(cur.select("part", "i", "j", (F.col("v") / (F.col("fi") * F.col("fj"))).alias("v")), "cells")  # else the plan doubles with every round
    return cur
