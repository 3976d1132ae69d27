"""Regression from sufficient statistics.

One aggregation gives the moments of all columns per group; systems of a few columns are then solved in
numpy, group by group.  Rows never leave the executors.  Robust errors need residuals, so they take a
second aggregation that uses the coefficients of the first.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.tails import chi2_1_p, f_p, normal_p, normal_ppf, normal_sf, t_p, t_ppf, t_two_sided
from lattica.operators.signal import remove_group_means
from lattica.session import q


def complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with all ``cols`` present and finite."""
    ok = None
    for c in cols:
        v = q(c).cast("double")
        this = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        ok = this if ok is None else ok & this
    return df.where(ok)


def moments(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, xtx, xty, yty): of the design [1, xs...]; xtx is flat, row by row."""
    cols = [F.lit(1.0), *[q(x).cast("double") for x in xs]]
    p = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [F.sum(c * q(y)).alias(f"t{i}") for i, c in enumerate(cols)] + [F.sum(q(y).cast("double") * q(y)).alias("yty"), F.count("*").alias("n")]
    got = complete(df, [y, *xs]).groupBy(*[q(c) for c in by]).agg(*sums)
    xtx = F.array(*[F.col(f"s{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)])
    return got.select(*[q(c) for c in by], "n", xtx.alias("xtx"), F.array(*[F.col(f"t{i}") for i in range(p)]).alias("xty"), "yty")


def solve(xtx: np.ndarray, xty: np.ndarray) -> np.ndarray:
    """The least-squares solution, of least norm if columns are collinear."""
    return np.linalg.pinv(xtx) @ xty


def ols(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., term, coef, se, t, p, n, r2): ordinary least squares with an intercept per group.  Groups with
    fewer rows than columns have null errors; an empty table gives no rows."""
    terms = ["intercept", *xs]
    p = len(terms)
    m = moments(df, y, xs, by)
    schema = ", ".join([*[f"`{c}` {m.schema[c].dataType.simpleString()}" for c in by], "term string, coef double, se double, t double, p double, n bigint, r2 double"])

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                d = r._asdict() if hasattr(r, "_asdict") else dict(zip(f.columns, r))
                if not d["n"]:
                    continue
                a, b = np.array(d["xtx"], float).reshape(p, p), np.array(d["xty"], float)
                beta = solve(a, b)
                rss = max(d["yty"] - beta @ b, 0.0)
                rank = np.linalg.matrix_rank(a, hermitian=True)
                df_ = d["n"] - rank
                se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(a)), 0) * rss / df_) if df_ > 0 else np.full(p, np.nan)
                with np.errstate(all="ignore"):
                    t = beta / se
                tss = d["yty"] - b[0] ** 2 / d["n"]
                r2 = 1 - rss / tss if tss > 0 else np.nan
                rows += [[*[d[c] for c in by], term, beta[i], se[i], t[i], float(t_two_sided(t[i], df_)), d["n"], r2] for i, term in enumerate(terms)]
            yield pd.DataFrame(rows, columns=[*by, "term", "coef", "se", "t", "p", "n", "r2"])

    out = m.mapInPandas(run, schema)
    return out.select(*[q(c) for c in by], "term", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("coef", "se", "t", "p")], "n", F.when(~F.isnan("r2"), F.col("r2")).alias("r2"))


def indicators(df: DataFrame, column: str, levels: Sequence[str], prefix: str) -> tuple[DataFrame, list[str]]:
    """Indicator columns of every level but the first, and their names."""
    names = [f"{prefix}_{i}" for i in range(1, len(levels))]
    return df.withColumns({n: (q(column) == v).cast("double") for n, v in zip(names, levels[1:])}), names


def fixed_effect(df: DataFrame, y: str, xs: Sequence[str], within: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """:func:`ols` of ``y`` on ``xs`` after taking the means of (by..., within...) from all of them: slopes with an
    intercept for each such group.  The constant term that remains is zero and is left out."""
    keys = [*by, *within]
    rows = complete(df, [y, *xs])
    for c in [y, *xs]:
        rows = remove_group_means(rows, c, keys, f"_d_{c}").drop(c).withColumnRenamed(f"_d_{c}", c)
    return ols(rows, y, xs, by).where(F.col("term") != "intercept")


def fe_slope(df: DataFrame, y: str, x: str, within: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., slope, n): the within-group slope of one column, from group moments alone, so that no row is
    joined: sum of within covariances over sum of within variances."""
    got = complete(df, [y, x]).groupBy(*[q(c) for c in [*by, *within]]).agg(F.covar_pop(q(x), q(y)).alias("_c"), F.var_pop(q(x)).alias("_v"), F.count("*").alias("_n"))
    return got.groupBy(*[q(c) for c in by]).agg(F.try_divide(F.sum(F.col("_c") * F.col("_n")), F.sum(F.col("_v") * F.col("_n"))).alias("slope"), F.sum("_n").alias("n"))


def robust(df: DataFrame, y: str, xs: Sequence[str], cluster: str | None = None, level: float = 0.95) -> DataFrame:
    """(term, coef, se, ci_low, ci_high, p, n): least squares over the whole table with HC3 errors, or with
    errors robust to ``cluster`` (small-sample factor G/(G-1) * (n-1)/(n-p); Student tail with G - 1
    degrees for clusters, normal for HC3).  Two aggregations over the rows; the meat of each cluster is
    summed in place."""
    spark = df.sparkSession
    terms = ["intercept", *xs]
    p = len(terms)
    rows = complete(df, [y, *xs])
    first = moments(rows, y, xs).collect()[0]  # one row
    n = first["n"]
    schema = "term string, coef double, se double, ci_low double, ci_high double, p double, n bigint"
    if n <= p:
        return spark.createDataFrame([], schema)
    inv = np.linalg.pinv(np.array(first["xtx"], float).reshape(p, p))
    beta = inv @ np.array(first["xty"], float)
    cols = [F.lit(1.0), *[q(x).cast("double") for x in xs]]
    total = lambda parts: sum(parts[1:], parts[0])
    e = q(y).cast("double") - total([F.lit(float(b)) * c for b, c in zip(beta, cols)])
    if cluster is None:
        h = total([F.lit(float(inv[i, j])) * cols[i] * cols[j] for i in range(p) for j in range(p)])
        w = F.pow(e / F.greatest(1 - h, F.lit(1e-12)), F.lit(2))
        meat_row = rows.agg(*[F.sum(w * cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(p) for j in range(p)]).collect()[0]
        factor, tail, quant = 1.0, (lambda t: 2 * normal_sf(abs(t))), normal_ppf((1 + level) / 2)
    else:
        scores = rows.groupBy(q(cluster)).agg(*[F.sum(e * c).alias(f"u{i}") for i, c in enumerate(cols)])
        meat_row = scores.agg(*[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in range(p) for j in range(p)], F.count("*").alias("g")).collect()[0]
        g = meat_row["g"]
        factor = g / (g - 1) * (n - 1) / (n - p) if g > 1 else float("nan")
        tail, quant = (lambda t: t_two_sided(t, g - 1)), (t_ppf((1 + level) / 2, g - 1) if g > 1 else float("nan"))
    meat = np.array([[meat_row[f"m{i}_{j}"] for j in range(p)] for i in range(p)], float)
    se = np.sqrt(np.maximum(np.diag(inv @ meat @ inv) * factor, 0))
    out = [(t, float(b), float(s), float(b - quant * s), float(b + quant * s), float(tail(b / s)) if s > 0 else None, n) for t, b, s in zip(terms, beta, se)]
    return spark.createDataFrame(out, schema)


def spline_basis(x: np.ndarray, df: int = 5, knots: np.ndarray | None = None) -> np.ndarray:
    """A cubic B-spline basis without its first column: ``df - 3`` inner knots at equal quantiles of ``x`` (or
    the given ones), boundary knots at its range."""
    x = np.asarray(x, float)
    inner = np.quantile(x, np.linspace(0, 1, df - 1)[1:-1]) if knots is None else np.asarray(knots, float)
    t = np.r_[[x.min()] * 4, inner, [x.max()] * 4]
    basis = np.zeros((len(x), len(t) - 1))
    for i in range(len(t) - 1):
        basis[:, i] = (x >= t[i]) & (x < t[i + 1])
    last = np.flatnonzero(t[:-1] < t[1:])[-1]
    basis[x == t[-1], last] = 1
    for d in range(1, 4):
        nxt = np.zeros((len(x), len(t) - 1 - d))
        for i in range(len(t) - 1 - d):
            left = (x - t[i]) / (t[i + d] - t[i]) * basis[:, i] if t[i + d] > t[i] else 0
            right = (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) * basis[:, i + 1] if t[i + d + 1] > t[i + 1] else 0
            nxt[:, i] = left + right
        basis = nxt
    return basis[:, 1:]


# ------------------------------------------------------------------------------- tests on moments


def eta_squared(df: DataFrame, value: str, group: str, by: Sequence[str] = (), least: int = 3) -> DataFrame:
    """(by..., eta2, groups): between-group over total sum of squares, groups of at least ``least`` rows; the
    total is taken over those groups around the mean of all rows.  Null with fewer than two groups."""
    keys = [q(c) for c in by]
    g = df.where(q(value).isNotNull()).groupBy(*keys, q(group)).agg(F.count("*").alias("n"), F.sum(q(value)).alias("s"), F.sum(q(value) * q(value)).alias("ss"))
    totals = g.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("grand"))
    big = g.where(F.col("n") >= least)
    j = big.join(totals, list(by)) if by else big.crossJoin(F.broadcast(totals))  # one row
    mean = F.col("s") / F.col("n")
    between = F.sum(F.col("n") * F.pow(mean - F.col("grand"), F.lit(2)))
    total = F.sum(F.col("ss") - 2 * F.col("grand") * F.col("s") + F.col("n") * F.col("grand") * F.col("grand"))
    return j.groupBy(*keys).agg(F.when(F.count("*") > 1, F.try_divide(between, total)).alias("eta2"), F.count("*").alias("groups"))


def anova(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., f, df1, df2, p): one-way analysis of variance; null F without residual degrees."""
    keys = [q(c) for c in by]
    g = df.where(q(value).isNotNull() & q(group).isNotNull()).groupBy(*keys, q(group)).agg(F.count("*").alias("n"), F.avg(q(value)).alias("m"), (F.var_pop(q(value)) * F.count("*")).alias("within"))
    n, k = F.sum("n"), F.count("*")
    s = g.groupBy(*keys).agg(n.alias("_n"), k.alias("_k"), F.sum("within").alias("_w"), F.sum(F.col("n") * F.col("m")).alias("_s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("_q"))
    between = F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")
    f = F.try_divide(between / F.nullif(F.col("_k") - 1, F.lit(0)), F.col("_w") / F.nullif(F.col("_n") - F.col("_k"), F.lit(0)))
    out = s.select(*keys, f.alias("f"), (F.col("_k") - 1).alias("df1"), (F.col("_n") - F.col("_k")).alias("df2"))
    return out.withColumn("p", f_p(F.col("f"), F.col("df1"), F.col("df2")))


def welch(df: DataFrame, value: str, group: str, by: Sequence[str] = (), with_p: bool = True) -> DataFrame:
    """(by..., difference, t, df[, p]): rows with ``group`` true against false; Welch and Satterthwaite."""
    side = lambda flag, agg: agg(F.when(q(group) if flag else ~q(group), q(value)))
    got = df.groupBy(*[q(c) for c in by]).agg(
        *[side(flag, agg).alias(f"{name}{k}") for k, flag in ((1, True), (0, False)) for name, agg in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    )
    a, b = F.try_divide(F.col("v1"), F.col("n1").cast("double")), F.try_divide(F.col("v0"), F.col("n0").cast("double"))
    t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(a + b))
    d = F.try_divide(F.pow(a + b, F.lit(2)), F.try_divide(a * a, (F.col("n1") - 1).cast("double")) + F.try_divide(b * b, (F.col("n0") - 1).cast("double")))
    out = got.select(*[q(c) for c in by], (F.col("m1") - F.col("m0")).alias("difference"), t.alias("t"), d.alias("df"))
    return out.withColumn("p", t_p(F.col("t"), F.col("df"))) if with_p else out


def regularised_t(df: DataFrame, value: str, group: str, by: Sequence[str], add: float = 0.01, eps: float = 1e-9) -> DataFrame:
    """(by..., t): mean difference over ``sqrt(v1 / n1 + v0 / n0 + eps) + add``."""
    w = df.groupBy(*[q(c) for c in by]).agg(
        *[agg(F.when(q(group) if k else ~q(group), q(value))).alias(f"{n}{k}") for k in (1, 0) for n, agg in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    )
    se = F.sqrt(F.try_divide(F.coalesce("v1", F.lit(0.0)), F.col("n1").cast("double")) + F.try_divide(F.coalesce("v0", F.lit(0.0)), F.col("n0").cast("double")) + eps) + add
    return w.select(*[q(c) for c in by], F.try_divide(F.col("m1") - F.col("m0"), se).alias("t"))


def correlation_p(r: Column, n: Column) -> Column:
    """The two-sided p of a Pearson correlation over ``n`` pairs."""
    t = r * F.sqrt(F.try_divide((n - 2).cast("double"), F.greatest(1 - r * r, F.lit(1e-300))))
    return t_p(t, n - 2)


def meta_analysis(df: DataFrame, est: str, se: str, by: Sequence[str] = (), with_p: bool = True) -> DataFrame:
    """(by..., estimate, se, ci_low, ci_high, cochran_q, studies[, p, p_heterogeneity]): inverse-variance
    weights; heterogeneity has a tail for two studies (one degree of freedom)."""
    w = 1 / (q(se) * q(se))
    got = df.where(q(se) > 0).groupBy(*[q(c) for c in by]).agg(F.sum(w).alias("_w"), F.sum(w * q(est)).alias("_we"), F.sum(w * q(est) * q(est)).alias("_wee"), F.count("*").alias("studies"))
    m, s = F.col("_we") / F.col("_w"), 1 / F.sqrt("_w")
    z = F.lit(1.959964)
    out = got.select(*[q(c) for c in by], m.alias("estimate"), s.alias("se"), (m - z * s).alias("ci_low"), (m + z * s).alias("ci_high"), F.greatest(F.col("_wee") - F.col("_we") * m, F.lit(0.0)).alias("cochran_q"), "studies")
    return out.withColumns({"p": normal_p(F.col("estimate") / F.col("se")), "p_heterogeneity": F.when(F.col("studies") == 2, chi2_1_p(F.col("cochran_q")))}) if with_p else out


def tost(est: Column, se: Column, margin: Column) -> Column:
    """The p of two one-sided tests that the estimate lies within ``margin``."""
    one = lambda z: normal_p(F.abs(z)) / 2
    up, low = (margin - est) / se, (est + margin) / se
    tail = lambda z: F.when(z >= 0, one(z)).otherwise(1 - one(z))
    return F.greatest(tail(up), tail(low))


def detectable(se: Column, factor: float = 2.80) -> Column:
    """The effect found with a power of 80 % at the 5 % level."""
    return se * factor


def sign_concordance(pred: Column, obs: Column) -> Column:
    """Of the negative predictions, the share that is observed negative; an aggregate."""
    return F.try_divide(F.count_if((pred < 0) & (obs < 0)).cast("double"), F.count_if(pred < 0).cast("double"))


def rule_met(predicted: Column, neighbour: Column, target: Column, qvalue: Column, level: float = 0.10) -> tuple[Column, Column]:
    """(direction met, supported): the observed relation of signs is that predicted (1 same, -1 opposite),
    and the q value below ``level``."""
    met = F.signum(neighbour) * F.signum(target) == predicted
    return met, met & (qvalue < level)
