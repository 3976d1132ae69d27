"""Nonlinear fits in numpy, and their application per group in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lattica.session import q


def least_squares(f: Callable, x: np.ndarray, y: np.ndarray, start: Sequence[float], low: Sequence[float], high: Sequence[float], sigma: np.ndarray | None = None, steps: int = 500) -> tuple[np.ndarray, float]:
    """(parameters, weighted sum of squares): bounded Levenberg-Marquardt with projected steps and a
    numerical Jacobian."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    p = np.clip(np.asarray(start, float), low, high)
    w = np.ones_like(y, float) if sigma is None else 1 / np.asarray(sigma, float)
    res = lambda v: w * (f(x, *v) - y)
    r = res(p)
    cost, lam = float(r @ r), 1e-3
    for _ in range(steps):
        h = 1e-7 * np.maximum(np.abs(p), 1e-3)
        h = np.where(p + h > high, -h, h)
        jac = np.column_stack([(res(p + np.eye(len(p))[i] * h[i]) - r) / h[i] for i in range(len(p))])
        grad, hess = jac.T @ r, jac.T @ jac
        moved = False
        for _ in range(12):
            free = ~(((p <= low) & (grad > 0)) | ((p >= high) & (grad < 0)))
            if not free.any():
                break
            step = np.zeros(len(p))
            a = hess[np.ix_(free, free)]
            step[free] = -np.linalg.lstsq(a + lam * np.diag(np.maximum(np.diag(a), 1e-12)), grad[free], rcond=None)[0]
            trial = np.clip(p + step, low, high)
            rt = res(trial)
            ct = float(rt @ rt)
            if np.isfinite(ct) and ct < cost:
                gain = cost - ct
                p, r, cost, lam, moved = trial, rt, ct, max(lam / 4, 1e-12), True
                break
            lam *= 4
        if not moved or gain <= 1e-14 * (cost + 1e-30):
            break
    return p, cost


def nelder_mead(f: Callable, start: Sequence[float], scale: float = 0.2, steps: int = 4000, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """(point, value) of a local minimum by the simplex method; values that are not finite count as large."""
    n = len(start)
    val = lambda v: (lambda z: z if math.isfinite(z) else 1e300)(float(f(v)))
    s = [np.asarray(start, float)]
    for i in range(n):
        v = s[0].copy()
        v[i] += scale * (abs(v[i]) if v[i] else 1.0)
        s.append(v)
    fs = [val(v) for v in s]
    for _ in range(steps):
        order = np.argsort(fs, kind="stable")
        s, fs = [s[i] for i in order], [fs[i] for i in order]
        if abs(fs[-1] - fs[0]) <= tol * (abs(fs[0]) + tol):
            break
        c = np.mean(s[:-1], axis=0)
        r = c + (c - s[-1])
        fr = val(r)
        if fr < fs[0]:
            e = c + 2 * (c - s[-1])
            fe = val(e)
            s[-1], fs[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < fs[-2]:
            s[-1], fs[-1] = r, fr
        else:
            k = c + 0.5 * ((r if fr < fs[-1] else s[-1]) - c)
            fk = val(k)
            if fk < min(fr, fs[-1]):
                s[-1], fs[-1] = k, fk
            else:
                s = [s[0]] + [s[0] + 0.5 * (v - s[0]) for v in s[1:]]
                fs = [fs[0]] + [val(v) for v in s[1:]]
    i = int(np.argmin(fs))
    return s[i], fs[i]


def fit_contact_law(contact, coupling, sigma=None) -> dict[str, dict[str, float]]:
    """A power law ``r0 + A c^k`` and a fixed-size hub ``r0 + A (1 + (c* / c)^(2/3))^-1.5`` fitted to mean coupling
    against mean contact, each with its weighted chi-square."""
    c, r = np.asarray(contact, float), np.asarray(coupling, float)
    # fixed values: starts and bounds of both fits
    power, chi_p = least_squares(lambda x, r0, a, k: r0 + a * x**k, c, r, [0.0, 0.002, 0.5], [-0.05, 0, 0.01], [0.05, 5, 3], sigma)
    hub = min((least_squares(lambda x, r0, a, s: r0 + a * (1 + (s / x) ** (2 / 3)) ** -1.5, c, r, [0.005, 0.2, m * float(np.median(c))], [-0.05, 0, 1], [0.05, 5, 1e6], sigma) for m in (0.1, 1, 10)), key=lambda v: v[1])
    return {"power_law": dict(zip(("r0", "A", "k", "chi2"), (*power, chi_p))), "hub": dict(zip(("r0", "A", "c_star", "chi2"), (*hub[0], hub[1])))}


def exponential_fits(lag: np.ndarray, value: np.ndarray, floor: float = 0.0) -> dict[str, float]:
    """One and two exponentials fitted to a lag profile above its floor: lengths, amplitudes and residuals."""
    x, y = np.asarray(lag, float), np.asarray(value, float) - floor
    top = max(float(y.max()), 1e-6)
    one, rss1 = least_squares(lambda t, a, u: a * np.exp(-t / u), x, y, [top, 5.0], [0, 0.05], [10, 1e4])
    two, rss2 = min((least_squares(lambda t, a, u, b, v: a * np.exp(-t / u) + b * np.exp(-t / v), x, y, [top, s, top / 5, l], [0, 0.05, 0, 1], [10, 50, 10, 1e4]) for s, l in ((2.0, 20.0), (1.0, 50.0), (5.0, 100.0))), key=lambda v: v[1])
    short, long = sorted((two[1], two[3]))
    return {"length_one": one[1], "rss_one": rss1, "length_short": short, "length_long": long, "rss_two": rss2}


def lorentzian_fits(freq: np.ndarray, power: np.ndarray, count: np.ndarray) -> dict[str, float]:
    """One and two Lorentzians over a floor and a power law fitted to a binned spectrum on the log scale,
    weighted by the square root of the bin counts; lengths are 1 / (2 pi f0); AICc each."""
    f, y = np.asarray(freq, float), np.log(np.asarray(power, float))
    s = 1 / np.sqrt(np.asarray(count, float))
    n = len(f)
    model1 = lambda x, a, u, c: np.log(np.exp(a) / (1 + (2 * np.pi * x * np.exp(u)) ** 2) + np.exp(c))
    model2 = lambda x, a, u, b, v, c: np.log(np.exp(a) / (1 + (2 * np.pi * x * np.exp(u)) ** 2) + np.exp(b) / (1 + (2 * np.pi * x * np.exp(v)) ** 2) + np.exp(c))
    modelp = lambda x, a, k: a - k * np.log(x)
    hi, lo = float(y.max()), float(y.min())
    box = ([-40, -2, -40], [40, 9, 40])
    one, c1 = min((least_squares(model1, f, y, [hi, u, lo], *box, s) for u in (0.5, 1.5, 3.0)), key=lambda v: v[1])
    two, c2 = min((least_squares(model2, f, y, [hi, u, hi - 1, v, lo], [-40, -2, -40, -2, -40], [40, 9, 40, 9, 40], s) for u, v in ((0.5, 3.0), (1.5, 4.5), (0.5, 5.0))), key=lambda v: v[1])
    pl, cp = least_squares(modelp, f, y, [lo, 0.5], [-40, -5], [40, 5], s)
    aicc = lambda cost, k: n * math.log(max(cost, 1e-300) / n) + 2 * k + (2 * k * (k + 1) / (n - k - 1) if n > k + 1 else 0)
    short, long = sorted((math.exp(two[1]), math.exp(two[3])))
    return {"length_one": math.exp(one[1]), "length_short": short, "length_long": long, "exponent": pl[1], "aic_one": aicc(c1, 3), "aic_two": aicc(c2, 5), "aic_power": aicc(cp, 2)}


def whittle(freq: np.ndarray, power: np.ndarray) -> dict[str, float]:
    """Whittle likelihood of one and two Lorentzians and a power law, each from three starts; AIC."""
    f, p = np.asarray(freq, float), np.asarray(power, float)
    scale = math.log(float(p.mean()))
    s1 = lambda v: np.exp(v[0]) / (1 + (2 * np.pi * f * np.exp(v[1])) ** 2) + np.exp(v[2])
    s2 = lambda v: np.exp(v[0]) / (1 + (2 * np.pi * f * np.exp(v[1])) ** 2) + np.exp(v[2]) / (1 + (2 * np.pi * f * np.exp(v[3])) ** 2) + np.exp(v[4])
    sp = lambda v: np.exp(v[0]) * f ** -v[1] + np.exp(v[2])

    def loss(shape):
        def of(v):
            with np.errstate(all="ignore"):
                s = np.maximum(shape(v), 1e-300)
                return float(np.sum(np.log(s) + p / s))

        return of

    best = lambda shape, starts: min((nelder_mead(loss(shape), v) for v in starts), key=lambda r: r[1])
    one = best(s1, [[scale + 1, u, scale - 1] for u in (0.3, 1.2, 2.5)])
    two = best(s2, [[scale + 1, u, scale, v, scale - 1] for u, v in ((0.3, 2.5), (1.0, 4.0), (0.3, 4.5))])
    pw = best(sp, [[scale - 1, k, scale - 2] for k in (0.3, 0.8, 1.5)])
    aic = lambda r, k: 2 * r[1] + 2 * k
    short, long = sorted((math.exp(two[0][1]), math.exp(two[0][3])))
    return {"length_one": math.exp(one[0][1]), "length_short": short, "length_long": long, "aic_one": aic(one, 3), "aic_two": aic(two, 5), "aic_power": aic(pw, 3)}


def per_group(df: DataFrame, by: Sequence[str], columns: Sequence[str], fn: Callable, names: Sequence[str]) -> DataFrame:
    """``fn(*columns)`` of every group, as columns ``names``, nulls where it fails, and ``failure``, the reason.  For
    profiles and spectra: a group is one short curve."""
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by], *[f"`{n}` double" for n in names], "failure string"])

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.dropna(subset=list(columns)).sort_values(list(columns)[0])
        try:
            got = fn(*[f[c].to_numpy(float) for c in columns])
            values, why = [float(got[n]) for n in names], None
        except Exception as e:
            values, why = [None] * len(names), f"{type(e).__name__}: {e}"[:200]
        return pd.DataFrame([[*key, *values, why]], columns=[*by, *names, "failure"])

    return df.select(*[q(c) for c in by], *[q(c) for c in columns]).groupBy(*[q(c) for c in by]).applyInPandas(run, schema)


