"""Binning expressions with the closure and tie rules that analyses of ordered signals rely on."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.session import colname, q


def interval_labels(edges: Sequence[float], right: bool = True) -> list[str]:
    ends = zip(edges[:-1], edges[1:])
    return [f"({a}, {b}]" if right else f"[{a}, {b})" for a, b in ends]


def cut(x: Column, edges: Sequence[float], labels: Sequence[str] | None = None, *, right: bool = True, lowest: bool = False) -> Column:
    """The label of the interval that holds ``x``: right-closed by default, left-closed with ``right=False``
    (as a digitiser).  ``lowest`` closes the first interval on the left as well.  Null, NaN and values
    outside get null.  Edges must ascend."""
    if any(not a < b for a, b in zip(edges[:-1], edges[1:])):
        raise ValueError("edges must ascend")
    labels = labels or interval_labels(edges, right)
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval")
    out = None
    for k, label in enumerate(labels):
        a, b = F.lit(float(edges[k])), F.lit(float(edges[k + 1]))
        over = (x >= a) if not right or (lowest and k == 0) else (x > a)
        inside = over & ((x <= b) if right else (x < b))
        out = F.when(inside & ~F.isnan(x.cast("double")), F.lit(label)) if out is None else out.when(inside & ~F.isnan(x.cast("double")), F.lit(label))
    return out


def log_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """Left-closed bin number, 0 to bins - 1, of ``bins`` equal steps of log10 from ``low`` to ``high``;
    null outside."""
    step = (math.log10(high) - math.log10(low)) / bins
    k = F.floor((F.log10(x) - F.lit(math.log10(low))) / F.lit(step)).cast("int")
    return F.when((x > 0) & (k >= 0) & (k < bins), k)


def quantile_edges(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., edges): the exact, linearly interpolated quantiles 0, 1/bins, .. 1.  Exact percentiles merge
    value counts map-side, so what moves is bounded by the distinct values of a group."""
    points = F.array(*[F.lit(k / bins) for k in range(bins + 1)])
    return df.groupBy(*[q(c) for c in by]).agg(F.percentile(q(value), points).alias("edges"))


def qcut(df: DataFrame, value: str, bins: int, by: Sequence[str] = (), out: str = "bin", drop_duplicates: bool = False) -> DataFrame:
    """``df`` with ``out``: the quantile bin, from 0, right-closed with the lowest value included.  Tied
    values share a bin, so bins may be uneven; equal edges are an error of the caller's data unless
    ``drop_duplicates`` merges them.  Null values get a null bin."""
    edges = quantile_edges(df, value, bins, by)
    name = colname(df.columns, base="_edges")
    edges = edges.withColumnRenamed("edges", name)
    if drop_duplicates:
        edges = edges.withColumn(name, F.array_distinct(name))
    joined = df.join(edges, list(by), "left") if by else df.crossJoin(F.broadcast(edges))  # one row
    inner = F.slice(F.col(name), 2, F.greatest(F.size(name) - 2, F.lit(0)))
    return joined.withColumn(out, F.when(q(value).isNotNull(), F.size(F.filter(inner, lambda e: e < q(value))))).drop(name)


def orientation(first: Column, second: Column, plus: Sequence[str] = ("+", "1")) -> Column:
    """tandem if the strands are equal, divergent for (-, +), else convergent; null if either is null."""
    a, b = first.isin(*plus), second.isin(*plus)
    return F.when(a == b, F.lit("tandem")).when(~a & b, F.lit("divergent")).when(a & ~b, F.lit("convergent"))


def safe_div(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null for constant input."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return safe_div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
