"""Percentiles of very large numeric columns (problem 2).

A digest of a group holds, per field, centroids (mean, weight) in order of value.  Values are sorted and
clustered so that the k-th cluster spans one unit of the size function
``k(q) = delta / pi * asin(2q - 1)``: clusters at the median hold up to ``pi / (2 delta)`` of the rows, those
at the ends single values.  A group of no more values than the scale has units keeps them all.  Digests of
parts or days merge by sorting their centroids together and clustering again.  A second pass over the rows
counts, for every estimate, the rows below and at it, which certifies its rank error; groups beyond the
stated bound are digested again with a larger ``delta``, and if none of these suffices the call fails.

NaN and null are no values and are counted apart.  Infinite values count at their end of the order but
enter no mean.  Group keys may be null and then form a group like any other.

A table of digests has the group's columns and one struct per field: ``odd`` (counts of -inf, inf, NaN and
null; null if all are 0), ``mean``, ``weight`` (null if every centroid is one value) and ``ends`` (least and
greatest value; null if every centroid is one value).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.skew import lookup, matches
from lattica.session import colname, q, small_enough, written

DELTA, BOUND = 200, 0.01
QS = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Values or centroids held by a task before it clusters what it has; bounds its memory whatever the groups' sizes.
FLUSH_ROWS = 400_000
#: Tasks whose digests of one group are joined by one task; with more tasks groups are first joined in parts.
JOINED = 64
#: Rounds of digests, each four times finer, before a bound counts as out of reach.
ROUNDS = 6

_ODD = ("n_low", "n_high", "n_nan", "n_null")
_SQL = "struct<odd: array<bigint>, mean: array<double>, weight: array<double>, ends: array<double>>"
_LONGS, _DOUBLES = pa.list_(pa.int64()), pa.list_(pa.float64())


def cluster(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids (group, mean, weight) of many groups at once, in order of value.  ``group`` holds integer
    codes.  The cluster of a centroid is where the middle of its weight falls on the size function's scale."""
    order = np.lexsort((mean, group))
    group, mean, weight = group[order], mean[order], weight[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    if not (size > delta / 2).any():
        return group, mean, weight
    run = np.repeat(np.arange(len(first)), size)
    total = np.add.reduceat(weight, first)
    upto = np.cumsum(weight)
    before = upto - weight - (upto[first] - weight[first])[run]
    middle = np.clip((before + weight / 2) / total[run], 0, 1)
    scale = np.floor(delta / np.pi * np.arcsin(2 * middle - 1)).astype(np.int64)
    # a group with no more centroids than the scale has units keeps them all
    scale = np.where(size[run] <= delta / 2, np.arange(len(group)), scale)
    cut = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (scale[1:] != scale[:-1])])
    w = np.add.reduceat(weight, cut)
    low, high = mean[cut], mean[np.r_[cut[1:], len(mean)] - 1]
    # equal values keep their value exactly, so that ties are found again when ranks are counted
    return group[cut], np.where(low == high, low, np.add.reduceat(mean * weight, cut) / w), w


def _codes(cols: Sequence[pa.Array], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(code of each row's group from 0, a row of each group); nulls are keys like others."""
    code = np.zeros(n, np.int64)
    for c in cols:
        coded = c.dictionary_encode()
        index = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (len(coded.dictionary) + 1) + index, return_inverse=True)[1]
    _, at, code = np.unique(code, return_index=True, return_inverse=True)
    return code, at


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType, null: np.ndarray | None = None) -> pa.Array:
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    mask = None if null is None else pa.array(null)
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind.value_type), mask=mask)


def _struct(groups: int, group: np.ndarray, mean: np.ndarray, weight: np.ndarray, least: np.ndarray, greatest: np.ndarray, odd: np.ndarray) -> pa.StructArray:
    """The digests of groups 0 .. ``groups`` - 1 from their centroids in order, their ends and odd counts."""
    sizes = np.bincount(group, minlength=groups)
    merged = np.bincount(group, weight != 1, groups) > 0
    none = ~odd.any(axis=1)
    return pa.StructArray.from_arrays(
        [
            _lists(odd[~none].ravel(), np.where(none, 0, len(_ODD)), _LONGS, none),
            _lists(mean, sizes, _DOUBLES),
            _lists(weight[merged[group]], np.where(merged, sizes, 0), _DOUBLES, ~merged),
            _lists(np.column_stack([least, greatest])[merged].ravel(), np.where(merged, 2, 0), _DOUBLES, ~merged),
        ],
        names=["odd", "mean", "weight", "ends"],
    )


def _parts(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, means, weights, least, greatest, odd counts) of a column of digests: centroids flat, the rest
    per row."""
    odd, mean, weight, ends = column.flatten()
    sizes = pc.list_value_length(mean).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    means = mean.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    merged = weight.is_valid().to_numpy(zero_copy_only=False)
    weights = np.ones(len(means))
    weights[np.repeat(merged, sizes)] = weight.flatten().to_numpy(zero_copy_only=False)
    least, greatest = np.full(len(sizes), np.inf), np.full(len(sizes), -np.inf)
    some = sizes > 0
    least[some], greatest[some] = means[first[some]], means[(first + sizes)[some] - 1]
    two = ends.flatten().to_numpy(zero_copy_only=False)
    least[merged], greatest[merged] = two[::2], two[1::2]
    counts = np.zeros((len(sizes), len(_ODD)), np.int64)
    counts[odd.is_valid().to_numpy(zero_copy_only=False)] = odd.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(_ODD))
    return sizes, means, weights, least, greatest, counts


def _from_values(x: pa.Array, code: np.ndarray, groups: int, delta: float) -> pa.StructArray:
    null = x.is_null().to_numpy(zero_copy_only=False)
    v = x.fill_null(0.0).to_numpy(zero_copy_only=False)
    odd = np.column_stack([np.bincount(code, t, groups).astype(np.int64) for t in (v == -np.inf, v == np.inf, np.isnan(v), null)])
    ok = np.isfinite(v) & ~null
    if not ok.any():
        none = np.zeros(0)
        return _struct(groups, np.zeros(0, np.int64), none, none, np.zeros(groups), np.zeros(groups), odd)
    group, mean, weight = cluster(code[ok], v[ok], np.ones(ok.sum()), delta)
    least, greatest = np.full(groups, np.inf), np.full(groups, -np.inf)
    np.minimum.at(least, code[ok], v[ok])
    np.maximum.at(greatest, code[ok], v[ok])
    return _struct(groups, group, mean, weight, least, greatest, odd)


def _from_digests(column: pa.StructArray, code: np.ndarray, groups: int, delta: float) -> pa.StructArray:
    sizes, means, weights, least, greatest, counts = _parts(column)
    odd = np.column_stack([np.bincount(code, counts[:, i], groups).astype(np.int64) for i in range(len(_ODD))])
    low, high = np.full(groups, np.inf), np.full(groups, -np.inf)
    np.minimum.at(low, code, least)
    np.maximum.at(high, code, greatest)
    group, mean, weight = cluster(np.repeat(code, sizes), means, weights, delta) if len(means) else (np.zeros(0, np.int64), means, weights)
    return _struct(groups, group, mean, weight, low, high, odd)


def _table(batches: Sequence[pa.RecordBatch]) -> list[pa.Array]:
    whole = pa.Table.from_batches(batches)
    return [c.combine_chunks() for c in whole.columns]


def _joined(names: Sequence[str], cols: Sequence[pa.Array], keys: int, delta: float, make) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    code, at = _codes(cols[:keys], len(cols[0]))
    rows = pa.array(at)
    return pa.RecordBatch.from_arrays([*[c.take(rows) for c in cols[:keys]], *[make(c, code, len(at), delta) for c in cols[keys:]]], names=list(names)), code, at


def _schema(df: DataFrame, by: Sequence[str], fields: Sequence[str]) -> str:
    return ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by], *[f"`{f}` {_SQL}" for f in fields]])


def digest(df: DataFrame, by: Sequence[str], fields: Sequence[str], delta: float = DELTA, qs: Sequence[float] = ()) -> DataFrame:
    """One digest per group.  Tasks cluster what they read before anything is shuffled; a group that fills many
    tasks arrives as their few centroids.  ``qs`` as for :func:`merge`."""
    keys = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= FLUSH_ROWS:
                yield _joined(b.schema.names, _table(held), keys, delta, _from_values)[0]
                held, n = [], 0
        if n:
            yield _joined(held[0].schema.names, _table(held), keys, delta, _from_values)[0]

    raw = df.select(*[q(c) for c in by], *[q(c).cast("double").alias(c) for c in fields])
    return merge(raw.mapInArrow(run, _schema(df, by, fields)), by, fields, delta, qs)


def merge(digests: DataFrame, by: Sequence[str], fields: Sequence[str], delta: float = DELTA, qs: Sequence[float] = ()) -> DataFrame:
    """Digests of the same groups, from parts, days or finer groups, as one per group of ``by``.  A task sees
    its groups one after another and clusters again whenever it holds enough, so a group of any size needs
    no more memory than others.  With ``qs`` the estimates of every field (:func:`estimates`) come with the digests,
    as columns :func:`found_name`."""
    keys, points = len(by), np.array(qs, float)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, *[_estimate(c, points) for c in b.columns[keys:]]], names=[*b.schema.names, *[found_name(f) for f in b.schema.names[keys:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows + sum(len(b.column(i).field(1).flatten()) for i in range(keys, b.num_columns))
            if n >= FLUSH_ROWS:
                done, code, at = _joined(b.schema.names, _table(held), keys, delta, _from_digests)
                last = int(code[-1])  # may go on in the next batch
                rest = np.delete(np.arange(len(at)), last)
                if len(rest):
                    yield done.take(pa.array(rest))
                held, n = [done.slice(last, 1)], 0
        if held and sum(h.num_rows for h in held):
            yield _joined(held[0].schema.names, _table(held), keys, delta, _from_digests)[0]

    cols = [q(c) for c in by]
    out, schema = digests.select(*cols, *[q(f) for f in fields]), _schema(digests, by, fields)
    tasks = out.rdd.getNumPartitions()
    if tasks > JOINED:  # a group's digests from many tasks are first joined in parts
        part = F.pmod(F.spark_partition_id(), F.lit(-(-tasks // JOINED)))
        out = out.repartition(*cols, part).sortWithinPartitions(*cols).mapInArrow(run, schema)
    out = out.repartition(*cols).sortWithinPartitions(*cols)
    return out.mapInArrow(whole, ", ".join([schema, *[f"`{found_name(f)}` {_FOUND}" for f in fields]])) if qs else out.mapInArrow(run, schema)


def found_name(field: str) -> str:
    """The column of a field's estimates beside its digest."""
    return f"{field} estimates"


_FOUND = "struct<n: bigint, estimates: array<double>>"


def _estimate(column: pa.StructArray, points: np.ndarray) -> pa.StructArray:
    """(n, estimates) of a column of digests, null where there are no values."""
    sizes, means, weights, least, greatest, odd = _parts(column)
    first = np.cumsum(sizes) - sizes
    group = np.repeat(np.arange(len(sizes)), sizes)
    finite = np.bincount(group, weights, len(sizes))
    n = finite + odd[:, 0] + odd[:, 1]
    at = points[None, :] * np.maximum(n - 1, 0)[:, None] - odd[:, :1]
    inside = np.clip(at, 0, np.maximum(finite - 1, 0)[:, None])
    got = np.zeros(at.shape)
    some = sizes > 0
    if some.any():
        k = np.floor(inside[some]).astype(np.int64)
        top = (sizes[some] - 1)[:, None]
        a = means[np.minimum(first[some][:, None] + np.minimum(k, top), len(means) - 1)]
        z = means[np.minimum(first[some][:, None] + np.minimum(k + 1, top), len(means) - 1)]
        got[some] = a + (z - a) * (inside[some] - k)
    for i in np.flatnonzero(finite > sizes):  # centroids of several values
        m, w = means[first[i] : first[i] + sizes[i]], weights[first[i] : first[i] + sizes[i]]
        got[i] = np.interp(inside[i], np.r_[0.0, np.cumsum(w) - w / 2 - 0.5, finite[i] - 1], np.r_[least[i], m, greatest[i]])
    got = np.where(at < -0.5, -np.inf, np.where(at > finite[:, None] - 0.5, np.inf, got))
    return pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), _lists(got.ravel(), np.full(len(n), len(points)), _DOUBLES)], names=["n", "estimates"], mask=pa.array(n == 0))


def estimates(digests: DataFrame, by: Sequence[str], fields: Sequence[str], qs: Sequence[float] = QS) -> DataFrame:
    """Per group and field a struct (n, estimates): the number of values and the value at each ``q`` of ``qs``, by
    interpolation between the middles of neighbouring centroids; among single values, between those
    around the place ``q * (n - 1)``.  Null for a field without values."""
    keys, points = len(by), np.array(qs, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:keys], *[_estimate(b.column(i), points) for i in range(keys, b.num_columns)]], names=b.schema.names)

    schema = ", ".join([*[f"`{c}` {digests.schema[c].dataType.simpleString()}" for c in by], *[f"`{f}` {_FOUND}" for f in fields]])
    return digests.select(*[q(c) for c in by], *[q(f) for f in fields]).mapInArrow(run, schema)


def certify(df: DataFrame, found: DataFrame, by: Sequence[str], fields: Sequence[str], qs: Sequence[float] = QS) -> DataFrame:
    """(by..., field, n, estimates, rank_error) from written ``found`` of :func:`estimates`: per group and field, how
    far ``q * (n - 1)`` at most lies outside the places that an estimate's value has, as a share of n, counted
    over the rows themselves.  The estimates go to the rows by broadcast if counted small, else by a join
    in which large groups are salted; rows return as sums per task and group only."""
    tag = colname(df.columns, found.columns, base="_e")
    flat = [F.element_at(q(f)["estimates"], j + 1).alias(f"{tag}_{i}_{j}") for i, f in enumerate(fields) for j in range(len(qs))]
    rows = df.select(*[q(c) for c in by], *[q(f).cast("double").alias(f) for f in fields])
    seen = lookup(rows, found.select(*[q(c) for c in by], *flat), by, "inner", limit=64 << 20, null_safe=True)
    sums = []
    for i, f in enumerate(fields):
        x = F.when(~F.isnan(q(f)), q(f))
        for j in range(len(qs)):
            e = F.col(f"{tag}_{i}_{j}")
            sums += [F.count_if(x < e).alias(f"{tag}lt_{i}_{j}"), F.count_if(x <= e).alias(f"{tag}le_{i}_{j}")]
    got = seen.groupBy(*[q(c) for c in by]).agg(*sums).withColumnsRenamed({c: f"{tag}k{i}" for i, c in enumerate(by)})
    both = found.join(got, matches(by, [f"{tag}k{i}" for i in range(len(by))]))

    def error(i: int, f: str) -> Column:
        # q stands for the place q * (n - 1) from 0; the estimate's value covers the places lt - 1 .. le
        n = q(f)["n"]
        place = lambda x: F.lit(float(x)) * (n - 1)
        return F.greatest(F.lit(0.0), *[e / n for j, x in enumerate(qs) for e in (F.col(f"{tag}lt_{i}_{j}") - 1 - place(x), place(x) - F.col(f"{tag}le_{i}_{j}"))])

    cells = [F.struct(F.lit(f).alias("field"), q(f)["n"].alias("n"), q(f)["estimates"].alias("estimates"), error(i, f).alias("rank_error")) for i, f in enumerate(fields)]
    long = both.select(*[q(c) for c in by], F.explode(F.array(*cells)).alias(f"{tag}c")).where(F.col(f"{tag}c.n").isNotNull())
    return long.select(*[q(c) for c in by], f"{tag}c.*")


def percentiles(df: DataFrame, by: Sequence[str], fields: Sequence[str], qs: Sequence[float] = QS, bound: float = BOUND, delta: float = DELTA) -> tuple[DataFrame, DataFrame]:
    """(digests, results): results have by..., field, n, estimates and the certified rank_error, at most
    ``bound``.  Groups that miss it are digested again with four times the ``delta``; if any still misses it
    after ROUNDS rounds, ValueError names how many.  Groups without any value of a field have no row for it."""
    made, todo, results, again = None, df, None, None
    for _ in range(ROUNDS):
        both = written(digest(todo, by, fields, delta, qs), "digest")
        made = both.select(*[q(c) for c in by], *[q(f) for f in fields]) if made is None else made
        sure = certify(todo, both.select(*[q(c) for c in by], *[q(found_name(f)).alias(f) for f in fields]), by, fields, qs)
        if again is not None:  # only the fields that missed the bound
            sure = lookup(sure, again, [*by, "field"], "inner", null_safe=True)
        sure = written(sure, "certified")
        good = sure.where(F.col("rank_error") <= bound)
        results = good if results is None else results.unionByName(good)
        bad = sure.where(~(F.col("rank_error") <= bound)).select(*[q(c) for c in by], "field")
        if bad.limit(1).count() == 0:
            return made, results
        again, delta = written(bad, "missed"), delta * 4
        todo = lookup(df.select(*[q(c) for c in by], *[q(f) for f in fields]), written(again.select(*[q(c) for c in by]).distinct(), "missed"), by, "inner", null_safe=True)
    raise ValueError(f"{again.count()} groups and fields miss the rank error of {bound} after {ROUNDS} rounds")
