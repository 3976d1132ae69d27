"""Column-level data quality profile (problem 5).

Every field of a table is unpivoted to (group, field, value) and counted once: the *value counts*.  All
that follows is exact and comes from those counts, which are never more than the cells, and far fewer
unless values are unique: null rates, distinct counts, ranges, medians, violations, the most frequent
value, and the comparison of loads by the population stability index and chi-square.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.skew import join_keys, lookup, numbered
from lattica.session import q, small_enough, written


@dataclass(frozen=True)
class FieldRule:
    """What counts as valid: a closed range for numbers (NaN is never valid), or a pattern that the
    whole stored text must match; without either, any value.  ``low_median``/``high_median`` bound a
    load's median as a share of the table's; ``top_share`` bounds the share of one value among a load's
    valid values.  ``number`` tells whether values count as numbers (dates and times in seconds since
    1970), by default those without a pattern."""

    name: str
    low: float | None = None
    high: float | None = None
    pattern: str | None = None
    null_rate: float | None = None
    low_median: float | None = None
    high_median: float | None = None
    top_share: float | None = None
    number: bool | None = None

    @property
    def numeric(self) -> bool:
        return self.pattern is None if self.number is None else self.number

    def valid(self, value: Column | None = None) -> Column:
        """True, false, or null for a null value."""
        value = q(self.name) if value is None else value
        if self.pattern is not None:
            return value.rlike(rf"\A(?:{self.pattern})\z")
        if not self.numeric:
            return F.when(value.isNotNull(), True)
        number = value.cast("double")
        ok = ~F.isnan(number)
        ok = ok if self.low is None else ok & (number >= self.low)
        ok = ok if self.high is None else ok & (number <= self.high)
        return F.when(number.isNotNull(), ok)


def rules_of(df: DataFrame, rules: Sequence[FieldRule], group: str) -> list[FieldRule]:
    """A rule for every column of ``df`` but ``group``: those given, and for the others one that takes any
    value."""
    given = {r.name: r for r in rules}
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp")
    return [given.get(name) or FieldRule(name, number=kind.startswith(numbers)) for name, kind in df.dtypes if name != group]


def _number(df: DataFrame, name: str) -> Column:
    """A column as a double; dates and times as seconds."""
    kind = dict(df.dtypes)[name]
    return (q(name).cast("timestamp") if kind.startswith(("date", "timestamp")) else q(name)).cast("double")


def value_counts(df: DataFrame, rules: Sequence[FieldRule], group: str) -> DataFrame:
    """(group, field, text, number, valid, n): each value of each field with its frequency, nulls too.
    One scan, one shuffle of map-side counts."""
    cells = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("field"),
                q(r.name).cast("string").alias("text"),
                (_number(df, r.name) if r.numeric else F.lit(None).cast("double")).alias("number"),
                r.valid(_number(df, r.name) if r.numeric else None).alias("valid"),
            )
            for r in rules
        ]
    )
    return df.select(q(group).alias("group_key"), F.explode(cells).alias("c")).select("group_key", "c.*").groupBy("group_key", "field", "text", "number", "valid").agg(F.count("*").alias("n"))


def weighted_median(counts: DataFrame, by: Sequence[str], edges: int = 64) -> DataFrame:
    """The exact median (mean of the two middle values for even counts) per group of ``by`` from rows
    ``(by, number, n)`` with distinct numbers.  Values are first cut at approximate quantiles of all
    groups, so that no task sorts more than the cell that holds the middle; a cell is a 1/``edges``
    share of the distinct values."""
    field = [c for c in by if c == "field"]
    cuts = counts.groupBy(*field).agg(F.percentile_approx("number", [i / edges for i in range(1, edges)], 20000).alias("_cuts"))
    placed = counts.join(F.broadcast(cuts), field) if field else counts.crossJoin(F.broadcast(cuts))
    placed = placed.withColumn("_cell", F.size(F.filter("_cuts", lambda e: e < F.col("number")))).drop("_cuts")
    cells = placed.groupBy(*by, "_cell").agg(F.sum("n").alias("_in"))
    up = Window.partitionBy(*by).orderBy("_cell")
    cells = cells.withColumn("_upto", F.sum("_in").over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_in").over(Window.partitionBy(*by)))
    lo, hi = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)  # places, from 0, of the middle values
    start = F.col("_upto") - F.col("_in")
    wanted = cells.where((hi >= start) & (lo < F.col("_upto"))).select(*by, "_cell", start.alias("_start"), lo.alias("_lo"), hi.alias("_hi"))
    inside = placed.join(wanted, [*by, "_cell"])
    along = Window.partitionBy(*by, "_cell").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_to", F.sum("n").over(along) + F.col("_start")).withColumn("_from", F.col("_to") - F.col("n"))
    at = lambda place: F.min(F.when((F.col("_from") <= place) & (place < F.col("_to")), F.col("number")))
    return inside.groupBy(*by).agg(((at(F.col("_lo")) + at(F.col("_hi"))) / 2).alias("median"))


def profile(counts: DataFrame, by: Sequence[str] = ("group_key", "field")) -> DataFrame:
    """Per group and field: rows, nulls and their rate, distinct values, range (of numbers, else of
    texts), invalid values, median and most frequent of the valid values (ties: the smaller text).
    ``counts`` should be written, as it is read several times.  No rows in, none out."""
    by = list(by)
    if by != ["group_key", "field"]:
        counts = counts.groupBy(*by, "text", "number", "valid").agg(F.sum("n").alias("n"))
    ok = F.col("valid")
    base = counts.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("text").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.count("text").alias("n_distinct"),
        F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("n_invalid"),
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("n_valid"),
        F.min(F.when(ok, F.col("number"))).alias("min_number"),
        F.max(F.when(ok, F.col("number"))).alias("max_number"),
        F.min("text").alias("min_text"),
        F.max("text").alias("max_text"),
        F.max(F.when(ok, F.col("n"))).alias("top_n"),
    )
    tops = counts.where(ok).groupBy(*by, "n").agg(F.min("text").alias("top_value"))
    base = base.join(tops.withColumnRenamed("n", "top_n"), [*by, "top_n"], "left")
    middle = weighted_median(counts.where(ok & F.col("number").isNotNull()).groupBy(*by, "number").agg(F.sum("n").alias("n")), by)
    return base.withColumn("null_rate", F.col("n_null") / F.col("n_rows")).join(middle, by, "left")


def departures(counts: DataFrame, rules: Sequence[FieldRule]) -> DataFrame:
    """(group_key, field, null_rate, median, table_median, top_share, reasons): the loads that depart
    from the rest by the rules' bounds.  A load without valid values departs only by its null rate."""
    loads = profile(counts)
    whole = profile(counts, ["field"]).select("field", F.col("median").alias("table_median"))
    rows = loads.join(F.broadcast(whole), "field").withColumn("top_share", F.col("top_n") / F.when(F.col("n_valid") > 0, F.col("n_valid")))
    reasons = []
    for r in rules:
        mine = F.col("field") == r.name
        if r.null_rate is not None:
            reasons.append(F.when(mine & (F.col("null_rate") >= r.null_rate), F.lit("null_rate")))
        if r.low_median is not None:
            reasons.append(F.when(mine & (F.col("median") < F.col("table_median") * r.low_median), F.lit("low_median")))
        if r.high_median is not None:
            reasons.append(F.when(mine & (F.col("median") > F.col("table_median") * r.high_median), F.lit("high_median")))
        if r.top_share is not None:
            reasons.append(F.when(mine & (F.col("top_share") > r.top_share), F.lit("one_value")))
    found = rows.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return found.where(F.size("reasons") > 0).select("group_key", "field", "null_rate", "median", "table_median", "top_share", "reasons")


def invalid_rows(df: DataFrame, counts: DataFrame, rules: Sequence[FieldRule], row_id: str) -> DataFrame:
    """(key_id, field_name): every cell that is neither null nor valid, with its row's id.  The written value counts
    tell which values of a field are invalid; rows that hold one are found by its text, by broadcast if the
    invalid values are counted small, else by a join in which frequent ones are salted."""
    bad = written(counts.where(~F.col("valid")).select("field", "text").distinct().withColumn("bad", F.lit(True)), "invalid")
    cells = F.array(*[F.struct(F.lit(r.name).alias("field"), q(r.name).cast("string").alias("text")) for r in rules])
    held = df.select(q(row_id).alias("key_id"), F.explode(cells).alias("c")).where("c.text IS NOT NULL").select("key_id", "c.*")
    return lookup(held, bad, ["field", "text"], "inner").select("key_id", F.col("field").alias("field_name"))


def quantile_cuts(values: DataFrame, by: str, value: str, parts: int) -> DataFrame:
    """(by, cuts): per group of ``by`` the values, among its distinct ones, at the places 1/parts, 2/parts .. of their
    order (the first value that has at least that share up to it).  Exact; values are numbered in ordered blocks, so no
    group is sorted in one task."""
    place = numbered(values, [by], [value], "_place")
    sized = place.join(F.broadcast(place.groupBy(by).agg(F.max("_place").alias("_last"))), by)
    n = F.col("_last") + 1
    wanted = F.array(*[F.floor((F.lit(i) * n + parts - 1) / parts) - 1 for i in range(1, parts)])
    return sized.where(F.array_contains(wanted, F.col("_place"))).groupBy(by).agg(F.sort_array(F.collect_set(value)).alias("cuts"))  # at most ``parts`` - 1


def drift(counts: DataFrame, rules: Sequence[FieldRule], bins: int = 10, least: float = 1e-4) -> DataFrame:
    """Per load and field, null loads too: ``load_n`` valid values in ``cells`` cells, and their population stability
    index and chi-square against all other loads.  Numbers fall into ``bins`` cells at the quantiles of the table's
    distinct values, texts stand for themselves; shares below ``least`` count as ``least`` in the index.  Cells that a
    load lacks count in both figures; ``psi_present`` is the index without them.  A load without valid values
    has ``load_n`` 0 and no figures."""
    keys = ["group_key", "field"]
    numeric = [r.name for r in rules if r.numeric]
    ok = counts.where("valid")
    cuts = quantile_cuts(ok.where(F.col("field").isin(numeric)).select("field", "number").distinct(), "field", "number", bins)
    cell = F.when(F.col("cuts").isNotNull(), F.size(F.filter("cuts", lambda e: e < F.col("number"))).cast("string")).otherwise(F.col("text"))
    binned = ok.join(F.broadcast(cuts), "field", "left").withColumn("cell", cell).groupBy(*keys, "cell").agg(F.sum("n").alias("n"))
    totals = written(counts.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("valid"), F.col("n"))), F.lit(0)).alias("load_n")), "totals")
    cells = binned.groupBy("field", "cell").agg(F.sum("n").alias("cell_n"))
    whole = totals.groupBy("field").agg(F.sum("load_n").alias("all_n"), F.max("load_n").alias("_most"))
    loads = totals.join(F.broadcast(whole.drop("_most")), "field").withColumn("rest_n", F.col("all_n") - F.col("load_n"))
    grid = join_keys(binned.join(cells, ["field", "cell"]), loads, keys)
    others = F.when(F.col("rest_n") > 0, F.col("rest_n"))
    here = F.greatest(F.col("n") / F.col("load_n"), F.lit(least))
    rest = F.greatest((F.col("cell_n") - F.col("n")) / others, F.lit(least))
    expected = F.col("cell_n") * F.col("load_n") / F.col("all_n")
    # a cell that a load lacks adds to the index if the others' share is above ``least``: 1 / least cells of a load at most
    share = F.col("cell_n") / others
    could_lack = (F.col("cell_n") > least * F.col("rest_n")) & (F.col("cell_n") <= F.col("rest_n"))
    lacked = F.sum(F.when(could_lack, (least - share) * F.log(least / share)))
    present = grid.groupBy(*keys).agg(
        F.sum((here - rest) * F.log(here / rest)).alias("psi_present"),
        F.sum((F.col("n") - expected) ** 2 / expected).alias("_chi"),
        F.sum(expected).alias("_exp"),
        F.count("*").alias("cells"),
        lacked.alias("_held"),
    )
    frequent = cells.join(F.broadcast(whole), "field").where(F.col("cell_n") > least * (F.col("all_n") - F.col("_most"))).select("field", "cell_n")
    side, _ = small_enough(loads, counted=totals)
    every = frequent.join(side, "field").where(could_lack).groupBy(*keys).agg(lacked.alias("_every"))
    found = join_keys(join_keys(totals, present, keys, "left"), every, keys, "left")
    absent = F.greatest(F.coalesce("_every", F.lit(0.0)) - F.coalesce("_held", F.lit(0.0)), F.lit(0.0))
    # expected counts of absent cells sum to load_n minus those of present ones, each adding its expectation to chi-square
    chi = F.col("_chi") + F.col("load_n") - F.col("_exp")
    return found.select(*keys, "load_n", F.coalesce("cells", F.lit(0)).alias("cells"), (F.col("psi_present") + absent).alias("psi"), "psi_present", chi.alias("chi_square"))


def drifted_profile(df: DataFrame, rules: Sequence[FieldRule], group: str) -> tuple[DataFrame, DataFrame]:
    """(written value counts, departures) of a table."""
    counts = written(value_counts(df, rules, group), "value_counts")
    return counts, departures(counts, rules)
