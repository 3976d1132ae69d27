"""Joins and running states under a key that holds nearly all rows."""

import pytest
from pyspark.sql import functions as F

from lattica.operators import interval, ranks, skew


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup(spark, limit, how):
    left = spark.range(500).select("id", F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, F.col("id").cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("8", 2), ("never", 3)], "k string, v int")
    got = {r.id: r.v for r in skew.lookup(left, right, ["k"], how, limit).collect()}
    want = {r.id: {"hot": 1, "8": 2}.get(r.k) for r in left.collect()}
    assert got == (want if how == "left" else {k: v for k, v in want.items() if v is not None})


def test_states_are_carried_over_blocks(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1900, "hot").otherwise("cold").alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 700 == 3, F.col("id")).alias("v"))
    b = skew.ordered_blocks(df, ["k"], ["t"])
    assert b.where("k = 'hot'").select("_block").distinct().count() > 1
    got = {r.t: (r.last, r.total) for r in skew.carried_sum(skew.carried_last(b, ["k"], [F.col("t")], "v", "last").withColumn("one", F.lit(1)), ["k"], [F.col("t")], "one", "total").collect()}
    for t in (0, 2, 3, 699, 703, 1402, 1403, 1899, 1900, 1999):
        seen = [v for v in (3, 703, 1403) if v <= t and t < 1900]
        assert got[t] == (seen[-1] if seen else None, t + 1 if t < 1900 else t - 1899)


def test_as_of_under_one_key(spark):
    p = spark.range(1000).select(F.lit("x").alias("k"), F.col("id").alias("p"))
    e = spark.createDataFrame([("x", 10, "a"), ("x", 500, "b"), ("x", 500, "c"), ("y", 0, "z")], "k string, s long, v string")
    got = {r.p: r.v for r in interval.as_of(p, e, ["k"], "p", "s", ["v"]).collect()}
    assert (got[9], got[10], got[499], got[500], got[999]) == (None, "a", "a", "c", "c")


def test_equal_rows_and_null_keys_are_spread(spark):
    left = spark.range(4000).select(F.when(F.col("id") < 2000, F.lit(None).cast("string")).when(F.col("id") < 3800, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit(1).alias("v"))
    right = spark.createDataFrame([(None, 1), ("hot", 2)], "k2 string, w int")
    a, b, slot = skew.salted(left, right, ["k"], ["k2"], "_t")
    salts = {(r.k, r.n) for r in a.where("k IS NULL OR k = 'hot'").groupBy("k").agg(F.count_distinct(f"{slot}l").alias("n")).collect()}
    assert all(n > 1 for _, n in salts) and len(salts) == 2
    got = skew.lookup(left, right.withColumnRenamed("k2", "k"), ["k"], "inner", 0, True).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {None: 2000, "hot": 1800}


@pytest.mark.parametrize("most", [500_000, 0])
def test_ranks_of_few_and_of_many_values(spark, monkeypatch, most):
    monkeypatch.setattr(ranks, "MOST_SORTED", most)
    rows = [("g", float(i % 37) if i % 11 else None, i) for i in range(900)] + [("h", 1.0, 900), ("h", float("nan"), 901), (None, 2.0, 902)]
    df = spark.createDataFrame(rows, "g string, x double, id long")
    got = {r.id: r["rank"] for r in ranks.average_rank(df, "x", ["g"]).collect()}
    known = sorted(x for g, x, _ in rows if g == "g" and x is not None)
    for g, x, i in rows:
        if g == "g":
            want = None if x is None else known.index(x) + (known.count(x) + 1) / 2
            assert got[i] == want
    assert got[900] == 1 and got[901] is None and got[902] == 1


def test_states_of_a_null_key_are_carried_too(spark):
    df = spark.range(1500).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("t"), F.when(F.col("id") == 3, 7).alias("v"), F.lit(1).alias("one"))
    b = skew.ordered_blocks(df, ["k"], ["t"])
    got = {r.t: (r.last, r.total) for r in skew.carried_sum(skew.carried_last(b, ["k"], [F.col("t")], "v", "last"), ["k"], [F.col("t")], "one", "total").collect()}
    assert len(got) == 1500 and got[2] == (None, 3) and got[1499] == (7, 1500)
