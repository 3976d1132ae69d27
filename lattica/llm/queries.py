"""Queries of the training-data problems, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import digests, leakage, packing, pii, splits
from lattica.session import table, written

# ------------------------------------------------------------------------------------------ problem 1
SHARES = {"test": 0.1, "validation": 0.1}


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sample_attr").select("row_id", "sample_id")
    links = table(spark, d, "donor_link").where("link_kind = 're_enrolled'").select(splits.donor(F.col("donor_a")).alias("a"), splits.donor(F.col("donor_b")).alias("b"))
    return splits.grouped(rows, splits.donor(F.col("sample_id")), links, "a", "b")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.first_of_group(_grouped(spark, d), "row_id")


def _group_splits(rows: DataFrame) -> DataFrame:
    return splits.assign_splits(rows.groupBy(splits.own_group("row_id").alias("group")).agg(F.count("*").alias("size")), SHARES)


def p1_group_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every group with its rows and its split.  Rows without a donor form groups of their own."""
    return _group_splits(_grouped(spark, d))


def p1_record_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its split."""
    rows = written(_grouped(spark, d), "grouped")
    return splits.record_splits(rows, "row_id", _group_splits(rows))


def p1_split_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per split its rows, from the rows' own splits, and the groups that have rows in several splits."""
    rows = written(_grouped(spark, d), "grouped")
    placed = written(splits.record_splits(rows, "row_id", _group_splits(rows)), "placed")
    own = placed.join(rows.select("row_id", splits.own_group("row_id").alias("group")), "row_id").groupBy("group", "split").agg(F.count("*").alias("n"))
    parted = own.groupBy("group").agg(F.count("*").alias("splits")).agg(F.count_if(F.col("splits") > 1).alias("parted_groups"))
    return own.groupBy("split").agg(F.sum("n").alias("n_rows")).crossJoin(F.broadcast(parted))  # one row


# ------------------------------------------------------------------------------------------ problem 2
BY, FIELDS = ["cell", "chr", "map_day"], ["oe", "tss_distance", "r"]


def _named(results: DataFrame, by: list[str]) -> DataFrame:
    cols = [F.element_at("estimates", i + 1).alias(f"p{round(100 * x):02d}") for i, x in enumerate(digests.QS)]
    return results.select(*by, F.col("field").alias("field_name"), "n", *cols, "rank_error")


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    _, results = digests.percentiles(table(spark, d, "contact").select(*BY, *FIELDS), BY, FIELDS)
    return _named(results, BY)


def p2_whole_from_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per cell put together from the digests of cell, chromosome and day, without the rows;
    the rank error is then counted over the rows."""
    df = table(spark, d, "contact").select(*BY, *FIELDS)
    days = written(digests.digest(df, BY, FIELDS), "days")
    whole = written(digests.estimates(digests.merge(days, ["cell"], FIELDS), ["cell"], FIELDS), "whole")
    return _named(digests.certify(df, whole, ["cell"], FIELDS), ["cell"])


def p2_whole_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Whether the percentiles put together from days keep twice the bound of a single digest, with the exact
    number of values of each cell."""
    return p2_whole_from_days(spark, d).select("cell", "field_name", "n", (F.col("rank_error") <= 2 * digests.BOUND).alias("within"))


# ------------------------------------------------------------------------------------------ problem 7


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    placed, _ = packing.pack(table(spark, d, "documents").select("doc_id", "text"))
    return placed


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, those fixed by dominance, the least any packing needs, and the share filled."""
    _, summary = packing.pack(table(spark, d, "documents").select("doc_id", "text"))
    return summary.withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))


def p7_rules(spark: SparkSession, d: str) -> DataFrame:
    """Texts placed, containers above their capacity, texts within it that are parted, texts of tokens without a
    container, and whether the containers' numbers have gaps."""
    placed = written(packing.pack(table(spark, d, "documents").select("doc_id", "text"))[0], "placed")
    per_text = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.count_if(F.col("container_id").isNull() & (F.col("n_tokens") > 0)).alias("lost"))
    texts = per_text.agg(F.count("*").alias("texts"), F.count_if((F.col("n") <= packing.CAPACITY) & (F.col("pieces") > 1)).alias("parted"), F.coalesce(F.sum("lost"), F.lit(0)).alias("lost"))
    full = placed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    whole = full.agg(F.count_if(F.col("n") > packing.CAPACITY).alias("above"), (F.coalesce(F.max("container_id"), F.lit(-1)) + 1 - F.count("*")).alias("gaps"))
    return texts.crossJoin(F.broadcast(whole))  # one row each


# ------------------------------------------------------------------------------------------ problem 8


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every leak with the passage's words, those covered and those equal."""
    return leakage.find_leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_item"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


# ------------------------------------------------------------------------------------------ problem 9


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pii.find_pii(docs, pii.corpus_lexicon(docs))


def p9_sanitised(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pii.sanitise(docs, pii.corpus_lexicon(docs))


def p9_disclosure(spark: SparkSession, d: str) -> DataFrame:
    """The terms that tell protected entities, with their counts and disclosure."""
    return pii.disclosure(table(spark, d, "documents").select("text"))


def p9_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The shapes of numbers and the street words, with how often names stand near them, and their disclosure."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pii.shapes(written(pii.candidates(docs, pii.corpus_lexicon(docs)), "candidates"))


QUERIES = {f.__name__: f for f in (p1_found, p1_group_splits, p1_record_splits, p1_split_totals, p2_percentiles, p2_whole_from_days, p2_whole_within_bound, p7_containers, p7_fill, p7_rules, p8_found, p8_leaks, p9_found, p9_sanitised, p9_disclosure, p9_shapes)}

_DONOR = "array_to_string((string_split(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-'), '-'))[1:2], '-')"

_LONG = " UNION ALL ".join(f"SELECT cell, chr, map_day, '{f}' AS field_name, cast({f} AS double) AS x FROM contact" for f in ("oe", "tss_distance", "r"))
_AT = "least(greatest({q} * (n - 1) - n_low, 0), len(v) - 1)"
_VALUE = (
    "CASE WHEN {q} * (n - 1) - n_low < -0.5 THEN '-inf'::double WHEN {q} * (n - 1) - n_low > len(v) - 0.5 THEN 'inf'::double "
    f"ELSE v[cast(floor({_AT}) AS bigint) + 1] + (v[least(cast(floor({_AT}) AS bigint) + 2, len(v))] - v[cast(floor({_AT}) AS bigint) + 1]) * ({_AT} - floor({_AT})) END AS p{{name}}"
)
SQL = {
    "p1_found": f"""
  WITH RECURSIVE l AS (SELECT {_DONOR.format("donor_a")} AS a, {_DONOR.format("donor_b")} AS b FROM donor_link WHERE link_kind = 're_enrolled'),
  e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  reach(n, m) AS (SELECT a, a FROM e UNION SELECT reach.n, e.b FROM reach JOIN e ON e.a = reach.m),
  root AS (SELECT n, min(m) AS r FROM reach GROUP BY n),
  s AS (SELECT row_id, {_DONOR.format("sample_id")} AS d FROM sample_attr WHERE sample_id IS NOT NULL),
  g AS (SELECT row_id, min(row_id) OVER (PARTITION BY coalesce(r, d)) AS first_row_id FROM s LEFT JOIN root ON root.n = s.d)
  SELECT first_row_id, row_id FROM g WHERE row_id <> first_row_id""",
    # a digest keeps all values of a group of at most digests.DELTA / 2: at this size, of every group
    "p2_percentiles": f"""
  WITH g AS (SELECT cell, chr, map_day, field_name, count(*) AS n, count(*) FILTER (x = '-inf'::double) AS n_low, list_sort(coalesce(list(x) FILTER (isfinite(x)), [])) AS v
    FROM ({_LONG}) l WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY cell, chr, map_day, field_name)
  SELECT cell, chr, map_day, field_name, n, {", ".join(_VALUE.format(q=f"{x}::double", name=f"{round(100 * x):02d}") for x in digests.QS)}, 0.0::double AS rank_error FROM g""",
    "p2_whole_within_bound": f"""
  SELECT cell, field_name, count(*) AS n, true AS within FROM ({_LONG}) l WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY cell, field_name""",
    # with so many small groups every total is met exactly, and no group has rows in two splits
    "p1_split_totals": """
  WITH n AS (SELECT count(*) AS n, cast(floor(0.1 * count(*) + 0.5) AS bigint) AS part FROM sample_attr)
  SELECT split, CASE split WHEN 'train' THEN n - 2 * part ELSE part END AS n_rows, cast(0 AS bigint) AS parted_groups FROM n, (VALUES ('test'), ('validation'), ('train')) s(split)""",
    "p7_rules": "SELECT count(*) AS texts, cast(0 AS bigint) AS parted, cast(0 AS bigint) AS lost, cast(0 AS bigint) AS above, cast(0 AS bigint) AS gaps FROM documents",
}
