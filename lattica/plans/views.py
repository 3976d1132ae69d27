"""The project's tables as the shapes that operators take, and the same views in SQL for the twins.

``signal``  unit, sample, part, rank, value   counts of ``expr_signal``: nulls and negative counts out,
                                              spellings of a sample joined, repeated rows averaged
``matrix``  unit, sample, part, rank, value   ``embeddings``: label, vector, quarter and place
``genes``   one row per gene id (the first by row id) with part, start, end, strand, gc, name, biotype
``pairs``   rows of ``contact`` with canonical genes and positive distance
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.keys import canonical_gene, canonical_key
from lattica.operators.signal import keep_first
from lattica.session import table


def signal(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "expr_signal").where("expr_value >= 0 AND sample_id IS NOT NULL AND NOT isnan(expr_value)")
    return rows.groupBy("unit", canonical_key(F.col("sample_id")).alias("sample"), F.col("chr").alias("part"), F.col("gene_rank").alias("rank")).agg(F.avg("expr_value").alias("value"))


def matrix(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("j", "x"))
    return v.select(F.col("label").alias("unit"), F.col("vec_id").alias("sample"), F.floor(F.col("j") / 16).cast("int").alias("part"), (F.col("j") % 16).cast("int").alias("rank"), F.col("x").cast("double").alias("value"))


def genes(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gene").select("row_id", canonical_gene(F.col("gene_id")).alias("gene"), F.col("chr").alias("part"), F.col("gene_start").alias("start"), F.col("gene_end").alias("end"), "strand", "gene_name", "biotype", "gc")
    return keep_first(g, ["gene"], ["row_id"])


def pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "contact").where("tss_distance > 0")
    clean = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.col(x))
    return c.select("row_id", F.col("cell").alias("unit"), canonical_gene(F.col("g1")).alias("g1"), canonical_gene(F.col("g2")).alias("g2"), F.col("chr").alias("part"), "tss_distance", "contact_kr", "bin_distance", "expected_kr", clean("oe").alias("oe"), clean("r").alias("r"), "map_day")


KEY = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-')"
GENE = "trim(regexp_replace(lower(regexp_replace(trim({0}), '\\.[0-9]+\\s*$', '')), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-')"
SIGNAL = f"""signal AS (SELECT unit, {KEY.format("sample_id")} AS sample, chr AS part, gene_rank AS rank, avg(expr_value) AS value FROM expr_signal
  WHERE expr_value >= 0 AND sample_id IS NOT NULL AND NOT isnan(expr_value) GROUP BY 1, 2, 3, 4)"""
MATRIX = """matrix AS (SELECT label AS unit, vec_id AS sample, cast(floor(j / 16) AS int) AS part, j % 16 AS rank, x AS value FROM
  (SELECT label, vec_id, cast(unnest(range(0, 64)) AS int) AS j, cast(unnest(embedding) AS double) AS x FROM embeddings) e)"""
GENES = f"""genes AS (SELECT gene, part, start, "end", strand, gene_name, biotype, gc FROM (SELECT row_id, {GENE.format("gene_id")} AS gene, chr AS part, gene_start AS start,
  gene_end AS "end", strand, gene_name, biotype, gc, row_number() OVER (PARTITION BY {GENE.format("gene_id")} ORDER BY row_id) AS rn FROM gene) g WHERE rn = 1)"""
PAIRS = f"""pairs AS (SELECT row_id, cell AS unit, {GENE.format("g1")} AS g1, {GENE.format("g2")} AS g2, chr AS part, tss_distance, contact_kr, bin_distance, expected_kr,
  CASE WHEN NOT isnan(oe) AND NOT isinf(oe) THEN oe END AS oe, CASE WHEN NOT isnan(r) AND NOT isinf(r) THEN r END AS r, map_day FROM contact WHERE tss_distance > 0)"""
