"""Query catalogue II: joins of pairs, intervals and ranges, regression, resampling, fits and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import bins
from lattica.functions.keys import canonical_gene, canonical_key
from lattica.operators import fit, interval, lag, pairs, ranks, regress, resample, resid, simulate, spectral, store
from lattica.operators import signal as sig
from lattica.plans import views as V
from lattica.plans.catalog import _ADJ, _adjacent, _norm, query, r6
from lattica.session import table, written

# ------------------------------------------------------------------------------------------ pairs

# suppliers stand for genes, parts for variants; a pair is a supplier and the next one of its nation
_SUP = """sp AS (SELECT s_suppkey AS g1, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS g2 FROM supplier), prs AS (SELECT * FROM sp WHERE g2 IS NOT NULL)"""


def _supplier_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "g")
    return lag.adjacent_pairs(s, ["s_nationkey"], ["g"], ["g"]).select("g1", "g2")


_ASSOC = """assoc AS (SELECT l_suppkey AS i, l_partkey AS k, min(sign(l_discount - 0.05)) AS s FROM lineitem GROUP BY 1, 2)"""


@query(
    f"""WITH {_SUP}, {_ASSOC}, m AS (SELECT g1, g2, count(*) AS n_shared, bool_or(a.s = b.s) AS same FROM prs JOIN assoc a ON a.i = g1 JOIN assoc b ON b.i = g2 AND b.k = a.k GROUP BY 1, 2)
  SELECT prs.g1, prs.g2, coalesce(n_shared, 0) AS n_shared, coalesce(n_shared, 0) > 0 AS share_any, coalesce(same, false) AS share_same FROM prs LEFT JOIN m ON m.g1 = prs.g1 AND m.g2 = prs.g2"""
)
def pairs_share_variant(spark, d):
    a = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_discount") - 0.05).alias("slope"))
    return pairs.shared_keys(_supplier_pairs(spark, d), a, "l_suppkey", "l_partkey", "slope")


_SETS = """tot AS (SELECT l_suppkey AS gene, l_returnflag AS cs, sum(l_quantity) AS t FROM lineitem GROUP BY 1, 2),
  sets AS (SELECT l_suppkey AS gene, l_returnflag AS cs, l_partkey AS variant, sum(l_quantity) / max(t) AS pip, min(l_tax) * 5 AS af, nullif(max(l_discount) - 0.05, 0) AS effect FROM lineitem JOIN tot ON gene = l_suppkey AND cs = l_returnflag GROUP BY 1, 2, 3),
  met AS (SELECT g1, g2, a.cs AS cs1, b.cs AS cs2, a.variant, a.pip * b.pip AS pp, a.af, a.effect AS e1, b.effect AS e2 FROM prs JOIN sets a ON a.gene = g1 JOIN sets b ON b.gene = g2 AND b.variant = a.variant),
  ps AS (SELECT g1, g2, cs1, cs2, sum(pp) AS score FROM met GROUP BY 1, 2, 3, 4),
  ld AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g1, g2, cs1, cs2 ORDER BY pp DESC, variant) AS rn FROM met WHERE e1 IS NOT NULL AND e2 IS NOT NULL AND af IS NOT NULL) z WHERE rn = 1)"""


def _sets(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    tot = li.groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("t"))
    s = li.join(tot, ["l_suppkey", "l_returnflag"]).groupBy(F.col("l_suppkey").alias("gene"), F.col("l_returnflag").alias("cs"), F.col("l_partkey").alias("variant"))
    return s.agg((F.sum("l_quantity") / F.max("t")).alias("pip"), (F.min("l_tax") * 5).alias("af"), F.nullif(F.max("l_discount") - 0.05, F.lit(0.0)).alias("effect"))


@query(
    f"""WITH {_SUP}, {_SETS}, bs AS (SELECT * FROM (SELECT ps.*, sign(e1) * sign(e2) AS direction, row_number() OVER (PARTITION BY ps.g1, ps.g2 ORDER BY round(score, 12) DESC, ps.cs1, ps.cs2) AS rn FROM ps
    LEFT JOIN ld ON ld.g1 = ps.g1 AND ld.g2 = ps.g2 AND ld.cs1 = ps.cs1 AND ld.cs2 = ps.cs2) z WHERE rn = 1)
  SELECT prs.g1, prs.g2, true AS fm1, true AS fm2, round(coalesce(score, 0), 8) AS p_coloc, direction FROM prs LEFT JOIN bs ON bs.g1 = prs.g1 AND bs.g2 = prs.g2"""
)
def coloc_score(spark, d):
    got = pairs.colocalisation(_supplier_pairs(spark, d), _sets(spark, d))
    return got.select("g1", "g2", "fm1", "fm2", F.round("p_coloc", 8).alias("p_coloc"), "direction")


@query(
    f"""WITH {_SUP}, {_SETS}, v AS (SELECT ps.g1, ps.g2, sum(score * 2 * af * (1 - af) * e1 / 2 * e2 / 2) AS pred, max(score) AS p FROM ps LEFT JOIN ld ON ld.g1 = ps.g1 AND ld.g2 = ps.g2 AND ld.cs1 = ps.cs1 AND ld.cs2 = ps.cs2 GROUP BY 1, 2)
  SELECT g1, g2, round(pred, 12) AS pred_r, round(p, 8) AS p_coloc FROM v WHERE p >= 0.0001"""
)
def predicted_genetic_cov(spark, d):
    got = pairs.genetic_prediction(_supplier_pairs(spark, d), _sets(spark, d), 0.0001)
    return got.select("g1", "g2", F.round("pred_r", 12).alias("pred_r"), F.round("p_coloc", 8).alias("p_coloc"))


@query(
    f"""WITH {_SUP}, {_SETS}, sl AS (SELECT l_suppkey AS gene, l_partkey AS variant, avg(l_discount) - 0.04 AS b, min(l_tax) * 5 AS af FROM lineitem WHERE l_quantity > 20 GROUP BY 1, 2),
  w AS (SELECT m.g1, m.g2, pp, x.b AS b1, y.b AS b2, x.af FROM met m LEFT JOIN sl x ON x.gene = m.g1 AND x.variant = m.variant LEFT JOIN sl y ON y.gene = m.g2 AND y.variant = m.variant)
  SELECT g1, g2, round(sum(CASE WHEN b1 IS NOT NULL AND b2 IS NOT NULL THEN pp * 2 * af * (1 - af) * b1 * b2 END), 12) AS pred_r, round(sum(pp), 8) AS weight, round(sum(CASE WHEN b1 IS NOT NULL AND b2 IS NOT NULL THEN pp ELSE 0 END) / sum(pp), 6) AS covered FROM w GROUP BY 1, 2"""
)
def variant_prediction(spark, d):
    sl = table(spark, d, "lineitem").where("l_quantity > 20").groupBy(F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("variant")).agg((F.avg("l_discount") - 0.04).alias("slope"), (F.min("l_tax") * 5).alias("af"))
    got = pairs.variant_prediction(_supplier_pairs(spark, d), _sets(spark, d), sl)
    return got.select("g1", "g2", F.round("pred_r", 12).alias("pred_r"), F.round("weight", 8).alias("weight"), *r6("covered"))


@query(
    f"""WITH {_SUP}, {_SETS}, b AS (SELECT prs.g1, prs.g2, coalesce(max(score), 0) AS p FROM prs LEFT JOIN ps ON ps.g1 = prs.g1 AND ps.g2 = prs.g2 GROUP BY 1, 2)
  SELECT CASE WHEN p > -1 AND p <= 1e-9 THEN 'none' WHEN p > 1e-9 AND p <= 7e-4 THEN 'low' WHEN p > 7e-4 AND p <= 8e-4 THEN 'mid' WHEN p > 8e-4 AND p <= 1.01 THEN 'high' END AS p_bin, count(*) AS n, round(avg(g2 - g1), 6) AS mean_gap FROM b GROUP BY 1"""
)
def coloc_dose_response(spark, d):
    got = pairs.colocalisation(_supplier_pairs(spark, d), _sets(spark, d)).withColumn("p_bin", bins.cut(F.col("p_coloc"), [-1, 1e-9, 7e-4, 8e-4, 1.01], ["none", "low", "mid", "high"]))
    return got.groupBy("p_bin").agg(F.count("*").alias("n"), F.round(F.avg(F.col("g2") - F.col("g1")), 6).alias("mean_gap"))


@query(
    f"""WITH {_SUP}, fp AS (SELECT l_suppkey AS gene, l_partkey AS source, avg(l_discount) AS a FROM lineitem GROUP BY 1, 2), v AS (SELECT p_partkey AS source, p_size / 50.0 AS variance FROM part)
  SELECT prs.g1, prs.g2, round(coalesce(sum(variance * x.a * y.a), 0), 8) AS cov FROM prs LEFT JOIN (fp x JOIN fp y ON x.source = y.source JOIN v ON v.source = x.source) ON x.gene = g1 AND y.gene = g2 GROUP BY 1, 2"""
)
def source_covariance(spark, d):
    f = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("source")).agg(F.avg("l_discount").alias("a"))
    v = table(spark, d, "part").select(F.col("p_partkey").alias("source"), (F.col("p_size") / 50).alias("variance"))
    return pairs.source_covariance(v, f, _supplier_pairs(spark, d)).select("g1", "g2", F.round("cov", 8).alias("cov"))


@query(
    f"""WITH {_ADJ}, e AS (SELECT g1, g2, (gc1 * gc2) / 10000 AS v FROM adj WHERE gc1 IS NOT NULL AND gc2 IS NOT NULL)
  SELECT g1 AS source, g2 AS target, 1 AS steps, round(v, 9) AS value FROM e UNION ALL SELECT a.g1, b.g2, 2, round(a.v * b.v, 9) FROM e a JOIN e b ON a.g2 = b.g1 WHERE a.g1 <> b.g2"""
)
def two_step_neighbours(spark, d):
    e = _adjacent(spark, d).where("gc1 IS NOT NULL AND gc2 IS NOT NULL").select(F.col("gene1").alias("g1"), F.col("gene2").alias("g2"), (F.col("gc1") * F.col("gc2") / 10000).alias("r"))
    return pairs.two_steps(e).select("source", "target", "steps", F.round("value", 9).alias("value"))


@query(
    f"""WITH {V.PAIRS}, a AS (SELECT unit, g1, g2, avg(r) AS r, avg(oe) AS oe FROM pairs WHERE r IS NOT NULL AND oe IS NOT NULL GROUP BY 1, 2, 3)
  SELECT x.unit AS unit_a, y.unit AS unit_b, count(*) AS n, round(corr(x.r, y.oe), 6) AS r FROM a x JOIN a y ON x.g1 = y.g1 AND x.g2 = y.g2 AND x.unit <> y.unit GROUP BY 1, 2 HAVING count(*) >= 20"""
)
def unit_cross_specificity(spark, d):
    a = V.pairs(spark, d).where("r IS NOT NULL AND oe IS NOT NULL").groupBy("unit", "g1", "g2").agg(F.avg("r").alias("r"), F.avg("oe").alias("oe"))
    x = pairs.unit_cross(a.select("unit", "g1", "g2", "r"), a.select("unit", "g1", "g2", "oe"))
    return x.groupBy("unit_a", "unit_b").agg(F.count("*").alias("n"), F.round(bins.pearson(F.col("r"), F.col("oe")), 6).alias("r")).where("n >= 20")


@query(
    f"""WITH {V.PAIRS}, {V.GENES}, ex AS (SELECT unit, part, bin_distance, avg(contact_kr) AS e FROM pairs GROUP BY 1, 2, 3)
  SELECT p.unit, coalesce(a.biotype, 'unknown') AS b1, coalesce(b.biotype, 'unknown') AS b2, count(*) AS n, round(avg(p.contact_kr / nullif(e, 0)), 6) AS oe FROM pairs p LEFT JOIN ex ON ex.unit = p.unit AND ex.part = p.part AND ex.bin_distance = p.bin_distance
  LEFT JOIN genes a ON a.gene = p.g1 LEFT JOIN genes b ON b.gene = p.g2 GROUP BY 1, 2, 3"""
)
def contacts_with_dimensions(spark, d):
    p = V.pairs(spark, d)
    ex = p.groupBy("unit", "part", "bin_distance").agg(F.avg("contact_kr").alias("e"))
    g = V.genes(spark, d).select("gene", "biotype")
    j = p.join(ex, ["unit", "part", "bin_distance"], "left").join(g.select(F.col("gene").alias("g1"), F.col("biotype").alias("b1")), "g1", "left").join(g.select(F.col("gene").alias("g2"), F.col("biotype").alias("b2")), "g2", "left")
    return j.groupBy("unit", F.coalesce("b1", F.lit("unknown")).alias("b1"), F.coalesce("b2", F.lit("unknown")).alias("b2")).agg(F.count("*").alias("n"), F.round(F.avg(bins.safe_div(F.col("contact_kr"), F.col("e"))), 6).alias("oe"))


@query(
    f"""WITH m AS (SELECT rna, dna FROM (SELECT {V.KEY.format("dbgap_rnaseq_sample")} AS rna, {V.KEY.format("dbgap_dnaseq_sample")} AS dna, row_number() OVER (PARTITION BY {V.KEY.format("dbgap_rnaseq_sample")} ORDER BY row_id) AS rn FROM sample_mapping
    WHERE dbgap_rnaseq_sample IS NOT NULL AND dbgap_dnaseq_sample IS NOT NULL) z WHERE rn = 1)
  SELECT rna, dna FROM m WHERE rna IN (SELECT {V.KEY.format("sample_id")} FROM expr_signal WHERE sample_id IS NOT NULL) AND dna IN (SELECT {V.KEY.format("dbgap_sample_id")} FROM beataml_mutation WHERE dbgap_sample_id IS NOT NULL)"""
)
def sample_mapping_pairs(spark, d):
    m = table(spark, d, "sample_mapping").where("dbgap_rnaseq_sample IS NOT NULL AND dbgap_dnaseq_sample IS NOT NULL").select("row_id", canonical_key(F.col("dbgap_rnaseq_sample")).alias("rna"), canonical_key(F.col("dbgap_dnaseq_sample")).alias("dna"))
    m = sig.keep_first(m, ["rna"], ["row_id"]).select("rna", "dna")
    rna = table(spark, d, "expr_signal").select(canonical_key(F.col("sample_id")).alias("rna")).distinct()
    dna = table(spark, d, "beataml_mutation").select(canonical_key(F.col("dbgap_sample_id")).alias("dna")).distinct()
    return m.join(rna, "rna", "left_semi").join(dna, "dna", "left_semi")


@query(
    """WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 9000 GROUP BY 1)
  SELECT coalesce(a.k, b.k) AS nation, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM a FULL JOIN b ON a.k = b.k"""
)
def full_outer_alignment(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = table(spark, d, "supplier").where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query(
    """SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
  UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0"""
)
def key_sets(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    st = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    got = c.intersect(st("F")).intersect(st("O")).join(st("P").distinct(), "k", "left_anti")
    return got.union(table(spark, d, "supplier").where("s_acctbal < 0").select("s_suppkey")).distinct()


# ------------------------------------------------------------------------------------------ intervals


@query(
    f"""WITH {V.GENES} SELECT g.gene, count(*) AS n, count(DISTINCT sample_id) AS samples FROM mutation m JOIN genes g ON g.part = m.chrom AND m.pos BETWEEN g.start AND g."end" GROUP BY 1"""
)
def point_in_interval(spark, d):
    g = V.genes(spark, d).where("part IS NOT NULL").select(F.col("gene").alias("in_gene"), F.col("part").alias("chrom"), "start", "end")
    m = table(spark, d, "mutation").select("chrom", "pos", "sample_id")
    hit = interval.points_in_intervals(m, g, ["chrom"], "pos", "start", "end", 100_000)
    return hit.groupBy(F.col("in_gene").alias("gene")).agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("samples"))


@query(
    """WITH e AS (SELECT user_id, ts, event_id, value, ts + INTERVAL 6 HOUR AS until FROM events WHERE event_type = 'error'),
  j AS (SELECT p.event_id, p.ts, e.event_id AS error_id, e.value AS error_value, e.until, row_number() OVER (PARTITION BY p.event_id ORDER BY e.ts DESC, e.event_id DESC) AS rn FROM events p LEFT JOIN e ON e.user_id = p.user_id AND e.ts <= p.ts WHERE p.event_type = 'click')
  SELECT event_id, CASE WHEN ts <= until THEN error_id END AS error_id, CASE WHEN ts <= until THEN error_value END AS error_value FROM j WHERE rn = 1"""
)
def segment_asof(spark, d):
    e = table(spark, d, "events")
    err = e.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"), F.col("value").alias("error_value"), (F.col("ts") + F.expr("INTERVAL 6 HOUR")).alias("until"))
    p = e.where("event_type = 'click'").select("user_id", "event_id", "ts")
    return interval.as_of(p, err, ["user_id"], "ts", "ts", ["error_id", "error_value"], ["error_id"], "until").select("event_id", "error_id", "error_value")


@query(
    f"""WITH {V.GENES}, mid AS (SELECT gene, part, (start + "end") / 2.0 AS mid FROM genes WHERE part IS NOT NULL AND start IS NOT NULL), b AS (SELECT part, start AS loc FROM genes WHERE biotype = 'lncRNA' AND part IS NOT NULL AND start IS NOT NULL)
  SELECT m.gene, (SELECT count(*) FROM b WHERE b.part = m.part AND b.loc < m.mid) AS segment FROM mid m"""
)
def boundary_rank(spark, d):
    g = V.genes(spark, d).where("part IS NOT NULL AND start IS NOT NULL")
    p = g.select("gene", "part", ((F.col("start") + F.col("end")) / 2).alias("mid"))
    b = g.where("biotype = 'lncRNA'").select("part", F.col("start").alias("loc"))
    return interval.events_before(p, b, ["part"], "mid", "loc", "segment").select("gene", "segment")


@query(
    f"""WITH {_ADJ}, p AS (SELECT part, g1, g2, e1 AS lo, st2 AS hi FROM adj WHERE st2 > e1), x AS (SELECT p.g1, p.g2, max(m.dna_vaf) AS top FROM p JOIN mutation m ON m.chrom = p.part AND m.pos > p.lo AND m.pos < p.hi GROUP BY 1, 2)
  SELECT p.part, p.g1, p.g2, top AS strongest, CASE WHEN top IS NULL THEN 'within' WHEN top >= 0.45 THEN 'stable' ELSE 'weak' END AS class FROM p LEFT JOIN x ON x.g1 = p.g1 AND x.g2 = p.g2"""
)
def boundary_between(spark, d):
    p = _adjacent(spark, d).where("start2 > end1").select("part", F.col("gene1").alias("g1"), F.col("gene2").alias("g2"), F.col("end1").alias("lo"), F.col("start2").alias("hi"))
    m = table(spark, d, "mutation").where("dna_vaf IS NOT NULL").select(F.col("chrom").alias("part"), "pos", "dna_vaf")
    got = interval.strongest_between(p, m, ["part"], "lo", "hi", "pos", "dna_vaf", 100_000, ["g1", "g2"])
    return got.select("part", "g1", "g2", "strongest", F.when(F.col("strongest").isNull(), "within").when(F.col("strongest") >= 0.45, "stable").otherwise("weak").alias("class"))


@query(
    f"""WITH {_ADJ}, {V.GENES.replace("genes AS", "gg AS", 1)}, p AS (SELECT part, g1, g2, st1 AS a, st2 AS b FROM adj), sp AS (SELECT part, start - 20000 AS lo, "end" + 20000 AS hi FROM gg WHERE biotype = 'lncRNA' AND part IS NOT NULL AND start IS NOT NULL)
  SELECT p.part, p.g1, p.g2, coalesce(bool_or(a BETWEEN lo AND hi AND b BETWEEN lo AND hi), false) AS same, coalesce(sum(CASE WHEN (a BETWEEN lo AND hi) <> (b BETWEEN lo AND hi) THEN 1 ELSE 0 END), 0)::bigint AS crossed
  FROM p LEFT JOIN sp ON sp.part = p.part AND (a BETWEEN lo AND hi OR b BETWEEN lo AND hi) GROUP BY 1, 2, 3"""
)
def loop_crossings(spark, d):
    p = _adjacent(spark, d).select("part", F.col("gene1").alias("g1"), F.col("gene2").alias("g2"), F.col("start1").alias("a"), F.col("start2").alias("b"))
    sp = V.genes(spark, d).where("biotype = 'lncRNA' AND part IS NOT NULL AND start IS NOT NULL").select("part", (F.col("start") - 20000).alias("lo"), (F.col("end") + 20000).alias("hi"))
    return interval.contained_and_crossed(p, sp, ["part"], "a", "b", "lo", "hi", 100_000, ["g1", "g2"]).select("part", "g1", "g2", "same", "crossed")


@query(
    f"""WITH {V.GENES}, g AS (SELECT gene, part, start FROM genes WHERE part IS NOT NULL AND start IS NOT NULL),
  p AS (SELECT a.part, a.gene AS g1, b.gene AS g2, b.start - a.start AS dist FROM g a JOIN g b ON a.part = b.part AND b.start - a.start BETWEEN 0 AND 50000 AND (b.start > a.start OR a.gene < b.gene)) SELECT part, g1, g2, dist, cast(floor(dist / 5000) AS int) AS bin FROM p"""
)
def range_pairs(spark, d):
    g = V.genes(spark, d).where("part IS NOT NULL AND start IS NOT NULL").select("gene", "part", "start")
    p = interval.range_pairs(g, ["part"], "start", "gene", 50_000)
    return p.select("part", F.col("gene1").alias("g1"), F.col("gene2").alias("g2"), (F.col("start2") - F.col("start1")).alias("dist"), F.floor((F.col("start2") - F.col("start1")) / 5000).cast("int").alias("bin"))


@query(
    f"""WITH {V.PAIRS}, n AS (SELECT part, max(bin_distance) // 25000 + 1 AS nb FROM pairs GROUP BY 1) SELECT p.part, p.bin_distance, round(sum(contact_kr) / max(greatest(nb - p.bin_distance // 25000, 1)), 9) AS expected FROM pairs p JOIN n ON n.part = p.part GROUP BY 1, 2"""
)
def expected_by_distance(spark, d):
    p = V.pairs(spark, d).select("part", "bin_distance", "contact_kr")
    n = p.groupBy("part").agg((F.floor(F.max("bin_distance") / 25000) + 1).alias("nb"))
    cells = F.max(F.greatest(F.col("nb") - F.floor(F.col("bin_distance") / 25000), F.lit(1)))
    return p.join(n, "part").groupBy("part", "bin_distance").agg(F.round(F.sum("contact_kr") / cells, 9).alias("expected"))


_RK = f"""{V.GENES}, rk AS (SELECT gene, part, gc, biotype, row_number() OVER (PARTITION BY part ORDER BY start, gene) - 1 AS rank FROM genes WHERE part IS NOT NULL AND start IS NOT NULL)"""


@query(f"""WITH {_RK} SELECT a.gene AS gene, count(*) AS neighbours, round(avg(b.gc), 6) AS mean_gc FROM rk a JOIN rk b ON a.part = b.part AND abs(b.rank - a.rank) BETWEEN 1 AND 5 GROUP BY 1""")
def rank_neighbours(spark, d):
    g = sig.number_positions(V.genes(spark, d), "part", "start", "gene")
    n = interval.rank_neighbours(g, ["part"], "rank", 5, ["gene", "gc"])
    return n.groupBy(F.col("gene1").alias("gene")).agg(F.count("*").alias("neighbours"), F.round(F.avg("gc2"), 6).alias("mean_gc"))


@query(
    f"""WITH {V.GENES}, a AS (SELECT * FROM genes WHERE biotype = 'protein_coding' AND part IS NOT NULL AND start IS NOT NULL), b AS (SELECT * FROM genes WHERE biotype <> 'protein_coding' AND part IS NOT NULL AND start IS NOT NULL),
  o AS (SELECT a.gene, b.gene AS other, count(*) OVER (PARTITION BY a.gene) AS n FROM a JOIN b ON a.part = b.part AND a.strand = b.strand AND a.start <= b."end" AND a."end" >= b.start) SELECT gene, other FROM o WHERE n = 1"""
)
def overlap_unique(spark, d):
    g = V.genes(spark, d).where("part IS NOT NULL AND start IS NOT NULL").select("gene", "part", "strand", "start", "end", "biotype")
    a, b = g.where("biotype = 'protein_coding'"), g.where("biotype <> 'protein_coding'").withColumnRenamed("gene", "other")
    return interval.overlap_unique(a.select("gene", "part", "strand", "start", "end"), b, ["part", "strand"], "start", "end", "gene", 50_000, ["other"]).select("gene", "other")


@query(
    f"""WITH {V.GENES}, g AS (SELECT gene, part, start FROM genes WHERE part IS NOT NULL AND start IS NOT NULL) SELECT gene, count(*) OVER (PARTITION BY part ORDER BY start RANGE BETWEEN 1000000 PRECEDING AND 1000000 FOLLOWING) AS density FROM g"""
)
def local_density(spark, d):
    g = V.genes(spark, d).where("part IS NOT NULL").select("gene", "part", "start")
    return interval.density(g, ["part"], "start", 1_000_000).select("gene", "density")


@query(
    """WITH a AS (SELECT event_id, user_id, cast(floor(value) AS bigint) AS v FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id, cast(floor(value) AS bigint) AS w FROM events WHERE event_type = 'purchase')
  SELECT a.event_id, (SELECT min(w) FROM b WHERE b.user_id = a.user_id AND w BETWEEN v - 3 AND v + 3) AS near FROM a"""
)
def tolerance_match(spark, d):
    e = table(spark, d, "events").withColumn("v", F.floor("value"))
    a, b = e.where("event_type = 'click'").select("event_id", "user_id", "v"), e.where("event_type = 'purchase'").select("user_id", F.col("v").alias("w"))
    return interval.nearest_tolerance(a, b, ["user_id"], "v", "w", 3, "near").select("event_id", "near")


@query(
    f"""WITH {V.PAIRS}, c AS (SELECT part, bin_distance // 25000 AS k, tss_distance % 7 AS lo, avg(contact_kr) AS o, avg(expected_kr) AS e FROM pairs WHERE unit = 'lymph_a' GROUP BY 1, 2, 3), md AS (SELECT k, median(e) AS m FROM c GROUP BY 1),
  q AS (SELECT part, bin_distance // 25000 AS k, tss_distance % 7 AS lo, count(*) AS n FROM pairs WHERE unit = 'eryth_c' GROUP BY 1, 2, 3)
  SELECT q.part, q.lo, q.k, n, round(coalesce(o, 0), 6) AS observed, round(coalesce(e, m), 6) AS expected FROM q LEFT JOIN c ON c.part = q.part AND c.k = q.k AND c.lo = q.lo LEFT JOIN md ON md.k = q.k"""
)
def cell_lookup(spark, d):
    p = V.pairs(spark, d).withColumn("kk", F.floor(F.col("bin_distance") / 25000)).withColumn("b1", F.pmod("tss_distance", F.lit(7))).withColumn("b2", F.col("b1") + F.col("kk"))
    cells = p.where("unit = 'lymph_a'").groupBy("part", F.col("b1").alias("lo"), F.col("kk").alias("k")).agg(F.avg("contact_kr").alias("observed"), F.avg("expected_kr").alias("expected"))
    q = p.where("unit = 'eryth_c'").groupBy("part", "b1", "b2").agg(F.count("*").alias("n"))
    return interval.cell_lookup(q, cells, ["part"], "b1", "b2").select("part", "lo", "k", "n", *r6("observed", "expected"))


@query()
def matched_random_pairs(spark, d):
    g = sig.number_positions(V.genes(spark, d).where("gc IS NOT NULL AND NOT isnan(gc)"), "part", "start", "gene")
    g = bins.qcut(g, "gc", 3, ["part"], "gq", True).select("part", "gq", "gene", "rank")
    p = lag.adjacent_pairs(g, ["part"], ["rank"], ["gene", "gq"])
    p = p.select("gene1", "gene2", F.struct("part", F.col("gq1").alias("gq")).alias("s1"), F.struct("part", F.col("gq2").alias("gq")).alias("s2"))
    got = interval.random_partners(p, g, ["part", "gq"], ["gene"], "rank", 20, 20, 7)
    return got.select("gene1", "gene2", F.col("u.gene").alias("u"), F.col("v.gene").alias("v"))


@query(
    f"""WITH {V.PAIRS}, l AS (SELECT DISTINCT part FROM pairs WHERE unit = 'lymph_a') SELECT p.unit, count(*) FILTER (tss_distance < 500000) AS near, count(*) AS n, round(avg(r) FILTER (tss_distance < 500000) - avg(r), 8) AS gap FROM pairs p WHERE part IN (SELECT part FROM l) GROUP BY 1"""
)
def locus_window(spark, d):
    p = V.pairs(spark, d)
    here = p.join(p.where("unit = 'lymph_a'").select("part").distinct(), "part", "left_semi")
    near = F.col("tss_distance") < 500_000
    return here.groupBy("unit").agg(F.count_if(near).alias("near"), F.count("*").alias("n"), F.round(F.avg(F.when(near, F.col("r"))) - F.avg("r"), 8).alias("gap"))


# ------------------------------------------------------------------------------------------ regression


@query(
    f"""WITH {V.PAIRS}, x AS (SELECT unit, r AS y, ln(contact_kr + 1) AS a, log10(tss_distance) AS b FROM pairs WHERE r IS NOT NULL AND contact_kr IS NOT NULL),
  m AS (SELECT unit, count(*) AS n, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb FROM x GROUP BY 1)
  SELECT unit, n, round((ay * bb - byy * ab) / (aa * bb - ab * ab), 8) AS coef_contact, round((byy * aa - ay * ab) / (aa * bb - ab * ab), 8) AS coef_distance FROM m"""
)
def ols_moments(spark, d):
    x = V.pairs(spark, d).where("contact_kr IS NOT NULL").select("unit", "r", F.ln(F.col("contact_kr") + 1).alias("a"), F.log10("tss_distance").alias("b"))
    o = regress.ols(x, "r", ["a", "b"], ["unit"])
    pick = lambda t: F.round(F.max(F.when(F.col("term") == t, F.col("coef"))), 8)
    return o.groupBy("unit").agg(F.max("n").alias("n"), pick("a").alias("coef_contact"), pick("b").alias("coef_distance"))


@query(
    f"""WITH {V.PAIRS}, g AS (SELECT unit, bin_distance, covar_pop(contact_kr, r) AS c, var_pop(contact_kr) AS v, count(*) AS n FROM pairs WHERE contact_kr IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2)
  SELECT unit, round(sum(c * n) / sum(v * n), 8) AS slope, sum(n)::bigint AS n FROM g GROUP BY 1"""
)
def fe_slope(spark, d):
    return regress.fe_slope(V.pairs(spark, d), "r", "contact_kr", ["bin_distance"], ["unit"]).select("unit", F.round("slope", 8).alias("slope"), "n")


@query(
    f"""WITH {V.PAIRS}, x AS (SELECT unit, bin_distance, r AS y, ln(contact_kr + 1) AS a, ln(tss_distance) AS b FROM pairs WHERE r IS NOT NULL AND contact_kr IS NOT NULL), m AS (SELECT unit, bin_distance, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM x GROUP BY 1, 2),
  w AS (SELECT x.unit, y - my AS y, a - ma AS a, b - mb AS b FROM x JOIN m USING (unit, bin_distance)), s AS (SELECT unit, sum(a * y) AS ay, sum(b * y) AS byy, sum(a * b) AS ab, sum(a * a) AS aa, sum(b * b) AS bb FROM w GROUP BY 1)
  SELECT unit, 'a' AS term, round((ay * bb - byy * ab) / (aa * bb - ab * ab), 8) AS coef FROM s UNION ALL SELECT unit, 'b', round((byy * aa - ay * ab) / (aa * bb - ab * ab), 8) FROM s"""
)
def fixed_effects(spark, d):
    x = V.pairs(spark, d).where("contact_kr IS NOT NULL").select("unit", "bin_distance", "r", F.ln(F.col("contact_kr") + 1).alias("a"), F.ln("tss_distance").alias("b"))
    return regress.fixed_effect(x, "r", ["a", "b"], ["bin_distance"], ["unit"]).select("unit", "term", F.round("coef", 8).alias("coef"))


@query(
    f"""WITH {V.PAIRS}, x AS (SELECT unit, bin_distance, ln(r) AS y, ln(contact_kr) AS c FROM pairs WHERE r > 0 AND contact_kr > 0), b AS (SELECT unit, bin_distance, covar_pop(c, y) AS cv, var_pop(c) AS v, count(*) AS n, avg(c) AS mc, avg(y) AS my FROM x GROUP BY 1, 2)
  SELECT unit, round(sum(cv * n) / sum(v * n), 8) AS k_within, round(regr_slope(my, mc), 8) AS k_across FROM b GROUP BY 1"""
)
def contact_exponents(spark, d):
    x = V.pairs(spark, d).where("r > 0 AND contact_kr > 0").select("unit", "bin_distance", F.ln("r").alias("y"), F.ln("contact_kr").alias("c"))
    within = regress.fe_slope(x, "y", "c", ["bin_distance"], ["unit"]).select("unit", F.round("slope", 8).alias("k_within"))
    means = x.groupBy("unit", "bin_distance").agg(F.avg("c").alias("mc"), F.avg("y").alias("my"))
    return within.join(means.groupBy("unit").agg(F.round(F.regr_slope("my", "mc"), 8).alias("k_across")), "unit")


@query(
    """WITH g AS (SELECT event_type, avg(value) FILTER (user_id % 2 = 0) AS m1, avg(value) FILTER (user_id % 2 = 1) AS m0, var_samp(value) FILTER (user_id % 2 = 0) AS v1, var_samp(value) FILTER (user_id % 2 = 1) AS v0, count(*) FILTER (user_id % 2 = 0) AS n1, count(*) FILTER (user_id % 2 = 1) AS n0 FROM events GROUP BY 1)
  SELECT event_type, round(m1 - m0, 6) AS difference, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t, round(pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)), 4) AS df FROM g"""
)
def welch_t(spark, d):
    e = table(spark, d, "events").withColumn("even", F.pmod("user_id", F.lit(2)) == 0)
    return regress.welch(e, "value", "even", ["event_type"], False).select("event_type", *r6("difference", "t"), F.round("df", 4).alias("df"))


@query(
    """WITH x AS (SELECT event_type, value AS v, user_id % 2 = 0 AS g FROM events), k AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY v) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2.0 AS rk FROM x),
  s AS (SELECT event_type, sum(CASE WHEN g THEN rk ELSE 0 END) AS s, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2 FROM k GROUP BY 1) SELECT event_type, n1, n2, s - n1 * (n1 + 1) / 2.0 AS u FROM s"""
)
def mann_whitney(spark, d):
    e = table(spark, d, "events").select("event_type", "value", (F.pmod("user_id", F.lit(2)) == 0).alias("g"))
    return ranks.mann_whitney(e, "value", "g", ["event_type"]).select("event_type", "n1", "n2", "u")


@query(
    """WITH s AS (SELECT event_type, user_id % 5 AS study, avg(value) AS est, stddev_samp(value) / sqrt(count(*)) AS se FROM events GROUP BY 1, 2), w AS (SELECT event_type, sum(1 / (se * se)) AS w, sum(est / (se * se)) AS we, sum(est * est / (se * se)) AS wee, count(*) AS studies FROM s GROUP BY 1)
  SELECT event_type, round(we / w, 6) AS estimate, round(1 / sqrt(w), 6) AS se, round(we / w - 1.959964 / sqrt(w), 6) AS ci_low, round(we / w + 1.959964 / sqrt(w), 6) AS ci_high, round(greatest(wee - we * we / w, 0), 5) AS cochran_q, studies FROM w"""
)
def meta_inverse_variance(spark, d):
    s = table(spark, d, "events").groupBy("event_type", F.pmod("user_id", F.lit(5)).alias("study")).agg(F.avg("value").alias("est"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("sd"))
    return regress.meta_analysis(s, "est", "sd", ["event_type"], False).select("event_type", *r6("estimate", "se", "ci_low", "ci_high"), F.round("cochran_q", 5).alias("cochran_q"), "studies")


@query()
def tost_equivalence(spark, d):
    s = table(spark, d, "events").groupBy("event_type").agg((F.avg("value") - 25).alias("est"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("se"))
    return s.select("event_type", F.round("est", 6).alias("est"), F.round(regress.detectable(F.col("se")), 6).alias("mde80"), F.round(regress.tost(F.col("est"), F.col("se"), regress.detectable(F.col("se"))), 6).alias("p_tost"))


@query()
def robust_hc3(spark, d):
    """Balances on the number of orders and their mean price in thousands."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), (F.avg("o_totalprice") / 1000).alias("mean"))
    got = regress.robust(table(spark, d, "customer").join(o, "c_custkey"), "c_acctbal", ["n", "mean"])
    return got.select("term", *[F.round(c, 4).alias(c) for c in ("coef", "se", "ci_low", "ci_high")], F.round("p", 6).alias("p"), "n")


@query()
def robust_clusters(spark, d):
    c = V.pairs(spark, d).where("contact_kr IS NOT NULL").withColumn("lc", F.ln(F.col("contact_kr") + 1))
    return regress.robust(c, "r", ["lc"], "part").select("term", *r6("coef", "se", "ci_low", "ci_high", "p"), "n")


# ------------------------------------------------------------------------------------------ resampling, fits


@query()
def block_bootstrap_ci(spark, d):
    p = V.pairs(spark, d).where("contact_kr IS NOT NULL")
    g = V.genes(spark, d).select(F.col("gene").alias("g1"), "start")
    p = p.join(g, "g1", "left").withColumn("block", resample.position_block(F.col("part"), F.col("start"), 1e6, F.col("g1"))).withColumn("lc", F.ln(F.col("contact_kr") + 1)).withColumn("ld", F.log10("tss_distance"))
    return resample.block_bootstrap(p, "r", ["lc", "ld"], "block", 300, 0).select("term", *r6("est", "ci_low", "ci_high", "boot_se", "p"), "blocks")


@query()
def stratified_block_bootstrap(spark, d):
    p = V.pairs(spark, d).where("contact_kr IS NOT NULL").withColumn("lc", F.ln(F.col("contact_kr") + 1)).withColumn("block", F.concat_ws(":", "unit", "part"))
    return resample.block_bootstrap(p, "r", ["lc"], "block", 500, 7, "unit").select("term", *r6("est", "ci_low", "ci_high", "boot_se", "p"), "blocks")


@query()
def relative_means_by_level(spark, d):
    p = V.pairs(spark, d).where("r IS NOT NULL").withColumn("level", bins.cut(F.col("oe"), [-1, 0.5, 1, 2, 1e9], ["a", "b", "c", "d"])).where("level IS NOT NULL")
    p = sig.remove_group_means(p, "r", ["bin_distance"], "adj").withColumn("v", F.col("adj") + 0.1)
    return resample.block_means(p, "v", "level", "part", 200, 23, "a").select("level", *r6("mean", "ci_low", "ci_high", "relative", "relative_ci_low", "relative_ci_high"))


@query()
def freedman_lane_test(spark, d):
    s = table(spark, d, "customer").join(table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("n"), F.max((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("urgent")), "c_custkey").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("y"), F.avg("urgent").alias("x"), F.avg("n").alias("z"))
    got = resample.freedman_lane(s.orderBy("c_nationkey").toPandas(), "y", "x", ["z"], spark, 500, 1)  # one row per nation
    return spark.createDataFrame([(got["effect"], got["t"], got["p"])], "effect double, t double, p double").select(*r6("effect", "t", "p"))


@query()
def split_half_agreement(spark, d):
    n = resample.ranked_halves(_norm(spark, d), "sample", ["unit"], 8)
    z = sig.zscore(n, "value", ["unit", "part", "rank", "half"])
    nxt = z.select("unit", "sample", "part", "half", (F.col("rank") - 1).alias("rank"), F.col("z").alias("z2"))
    r = z.join(nxt, ["unit", "sample", "part", "half", "rank"]).groupBy("unit", "part", "rank").pivot("half", [0, 1]).agg(F.avg(F.col("z") * F.col("z2")))
    return r.groupBy("unit").agg(F.round(bins.pearson(F.col("0"), F.col("1")), 6).alias("agreement"), F.count("*").alias("pairs"))


@query()
def active_set_clustering(spark, d):
    from pyspark.sql import Window

    s = V.signal(spark, d).withColumn("segment", F.concat_ws(":", "part", F.floor(F.col("rank") / 5))).withColumn("key", F.concat_ws(":", "part", "rank"))
    w = Window.partitionBy("unit", "sample").orderBy(F.desc("value"), "part", "rank")  # a sample's positions
    top = s.withColumn("k", F.row_number().over(w)).where("k <= 12")
    got = resample.gene_set_null(top, s, ["unit", "sample"], "segment", "key", 50, 11)
    return got.select("unit", "sample", "observed", *r6("expected", "sd", "z"))


@query()
def contact_law_fit(spark, d):
    p = V.pairs(spark, d).where("contact_kr > 0 AND r IS NOT NULL")
    q = bins.qcut(p, "contact_kr", 15, ["unit"], "b", True).groupBy("unit", "b").agg(F.avg("contact_kr").alias("c"), F.avg("r").alias("m"), (F.stddev_samp("r") / F.sqrt(F.count("*"))).alias("se"))
    law = lambda c, m, se: (lambda f: {"r0": f["power_law"]["r0"], "A": f["power_law"]["A"], "k": f["power_law"]["k"], "chi2_power": f["power_law"]["chi2"], "chi2_hub": f["hub"]["chi2"]})(fit.fit_contact_law(c, m, se))
    return fit.per_group(q, ["unit"], ["c", "m", "se"], law, ["r0", "A", "k", "chi2_power", "chi2_hub"]).select("unit", *r6("r0", "A", "k"), F.round("chi2_power", 3).alias("chi2_power"), F.round("chi2_hub", 3).alias("chi2_hub"), "failure")


def _gc_track(spark: SparkSession, d: str) -> DataFrame:
    """(unit, part, rank, covariate): the gc of the gene at each position of ``expr_signal``."""
    at = table(spark, d, "expr_signal").select("unit", F.col("chr").alias("part"), F.col("gene_rank").alias("rank"), canonical_gene(F.col("gene_id")).alias("gene")).distinct()
    return at.join(V.genes(spark, d).select("gene", "gc"), "gene").groupBy("unit", "part", "rank").agg(F.avg("gc").alias("covariate"))


def _profile_fit(x, y) -> dict[str, float]:
    # floor: the last third of the lags; fit: their first half (41 to 60 and 1 to 30 where parts are long enough)
    last = int(x.max())
    if last < 8:
        raise ValueError(f"a profile of {last} lags is too short")
    return {"lags": last} | fit.exponential_fits(x[2 * x <= last], y[2 * x <= last], float(y[3 * x > 2 * last].mean()))


def _binned_fit(f, p) -> dict[str, float]:
    import numpy as np

    edges = np.logspace(np.log10(1 / 1500), np.log10(0.5), 61)
    at = np.digitize(f, edges) - 1
    f, p, at = (v[(at >= 0) & (at < 60)] for v in (f, p, at))
    n, total = np.bincount(at, minlength=60), np.bincount(at, p, 60)
    on = n > 0
    if on.sum() < 7 or not (total[on] > 0).all():
        raise ValueError(f"a spectrum of {on.sum()} bins, {(total[on] > 0).sum()} with power, is too short")
    return fit.lorentzian_fits(np.sqrt(edges[:-1] * edges[1:])[on], total[on] / n[on], n[on])


def _whittle_fit(f, p) -> dict[str, float]:
    if len(f) < 7 or not (p > 0).all():
        raise ValueError(f"a spectrum of {len(f)} frequencies, {(p > 0).sum()} with power, is too short")
    return fit.whittle(f, p)


@query()
def decay_fits(spark, d):
    """Per unit of ``expr_signal``, normalised and without its genes' gc trend: exponentials fitted to the lag
    profile, Lorentzians and a power law to the binned spectrum and by Whittle's likelihood to the whole one.
    Parts need six positions more than a lag, and as many as the first lag needs for the spectrum."""
    counts = written(V.signal(spark, d), "signal")  # read twice
    x = written(sig.log2_cpm(sig.expressed(counts, 10)).where("value IS NOT NULL"), "normalised")
    clean = written(resid.remove_trend(x, resid.trend_basis(x, _gc_track(spark, d))).select(*sig.POSITION, "sample", "value"), "clean")
    arrays = written(lag.gapped_arrays(sig.zscore(clean, "value", sig.POSITION)), "arrays")
    profile = lag.gapped_profile(arrays, range(1, 61), 5)
    # a sample's power over the values it has, averaged over samples
    spectra = spectral.periodogram(arrays.where((F.col("present") > 0) & (F.size("x") > 6)).drop("mask"), drop_zero=True)
    power = spectra.groupBy("unit", "part", "k", "n").agg(F.avg(F.col("power") / F.col("present")).alias("power")).withColumn("frequency", F.col("k") / F.col("n"))
    power = written(power, "spectrum")
    one = ["lags", "length_one", "rss_one", "length_short", "length_long", "rss_two"]
    lor, whi = ["length_one", "length_short", "length_long", "exponent", "aic_one", "aic_two", "aic_power"], ["length_one", "length_short", "length_long", "aic_one", "aic_two", "aic_power"]
    under = lambda df, name: df.select("unit", *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "unit"])
    a = fit.per_group(profile, ["unit"], ["lag", "correlation"], _profile_fit, one)
    b = under(fit.per_group(power, ["unit"], ["frequency", "power"], _binned_fit, lor), "lorentzian")
    c = under(fit.per_group(power.where("2 * k < n"), ["unit"], ["frequency", "power"], _whittle_fit, whi), "whittle")
    return x.select("unit").distinct().join(a, "unit", "left").join(b, "unit", "left").join(c, "unit", "left")


@query()
def simulate_recover(spark, d):
    """Decay lengths, raw and after removal of the covariate's trend, of simulations with known lengths."""
    out = None
    for length in (2.0, 5.0, 8.0):
        x = simulate.simulate_genome(spark, 300, 2, 60, length, seed=int(length), unit=f"{length:g}")
        track = x.select("part", "rank", F.col("gc").alias("covariate")).distinct()
        s = x.select("unit", "sample", "part", "rank", "value")
        raw, clean = lag.lag_profile(s, 40), lag.lag_profile(resid.remove_trend(s, resid.trend_basis(s, track)), 40)
        cols = []
        for name, p in (("naive", raw), ("corrected", clean)):
            first = p.where("lag = 1").select("unit", (F.col("correlation") * 0.05).alias("floor"))
            cols.append(lag.decay_length(p.join(F.broadcast(first), "unit"), ["unit"], "lag", "correlation", F.col("floor"), 40, 4).select("unit", F.round("decay_length", 6).alias(name)))
        one = cols[0].join(cols[1], "unit")
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------------------------------ stores


@query(
    """WITH old AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer), new AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier)
  SELECT k, v FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT k, v FROM new"""
)
def upserted_rows(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return store.upserted(old, new, ["k"])


@query(
    """SELECT c_nationkey AS unit, c_custkey AS k FROM customer WHERE c_nationkey NOT IN (1, 3, 5) UNION ALL SELECT s_nationkey, s_suppkey FROM supplier WHERE s_nationkey IN (1, 3)"""
)
def replaced_groups(spark, d):
    old = table(spark, d, "customer").select(F.col("c_nationkey").alias("unit"), F.col("c_custkey").alias("k"))
    new = table(spark, d, "supplier").where("s_nationkey IN (1, 3)").select(F.col("s_nationkey").alias("unit"), F.col("s_suppkey").alias("k"))
    return store.replaced(old, new, "unit", [1, 3, 5])


