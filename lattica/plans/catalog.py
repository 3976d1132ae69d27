"""Query catalogue I: signals, lags, spectra, residuals, bins, ranks and aggregates, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import bins
from lattica.functions.keys import leading_tokens
from lattica.operators import lag, ranks, regress, resid, spectral
from lattica.operators import signal as sig
from lattica.plans import views as V
from lattica.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin if SQL can express it."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def r6(*cols: str) -> list:
    return [F.round(c, 6).alias(c) for c in cols]


NORM = f"""WITH {V.SIGNAL},
  good AS (SELECT unit, part, rank FROM signal GROUP BY 1, 2, 3 HAVING median(value) >= 10),
  kept AS (SELECT s.* FROM signal s JOIN good USING (unit, part, rank)),
  lib AS (SELECT unit, sample, sum(value) AS l FROM kept GROUP BY 1, 2),
  norm AS (SELECT k.unit, k.sample, k.part, k.rank, log2(k.value / nullif(l, 0) * 1e6 + 1) AS value FROM kept k JOIN lib USING (unit, sample))"""


def _norm(spark: SparkSession, d: str) -> DataFrame:
    return sig.log2_cpm(sig.expressed(V.signal(spark, d), 10))


# ------------------------------------------------------------------------------------------ signals


@query(NORM + " SELECT unit, part, rank, count(*) AS samples, round(avg(value), 6) AS mean, round(max(value), 6) AS top FROM norm GROUP BY 1, 2, 3")
def log2_cpm(spark, d):
    return _norm(spark, d).groupBy("unit", "part", "rank").agg(F.count("*").alias("samples"), F.avg("value").alias("mean"), F.max("value").alias("top")).select("unit", "part", "rank", "samples", *r6("mean", "top"))


@query(
    NORM
    + """, s AS (SELECT unit, sample, avg(value) AS m FROM norm GROUP BY 1, 2), c AS (SELECT n.unit, n.sample, n.part, n.rank, n.value - s.m AS centered FROM norm n JOIN s USING (unit, sample)),
  p AS (SELECT unit, part, rank, avg(centered) AS mean FROM c GROUP BY 1, 2, 3)
  SELECT c.unit, c.sample, c.part, c.rank, round(centered, 6) AS centered, round(mean, 6) AS mean, round(centered - mean, 6) AS dev FROM c JOIN p USING (unit, part, rank)"""
)
def two_way_center(spark, d):
    return sig.two_way_center(_norm(spark, d)).select("unit", "sample", "part", "rank", *r6("centered", "mean", "dev"))


@query(
    f"""WITH {V.MATRIX}, s AS (SELECT unit, part, rank, avg(value) AS m, stddev_pop(value) AS sd FROM matrix GROUP BY 1, 2, 3)
  SELECT x.unit, x.sample, x.part, x.rank, round((value - m) / (sd + 1e-9), 6) AS z FROM matrix x JOIN s USING (unit, part, rank)"""
)
def zscore_rows(spark, d):
    return sig.zscore(V.matrix(spark, d), "value", sig.POSITION).select("unit", "sample", "part", "rank", *r6("z"))


@query(
    f"""WITH {V.GENES}, g AS (SELECT gene, part, gc FROM genes WHERE gc IS NOT NULL AND NOT isnan(gc) AND part IS NOT NULL),
  s AS (SELECT part, avg(gc) AS m, stddev_pop(gc) AS s0, stddev_samp(gc) AS s1 FROM g GROUP BY part)
  SELECT g.gene, round((gc - m) / nullif(s0, 0), 6) AS z0, round((gc - m) / nullif(s1, 0), 6) AS z1 FROM g JOIN s USING (part)"""
)
def standardise_covariate(spark, d):
    g = V.genes(spark, d).where("gc IS NOT NULL AND NOT isnan(gc) AND part IS NOT NULL").select("gene", "part", "gc")
    z = sig.zscore(sig.zscore(g, "gc", ["part"], "z0", 0, 0.0), "gc", ["part"], "z1", 1, 0.0)
    return z.select("gene", *r6("z0", "z1"))


@query(
    f"""WITH {V.SIGNAL}, a AS (SELECT DISTINCT {V.KEY.format("sample_id")} AS sample FROM sample_attr WHERE sample_id IS NOT NULL AND rin IS NOT NULL),
  k AS (SELECT s.* FROM signal s WHERE sample IN (SELECT sample FROM a)), u AS (SELECT unit FROM k GROUP BY unit HAVING count(DISTINCT sample) >= 10)
  SELECT unit, count(DISTINCT sample) AS samples, count(*) AS n_values FROM k WHERE unit IN (SELECT unit FROM u) GROUP BY unit"""
)
def eligible_samples(spark, d):
    attr = table(spark, d, "sample_attr").select(V.canonical_key(F.col("sample_id")).alias("key"), "rin").where("key IS NOT NULL")
    return sig.eligible_samples(V.signal(spark, d), attr, "key", ["rin"], 10).groupBy("unit").agg(F.count_distinct("sample").alias("samples"), F.count("*").alias("n_values"))


@query(f"WITH {V.SIGNAL} SELECT unit, part, rank, round(median(value), 6) AS median FROM signal GROUP BY 1, 2, 3 HAVING median(value) >= 10")
def expressed_positions(spark, d):
    return sig.expressed(V.signal(spark, d), 10).groupBy("unit", "part", "rank").agg(F.median("value").alias("median")).select("unit", "part", "rank", *r6("median"))


@query(
    f"""WITH {V.SIGNAL}, a AS (SELECT unit, part, rank, median(value) AS med FROM signal GROUP BY 1, 2, 3), b AS (SELECT s.*, med FROM signal s JOIN a USING (unit, part, rank)),
  c AS (SELECT unit, part, rank, median(abs(value - med)) AS mad FROM b GROUP BY 1, 2, 3)
  SELECT b.unit, b.sample, b.part, b.rank, round((value - med) / (mad * 1.4826 + 1e-6), 4) AS scaled FROM b JOIN c USING (unit, part, rank) WHERE mad > 0"""
)
def median_mad_scale(spark, d):
    s = sig.robust_scale(V.signal(spark, d), "value", sig.POSITION)
    # a MAD of zero leaves values over the epsilon alone: left out
    flat = s.groupBy(*sig.POSITION).agg(F.median(F.abs("scaled")).alias("m")).where("m > 0").select(*sig.POSITION)
    return s.join(flat, sig.POSITION, "left_semi").select("unit", "sample", "part", "rank", F.round("scaled", 4).alias("scaled"))


@query(f"""WITH {V.SIGNAL} SELECT unit, count(DISTINCT array_to_string((string_split(sample, '-'))[1:2], '-')) AS donors, count(DISTINCT sample) AS samples FROM signal GROUP BY unit""")
def donors_per_unit(spark, d):
    return V.signal(spark, d).groupBy("unit").agg(F.count_distinct(leading_tokens(F.col("sample"), 2)).alias("donors"), F.count_distinct("sample").alias("samples"))


@query(f"""WITH {V.GENES} SELECT gene, part, CASE WHEN strand IN ('+', '1') THEN start ELSE "end" END AS tss FROM genes WHERE part IS NOT NULL AND start IS NOT NULL""")
def strand_starts(spark, d):
    g = V.genes(spark, d).where("part IS NOT NULL AND start IS NOT NULL")
    return g.select("gene", "part", sig.strand_start(F.col("start"), F.col("end"), F.col("strand")).alias("tss"))


# fixed values: stems and suffixes of gene names that mark families, clusters and read-through genes
CLUSTER_STEMS = ["YAXB", "ZORT", "WOZT", "QUSN"]
_STEM = "^([A-Z]+)\\d"


@query(
    f"""WITH {V.GENES}, n AS (SELECT part, gene, gene_name, start, lead(gene_name) OVER (PARTITION BY part ORDER BY start, gene) AS next_name,
    lead(gene) OVER (PARTITION BY part ORDER BY start, gene) AS next_gene FROM genes WHERE part IS NOT NULL AND start IS NOT NULL)
  SELECT gene, next_gene, coalesce(nullif(regexp_extract(gene_name, '{_STEM}', 1), '') = nullif(regexp_extract(next_name, '{_STEM}', 1), ''), false) AS same_stem,
    coalesce(regexp_matches(gene_name, '^({"|".join(CLUSTER_STEMS)})') AND regexp_matches(next_name, '^({"|".join(CLUSTER_STEMS)})'), false) AS cluster,
    coalesce(contains(gene_name, '-') OR contains(next_name, '-'), false) AS read_through FROM n WHERE next_gene IS NOT NULL"""
)
def family_flags(spark, d):
    g = V.genes(spark, d).where("part IS NOT NULL AND start IS NOT NULL")
    p = lag.adjacent_pairs(g, ["part"], ["start", "gene"], ["gene", "gene_name"])
    stem = lambda c: F.nullif(F.regexp_extract(c, _STEM, 1), F.lit(""))
    family = f"^({'|'.join(CLUSTER_STEMS)})"
    flag = lambda c: F.coalesce(c, F.lit(False))
    return p.select(
        F.col("gene1").alias("gene"), F.col("gene2").alias("next_gene"), flag(stem("gene_name1") == stem("gene_name2")).alias("same_stem"),
        flag(F.col("gene_name1").rlike(family) & F.col("gene_name2").rlike(family)).alias("cluster"), flag(F.contains("gene_name1", F.lit("-")) | F.contains("gene_name2", F.lit("-"))).alias("read_through"),
    )


_NONCODING = ["synonymous_variant", "intron_variant", "3_prime_UTR_variant", "5_prime_UTR_variant", "upstream_gene_variant", "downstream_gene_variant", "intergenic_variant", "non_coding_transcript_exon_variant"]
_TRUNC = "stop_gained|frameshift|splice_acceptor|splice_donor"


@query(
    f"""SELECT chrom, count(*) AS n_pass, sum(CASE WHEN effect NOT IN ({", ".join(f"'{x}'" for x in _NONCODING)}) THEN 1 ELSE 0 END)::bigint AS n_coding,
  sum(CASE WHEN effect NOT IN ({", ".join(f"'{x}'" for x in _NONCODING)}) AND regexp_matches(effect, '{_TRUNC}') THEN 1 ELSE 0 END)::bigint AS n_truncating FROM mutation WHERE upper(trim(filter_status)) = 'PASS' GROUP BY chrom"""
)
def mutation_classes(spark, d):
    m = table(spark, d, "mutation").where(F.upper(F.trim("filter_status")) == "PASS")
    coding = ~F.col("effect").isin(*_NONCODING)
    return m.groupBy("chrom").agg(F.count("*").alias("n_pass"), F.count_if(coding).alias("n_coding"), F.count_if(coding & F.col("effect").rlike(_TRUNC)).alias("n_truncating"))


@query("SELECT substr(sample_id, 14, 2) AS code, substr(sample_id, 14, 2) IN ('01', '03') AS primary_tumour, count(*) AS n FROM mutation WHERE sample_id IS NOT NULL GROUP BY 1, 2")
def sample_types(spark, d):
    m = table(spark, d, "mutation").where("sample_id IS NOT NULL")
    return m.groupBy(F.substring("sample_id", 14, 2).alias("code"), sig.sample_type(F.col("sample_id"), ["01", "03"]).alias("primary_tumour")).agg(F.count("*").alias("n"))


@query(
    """WITH b AS (SELECT sample_id, log10(count(*) + 1) AS log_tmb FROM mutation WHERE sample_id IS NOT NULL GROUP BY 1), t AS (SELECT quantile_cont(log_tmb, 0.9) AS cut FROM b)
  SELECT sample_id, round(log_tmb, 6) AS log_tmb FROM b, t WHERE log_tmb <= cut"""
)
def hypermutators_out(spark, d):
    b = table(spark, d, "mutation").where("sample_id IS NOT NULL").groupBy("sample_id").agg(F.log10(F.count("*") + 1).alias("log_tmb"))
    cut = b.agg(F.percentile("log_tmb", 0.9).alias("cut"))
    return b.crossJoin(F.broadcast(cut)).where("log_tmb <= cut").select("sample_id", *r6("log_tmb"))  # cut is one row


@query(
    f"""WITH {V.PAIRS} SELECT row_id, round(log2(contact_kr / expected_kr + 0.05), 6) AS log_oe, round(log10(tss_distance), 6) AS log_d, round(log10(contact_kr + 0.1), 6) AS log_c,
  round(least(greatest(r, -0.2), 0.2), 6) AS r_clipped FROM pairs WHERE bin_distance > 0 AND expected_kr > 0 AND contact_kr IS NOT NULL"""
)
def contact_transforms(spark, d):
    p = V.pairs(spark, d).where("bin_distance > 0 AND expected_kr > 0 AND contact_kr IS NOT NULL")
    clip = F.when(F.col("r").isNotNull(), F.least(F.greatest("r", F.lit(-0.2)), F.lit(0.2)))
    return p.select("row_id", F.log2(F.col("contact_kr") / F.col("expected_kr") + 0.05).alias("log_oe"), F.log10("tss_distance").alias("log_d"), F.log10(F.col("contact_kr") + 0.1).alias("log_c"), clip.alias("r_clipped")).select("row_id", *r6("log_oe", "log_d", "log_c", "r_clipped"))


SQL["contact_transforms"] = SQL["contact_transforms"].replace("round(least(greatest(r, -0.2), 0.2), 6)", "CASE WHEN r IS NOT NULL THEN round(least(greatest(r, -0.2), 0.2), 6) END")


@query(
    NORM
    + f""", {V.GENES}, pos AS (SELECT DISTINCT {V.GENE.format("gene_id")} AS gene, unit, chr AS part, gene_rank AS rank FROM expr_signal),
  nm AS (SELECT DISTINCT unit, pos.part, rank, regexp_extract(gene_name, '{_STEM}', 1) AS name FROM pos JOIN genes USING (gene) WHERE gene_name IS NOT NULL),
  l AS (SELECT n.*, name FROM norm n JOIN nm USING (unit, part, rank) WHERE name IN ('YAXBA','YAXBB','YAXBC','YAXBJ','ZORTA','ZORTB','ZORTG','ZORTN')),
  s AS (SELECT unit, part, rank, avg(value) AS m, stddev_pop(value) AS sd FROM l GROUP BY 1, 2, 3)
  SELECT l.unit, l.sample, round(avg(CASE WHEN name LIKE 'YAXB%' THEN (value - m) / (sd + 1e-9) END) - avg(CASE WHEN name LIKE 'ZORT%' THEN (value - m) / (sd + 1e-9) END), 6) AS score
  FROM l JOIN s USING (unit, part, rank) GROUP BY 1, 2"""
)
def signature_score(spark, d):
    pos = table(spark, d, "expr_signal").select(V.canonical_gene(F.col("gene_id")).alias("gene"), "unit", F.col("chr").alias("part"), F.col("gene_rank").alias("rank")).distinct()
    names = pos.join(V.genes(spark, d).where("gene_name IS NOT NULL").select("gene", "gene_name"), "gene").select("unit", "part", "rank", F.regexp_extract("gene_name", _STEM, 1).alias("name")).distinct()
    up, down = ["YAXBA", "YAXBB", "YAXBC", "YAXBJ"], ["ZORTA", "ZORTB", "ZORTG", "ZORTN"]
    return sig.signature_score(_norm(spark, d), names, up, down).select("unit", "sample", *r6("score"))


@query(
    """WITH a AS (SELECT row_id, rin, ischaemic, coalesce(batch_na, 'nan') AS b FROM sample_attr WHERE rin IS NOT NULL), m AS (SELECT coalesce(median(ischaemic), 0) AS med FROM a)
  SELECT row_id AS sample, rin, rin * rin AS rin_sq, coalesce(ischaemic, med) AS ischaemic_imp, cast(b = 'BP-20010' AS double) AS "batch_na=BP-20010" FROM a, m"""
)
def technical_design(spark, d):
    a = table(spark, d, "sample_attr").where("rin IS NOT NULL").withColumn("sample", F.col("row_id"))
    return sig.design_matrix(a, ["rin"], ["rin"], ["ischaemic"], {"batch_na": ["BP-20005", "BP-20010"]})


# ------------------------------------------------------------------------------------------ lags

_DIST = [float("-inf"), 0, 1e3, 5e3, 2e4, 1e5, 5e5, float("inf")]
_DIST_NAMES = ["overlap", "0-1kb", "1-5kb", "5-20kb", "20-100kb", "100-500kb", ">500kb"]
_ADJ = f"""{V.GENES}, adj AS (SELECT * FROM (SELECT part, gene AS g1, strand AS s1, biotype AS b1, "end" AS e1, start AS st1, gc AS gc1, lead(gene) OVER w AS g2, lead(strand) OVER w AS s2, lead(biotype) OVER w AS b2,
    lead(start) OVER w AS st2, lead(gc) OVER w AS gc2 FROM genes WHERE part IS NOT NULL AND start IS NOT NULL WINDOW w AS (PARTITION BY part ORDER BY start, gene)) a WHERE g2 IS NOT NULL)"""
_ORI = "CASE WHEN s1 = s2 THEN 'tandem' WHEN s1 <> '+' AND s2 = '+' THEN 'divergent' WHEN s1 = '+' AND s2 <> '+' THEN 'convergent' END"
_BIN = "CASE WHEN dist <= 0 THEN 'overlap' WHEN dist <= 1e3 THEN '0-1kb' WHEN dist <= 5e3 THEN '1-5kb' WHEN dist <= 2e4 THEN '5-20kb' WHEN dist <= 1e5 THEN '20-100kb' WHEN dist <= 5e5 THEN '100-500kb' ELSE '>500kb' END"


def _adjacent(spark: SparkSession, d: str) -> DataFrame:
    g = V.genes(spark, d).where("part IS NOT NULL AND start IS NOT NULL")
    p = lag.adjacent_pairs(g, ["part"], ["start", "gene"], ["gene", "start", "end", "strand", "biotype", "gc"])
    return p.withColumn("dist", F.col("start2") - F.col("end1")).withColumn("orientation", bins.orientation(F.col("strand1"), F.col("strand2")))


@query(f"""WITH {_ADJ} SELECT part, g1, g2, st2 - e1 AS dist, {_ORI} AS orientation, b1 = 'protein_coding' AND b2 = 'protein_coding' AS pc FROM adj""")
def adjacent_pairs(spark, d):
    p = _adjacent(spark, d)
    return p.select("part", F.col("gene1").alias("g1"), F.col("gene2").alias("g2"), "dist", "orientation", ((F.col("biotype1") == "protein_coding") & (F.col("biotype2") == "protein_coding")).alias("pc"))


@query(
    f"""WITH {_ADJ}, x AS (SELECT *, st2 - e1 AS dist, {_ORI} AS orientation FROM adj)
  SELECT orientation, {_BIN} AS dist_bin, count(*) AS n_pairs, round(avg(gc1 * gc2), 6) AS mean_product FROM x GROUP BY 1, 2"""
)
def orientation_distance_bins(spark, d):
    p = _adjacent(spark, d).withColumn("dist_bin", bins.cut(F.col("dist"), _DIST, _DIST_NAMES))
    return p.groupBy("orientation", "dist_bin").agg(F.count("*").alias("n_pairs"), F.round(F.avg(F.col("gc1") * F.col("gc2")), 6).alias("mean_product"))


@query(
    f"""WITH {V.GENES} SELECT * FROM (SELECT part, gene AS gi, lead(gene, 1) OVER w AS gk, lead(gene, 2) OVER w AS gj, lead(start, 2) OVER w - "end" AS dist,
    lead("end", 1) OVER w - lead(start, 1) OVER w AS between FROM genes WHERE part IS NOT NULL AND start IS NOT NULL WINDOW w AS (PARTITION BY part ORDER BY start, gene)) t WHERE gj IS NOT NULL"""
)
def triples_between(spark, d):
    g = V.genes(spark, d).where("part IS NOT NULL AND start IS NOT NULL")
    t = lag.triples(g, ["part"], ["start", "gene"], ["gene", "start", "end"])
    return t.select("part", F.col("gene1").alias("gi"), F.col("gene2").alias("gk"), F.col("gene3").alias("gj"), (F.col("start3") - F.col("end1")).alias("dist"), (F.col("end2") - F.col("start2")).alias("between"))


@query(
    f"""WITH {V.MATRIX}, s AS (SELECT unit, part, rank, avg(value) AS m, stddev_pop(value) AS sd FROM matrix GROUP BY 1, 2, 3),
  z AS (SELECT x.unit, x.sample, x.part, x.rank, (value - m) / (sd + 1e-12) AS z FROM matrix x JOIN s USING (unit, part, rank)),
  l AS (SELECT cast(unnest(range(0, 18)) AS int) AS lag), g AS (SELECT DISTINCT unit, lag FROM z, l),
  p AS (SELECT a.unit, l.lag, avg(a.z * b.z) AS c, count(*) AS n FROM z a JOIN l ON true JOIN z b ON a.unit = b.unit AND a.sample = b.sample AND a.part = b.part AND b.rank = a.rank + l.lag GROUP BY 1, 2)
  SELECT g.unit, g.lag, round(c, 6) AS correlation, coalesce(n, 0) AS pairs FROM g LEFT JOIN p ON g.unit = p.unit AND g.lag = p.lag"""
)
def lag_profile(spark, d):
    return lag.lag_profile(V.matrix(spark, d), 17).select("unit", "lag", *r6("correlation"), "pairs")


@query(
    f"""WITH {V.MATRIX}, s AS (SELECT unit, part, rank, avg(value) AS m FROM matrix GROUP BY 1, 2, 3), y AS (SELECT x.unit, x.sample, x.part, x.rank, value - m AS v FROM matrix x JOIN s USING (unit, part, rank)),
  l AS (SELECT cast(unnest(range(0, 9)) AS int) AS lag), c AS (SELECT a.unit, a.part, a.sample, l.lag, sum(a.v * b.v) AS c FROM y a JOIN l ON true
   JOIN y b ON a.unit = b.unit AND a.sample = b.sample AND a.part = b.part AND b.rank = (a.rank + l.lag) % 16 GROUP BY 1, 2, 3, 4)
  SELECT unit, part, lag, round(avg(c), 8) AS covariance FROM c GROUP BY 1, 2, 3"""
)
def lag_covariance_circular(spark, d):
    x = sig.remove_group_means(V.matrix(spark, d), "value", sig.POSITION, "dev")
    return lag.lag_covariance(x, 9).select("unit", "part", "lag", F.round("covariance", 8).alias("covariance"))


@query(
    f"""WITH {V.MATRIX}, s AS (SELECT unit, part, rank, avg(value) AS m, stddev_pop(value) AS sd FROM matrix GROUP BY 1, 2, 3),
  z AS (SELECT x.unit, x.sample, x.part, x.rank, (value - m) / (sd + 1e-9) AS z FROM matrix x JOIN s USING (unit, part, rank)), l AS (SELECT unnest([1, 2, 3, 8, 10]) AS lag),
  p AS (SELECT a.unit, a.sample, l.lag, avg(a.z * b.z) AS m FROM z a JOIN l ON true JOIN z b ON a.unit = b.unit AND a.sample = b.sample AND a.part = b.part AND b.rank = a.rank + l.lag GROUP BY 1, 2, 3),
  n AS (SELECT unit, sample, avg(m) FILTER (lag <= 3) AS near, avg(m) FILTER (lag > 3) AS far FROM p GROUP BY 1, 2)
  SELECT unit, sample, round(near, 6) AS near, round(far, 6) AS far, round(near - far, 6) AS cis_excess FROM n"""
)
def lag_scores(spark, d):
    return lag.lag_scores(V.matrix(spark, d), (1, 2, 3), (8, 10)).select("unit", "sample", *r6("near", "far", "cis_excess"))


@query()
def lag_excess_shuffled(spark, d):
    return lag.lag_excess(V.matrix(spark, d), [1, 2, 3, 5, 7], 3).select("unit", "lag", *r6("observed", "shuffled", "excess"))


@query(
    NORM
    + """, s AS (SELECT unit, part, rank, avg(value) AS m, stddev_pop(value) AS sd FROM norm GROUP BY 1, 2, 3), z AS (SELECT n.unit, n.sample, n.part, n.rank, (value - m) / (sd + 1e-9) AS z FROM norm n JOIN s USING (unit, part, rank))
  SELECT a.unit, a.part, a.rank AS rank1, b.rank AS rank2, round(avg(a.z * b.z), 6) AS r, count(*) AS n_samples FROM z a JOIN z b ON a.unit = b.unit AND a.sample = b.sample AND a.part = b.part AND b.rank = a.rank + 1
  GROUP BY 1, 2, 3, 4"""
)
def neighbour_correlations(spark, d):
    return lag.neighbour_correlations(_norm(spark, d)).select("unit", "part", "rank1", "rank2", *r6("r"), F.col("n_samples").cast("bigint").alias("n_samples"))


@query(SQL["neighbour_correlations"].replace("b.rank = a.rank + 1", "b.rank = a.rank + 2"))
def pair_correlations(spark, d):
    """Positions two ranks apart, as given pairs."""
    n = _norm(spark, d)
    pairs = n.select(*sig.POSITION).distinct().select("unit", "part", F.col("rank").alias("rank1"), (F.col("rank") + 2).alias("rank2"))
    return lag.pair_correlations(n, pairs).where("n_samples > 0").select("unit", "part", "rank1", "rank2", *r6("r"), F.col("n_samples").cast("bigint").alias("n_samples"))


# ------------------------------------------------------------------------------------------ spectra

_DFT = """k AS (SELECT cast(unnest(range(0, 9)) AS int) AS k), {name} AS (SELECT unit, part, sample, k, pow(sum(value * cos(-2 * pi() * k * rank / 16)), 2) + pow(sum(value * sin(-2 * pi() * k * rank / 16)), 2) AS power FROM {source}, k GROUP BY 1, 2, 3, 4)"""


@query(
    f"""WITH {V.MATRIX}, m AS (SELECT unit, part, rank, 0 AS sample, avg(value) AS value FROM matrix GROUP BY 1, 2, 3), y AS (SELECT x.unit, x.part, x.sample, x.rank, x.value - m.value AS value FROM matrix x JOIN m USING (unit, part, rank)),
  {_DFT.format(name="px", source="matrix")}, {_DFT.format(name="pm", source="m").split("), ", 1)[1]}, {_DFT.format(name="py", source="y").split("), ", 1)[1]}
  SELECT a.unit, a.part, a.k, round(a.p, 6) AS mean_periodogram, round(b.p, 6) AS landscape, round(c.p, 6) AS covariance, abs(a.p - b.p - c.p) / (abs(a.p) + 1e-12) < 1e-8 AS exact FROM
  (SELECT unit, part, k, avg(power) AS p FROM px GROUP BY 1, 2, 3) a JOIN (SELECT unit, part, k, avg(power) AS p FROM pm GROUP BY 1, 2, 3) b USING (unit, part, k) JOIN (SELECT unit, part, k, avg(power) AS p FROM py GROUP BY 1, 2, 3) c USING (unit, part, k)"""
)
def periodogram_identity(spark, d):
    got = spectral.periodogram_identity(V.matrix(spark, d))
    return got.select("unit", "part", "k", *r6("mean_periodogram", "landscape", "covariance"), (F.col("relative_error") < 1e-8).alias("exact"))


@query(
    f"""WITH {V.MATRIX}, p AS (SELECT unit, part, rank, avg(value) AS m, count(*) AS n, var_pop(value) AS v FROM matrix GROUP BY 1, 2, 3)
  SELECT unit, round(sum(n * m * m) / sum(n * m * m + n * v), 8) AS share FROM p GROUP BY unit"""
)
def landscape_share(spark, d):
    return spectral.landscape_share(V.matrix(spark, d)).select("unit", F.round("share", 8).alias("share"))


_WHITE = f"""{V.MATRIX}, {_DFT.format(name="px", source="matrix")}, w0 AS (SELECT *, log10(k / 16.0) AS lx, log10(power + 1e-12) AS ly FROM px WHERE k >= 1),
  ln AS (SELECT unit, part, sample, regr_slope(ly, lx) AS b, regr_intercept(ly, lx) AS a FROM w0 GROUP BY 1, 2, 3), w1 AS (SELECT w0.unit, w0.part, w0.sample, k, power / pow(10, b * lx + a) AS w FROM w0 JOIN ln USING (unit, part, sample)),
  mm AS (SELECT unit, part, sample, avg(w) AS m FROM w1 GROUP BY 1, 2, 3), white AS (SELECT w1.unit, w1.part, w1.sample, k, w / m AS white FROM w1 JOIN mm USING (unit, part, sample))"""


@query(f"WITH {_WHITE} SELECT unit, part, k, count(*) AS samples, sum(CASE WHEN white > 1 THEN 1 ELSE 0 END)::bigint AS hits, 10 * sum(CASE WHEN white > 1 THEN 1 ELSE 0 END) >= 4 * count(*) AS universal FROM white GROUP BY 1, 2, 3")
def universal_peaks(spark, d):
    w = spectral.whiten(spectral.dft(lag.as_arrays(V.matrix(spark, d))))
    return spectral.universal_peaks(w, 1.0, 4)


@query(f"WITH {_WHITE} SELECT unit, part, k, round(exp(avg(ln(white)) + 0.5772156649015329), 6) AS consensus FROM white WHERE white > 0 GROUP BY 1, 2, 3")
def spectral_consensus(spark, d):
    w = spectral.whiten(spectral.periodogram(lag.as_arrays(V.matrix(spark, d))))
    return spectral.consensus(w).select("unit", "part", "k", *r6("consensus"))


@query(
    f"""WITH {V.MATRIX}, {_DFT.format(name="px", source="matrix")}, b AS (SELECT unit, cast(floor((log10(k / 16.0) - log10(0.06)) / ((log10(0.6) - log10(0.06)) / 4)) AS int) AS bin, power / 16 AS p FROM px WHERE k >= 1)
  SELECT unit, bin, count(*) AS n, round(avg(p), 8) AS power FROM b WHERE bin >= 0 AND bin < 4 GROUP BY 1, 2"""
)
def log_binned_spectrum(spark, d):
    p = spectral.periodogram(lag.as_arrays(V.matrix(spark, d)), drop_zero=True).withColumn("bin", bins.log_bin(F.col("k") / F.col("n"), 0.06, 0.6, 4))
    return p.where("bin IS NOT NULL").groupBy("unit", "bin").agg(F.count("*").alias("n"), F.round(F.avg(F.col("power") / F.col("n")), 8).alias("power"))


@query()
def red_noise_peaks(spark, d):
    m = V.matrix(spark, d).groupBy("unit", "part", "rank").agg(F.avg("value").alias("value")).withColumn("sample", F.lit("mean"))
    return spectral.red_noise_peaks(lag.as_arrays(m)).select("unit", "part", "k", *r6("power", "threshold"), "peak")


# ------------------------------------------------------------------------------------------ residuals

_TRACK = """track AS (SELECT part, rank, sin(1.0 + part * 16 + rank) AS covariate FROM (SELECT DISTINCT part, rank FROM matrix) t)"""


def _track(spark: SparkSession, d: str) -> DataFrame:
    return V.matrix(spark, d).select("part", "rank").distinct().withColumn("covariate", F.sin(1.0 + F.col("part") * 16 + F.col("rank")))


@query(
    f"""WITH {V.MATRIX}, {_TRACK}, x AS (SELECT m.*, covariate AS g FROM matrix m JOIN track USING (part, rank)), s AS (SELECT unit, stddev_pop(g) AS sd FROM (SELECT DISTINCT unit, part, rank, g FROM x) d GROUP BY unit)
  SELECT x.unit, sample, round(regr_slope(value, g) * max(sd), 8) AS slope FROM x JOIN s ON x.unit = s.unit GROUP BY x.unit, sample"""
)
def covariate_slopes(spark, d):
    return resid.covariate_slopes(V.matrix(spark, d), _track(spark, d)).select("unit", "sample", F.round("slope", 8).alias("slope"))


@query(
    f"""WITH {V.MATRIX}, {_TRACK}, x AS (SELECT m.*, covariate AS g FROM matrix m JOIN track USING (part, rank)), c AS (SELECT unit, sample, regr_slope(value, g) AS b, regr_intercept(value, g) AS a FROM x GROUP BY 1, 2)
  SELECT x.unit, x.sample, x.part, x.rank, round(value - a - b * g, 6) AS value FROM x JOIN c USING (unit, sample)"""
)
def covariate_trend_removed(spark, d):
    x = V.matrix(spark, d)
    return resid.remove_trend(x, resid.trend_basis(x, _track(spark, d), 1)).select("unit", "sample", "part", "rank", *r6("value"))


@query(
    f"""WITH {V.MATRIX}, {_TRACK}, x AS (SELECT m.*, covariate AS g FROM matrix m JOIN track USING (part, rank)), s AS (SELECT unit, avg(g) AS gm, stddev_pop(g) AS gs FROM (SELECT DISTINCT unit, part, rank, g FROM x) d GROUP BY unit),
  sl AS (SELECT x.unit, sample, regr_slope(value, g) * max(gs) AS b FROM x JOIN s ON x.unit = s.unit GROUP BY x.unit, sample), vb AS (SELECT unit, var_pop(b) AS vb FROM sl GROUP BY unit),
  p AS (SELECT x.unit, x.part, x.rank, (max(g) - max(gm)) / max(gs) AS gz, stddev_pop(value) AS sd FROM x JOIN s ON x.unit = s.unit GROUP BY 1, 2, 3), l AS (SELECT unnest([1, 2, 5]) AS lag)
  SELECT a.unit, l.lag, round(avg(vb * a.gz * b.gz / (a.sd * b.sd)), 8) AS predicted FROM p a JOIN l ON true JOIN p b ON a.unit = b.unit AND a.part = b.part AND b.rank = a.rank + l.lag JOIN vb ON vb.unit = a.unit GROUP BY 1, 2"""
)
def covariate_layer_by_lag(spark, d):
    from lattica.operators.pairs import gc_layer_correlation

    x, t = V.matrix(spark, d), _track(spark, d)
    var_b = resid.covariate_slopes(x, t).groupBy("unit").agg(F.var_pop("slope").alias("vb"))
    pos = x.groupBy(*sig.POSITION).agg(F.stddev_pop("value").alias("sd")).join(t, ["part", "rank"])
    pos = sig.zscore(pos, "covariate", ["unit"], "gz", 0, 0.0)
    a = pos.select("unit", "part", "rank", F.col("gz").alias("gi"), F.col("sd").alias("si")).withColumn("lag", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5)))).withColumn("to", F.col("rank") + F.col("lag"))
    b = pos.select("unit", "part", F.col("rank").alias("to"), F.col("gz").alias("gj"), F.col("sd").alias("sj"))
    p = a.join(b, ["unit", "part", "to"]).join(F.broadcast(var_b), "unit")  # one row per unit
    value = gc_layer_correlation(F.col("vb"), F.col("gi"), F.col("gj"), F.col("si"), F.col("sj"))
    return p.groupBy("unit", "lag").agg(F.round(F.avg(value), 8).alias("predicted"))


@query(
    f"""WITH {V.MATRIX}, f AS (SELECT DISTINCT sample, cos(cast(sample AS double)) AS f FROM matrix), x AS (SELECT m.*, f FROM matrix m JOIN f USING (sample)), c AS (SELECT unit, part, rank, regr_slope(value, f) AS b, regr_intercept(value, f) AS a FROM x GROUP BY 1, 2, 3)
  SELECT x.unit, x.sample, x.part, x.rank, round(value - a - b * f, 6) AS value FROM x JOIN c USING (unit, part, rank)"""
)
def sample_factor_removed(spark, d):
    x = V.matrix(spark, d)
    f = x.select("sample").distinct().withColumn("f", F.cos(F.col("sample").cast("double")))
    return resid.remove_sample_factors(x, f, ["f"]).select("unit", "sample", "part", "rank", *r6("value"))


@query()
def components_removed(spark, d):
    x = resid.remove_components(sig.remove_group_means(V.matrix(spark, d), "value", sig.POSITION, "v").drop("value").withColumnRenamed("v", "value"), 3)
    return lag.lag_profile(x, 5).select("unit", "lag", *r6("correlation"), "pairs")


_DOSE = f"""{V.MATRIX}, dose AS (SELECT unit, sample, part, rank, lead(value) OVER (PARTITION BY unit, sample, part ORDER BY rank) AS dose FROM matrix), x AS (SELECT m.*, coalesce(dose, 0) AS dose FROM matrix m JOIN dose USING (unit, sample, part, rank))"""


@query(f"""WITH {_DOSE} SELECT unit, part, rank, CASE WHEN stddev_pop(dose) >= 1e-6 THEN round(regr_intercept(value, dose), 6) ELSE 0 END AS b0, CASE WHEN stddev_pop(dose) >= 1e-6 THEN round(regr_slope(value, dose), 6) ELSE 0 END AS b1 FROM x GROUP BY 1, 2, 3""")
def dosage_moments(spark, d):
    x = V.matrix(spark, d)
    dose = x.select("unit", "sample", "part", (F.col("rank") - 1).alias("rank"), F.col("value").alias("dose")).where("rank >= 0")
    return resid.own_dosage(x, dose, 1).select("unit", "part", "rank", *r6("b0", "b1"))


@query()
def dosage_residual_covariance(spark, d):
    """Out of sample: coefficients from half of the samples, covariances at lag one of fit and residual over
    the other half."""
    from lattica.operators.resample import ranked_halves

    x = ranked_halves(V.matrix(spark, d), "sample", ["unit"], 5)
    dose = x.select("unit", "sample", "part", (F.col("rank") - 1).alias("rank"), F.col("value").alias("dose")).where("rank >= 0")
    coef = resid.own_dosage(x.where("half = 0").drop("half"), dose, 2, ridge=1e-9)
    held = resid.apply_dosage(x.where("half = 1").drop("half"), dose, coef)
    out = None
    for name in ("value", "fitted", "residual"):
        c = sig.remove_group_means(held.select("unit", "sample", "part", "rank", F.col(name).alias("v")), "v", sig.POSITION, "dev")
        one = lag.lag_products(lag.as_arrays(c, "dev"), [1, 2]).groupBy("unit", "lag").agg(F.round(F.sum("total") / F.sum("pairs"), 8).alias(f"cov_{name}"))
        out = one if out is None else out.join(one, ["unit", "lag"])
    return out


@query()
def matrix_balance(spark, d):
    """The contacts of each chromosome of each map, between genes, balanced."""
    p = V.pairs(spark, d).where("contact_kr > 0 AND bin_distance >= 0 AND g1 IS NOT NULL AND g2 IS NOT NULL")
    cells = p.groupBy(F.struct("unit", "part").alias("map"), F.least("g1", "g2").alias("i"), F.greatest("g1", "g2").alias("j")).agg(F.sum("contact_kr").alias("v"))
    return resid.balance(cells, "map", 30).select("part.unit", "part.part", "i", "j", F.round("v", 6).alias("v"))


# ------------------------------------------------------------------------------------------ bins and ranks


@query(
    """WITH x AS (SELECT l_extendedprice AS v, l_quantity AS q FROM lineitem) SELECT CASE WHEN v > 0 AND v <= 1000 THEN '(0, 1000]' WHEN v > 1000 AND v <= 10000 THEN '(1000, 10000]' WHEN v > 10000 AND v <= 50000 THEN '(10000, 50000]' END AS bin,
  count(*) AS n, round(avg(q), 6) AS mean, round(median(q), 6) AS median FROM x GROUP BY 1"""
)
def cut_bins(spark, d):
    x = table(spark, d, "lineitem").withColumn("bin", bins.cut(F.col("l_extendedprice"), [0, 1000, 10000, 50000], ["(0, 1000]", "(1000, 10000]", "(10000, 50000]"]))
    return x.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.median("l_quantity"), 6).alias("median"))


@query(
    f"""WITH {V.PAIRS}, e AS (SELECT unit, quantile_cont(contact_kr, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM pairs GROUP BY unit), b AS (SELECT p.unit, r, CASE WHEN contact_kr <= q[2] THEN 0 WHEN contact_kr <= q[3] THEN 1 WHEN contact_kr <= q[4] THEN 2 WHEN contact_kr <= q[5] THEN 3 ELSE 4 END AS bin
    FROM pairs p JOIN e ON p.unit = e.unit WHERE contact_kr IS NOT NULL) SELECT unit, bin, count(*) AS n, round(avg(r), 12) AS mean_r FROM b GROUP BY 1, 2"""
)
def qcut_quintiles(spark, d):
    p = V.pairs(spark, d).where("contact_kr IS NOT NULL").select("unit", "contact_kr", "r")
    return bins.qcut(p, "contact_kr", 5, ["unit"]).groupBy("unit", "bin").agg(F.count("*").alias("n"), F.round(F.avg("r"), 12).alias("mean_r"))


_PCT = """(rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0)"""


@query(
    f"""WITH {V.PAIRS}, x AS (SELECT unit, part, r, {_PCT.format(by="unit, part", v="contact_kr")} / count(*) OVER (PARTITION BY unit, part) AS pct FROM pairs WHERE contact_kr IS NOT NULL)
  SELECT unit, part, cast(floor(least(5 * pct, 4.999)) AS int) AS quintile, count(*) AS n, round(avg(r), 12) AS mean_r FROM x GROUP BY 1, 2, 3"""
)
def pct_rank_strata(spark, d):
    p = V.pairs(spark, d).where("contact_kr IS NOT NULL").select("unit", "part", "contact_kr", "r")
    x = ranks.pct_rank(p, "contact_kr", ["unit", "part"]).withColumn("quintile", ranks.pct_bin(F.col("pct")))
    return x.groupBy("unit", "part", "quintile").agg(F.count("*").alias("n"), F.round(F.avg("r"), 12).alias("mean_r"))


_RR = """{a} AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0 AS ry FROM {src})"""


@query(f"""WITH {V.PAIRS}, s AS (SELECT unit, contact_kr AS x, r AS y FROM pairs WHERE contact_kr IS NOT NULL AND r IS NOT NULL), {_RR.format(a="k", by="unit", src="s")} SELECT unit, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM k GROUP BY unit""")
def spearman(spark, d):
    return ranks.spearman(V.pairs(spark, d), "contact_kr", "r", ["unit"]).select("unit", *r6("rho"), "n")


@query(
    """WITH p AS (SELECT event_id, event_type, round(1 / (1 + value), 4) AS p FROM events), k AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY p) + count(*) OVER (PARTITION BY event_type, p) - 1 AS rk, count(*) OVER (PARTITION BY event_type) AS m FROM p)
  SELECT event_id, round(least(min(p * m / rk) OVER (PARTITION BY event_type ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 9) AS q FROM k"""
)
def bh_fdr(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.round(1 / (1 + F.col("value")), 4).alias("p"))
    return ranks.benjamini_hochberg(e, "p", ["event_type"]).select("event_id", F.round("q", 9).alias("q"))


@query(
    f"""WITH {V.PAIRS}, m AS (SELECT part, avg(r) AS m FROM pairs WHERE r IS NOT NULL GROUP BY part), a AS (SELECT unit, r - m AS adj FROM pairs JOIN m USING (part) WHERE r IS NOT NULL) SELECT unit, count(*) AS n, round(avg(adj), 8) AS adjusted FROM a GROUP BY unit"""
)
def stratum_adjusted_means(spark, d):
    p = V.pairs(spark, d).where("r IS NOT NULL").select("unit", "part", "r")
    return sig.remove_group_means(p, "r", ["part"], "adj").groupBy("unit").agg(F.count("*").alias("n"), F.round(F.avg("adj"), 8).alias("adjusted"))


# ------------------------------------------------------------------------------------------ aggregates


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS low, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS high FROM lineitem GROUP BY 1""")
def describe_percentiles(spark, d):
    p = F.percentile("l_quantity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("mean"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.min("l_quantity").alias("low"), p.alias("p"), F.max("l_quantity").alias("high"))
    return g.select("l_returnflag", "n", "mean", "sd", "low", F.col("p")[0].alias("q1"), F.col("p")[1].alias("q2"), F.col("p")[2].alias("q3"), "high")


@query("""SELECT event_type, round(avg(value) FILTER (user_id % 3 = 0), 6) AS m0, round(avg(value) FILTER (user_id % 3 = 1), 6) AS m1, round(avg(value) FILTER (user_id % 3 = 2), 6) AS m2 FROM events GROUP BY 1""")
def pivot_means(spark, d):
    e = table(spark, d, "events").withColumn("k", F.pmod("user_id", F.lit(3)))
    p = e.groupBy("event_type").pivot("k", [0, 1, 2]).agg(F.round(F.avg("value"), 6))
    return p.select("event_type", *[F.col(str(k)).alias(f"m{k}") for k in range(3)])


@query(
    """WITH g AS (SELECT tissue, batch_na, count(*) AS n, sum(rin) AS s, sum(rin * rin) AS ss FROM sample_attr WHERE rin IS NOT NULL GROUP BY 1, 2), t AS (SELECT tissue, sum(s) / sum(n) AS grand FROM g GROUP BY 1)
  SELECT g.tissue, CASE WHEN count(*) > 1 THEN round(sum(n * pow(s / n - grand, 2)) / nullif(sum(ss - 2 * grand * s + n * grand * grand), 0), 6) END AS eta2, count(*) AS groups FROM g JOIN t ON g.tissue = t.tissue WHERE n >= 2 GROUP BY g.tissue"""
)
def eta2_batch(spark, d):
    return regress.eta_squared(table(spark, d, "sample_attr"), "rin", "batch_na", ["tissue"], 2).select("tissue", *r6("eta2"), "groups")


@query(
    """WITH g AS (SELECT event_type, user_id % 7 AS k, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS w FROM events GROUP BY 1, 2), s AS (SELECT event_type, sum(n) AS n, count(*) AS k, sum(w) AS w, sum(n * m) AS s, sum(n * m * m) AS q FROM g GROUP BY 1)
  SELECT event_type, round(((q - s * s / n) / (k - 1)) / (w / (n - k)), 6) AS f, k - 1 AS df1, (n - k)::bigint AS df2 FROM s"""
)
def anova_f(spark, d):
    e = table(spark, d, "events").withColumn("k", F.pmod("user_id", F.lit(7)))
    return regress.anova(e, "value", "k", ["event_type"]).select("event_type", *r6("f"), "df1", "df2")


@query(
    f"""WITH {V.PAIRS} SELECT unit, count(*) AS n, round(avg(CASE WHEN oe > 1 THEN 1.0 ELSE 0.0 END), 6) AS frac_above, round(avg(r) FILTER (oe > 1), 6) AS r_above, round(avg(r) FILTER (oe <= 1), 6) AS r_below, sum(CASE WHEN r < 0 THEN 1 ELSE 0 END)::bigint AS negative,
  round(sum(CASE WHEN oe < 1 AND r < 0 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN oe < 1 THEN 1 ELSE 0 END), 0), 6) AS concordance FROM pairs WHERE oe IS NOT NULL GROUP BY 1"""
)
def conditional_means(spark, d):
    p = V.pairs(spark, d).where("oe IS NOT NULL")
    above = F.col("oe") > 1
    return p.groupBy("unit").agg(
        F.count("*").alias("n"), F.round(F.avg(above.cast("double")), 6).alias("frac_above"), F.round(F.avg(F.when(above, F.col("r"))), 6).alias("r_above"), F.round(F.avg(F.when(F.col("oe") <= 1, F.col("r"))), 6).alias("r_below"),
        F.count_if(F.col("r") < 0).alias("negative"), F.round(regress.sign_concordance(F.col("oe") - 1, F.col("r")), 6).alias("concordance"),
    )


@query(f"""WITH {V.SIGNAL}, m AS (SELECT unit, part, avg(value) AS v FROM signal GROUP BY 1, 2) SELECT a.unit, a.part, 1 + sum(CASE WHEN b.v > a.v THEN 1 ELSE 0 END)::bigint AS own_rank, round(median(CASE WHEN b.unit <> a.unit THEN b.v END), 6) AS others FROM m a JOIN m b ON a.part = b.part GROUP BY a.unit, a.part, a.v""")
def own_unit_rank(spark, d):
    m = V.signal(spark, d).groupBy("unit", "part").agg(F.avg("value").alias("v"))
    b = m.select(F.col("unit").alias("other"), "part", F.col("v").alias("w"))  # units per part: a few dozen
    return m.join(b, "part").groupBy("unit", "part").agg((1 + F.count_if(F.col("w") > F.col("v"))).alias("own_rank"), F.round(F.median(F.when(F.col("other") != F.col("unit"), F.col("w"))), 6).alias("others"))


@query(
    f"""WITH {V.SIGNAL}, t AS (SELECT unit, sample, part, rank, row_number() OVER (PARTITION BY unit, sample ORDER BY value DESC, part, rank) AS k FROM signal), s AS (SELECT unit, sample, part, rank // 5 AS seg, count(*) AS n FROM t WHERE k <= 15 GROUP BY 1, 2, 3, 4)
  SELECT unit, sample, sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END)::bigint AS clustered, max(n) AS largest FROM s GROUP BY 1, 2"""
)
def topk_segment_clustering(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("unit", "sample").orderBy(F.desc("value"), "part", "rank")  # a sample's positions
    top = V.signal(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 15")
    s = top.groupBy("unit", "sample", "part", F.floor(F.col("rank") / 5).alias("seg")).agg(F.count("*").alias("n"))
    return s.groupBy("unit", "sample").agg(F.count_if(F.col("n") >= 2).alias("clustered"), F.max("n").alias("largest"))


@query("""SELECT user_id, min(ts) AS first_ts, arg_min(event_type, struct_pack(ts := ts, id := event_id)) AS first_type, max(value) AS top, arg_max(event_id, struct_pack(v := value, id := -event_id)) AS top_id, count(DISTINCT event_type) AS types, bool_or(value > 400) AS any_large FROM events GROUP BY 1""")
def first_and_best(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(
        F.min("ts").alias("first_ts"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.max("value").alias("top"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("top_id"),
        F.count_distinct("event_type").alias("types"), F.bool_or(F.col("value") > 400).alias("any_large"),
    )
