"""Query catalogue IV: filters, tests, resampling and simulations.  Results that depend on random draws are stated as
what must hold of every draw (the estimate, counts, order of bounds), which SQL can tell as well."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica import demo
from lattica.functions import bins
from lattica.functions.tails import normal_p
from lattica.operators import fit, interval, lag, pairs, regress, resample, resid, simulate, spectral, store
from lattica.operators import signal as sig
from lattica.plans import catalog, catalog_joins
from lattica.plans import views as V
from lattica.plans.catalog import NORM, _ADJ, _adjacent, _norm, query, r6
from lattica.session import own_folder, table

# Simpson's rule over the standard normal density from 0 to {z} (at most 9): the two-sided tail
_TAIL = """greatest(0, 1 - 2 * list_sum(list_transform(range(0, 801), lambda i: (CASE WHEN i IN (0, 800) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
  * exp(-0.5 * (least(abs({z}), 9) * i / 800) ** 2) / sqrt(2 * pi()))) * least(abs({z}), 9) / 2400)"""

# ------------------------------------------------------------------------------------------ filters and small columns


@query(NORM + " SELECT unit, part, rank, round(avg(greatest(pow(2, value) - 1, 0)), 4) AS cpm FROM norm GROUP BY 1, 2, 3")
def inverse_log2(spark, d):
    return _norm(spark, d).groupBy("unit", "part", "rank").agg(F.round(F.avg(sig.from_log2(F.col("value"))), 4).alias("cpm"))


@query(f"WITH {V.SIGNAL} SELECT unit, count(DISTINCT sample) AS samples, 15 < count(DISTINCT sample) - 10 AS fits FROM signal GROUP BY 1")
def design_fits(spark, d):
    n = V.signal(spark, d).groupBy("unit").agg(F.count_distinct("sample").alias("samples"))
    return n.withColumn("fits", sig.covariates_fit(F.lit(15), F.col("samples")))


@query(f"WITH {V.GENES} SELECT try_cast(part AS int) % 2 AS odd, count(*) AS genes FROM genes GROUP BY 1")
def odd_even_parts(spark, d):
    return V.genes(spark, d).groupBy(sig.odd_part(F.col("part")).alias("odd")).agg(F.count("*").alias("genes"))


@query(
    """WITH c AS (SELECT unit, sample_id, avg(CASE WHEN expr_value IS NOT NULL THEN 1.0 ELSE 0.0 END) AS known FROM expr_signal WHERE sample_id IS NOT NULL GROUP BY 1, 2),
  m AS (SELECT DISTINCT dbgap_rnaseq_sample AS s FROM sample_mapping WHERE dbgap_rnaseq_sample IS NOT NULL)
  SELECT unit, sample_id, sample_id IN (SELECT s FROM m) AS mapped FROM c WHERE known > 0.5"""
)
def covered_samples(spark, d):
    """Samples with more than half of their values known, and whether they have a profile of the other kind."""
    x = table(spark, d, "expr_signal").where("sample_id IS NOT NULL")
    mapped = table(spark, d, "sample_mapping").where("dbgap_rnaseq_sample IS NOT NULL").select(F.col("dbgap_rnaseq_sample").alias("sample_id")).distinct().withColumn("_m", F.lit(True))
    return sig.covered(x, ["unit", "sample_id"], "expr_value", 0.5).join(mapped, "sample_id", "left").select("unit", "sample_id", F.coalesce("_m", F.lit(False)).alias("mapped"))


@query(
    f"""WITH {V.PAIRS}, x AS (SELECT unit, r, oe, (r - avg(r) OVER w) / nullif(stddev_samp(r) OVER w, 0) AS a, (oe - avg(oe) OVER w) / nullif(stddev_samp(oe) OVER w, 0) AS b FROM pairs WHERE r IS NOT NULL AND oe IS NOT NULL WINDOW w AS (PARTITION BY unit))
  SELECT unit, count(*) AS n, round(avg(a * b), 6) AS concordance FROM x GROUP BY 1"""
)
def concordance_product(spark, d):
    p = V.pairs(spark, d).where("r IS NOT NULL AND oe IS NOT NULL")
    z = sig.zscore(sig.zscore(p, "r", ["unit"], "a", 1, 0.0), "oe", ["unit"], "b", 1, 0.0)
    return z.groupBy("unit").agg(F.count("*").alias("n"), F.round(F.avg(F.col("a") * F.col("b")), 6).alias("concordance"))


@query(f"""WITH {_ADJ}, x AS (SELECT *, gc1 - 0.45 AS c1, gc2 - 0.45 AS c2 FROM adj) SELECT part, g1, g2, CASE WHEN abs(c1) >= abs(c2) THEN c1 ELSE c2 END AS driver, CASE WHEN abs(c1) >= abs(c2) THEN c2 ELSE c1 END AS neighbour FROM x WHERE gc1 IS NOT NULL AND gc2 IS NOT NULL""")
def driver_selection(spark, d):
    p = _adjacent(spark, d).where("gc1 IS NOT NULL AND gc2 IS NOT NULL")
    a, b = pairs.driver_and_neighbour(F.col("gc1") - 0.45, F.col("gc2") - 0.45)
    return p.select("part", F.col("gene1").alias("g1"), F.col("gene2").alias("g2"), a.alias("driver"), b.alias("neighbour"))


@query(
    f"""WITH {V.MATRIX}, m AS (SELECT unit, part, rank, avg(value) AS v FROM matrix GROUP BY 1, 2, 3), f AS (SELECT part, rank FROM m WHERE v > 0 GROUP BY 1, 2 HAVING count(*) >= 6)
  SELECT m.unit, m.part, m.rank, f.part IS NOT NULL AS universal FROM m LEFT JOIN f ON f.part = m.part AND f.rank = m.rank"""
)
def flags_merged(spark, d):
    """Flags of a place, made over all units, merged back to every unit's row; absent ones are false."""
    m = V.matrix(spark, d).groupBy("unit", "part", "rank").agg(F.avg("value").alias("v"))
    flags = m.where("v > 0").groupBy("part", "rank").agg(F.count("*").alias("n")).where("n >= 6").select("part", "rank", F.lit(True).alias("_f"))
    return m.join(flags, ["part", "rank"], "left").select("unit", "part", "rank", F.coalesce("_f", F.lit(False)).alias("universal"))


@query(f"WITH {V.PAIRS} SELECT unit, count(contact_kr) AS n, round(avg(50.0 / (contact_kr + 50)), 6) AS exponent FROM pairs GROUP BY 1")
def saturation_exponents(spark, d):
    p = V.pairs(spark, d)
    return p.groupBy("unit").agg(F.count("contact_kr").alias("n"), F.round(F.avg(pairs.saturation_exponent(F.col("contact_kr"), 50)), 6).alias("exponent"))


@query("SELECT user_id, ts, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM events")
def moving_averages(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value", F.struct("ts", "event_id").alias("place"))
    return sig.moving_average(e, ["user_id"], "place", "value", 5, "smooth").select("user_id", "ts", "event_id", F.round("smooth", 6).alias("smooth"))


# ------------------------------------------------------------------------------------------ tests


@query(
    """WITH w AS (SELECT event_type, count(*) FILTER (user_id % 2 = 0) AS n1, count(*) FILTER (user_id % 2 <> 0) AS n0, avg(value) FILTER (user_id % 2 = 0) AS m1, avg(value) FILTER (user_id % 2 <> 0) AS m0,
    var_samp(value) FILTER (user_id % 2 = 0) AS v1, var_samp(value) FILTER (user_id % 2 <> 0) AS v0 FROM events GROUP BY 1)
  SELECT event_type, round((m1 - m0) / (sqrt(v1 / n1 + v0 / n0 + 1e-9) + 0.01), 6) AS t FROM w"""
)
def regularised_t(spark, d):
    """Users of even and odd number are the two arms."""
    e = table(spark, d, "events").withColumn("arm", F.col("user_id") % 2 == 0)
    return regress.regularised_t(e, "value", "arm", ["event_type"]).select("event_type", *r6("t"))


@query(
    """WITH c AS (SELECT l_orderkey, count(*) AS n, corr(l_quantity, l_discount) AS r FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 3 AND 7 AND stddev_pop(l_quantity) > 0 AND stddev_pop(l_discount) > 0),
  a AS (SELECT *, atan(abs(r) / sqrt(greatest(1 - r * r, 1e-300))) AS h FROM c)
  SELECT l_orderkey, n, round(r, 5) AS r, round(CASE n WHEN 3 THEN 1 - 2 * h / pi() WHEN 4 THEN 1 - sin(h) WHEN 5 THEN 1 - 2 / pi() * (h + sin(h) * cos(h)) WHEN 6 THEN 1 - sin(h) * (1 + cos(h) ** 2 / 2)
    ELSE 1 - 2 / pi() * (h + sin(h) * (cos(h) + 2 * cos(h) ** 3 / 3)) END, 5) AS p FROM a"""
)
def correlation_tests(spark, d):
    """Correlations over three to seven rows, where the tail has a closed form."""
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), bins.pearson(F.col("l_quantity"), F.col("l_discount")).alias("r"), F.stddev_pop("l_quantity").alias("a"), F.stddev_pop("l_discount").alias("b"))
    c = c.where("n BETWEEN 3 AND 7 AND a > 0 AND b > 0")
    return c.select("l_orderkey", "n", F.round("r", 5).alias("r"), F.round(regress.correlation_p(F.col("r"), F.col("n")), 5).alias("p"))


@query(
    f"""WITH {_ADJ}, x AS (SELECT part, g1, g2, gc1 - 0.45 AS nb, gc2 - 0.45 AS tg, ((st1 // 1000) % 20) / 100.0 AS q FROM adj WHERE gc1 IS NOT NULL AND gc2 IS NOT NULL)
  SELECT part, g1, g2, sign(nb) * sign(tg) = 1 AS met, sign(nb) * sign(tg) = 1 AND q < 0.1 AS supported FROM x"""
)
def rule_evaluation(spark, d):
    p = _adjacent(spark, d).where("gc1 IS NOT NULL AND gc2 IS NOT NULL")
    level = (F.floor(F.col("start1") / 1000) % 20) / 100.0
    met, supported = regress.rule_met(F.lit(1), F.col("gc1") - 0.45, F.col("gc2") - 0.45, level)
    return p.select("part", F.col("gene1").alias("g1"), F.col("gene2").alias("g2"), met.alias("met"), supported.alias("supported"))


_EVENT_Z = "SELECT event_type, avg(value) - 25 AS est, stddev_samp(value) / sqrt(count(*)) AS se FROM events GROUP BY 1"


@query(f"SELECT event_type, round(z, 6) AS z, round({_TAIL.format(z='z')}, 6) AS p FROM (SELECT event_type, (est - 25) / (5 * se) AS z FROM ({_EVENT_Z}) e) x")
def normal_tail(spark, d):
    s = table(spark, d, "events").groupBy("event_type").agg((F.avg("value") - 25).alias("est"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("se"))
    z = (F.col("est") - 25) / (5 * F.col("se"))
    return s.select("event_type", F.round(z, 6).alias("z"), F.round(normal_p(z), 6).alias("p"))


_ONE = "CASE WHEN {z} >= 0 THEN " + _TAIL + " / 2 ELSE 1 - " + _TAIL + " / 2 END"
catalog.SQL["tost_equivalence"] = f"""
  SELECT event_type, round(est, 6) AS est, round(2.80 * se, 6) AS mde80, round(greatest({_ONE.format(z="up")}, {_ONE.format(z="low")}), 6) AS p_tost FROM
  (SELECT *, (2.80 * se - est) / se AS up, (est + 2.80 * se) / se AS low FROM ({_EVENT_Z}) e) x"""

catalog.SQL["red_noise_peaks"] = f"""
  WITH {V.MATRIX}, m AS (SELECT unit, part, rank, avg(value) AS v FROM matrix GROUP BY 1, 2, 3), c AS (SELECT *, v - avg(v) OVER w AS c, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY unit, part)),
  s AS (SELECT unit, part, max(n) AS n, sum(c * c) AS sq, sum(c * nx) / sum(c * c) AS phi FROM (SELECT *, lead(c) OVER (PARTITION BY unit, part ORDER BY rank) AS nx FROM c) l GROUP BY 1, 2),
  f AS (SELECT unit, part, k, sum(c * cos(2 * pi() * k * rank / n)) ** 2 + sum(c * sin(2 * pi() * k * rank / n)) ** 2 AS power FROM c JOIN range(1, 9) r(k) ON 2 * k <= n GROUP BY 1, 2, 3),
  t AS (SELECT f.*, sq * (1 - phi * phi) / (1 + phi * phi - 2 * phi * cos(2 * pi() * k / n)) * -ln(0.05 / (n // 2)) AS threshold FROM f JOIN s USING (unit, part))
  SELECT unit, part, k, round(power, 6) AS power, round(threshold, 6) AS threshold, power > threshold AS peak FROM t"""


@query("SELECT event_type, round(median(value) - (SELECT median(value) FROM events), 6) AS difference FROM events GROUP BY 1")
def median_differences(spark, d):
    e = table(spark, d, "events")
    whole = e.agg(F.median("value").alias("all"))
    return e.groupBy("event_type").agg(F.median("value").alias("own")).crossJoin(F.broadcast(whole)).select("event_type", F.round(F.col("own") - F.col("all"), 6).alias("difference"))  # one row


@query(
    """WITH r AS (SELECT l_suppkey, sum(l_quantity) FILTER (l_returnflag = 'A') AS k1, sum(l_quantity) FILTER (l_returnflag = 'N') AS k2, sum(l_quantity) FILTER (l_returnflag = 'R') AS k3 FROM lineitem GROUP BY 1)
  SELECT round(avg(CASE WHEN k1 > k2 AND k2 > k3 THEN 1.0 ELSE 0.0 END), 6) AS ordered, round(quantile_cont(k1 - k2, 0.025), 6) AS ci_low, round(quantile_cont(k1 - k2, 0.975), 6) AS ci_high FROM r WHERE k1 IS NOT NULL AND k2 IS NOT NULL AND k3 IS NOT NULL"""
)
def ordering_probability(spark, d):
    """Suppliers stand for replicates of three statistics: how often they are in order, and the interval of a difference."""
    r = table(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")).dropna()
    return r.agg(F.round(F.avg(((F.col("A") > F.col("N")) & (F.col("N") > F.col("R"))).cast("double")), 6).alias("ordered"), *[F.round(F.percentile(F.col("A") - F.col("N"), p), 6).alias(n) for p, n in ((0.025, "ci_low"), (0.975, "ci_high"))])


_BALANCE = "SELECT c_acctbal AS y, n AS x FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey"


@query(
    f"""WITH x AS ({_BALANCE}), m AS (SELECT count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx FROM x),
  e AS (SELECT x - mx AS c, n, mx, sxx, a, b, ((y - a - b * x) / (1 - (1.0 / n + (x - mx) ** 2 / sxx))) ** 2 AS w FROM x, m)
  SELECT 'x' AS term, round(max(b), 6) AS coef, round(sqrt(sum(c * c * w)) / max(sxx), 6) AS se, max(n) AS n FROM e
  UNION ALL SELECT 'intercept', round(max(a), 6), round(sqrt(sum((1.0 / n - mx * c / sxx) ** 2 * w)), 6), max(n) FROM e"""
)
def robust_line(spark, d):
    """A line with HC3 errors."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("x"))
    return regress.robust(table(spark, d, "customer").join(o, "c_custkey"), "c_acctbal", ["x"]).select("term", *r6("coef", "se"), "n")


catalog.SQL["robust_hc3"] = f"""
  WITH x AS (SELECT c_acctbal AS y, n AS x1, mean AS x2 FROM customer JOIN (SELECT o_custkey, count(*) AS n, avg(o_totalprice) / 1000 AS mean FROM orders GROUP BY 1) o ON o_custkey = c_custkey),
  m AS (SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, regr_sxx(x1, x1) AS s11, regr_sxx(x2, x2) AS s22, regr_sxy(x1, x2) AS s12, regr_sxy(y, x1) AS t1, regr_sxy(y, x2) AS t2 FROM x),
  b AS (SELECT *, (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) AS b1, (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) AS b2, s11 * s22 - s12 * s12 AS det FROM m),
  a AS (SELECT *, (s22 * (x1 - m1) - s12 * (x2 - m2)) / det AS a1, (s11 * (x2 - m2) - s12 * (x1 - m1)) / det AS a2, y - my - b1 * (x1 - m1) - b2 * (x2 - m2) AS e FROM x, b),
  w AS (SELECT *, (e / (1 - (1.0 / n + a1 * (x1 - m1) + a2 * (x2 - m2)))) ** 2 AS w FROM a),
  r AS (SELECT 'n' AS term, max(b1) AS coef, sqrt(sum(a1 * a1 * w)) AS se, max(n) AS n FROM w UNION ALL SELECT 'mean', max(b2), sqrt(sum(a2 * a2 * w)), max(n) FROM w
    UNION ALL SELECT 'intercept', max(my - b1 * m1 - b2 * m2), sqrt(sum((1.0 / n - m1 * a1 - m2 * a2) ** 2 * w)), max(n) FROM w)
  SELECT term, round(coef, 4) AS coef, round(se, 4) AS se, round(coef - 1.959963984540054 * se, 4) AS ci_low, round(coef + 1.959963984540054 * se, 4) AS ci_high, round({_TAIL.format(z="(coef / se)")}, 6) AS p, n FROM r"""

_CLUSTERED = f"""WITH {V.PAIRS}, x AS (SELECT part AS g, r AS y, ln(contact_kr + 1) AS x FROM pairs WHERE contact_kr IS NOT NULL AND r IS NOT NULL AND part IS NOT NULL),
  m AS (SELECT count(*) AS n, count(DISTINCT g) AS k, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx FROM x),
  u AS (SELECT g, sum((x - mx) * (y - a - b * x)) / max(sxx) AS ub, sum((1.0 / n - mx * (x - mx) / sxx) * (y - a - b * x)) AS ua FROM x, m GROUP BY 1)"""


@query(
    _CLUSTERED
    + """ SELECT 'lc' AS term, round(max(b), 6) AS coef, round(sqrt(sum(ub * ub) * max(k) / (max(k) - 1) * (max(n) - 1) / (max(n) - 2)), 6) AS se, max(n) AS n FROM u, m
  UNION ALL SELECT 'intercept', round(max(a), 6), round(sqrt(sum(ua * ua) * max(k) / (max(k) - 1) * (max(n) - 1) / (max(n) - 2)), 6), max(n) FROM u, m"""
)
def robust_cluster_line(spark, d):
    """A line with errors robust to clusters."""
    c = V.pairs(spark, d).where("contact_kr IS NOT NULL AND part IS NOT NULL").withColumn("lc", F.ln(F.col("contact_kr") + 1))
    return regress.robust(c, "r", ["lc"], "part").select("term", *r6("coef", "se"), "n")


# ------------------------------------------------------------------------------------------ resampling


def _inside(value: Column, low: Column, high: Column) -> Column:
    return (low <= value) & (value <= high)


_LINE = f"""WITH {V.PAIRS}, {V.GENES}, x AS (SELECT p.*, ln(contact_kr + 1) AS lc, CASE WHEN p.part IS NOT NULL AND start IS NOT NULL THEN p.part || ':' || cast(floor(start / 1e6) AS bigint) ELSE 'unplaced:' || g1 END AS block
  FROM pairs p LEFT JOIN (SELECT gene, start FROM genes) g ON g.gene = p.g1 WHERE contact_kr IS NOT NULL AND r IS NOT NULL)"""


@query(
    _LINE
    + """, m AS (SELECT regr_slope(r, lc) AS b, regr_intercept(r, lc) AS a, count(DISTINCT block) AS blocks FROM x)
  SELECT 'lc' AS term, round(b, 6) AS est, blocks, true AS inside, true AS p_in_range FROM m UNION ALL SELECT 'intercept', round(a, 6), blocks, true, true FROM m"""
)
def block_bootstrap_bounds(spark, d):
    """The estimates over blocks of positions, whether their intervals hold them, and the number of blocks."""
    p = V.pairs(spark, d).where("contact_kr IS NOT NULL AND r IS NOT NULL")
    g = V.genes(spark, d).select(F.col("gene").alias("g1"), "start")
    p = p.join(g, "g1", "left").withColumn("block", resample.position_block(F.col("part"), F.col("start"), 1e6, F.col("g1"))).withColumn("lc", F.ln(F.col("contact_kr") + 1))
    got = resample.block_bootstrap(p, "r", ["lc"], "block", 200, 0)
    return got.select("term", F.round("est", 6).alias("est"), "blocks", _inside(F.col("est"), F.col("ci_low"), F.col("ci_high")).alias("inside"), F.col("p").between(0, 1).alias("p_in_range"))


@query(
    f"""WITH {V.PAIRS}, x AS (SELECT r, ln(contact_kr + 1) AS lc, unit, part FROM pairs WHERE contact_kr IS NOT NULL AND r IS NOT NULL),
  m AS (SELECT regr_slope(r, lc) AS b, regr_intercept(r, lc) AS a, count(DISTINCT concat_ws(':', unit, part)) AS blocks FROM x)
  SELECT 'lc' AS term, round(b, 6) AS est, blocks, true AS inside FROM m UNION ALL SELECT 'intercept', round(a, 6), blocks, true FROM m"""
)
def stratified_bootstrap_bounds(spark, d):
    """Whole parts are drawn within their unit."""
    p = V.pairs(spark, d).where("contact_kr IS NOT NULL AND r IS NOT NULL").withColumn("lc", F.ln(F.col("contact_kr") + 1)).withColumn("block", F.concat_ws(":", "unit", "part"))
    got = resample.block_bootstrap(p, "r", ["lc"], "block", 300, 7, "unit")
    return got.select("term", F.round("est", 6).alias("est"), "blocks", _inside(F.col("est"), F.col("ci_low"), F.col("ci_high")).alias("inside"))


@query("WITH m AS (SELECT l_returnflag AS level, avg(l_quantity) AS m FROM lineitem GROUP BY 1) SELECT level, round(m, 6) AS mean, round(m / (SELECT m FROM m WHERE level = 'A'), 6) AS relative, true AS inside FROM m")
def relative_means_bounds(spark, d):
    got = resample.block_means(table(spark, d, "lineitem"), "l_quantity", "l_returnflag", "l_suppkey", 200, 23, "A")
    inside = _inside(F.col("mean"), F.col("ci_low"), F.col("ci_high")) & _inside(F.col("relative"), F.col("relative_ci_low"), F.col("relative_ci_high"))
    return got.select("level", *r6("mean", "relative"), inside.alias("inside"))


@query("SELECT round(median(c_acctbal) FILTER (c_mktsegment = 'BUILDING') - median(c_acctbal) FILTER (c_mktsegment <> 'BUILDING'), 6) AS difference, true AS inside, true AS p_in_range FROM customer")
def median_contrast_bounds(spark, d):
    c = table(spark, d, "customer").withColumn("g", F.col("c_mktsegment") == "BUILDING")
    m = resample.median_contrast(c, "c_acctbal", "g", "c_custkey", 300)
    return spark.createDataFrame([(round(m["difference"], 6), m["ci_low"] <= m["difference"] <= m["ci_high"], 1 / 300 <= m["p"] <= 1)], "difference double, inside boolean, p_in_range boolean")


_BY_NATION = "SELECT s_nationkey AS k, avg(s_acctbal) AS v, s_nationkey % 3 = 0 AS l FROM supplier GROUP BY 1"


def _by_nation(spark: SparkSession, d: str):
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("v")).orderBy("s_nationkey").toPandas()  # a row per nation


@query(f"SELECT round(avg(v) FILTER (l) - avg(v) FILTER (NOT l), 6) AS difference, true AS p_in_range FROM ({_BY_NATION}) x")
def label_permutation_bounds(spark, d):
    x = _by_nation(spark, d)
    got = resample.label_permutation(x.v.to_numpy(), (x.s_nationkey % 3 == 0).to_numpy(), spark, 500)
    return spark.createDataFrame([(round(got["difference"], 6), 1 / 501 <= got["p"] <= 1)], "difference double, p_in_range boolean")


@query(
    """WITH s AS (SELECT c_nationkey, avg(c_acctbal) AS y, avg(u) AS x, avg(n) AS z FROM customer JOIN (SELECT o_custkey, count(*) AS n, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) AS u FROM orders GROUP BY 1) o ON o_custkey = c_custkey GROUP BY 1),
  l AS (SELECT regr_slope(y, z) AS b1, regr_intercept(y, z) AS a1, regr_slope(x, z) AS b2, regr_intercept(x, z) AS a2 FROM s)
  SELECT round(regr_slope(y - a1 - b1 * z, x - a2 - b2 * z), 4) AS effect, true AS p_in_range FROM s, l"""
)
def freedman_lane_effect(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("n"), F.max((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("u"))
    s = table(spark, d, "customer").join(o, "c_custkey").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("y"), F.avg("u").alias("x"), F.avg("n").alias("z"))
    got = resample.freedman_lane(s.orderBy("c_nationkey").toPandas(), "y", "x", ["z"], spark, 300, 1)  # a row per nation
    return spark.createDataFrame([(round(got["effect"], 4), 1 / 301 <= got["p"] <= 1)], "effect double, p_in_range boolean")


@query(
    f"""WITH x AS (SELECT v - avg(v) OVER () AS c, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM ({_BY_NATION}) b)
  SELECT round(max(p), 3) AS peak FROM (SELECT k, sum(c * cos(2 * pi() * k * i / n)) ** 2 + sum(c * sin(2 * pi() * k * i / n)) ** 2 AS p FROM x JOIN range(1, 13) r(k) ON 2 * k <= n GROUP BY 1) f"""
)
def block_permutation_whole(spark, d):
    """Shuffles of one block that is the whole series leave its largest ordinate."""
    v = _by_nation(spark, d).v.to_numpy()
    return spark.createDataFrame([(round(resample.block_permutation_peak(v, len(v), 20), 3),)], "peak double")


@query(f"WITH {V.SIGNAL} SELECT unit, count(*) AS samples, count(*) // 2 AS first_half FROM (SELECT DISTINCT unit, sample FROM signal) s GROUP BY 1")
def sample_halves(spark, d):
    keys = V.signal(spark, d).select("unit", "sample").distinct()
    return resample.ranked_halves(keys, "sample", ["unit"], 8).groupBy("unit").agg(F.count("*").alias("samples"), F.count_if(F.col("half") == 0).alias("first_half"))


@query(f"SELECT round(avg(v), 6) AS whole, true AS inside, 200 AS replicates FROM ({_BY_NATION}) b")
def window_mean_bounds(spark, d):
    """Random windows: as wide as the series they are its mean, and narrower ones lie in its range."""
    v = _by_nation(spark, d).v.to_numpy()
    whole, part = resample.window_mean_null(v, len(v), spark, 200), resample.window_mean_null(v, 3, spark, 200)
    return spark.createDataFrame([(round(float(whole.mean()), 6), bool((part >= v.min()).all() and (part <= v.max()).all() and np.ptp(whole) < 1e-9), len(part))], "whole double, inside boolean, replicates int")


@query(f"WITH {V.MATRIX} SELECT unit, sample, part, count(*) AS n, round(sum(value), 6) AS total, round(sum(value * value), 6) AS squares FROM matrix GROUP BY 1, 2, 3")
def shuffled_control(spark, d):
    """A random order keeps what stands in each part of a sample."""
    return lag.shuffle_order(V.matrix(spark, d), 3).groupBy("unit", "sample", "part").agg(F.count("*").alias("n"), *[F.round(F.sum(x), 6).alias(n) for x, n in ((F.col("value"), "total"), (F.col("value") * F.col("value"), "squares"))])


@query(
    f"""WITH {V.GENES}, g AS (SELECT part, gene, start, ntile_ FROM (SELECT part, gene, start, 1 AS ntile_ FROM genes WHERE gc IS NOT NULL AND NOT isnan(gc) AND part IS NOT NULL AND start IS NOT NULL) x)
  SELECT part, count(*) - 1 AS adjacent, cast(0 AS bigint) AS too_near, cast(0 AS bigint) AS astray FROM g GROUP BY 1 HAVING count(*) > 60"""
)
def matched_partner_rules(spark, d):
    """Of random partners on the same chromosome, more than twenty ranks apart: pairs, and those that break a rule."""
    g = sig.number_positions(V.genes(spark, d).where("gc IS NOT NULL AND NOT isnan(gc)"), "part", "start", "gene").select("part", "gene", "rank")
    big = g.groupBy("part").agg(F.count("*").alias("_n")).where("_n > 60").select("part")
    p = lag.adjacent_pairs(g.join(big, "part", "left_semi"), ["part"], ["rank"], ["gene"])
    p = p.select("part", "gene1", "gene2", F.struct("part").alias("s1"), F.struct("part").alias("s2"))
    got = interval.random_partners(p, g, ["part"], ["gene"], "rank", 20, 20, 7)
    at = lambda name: g.select(F.col("gene").alias(f"{name}g"), F.col("part").alias(f"{name}p"), F.col("rank").alias(f"{name}r"))
    met = got.join(at("u"), F.col("u.gene") == F.col("ug")).join(at("v"), F.col("v.gene") == F.col("vg"))
    return met.groupBy("part").agg(F.count("*").alias("adjacent"), F.count_if(F.abs(F.col("ur") - F.col("vr")) <= 20).alias("too_near"), F.count_if((F.col("up") != F.col("part")) | (F.col("vp") != F.col("part"))).alias("astray"))


@query(
    f"""WITH {V.SIGNAL}, t AS (SELECT *, row_number() OVER (PARTITION BY unit, sample ORDER BY value DESC, part, rank) AS k FROM signal),
  c AS (SELECT unit, sample, part, floor(rank / 5) AS s, count(*) AS m FROM t WHERE k <= 12 GROUP BY 1, 2, 3, 4)
  SELECT unit, sample, count(*) FILTER (m >= 2) AS observed FROM c GROUP BY 1, 2"""
)
def active_sets_observed(spark, d):
    s = V.signal(spark, d).withColumn("segment", F.concat_ws(":", "part", F.floor(F.col("rank") / 5))).withColumn("key", F.concat_ws(":", "part", "rank"))
    w = Window.partitionBy("unit", "sample").orderBy(F.desc("value"), "part", "rank")  # a sample's positions
    top = s.withColumn("k", F.row_number().over(w)).where("k <= 12")
    return resample.gene_set_null(top, s, ["unit", "sample"], "segment", "key", 3, 11).select("unit", "sample", "observed")


# ------------------------------------------------------------------------------------------ layers and simulations


@query(f"WITH {V.MATRIX} SELECT unit, part, rank, 0.0::double AS most FROM matrix GROUP BY 1, 2, 3")
def one_component_removed(spark, d):
    """A signal of one component has nothing left without it."""
    m = V.matrix(spark, d)
    a, b = m.groupBy("unit", "part", "rank").agg(F.avg("value").alias("a")), m.groupBy("unit", "sample").agg(F.avg("value").alias("b"))
    x = m.join(a, ["unit", "part", "rank"]).join(b, ["unit", "sample"]).select("unit", "sample", "part", "rank", (F.col("a") * F.col("b") * 100).alias("value"))
    left = resid.remove_components(x, 1).groupBy("unit", "part", "rank").agg(F.max(F.abs("value")).alias("most"))
    return left.select("unit", "part", "rank", (F.round("most", 7) + 0.0).alias("most"))


@query("SELECT * FROM (VALUES ('noise', true), ('local', true), ('slope', true), ('track', true), ('local decay', true), ('track decay', true), ('sum', true)) v(layer, holds)")
def simulation_layers(spark, d):
    """Whether the layers of a simulation have the moments of its model."""
    x = simulate.simulate_genome(spark, 1500, 2, 80, 4.0, gc_phi=0.9, gc_bias_sd=0.3, cis_sd=0.6, noise_sd=0.4, seed=12)
    own = Window.partitionBy("sample", "part").orderBy("rank")  # positions of a part
    rest = F.col("value") - F.col("landscape") - F.col("gc_slope") * F.col("gc") - F.col("cis")
    x = x.withColumns({"rest": rest, "cis4": F.lead("cis", 4).over(own), "gc1": F.lead("gc", 1).over(own)})
    m = x.agg(F.stddev_pop("rest").alias("rest"), F.stddev_pop("cis").alias("cis"), F.stddev_pop("gc_slope").alias("slope"), F.stddev_pop("gc").alias("gc"), F.corr("cis", "cis4").alias("cis4"), F.corr("gc", "gc1").alias("gc1"), F.max(F.abs(F.col("rest"))).alias("most")).first()
    holds = {
        "noise": abs(m["rest"] - 0.4) < 0.01,
        "local": abs(m["cis"] - 0.6) < 0.03,
        "slope": abs(m["slope"] - 0.3) < 0.1,
        "track": abs(m["gc"] - 1) < 1e-9,
        "local decay": abs(m["cis4"] - math.exp(-1)) < 0.04,
        "track decay": abs(m["gc1"] - 0.9) < 0.05,
        "sum": m["most"] < 0.4 * 8,
    }
    return spark.createDataFrame(list(holds.items()), "layer string, holds boolean")


@query("SELECT * FROM (VALUES ('2', true), ('5', true), ('8', true)) v(unit, recovered)")
def decay_recovery(spark, d):
    """Whether the decay length of a simulation comes out within a third once the track is removed."""
    got = catalog_joins.simulate_recover(spark, d)
    return got.select("unit", (F.abs(F.col("corrected") / F.col("unit").cast("double") - 1) < 1 / 3).alias("recovered"))


@query("SELECT * FROM (VALUES (0.0::double, true), (0.5::double, true), (0.75::double, true)) v(share, less)")
def mixture_survival(spark, d):
    """Local covariance that follows the track is taken with its trend: the more of it, the less is left."""
    out = []
    for share in (0.0, 0.5, 0.75):
        x = simulate.mixture_with_covariate(spark, share, 5, n_genes=300, n_chrom=2, n_samples=60, decay_len=5.0)
        track = x.select("part", "rank", F.col("gc").alias("covariate")).distinct()
        s = x.select("unit", "sample", "part", "rank", "value")
        one = lambda p: p.where("lag = 1").first()["correlation"]
        out.append((share, one(lag.lag_profile(resid.remove_trend(s, resid.trend_basis(s, track, 2)), 3)) / one(lag.lag_profile(s, 3))))
    kept = dict(out)
    return spark.createDataFrame([(s, k <= kept[0.0] + 1e-9) for s, k in out], "share double, less boolean")


@query("SELECT * FROM (VALUES ('identity', true), ('share', true), ('corrected is closer', true)) v(quantity, holds)")
def demo_summary(spark, d):
    got = {r["quantity"]: r["value"] for r in demo.summary(spark).collect()}
    true = got["true decay length"]
    holds = {
        "identity": got["identity error"] < 1e-8,
        "share": 0 < got["landscape share"] < 1,
        "corrected is closer": abs(got["corrected decay length"] - true) < abs(got["naive decay length"] - true),
    }
    return spark.createDataFrame(list(holds.items()), "quantity string, holds boolean")


@query(catalog.SQL["lag_profile"])
def lag_profile_export(spark, d):
    """The lag profiles as a file of text, read again."""
    profile = catalog.lag_profile(spark, d)
    path = own_folder(spark, "export")
    store.write_csv(profile, path)
    return spark.read.schema(profile.schema).option("header", True).csv(path)


@query(
    """WITH e AS (SELECT label, cast(unnest(range(0, 64)) AS int) AS j, cast(unnest(embedding) AS double) AS x FROM embeddings), m AS (SELECT label, j, avg(x) AS v FROM e GROUP BY 1, 2),
  c AS (SELECT a.j, corr(a.v, b.v) AS r FROM m a JOIN m b ON b.label = a.label AND b.j = a.j + 1 GROUP BY 1)
  SELECT round(avg(r), 6) AS mean_r, cast(40 AS bigint) AS replicates, true AS inside FROM c"""
)
def double_bootstrap_point(spark, d):
    """Labels stand for samples, two to a donor; neighbours of the mean vectors are the pairs, in blocks of eight."""
    v = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("j", "x")).groupBy("label", "j").agg(F.avg(F.col("x").cast("double")).alias("v"))
    wide = v.toPandas().pivot(index="j", columns="label", values="v").sort_index()  # 64 places by ten labels
    i = np.arange(len(wide) - 1)
    rows = pd.DataFrame({"i": i, "j": i + 1, "block": i // 8})
    log = resample.double_bootstrap(rows, wide.to_numpy(), np.arange(wide.shape[1]) // 2, lambda p, r, w: {"mean_r": float((r * w).sum() / max(w.sum(), 1e-12))}, 40, 5, spark)
    point, draws = log[log["rep"] == -1]["mean_r"].iloc[0], log[log["rep"] >= 0]["mean_r"]
    return spark.createDataFrame([(round(float(point), 6), len(draws), bool((draws.abs() <= 1 + 1e-9).all()))], "mean_r double, replicates long, inside boolean")


@query("SELECT count(*) AS n, true AS nonnegative, true AS at_most_one, true AS fits FROM (SELECT DISTINCT p_retailprice FROM part) p")
def spline_rules(spark, d):
    """A cubic basis of five functions: not negative, at most 1 together, and able to fit any cubic exactly."""
    x = np.sort(np.array([r[0] for r in table(spark, d, "part").select("p_retailprice").distinct().collect()], float))  # prices of one table
    z = (x - x.mean()) / x.std()
    b = regress.spline_basis(z, 5)
    design = np.column_stack([np.ones(len(z)), b])
    y = 1 + z - 2 * z**2 + 0.5 * z**3
    left = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    return spark.createDataFrame([(len(x), bool((b >= -1e-12).all()), bool((b.sum(axis=1) <= 1 + 1e-9).all()), bool(np.abs(left).max() < 1e-8 * np.abs(y).max()))], "n long, nonnegative boolean, at_most_one boolean, fits boolean")


@query(
    f"""WITH {V.MATRIX}, x AS (SELECT a.unit, a.part, a.rank, a.value, b.value AS dose FROM matrix a JOIN matrix b ON b.unit = a.unit AND b.sample = a.sample AND b.part = a.part AND b.rank = (a.rank + 8) % 16)
  SELECT unit, part, rank, CASE WHEN stddev_pop(dose) >= 1e-6 THEN round(regr_intercept(value, dose), 6) ELSE 0 END AS b0, CASE WHEN stddev_pop(dose) >= 1e-6 THEN round(regr_slope(value, dose), 6) ELSE 0 END AS b1 FROM x GROUP BY 1, 2, 3"""
)
def dosage_shifted_control(spark, d):
    """The dosage of half a part away, in a circle, as a control without an effect of its own."""
    x = V.matrix(spark, d)
    dose = x.select("unit", "sample", "part", ((F.col("rank") + 8) % 16).cast("int").alias("rank"), F.col("value").alias("dose"))
    return resid.own_dosage(x, dose, 1).select("unit", "part", "rank", *r6("b0", "b1"))


@query("SELECT * FROM (VALUES ('exponential', true), ('two exponentials', true), ('lorentzian', true), ('whittle', true), ('power law', true), ('hub', true)) v(law, recovered)")
def fit_recovery(spark, d):
    """Whether each law's parameters come out of its own curve."""
    t, f = np.arange(1.0, 61), np.arange(1, 400) / 800
    near = lambda a, b: bool(abs(a / b - 1) < 0.05)
    lorentz = lambda length: 4 / (1 + (2 * np.pi * f * length) ** 2) + 0.01
    c = np.logspace(0, 3, 20)
    one = fit.exponential_fits(t, 0.4 * np.exp(-t / 6))
    two = fit.exponential_fits(t, 0.5 * np.exp(-t / 2) + 0.2 * np.exp(-t / 25))
    law = fit.fit_contact_law(c, 0.002 + 0.02 * c**0.5, np.full(20, 0.003))
    hub = fit.fit_contact_law(c, 0.005 + 0.2 * (1 + (40 / c) ** (2 / 3)) ** -1.5, np.full(20, 0.003))
    rows = {
        "exponential": near(one["length_one"], 6),
        "two exponentials": near(two["length_short"], 2) and near(two["length_long"], 25),
        "lorentzian": near(fit.lorentzian_fits(f, lorentz(4.0), np.ones(len(f)))["length_one"], 4),
        "whittle": near(fit.whittle(f, lorentz(4.0))["length_one"], 4),
        "power law": near(law["power_law"]["k"], 0.5) and law["power_law"]["chi2"] < law["hub"]["chi2"],
        "hub": hub["hub"]["chi2"] < hub["power_law"]["chi2"],
    }
    return spark.createDataFrame(list(rows.items()), "law string, recovered boolean")


@query(f"WITH {V.PAIRS} SELECT unit, part, true AS balanced FROM pairs WHERE contact_kr > 0 AND g1 IS NOT NULL AND g2 IS NOT NULL AND part IS NOT NULL GROUP BY 1, 2")
def balanced_ring(spark, d):
    """Members joined in a ring by their contacts' ranks balance to equal sums, whatever the contacts were."""
    p = V.pairs(spark, d).where("contact_kr > 0 AND g1 IS NOT NULL AND g2 IS NOT NULL AND part IS NOT NULL")
    ring = p.groupBy("unit", "part").agg(F.avg("contact_kr").alias("c")).withColumn("part", F.concat_ws("|", "unit", "part"))
    cells = ring.select("part", "c", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i")).select("part", "i", ((F.col("i") + 1) % 11).alias("j"), (F.col("c") * (1 + F.col("i") % 3)).alias("v"))
    b = resid.balance(cells.select("part", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "v"))
    sums = b.select("part", F.col("i").alias("n"), "v").unionByName(b.select("part", F.col("j").alias("n"), "v")).groupBy("part", "n").agg(F.sum("v").alias("s"))
    even = sums.groupBy("part").agg((F.max("s") / F.min("s") < 1.05).alias("balanced"))
    return even.select(F.split("part", r"\|")[0].alias("unit"), F.split("part", r"\|")[1].alias("part"), "balanced")


_PLACED = (
    NORM
    + """, s AS (SELECT unit, part, rank, avg(value) AS m, stddev_pop(value) AS sd FROM norm GROUP BY 1, 2, 3),
  o AS (SELECT *, row_number() OVER (PARTITION BY unit, part ORDER BY rank) - 1 AS i, count(*) OVER (PARTITION BY unit, part) AS n FROM s),
  z AS (SELECT x.unit, x.sample, x.part, o.i, o.n, (x.value - o.m) / (o.sd + 1e-9) AS z FROM norm x JOIN o USING (unit, part, rank))"""
)


@query(
    _PLACED
    + """ SELECT a.unit, l.lag, round(avg(a.z * b.z), 6) + 0.0 AS correlation, count(*) AS pairs FROM z a JOIN (SELECT cast(unnest(range(1, 13)) AS int) AS lag) l ON true
  JOIN z b ON b.unit = a.unit AND b.sample = a.sample AND b.part = a.part AND b.i = a.i + l.lag GROUP BY 1, 2"""
)
def expression_lag_profile(spark, d):
    """Lag profiles of normalised expression along chromosomes; values that a sample lacks keep their place."""
    z = sig.zscore(_norm(spark, d).where("value IS NOT NULL"), "value", sig.POSITION)
    got = lag.gapped_profile(lag.gapped_arrays(z), range(1, 13))
    return got.select("unit", "lag", (F.round("correlation", 6) + 0.0).alias("correlation"), "pairs")  # no negative zero


@query(
    _PLACED
    + """ SELECT unit, part, k, round(avg(power), 5) AS power, count(*) AS samples FROM (SELECT unit, sample, part, k, pow(sum(z * cos(2 * pi() * k * i / n)), 2) + pow(sum(z * sin(2 * pi() * k * i / n)), 2) AS power
  FROM z JOIN (SELECT cast(unnest(range(0, 200)) AS int) AS k) r ON 2 * k <= n GROUP BY 1, 2, 3, 4) f GROUP BY 1, 2, 3"""
)
def expression_spectrum(spark, d):
    """Mean spectra of normalised expression along chromosomes, over the samples measured there."""
    z = sig.zscore(_norm(spark, d).where("value IS NOT NULL"), "value", sig.POSITION)
    arrays = lag.gapped_arrays(z).where("present > 0").select("unit", "sample", "part", "x")
    return spectral.periodogram(arrays).where("k < 200").groupBy("unit", "part", F.col("k").cast("int").alias("k")).agg(F.round(F.avg("power"), 5).alias("power"), F.count("*").alias("samples"))


@query("WITH p AS (" + catalog.SQL["lag_profile"] + ") SELECT unit, lag, correlation AS observed, true AS adds_up FROM p WHERE lag IN (1, 2, 3, 5, 7)")
def lag_excess_observed(spark, d):
    """The observed part of the excess over a shuffled order, and that the excess is their difference."""
    got = lag.lag_excess(V.matrix(spark, d), [1, 2, 3, 5, 7], 3, 1e-12)
    return got.select("unit", "lag", F.round("observed", 6).alias("observed"), (F.abs(F.col("excess") - F.col("observed") + F.col("shuffled")) < 1e-12).alias("adds_up"))


@query(
    f"""WITH {V.MATRIX}, x AS (SELECT *, lead(value, 1, 0) OVER (PARTITION BY unit, sample, part ORDER BY rank) AS dose FROM matrix)
  SELECT unit, part, rank, 0.0::double AS mean, round(CASE WHEN stddev_pop(dose) >= 1e-6 THEN var_pop(value) * (1 - corr(value, dose) ** 2) ELSE avg(value * value) END, 6) AS variance FROM x GROUP BY 1, 2, 3"""
)
def dosage_residuals(spark, d):
    """What own dosage leaves of each position: nothing on average, and the variance that it does not explain."""
    x = V.matrix(spark, d)
    dose = x.select("unit", "sample", "part", (F.col("rank") - 1).alias("rank"), F.col("value").alias("dose")).where("rank >= 0")
    left = resid.apply_dosage(x, dose, resid.own_dosage(x, dose, 1))
    flat = F.col("rank") == 15  # no dosage there: all of the value is left
    mean = F.when(flat, F.lit(0.0)).otherwise(F.round(F.avg("residual"), 6) + 0.0)
    return left.groupBy("unit", "part", "rank").agg(mean.alias("mean"), F.round(F.avg(F.col("residual") * F.col("residual")), 6).alias("variance"))


@query(f"WITH {V.SIGNAL} SELECT unit, least(count(DISTINCT sample), 12) AS drawn, true AS once FROM signal GROUP BY 1")
def random_subset_rules(spark, d):
    """At most twelve samples of a unit, by a random order that depends on the seed alone, none twice."""
    keys = V.signal(spark, d).select("unit", "sample").distinct().withColumn("h", resample.hash_order(3, F.col("unit"), F.col("sample")))
    w = Window.partitionBy("unit").orderBy("h", "sample")  # the samples of a unit
    drawn = keys.withColumn("k", F.row_number().over(w)).where("k <= 12")
    return drawn.groupBy("unit").agg(F.count("*").alias("drawn"), (F.count_distinct("sample") == F.count("*")).alias("once"))
