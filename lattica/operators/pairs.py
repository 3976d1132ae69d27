"""Joins between pairs of positions and what they share: variants, credible sets, genetic predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.session import q


def shared_keys(pairs: DataFrame, assoc: DataFrame, item: str, key: str, sign: str) -> DataFrame:
    """``pairs`` (g1, g2, ...) with n_shared, share_any, share_same: the keys (variants) that both members
    have in ``assoc`` (item, key, sign), and whether any has the same sign in both.  Repeated rows of
    ``assoc`` count once per sign; pairs without shared keys stay, with 0 and false."""
    one = assoc.where(q(item).isNotNull() & q(key).isNotNull()).select(q(item).alias("_i"), q(key).alias("_k"), F.signum(q(sign)).alias("_s")).groupBy("_i", "_k").agg(F.min("_s").alias("_s"))
    base = pairs.select("g1", "g2").distinct()
    a, b = one.select(F.col("_i").alias("g1"), "_k", F.col("_s").alias("_s1")), one.select(F.col("_i").alias("g2"), "_k", F.col("_s").alias("_s2"))
    met = base.join(a, "g1").join(b, ["g2", "_k"])
    got = met.groupBy("g1", "g2").agg(F.count("*").alias("n_shared"), F.coalesce(F.bool_or(F.col("_s1") == F.col("_s2")), F.lit(False)).alias("share_same"))
    return pairs.join(got, ["g1", "g2"], "left").withColumns({"n_shared": F.coalesce("n_shared", F.lit(0)), "share_any": F.col("n_shared").isNotNull() & (F.coalesce("n_shared", F.lit(0)) > 0), "share_same": F.coalesce("share_same", F.lit(False))})


def colocalisation(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (g1, g2) with fm1, fm2 (has sets), p_coloc and direction.  ``sets``: (gene, cs, variant, pip,
    effect).  p_coloc is the largest, over pairs of sets, of the sum over shared variants of both pips (the
    first pair of sets, by their ids, wins a tie); direction is the sign product at the shared variant of
    that pair with the largest pip product among those with both effects known and finite (ties: the
    smaller variant), null without one."""
    s = sets.where("gene IS NOT NULL AND variant IS NOT NULL").select("gene", "cs", "variant", "pip", F.when(~F.isnan("effect"), F.col("effect")).alias("effect"))
    members = s.select("gene").distinct()
    base = pairs.select("g1", "g2").distinct()
    a = s.select(F.col("gene").alias("g1"), F.col("cs").alias("cs1"), "variant", F.col("pip").alias("p1"), F.col("effect").alias("e1"))
    b = s.select(F.col("gene").alias("g2"), F.col("cs").alias("cs2"), "variant", F.col("pip").alias("p2"), F.col("effect").alias("e2"))
    prod = F.col("p1") * F.col("p2")
    known = F.col("e1").isNotNull() & F.col("e2").isNotNull()
    met = base.join(a, "g1").join(b, ["g2", "variant"])
    per_set = met.groupBy("g1", "g2", "cs1", "cs2").agg(
        F.sum(prod).alias("score"), F.min_by(F.signum("e1") * F.signum("e2"), F.when(known, F.struct((-prod).alias("p"), F.col("variant").alias("v")))).alias("direction")
    )
    best = per_set.groupBy("g1", "g2").agg(F.min_by(F.struct("score", "direction"), F.struct((-F.col("score")).alias("s"), "cs1", "cs2")).alias("_b"))
    out = pairs.join(best, ["g1", "g2"], "left")
    for k in (1, 2):
        out = out.join(members.select(F.col("gene").alias(f"g{k}"), F.lit(True).alias(f"fm{k}")), f"g{k}", "left")
    return out.withColumns({"fm1": F.coalesce("fm1", F.lit(False)), "fm2": F.coalesce("fm2", F.lit(False)), "p_coloc": F.coalesce(F.col("_b.score"), F.lit(0.0)), "direction": F.col("_b.direction")}).drop("_b")


def predicted_genetic_covariance(freq: Column, beta1: Column, beta2: Column, p_same: Column | float = 1.0) -> Column:
    """``P(same variant) * 2 p (1 - p) * b1 * b2``."""
    p_same = F.lit(p_same) if not isinstance(p_same, Column) else p_same
    return p_same * 2 * freq * (1 - freq) * beta1 * beta2


def gc_layer_correlation(var_b: Column, g_i: Column, g_j: Column, sd_i: Column, sd_j: Column) -> Column:
    """``Var(b) g_i g_j / (sd_i sd_j)``; null for a zero sd."""
    return F.try_divide(var_b * g_i * g_j, sd_i * sd_j)


def saturation_exponent(contact: Column, k: float) -> Column:
    """``K / (c + K)``."""
    return F.try_divide(F.lit(float(k)), contact + k)


def genetic_prediction(pairs: DataFrame, sets: DataFrame, least: float = 0.1) -> DataFrame:
    """``pairs`` (g1, g2) with pred_r and p_coloc: over pairs of credible sets, the shared score times
    ``2 p (1 - p) (afc1 / 2) (afc2 / 2)`` of the lead shared variant (largest pip product with both effects
    known; ties: the smaller variant), summed; pairs whose best score is below ``least`` go.  ``sets``: (gene,
    cs, variant, pip, af, effect); the frequency is that of the first gene."""
    s = sets.select("gene", "cs", "variant", "pip", "af", F.when(~F.isnan("effect"), F.col("effect")).alias("effect"))
    a = s.select(F.col("gene").alias("g1"), F.col("cs").alias("cs1"), "variant", F.col("pip").alias("p1"), "af", F.col("effect").alias("e1"))
    b = s.select(F.col("gene").alias("g2"), F.col("cs").alias("cs2"), "variant", F.col("pip").alias("p2"), F.col("effect").alias("e2"))
    prod = F.col("p1") * F.col("p2")
    known = F.col("e1").isNotNull() & F.col("e2").isNotNull() & F.col("af").isNotNull()
    lead = F.min_by(F.struct("af", "e1", "e2"), F.when(known, F.struct((-prod).alias("p"), F.col("variant").alias("v"))))
    per_set = pairs.select("g1", "g2").distinct().join(a, "g1").join(b, ["g2", "variant"]).groupBy("g1", "g2", "cs1", "cs2").agg(F.sum(prod).alias("score"), lead.alias("_l"))
    value = predicted_genetic_covariance(F.col("_l.af"), F.col("_l.e1") / 2, F.col("_l.e2") / 2, F.col("score"))
    got = per_set.groupBy("g1", "g2").agg(F.sum(value).alias("pred_r"), F.max("score").alias("p_coloc")).where(F.col("p_coloc") >= least)
    return pairs.join(got, ["g1", "g2"])


def variant_prediction(pairs: DataFrame, sets: DataFrame, slopes: DataFrame) -> DataFrame:
    """``pairs`` with pred_r (all shared variants), weight and covered: as :func:`genetic_prediction` but
    with both genes' slopes at every shared variant; covered is the share of weight with both slopes.
    ``slopes``: (gene, variant, slope, af)."""
    a = sets.select(F.col("gene").alias("g1"), F.col("cs").alias("cs1"), "variant", F.col("pip").alias("p1"))
    b = sets.select(F.col("gene").alias("g2"), F.col("cs").alias("cs2"), "variant", F.col("pip").alias("p2"))
    sa = slopes.select(F.col("gene").alias("g1"), "variant", F.col("slope").alias("b1"), "af")
    sb = slopes.select(F.col("gene").alias("g2"), "variant", F.col("slope").alias("b2"))
    met = pairs.select("g1", "g2").distinct().join(a, "g1").join(b, ["g2", "variant"]).join(sa, ["g1", "variant"], "left").join(sb, ["g2", "variant"], "left")
    w = F.col("p1") * F.col("p2")
    both = F.col("b1").isNotNull() & F.col("b2").isNotNull() & F.col("af").isNotNull()
    got = met.groupBy("g1", "g2").agg(
        F.sum(F.when(both, predicted_genetic_covariance(F.col("af"), F.col("b1"), F.col("b2"), w))).alias("pred_r"), F.sum(w).alias("weight"), F.try_divide(F.sum(F.when(both, w).otherwise(0.0)), F.sum(w)).alias("covered")
    )
    return pairs.join(got, ["g1", "g2"])


def source_covariance(sources: DataFrame, footprints: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (g1, g2) with ``cov = sum over sources of variance * a1 * a2``; 0 without common sources.
    ``sources``: (source, variance); ``footprints``: (gene, source, a)."""
    a = footprints.select(F.col("gene").alias("g1"), "source", F.col("a").alias("_a1"))
    b = footprints.select(F.col("gene").alias("g2"), "source", F.col("a").alias("_a2"))
    got = pairs.select("g1", "g2").distinct().join(a, "g1").join(b, ["g2", "source"]).join(sources, "source").groupBy("g1", "g2").agg(F.sum(F.col("variance") * F.col("_a1") * F.col("_a2")).alias("cov"))
    return pairs.join(got, ["g1", "g2"], "left").withColumn("cov", F.coalesce("cov", F.lit(0.0)))


def two_steps(edges: DataFrame, value: str = "r") -> DataFrame:
    """(source, target, steps, value): the edges, and the paths of two edges through a middle node with
    the product of their values; paths back to their start go."""
    one = edges.select(F.col("g1").alias("source"), F.col("g2").alias("target"), F.lit(1).alias("steps"), q(value).alias("value"))
    a, b = edges.select("g1", F.col("g2").alias("_m"), q(value).alias("_v1")), edges.select(F.col("g1").alias("_m"), "g2", q(value).alias("_v2"))
    two = a.join(b, "_m").where("g1 <> g2").select(F.col("g1").alias("source"), F.col("g2").alias("target"), F.lit(2).alias("steps"), (F.col("_v1") * F.col("_v2")).alias("value"))
    return one.unionByName(two)


def driver_and_neighbour(a: Column, b: Column) -> tuple[Column, Column]:
    """The member with the larger absolute change (the first on a tie), and the other."""
    first = F.abs(a) >= F.abs(b)
    return F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)


def unit_cross(pairs: DataFrame, shares: DataFrame, keys: Sequence[str] = ("g1", "g2")) -> DataFrame:
    """Rows of ``pairs`` (unit, keys, ...) against the ``shares`` of every other unit on the same keys:
    unit_a, unit_b.  An equi-join on the keys, never a cross join."""
    return pairs.withColumnRenamed("unit", "unit_a").join(shares.withColumnRenamed("unit", "unit_b"), list(keys)).where("unit_a <> unit_b")
