"""Signals, lags, spectra, residuals, intervals, pairs: algebraic properties and numpy or brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import bins
from lattica.operators import interval, lag, pairs, ranks, resid, simulate, spectral
from lattica.operators import signal as sig


def long(spark, x, unit="u", parts=1):
    """A samples x positions array as a signal table."""
    n = x.shape[1] // parts
    rows = [(unit, f"s{s:03d}", str(j // n), j % n, float(x[s, j])) for s in range(x.shape[0]) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "unit string, sample string, part string, rank int, value double")


@pytest.fixture(scope="module")
def genome(spark):
    return simulate.simulate_genome(spark, 120, 2, 40, 5.0, seed=7).cache()


def wide(df, value="value"):
    p = df.toPandas()
    p["pos"] = p["part"].astype(str) + ":" + p["rank"].astype(str).str.zfill(6)
    return p.pivot(index="sample", columns="pos", values=value).to_numpy()


def test_identity_holds_and_landscape_dominates(spark, genome):
    s = genome.select("unit", "sample", "part", "rank", "value")
    assert spectral.periodogram_identity(s).agg(F.max("relative_error")).first()[0] < 1e-8
    x = wide(s)
    m = x.mean(0)
    want = (m**2).sum() * len(x) / ((m**2).sum() * len(x) + ((x - m) ** 2).sum())
    assert abs(spectral.landscape_share(s).first().share - want) < 1e-10
    assert 0.8 < want < 1


def test_both_transforms_agree(spark):
    a = spark.createDataFrame([(1, np.sin(np.arange(17.0)).tolist()), (2, np.arange(16.0).tolist()), (3, [])], "id int, x array<double>")
    p = {(r.id, r.k): r.power for r in spectral.periodogram(a).collect()}
    q = {(r.id, r.k): r.power for r in spectral.dft(a.where("size(x) > 0")).collect()}
    assert p.keys() == q.keys() and all(abs(p[k] - q[k]) < 1e-8 * (1 + p[k]) for k in p)


def test_circular_lags_match_rolled_sums(spark):
    x = np.random.default_rng(0).normal(size=(12, 30))
    y = x - x.mean(0)
    got = {r.lag: r.covariance for r in lag.lag_covariance(long(spark, y).withColumnRenamed("value", "dev"), 30).collect()}
    for k in (0, 1, 5, 29):
        assert abs(got[k] - (y * np.roll(y, -k, 1)).sum(1).mean()) < 1e-9


def test_lag_profile_matches_numpy_and_falls(spark, genome):
    s = genome.select("unit", "sample", "part", "rank", F.col("cis").alias("value"))
    got = {r.lag: (r.correlation, r.pairs) for r in lag.lag_profile(s, 130).collect()}
    x = wide(s)
    z = (x - x.mean(0)) / (x.std(0) + 1e-12)
    for k in (0, 1, 7, 119):
        want = np.mean([np.mean(z[:, c * 120 : (c + 1) * 120 - k] * z[:, c * 120 + k : (c + 1) * 120]) for c in range(2)])
        assert abs(got[k][0] - want) < 1e-9
    assert got[0][0] > got[5][0] > got[20][0]
    assert got[120] == (None, 0) and got[130] == (None, 0)


def test_white_noise_has_no_profile(spark):
    x = np.random.default_rng(1).normal(size=(200, 40))
    got = lag.lag_profile(long(spark, x), 5).where("lag > 0").agg(F.max(F.abs("correlation"))).first()[0]
    assert got < 0.05


def test_trend_removal_matches_projection(spark):
    rng = np.random.default_rng(2)
    x, g = rng.normal(size=(9, 25)), rng.normal(size=25)
    s = long(spark, x)
    cov = spark.createDataFrame([("0", j, float(v)) for j, v in enumerate(g)], "part string, rank int, covariate double")
    d = np.vander((g - g.mean()) / g.std(), 3, increasing=True)
    want = x - x @ d @ np.linalg.pinv(d)
    assert np.allclose(wide(resid.remove_trend(s, resid.trend_basis(s, cov))), want, atol=1e-9)
    slopes = {r.sample: r.slope for r in resid.covariate_slopes(s, cov).collect()}
    z = (g - g.mean()) / g.std()
    for i in range(9):
        assert abs(slopes[f"s{i:03d}"] - np.polyfit(z, x[i], 1)[0]) < 1e-9


def test_constant_covariate_removes_the_mean_only(spark):
    x = np.random.default_rng(3).normal(size=(5, 10)) + 7
    s = long(spark, x)
    cov = s.select("part", "rank").distinct().withColumn("covariate", F.lit(0.4))
    assert np.allclose(wide(resid.remove_trend(s, resid.trend_basis(s, cov))), x - x.mean(1, keepdims=True), atol=1e-9)
    assert {r.slope for r in resid.covariate_slopes(s, cov).collect()} == {0.0}


def test_sample_factors_and_components(spark):
    rng = np.random.default_rng(4)
    f = rng.normal(size=12)
    x = rng.normal(size=(12, 20))
    s = long(spark, x)
    fac = spark.createDataFrame([(f"s{i:03d}", float(v)) for i, v in enumerate(f)], "sample string, f double")
    d = np.column_stack([np.ones(12), f])
    assert np.allclose(wide(resid.remove_sample_factors(s, fac, ["f"])), x - d @ np.linalg.pinv(d) @ x, atol=1e-9)
    u, sv, vt = np.linalg.svd(x, full_matrices=False)
    want = x - (u[:, :3] * sv[:3]) @ vt[:3]
    assert np.allclose(wide(resid.remove_components(s, 3)), want, atol=1e-8)


def test_own_dosage_matches_polyfit(spark):
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(30, 4)), rng.normal(size=(30, 4))
    c[:, 3] = 0.5
    dose = long(spark, c).withColumnRenamed("value", "dose")
    coef = {r["rank"]: r for r in resid.own_dosage(long(spark, x), dose).collect()}
    for j in range(3):
        b2, b1, b0 = np.polyfit(c[:, j], x[:, j], 2)
        assert np.allclose([coef[j].b0, coef[j].b1, coef[j].b2], [b0, b1, b2], atol=1e-8)
    assert (coef[3].b0, coef[3].b1, coef[3].b2) == (0, 0, 0)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_balanced_rows_have_equal_sums(spark, most):
    rng = np.random.default_rng(6)
    m = rng.random((6, 6)) + 0.1
    rows = [("a", i, j, float(m[i, j])) for i in range(6) for j in range(i, 6)]
    got = resid.balance(spark.createDataFrame(rows, "part string, i int, j int, v double"), rounds=8 if most == 0 else 30, most_cells=most).collect()
    s = np.zeros(6)
    for r in got:
        s[r.i] += r.v
        if r.i != r.j:
            s[r.j] += r.v
    assert s.std() / s.mean() < (1e-2 if most == 0 else 1e-6)


def test_genes_are_balanced_by_map_and_chromosome(spark, small):
    from lattica.plans import catalog
    from lattica.plans import views as V

    got = catalog.matrix_balance(spark, small).toPandas()
    p = V.pairs(spark, small).where("contact_kr > 0 AND bin_distance >= 0").select("unit", "part", "g1", "g2", "contact_kr").toPandas()
    p["i"], p["j"] = p[["g1", "g2"]].min(axis=1), p[["g1", "g2"]].max(axis=1)
    cells = p.groupby(["unit", "part", "i", "j"], as_index=False)["contact_kr"].sum()
    assert len(got) == len(cells) and set(got.i) | set(got.j) == set(p.g1) | set(p.g2)
    one = max(cells.groupby(["unit", "part"]), key=lambda x: len(x[1]))
    f, v = one[1], one[1]["contact_kr"].to_numpy(float)
    names = sorted({*f.i, *f.j})
    i, j = f.i.map(names.index).to_numpy(), f.j.map(names.index).to_numpy()
    for _ in range(30):
        s = np.array([v[(i == k) | (j == k)].sum() for k in range(len(names))])
        x = np.sqrt(s / s.mean())
        v = v / x[i] / x[j]
    mine = got[(got.unit == one[0][0]) & (got.part == one[0][1])].set_index(["i", "j"])["v"]
    assert np.allclose([mine[a, b] for a, b in zip(f.i, f.j)], v, atol=2e-6)
    # the join path on the same genes
    t = spark.createDataFrame(cells[cells.unit == one[0][0]].rename(columns={"contact_kr": "v"})[["part", "i", "j", "v"]])
    both = [{(r.part, r.i, r.j): r.v for r in resid.balance(t, "part", 3, most).collect()} for most in (1 << 20, 0)]
    assert both[0].keys() == both[1].keys() and np.allclose(list(both[0].values()), [both[1][k] for k in both[0]])


def test_normalisation(spark):
    rng = np.random.default_rng(7)
    c = rng.integers(0, 60, (8, 6)).astype(float)
    s = long(spark, c)
    assert np.allclose(wide(sig.log2_cpm(s)), np.log2(c / c.sum(1, keepdims=True) * 1e6 + 1))
    t = sig.two_way_center(s)
    y = c - c.mean(1, keepdims=True)
    assert np.allclose(wide(t, "dev"), y - y.mean(0))
    med = np.median(c, 0)
    mad = np.median(abs(c - med), 0)
    assert np.allclose(wide(sig.robust_scale(s, "value", sig.POSITION), "scaled"), (c - med) / (1.4826 * mad + 1e-6))
    empty = s.where("false")
    assert sig.log2_cpm(empty).count() == 0 and sig.zscore(empty, "value", ["unit"]).count() == 0


def test_sample_without_counts_gets_null(spark):
    s = long(spark, np.zeros((2, 3)))
    assert {r.value for r in sig.log2_cpm(s).collect()} == {None}


def test_bins_close_right_and_keep_ties(spark):
    df = spark.createDataFrame([(v,) for v in [None, float("nan"), -1.0, 0.0, 1.0, 1.5, 2.0, 9.0]], "x double")
    got = [r[0] for r in df.select(bins.cut(F.col("x"), [0, 1, 2], ["a", "b"])).collect()]
    assert got == [None, None, None, None, "a", "b", "b", None]
    left = [r[0] for r in df.select(bins.cut(F.col("x"), [0, 1, 2], ["a", "b"], right=False)).collect()]
    assert left == [None, None, None, "a", "b", "b", None, None]
    q = bins.qcut(spark.createDataFrame([(v,) for v in [1, 1, 1, 2, 3, 4, 5, 6]], "v int"), "v", 4, drop_duplicates=True).orderBy("v")
    assert [r.bin for r in q.collect()] == [0, 0, 0, 0, 1, 1, 2, 2]
    with pytest.raises(ValueError):
        bins.cut(F.col("x"), [1, 1, 2])


def test_qcut_matches_edges_of_pandas(spark):
    import pandas as pd

    rng = random.Random(1)
    v = [rng.choice([0.0, 0.0, rng.random(), round(rng.random(), 1)]) for _ in range(301)]
    got = bins.qcut(spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double"), "v", 5, drop_duplicates=True).orderBy("i")
    assert [r.bin for r in got.collect()] == pd.qcut(v, 5, labels=False, duplicates="drop").tolist()


def test_ranks_and_fdr_match_brute_force(spark):
    import pandas as pd

    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice([None, float("nan"), round(rng.random(), 1)])) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, g string, v double")
    p = pd.DataFrame(rows, columns=["i", "g", "v"]).set_index("i")
    want = p.groupby("g").v.rank()
    got = {r.i: r.rank for r in ranks.average_rank(df, "v", ["g"]).collect()}
    assert len(got) == 200 and all((math.isnan(want[i]) and got[i] is None) or got[i] == want[i] for i in got)
    q = {r.i: r.q for r in ranks.benjamini_hochberg(df, "v", ["g"]).collect()}
    for g in "ab":
        s = p[p.g == g].v.dropna().sort_values(ascending=False)
        raw = s * len(s) / s.rank(method="max")
        best = raw.cummin().groupby(s).min().clip(upper=1)
        assert all(abs(q[i] - best[s[i]]) < 1e-12 for i in s.index)
    assert ranks.average_rank(df.where("false"), "v", ["g"]).count() == 0


def test_spearman_of_constant_input_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert ranks.spearman(df, "x", "y").first().rho is None


# ------------------------------------------------------------------------------------------ intervals


def _boxes(spark, seed, n=60):
    rng = random.Random(seed)
    pts = [(i, rng.choice(["1", "2"]), rng.choice([None, rng.randint(0, 300)])) for i in range(n)]
    iv = [(j, rng.choice(["1", "2"]), a, rng.choice([a, a + rng.randint(0, 40), a - 1])) for j in range(20) for a in [rng.randint(0, 280)]]
    return pts, iv, spark.createDataFrame(pts, "i int, chr string, p int"), spark.createDataFrame(iv, "j int, chr string, s int, e int")


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("width", [7, 1000])
def test_points_in_intervals(spark, monkeypatch, width, small):
    pts, iv, p, v = _boxes(spark, 1)
    if not small:
        monkeypatch.setattr(interval, "small_enough", lambda df, *_: (df, False))
    got = {(r.i, r.j) for r in interval.points_in_intervals(p, v, ["chr"], "p", "s", "e", width).collect()}
    assert got == {(i, j) for i, c, x in pts for j, d, s, e in iv if x is not None and c == d and s <= x <= e}
    both = interval.points_in_intervals(p, v, ["chr"], "p", "s", "e", width, "left")
    assert both.select("i").distinct().count() == len(pts)


def test_as_of(spark):
    pts, iv, p, v = _boxes(spark, 2)
    got = {r.i: (r.j, r.s) for r in interval.as_of(p, v, ["chr"], "p", "s", ["j", "s"], ["j"], "e").collect()}
    for i, c, x in pts:
        before = [(s, j, e) for j, d, s, e in iv if d == c and x is not None and s <= x]
        want = (None, None)
        if before:
            s, j, e = max(before)
            want = (j, s) if x <= e else want
        assert got[i] == want
    counts = {r.i: r.before for r in interval.events_before(p, v, ["chr"], "p", "s").collect()}
    assert counts == {i: None if x is None else sum(d == c and s < x for _, d, s, _ in iv) for i, c, x in pts}


def test_containment_overlap_and_range(spark):
    rng = random.Random(3)
    prs = [(i, rng.choice(["1", "2"]), rng.randint(0, 100), rng.randint(100, 300)) for i in range(40)]
    _, iv, _, v = _boxes(spark, 4)
    p = spark.createDataFrame(prs, "i int, chr string, a int, b int")
    good = [x for x in iv if x[2] <= x[3]]
    got = {r.i: (r.same, r.crossed) for r in interval.contained_and_crossed(p, v.where("s <= e"), ["chr"], "a", "b", "s", "e", 25, ["i"]).collect()}
    for i, c, a, b in prs:
        ins = [((s <= a <= e), (s <= b <= e)) for _, d, s, e in good if d == c]
        assert got[i] == (any(x and y for x, y in ins), sum(x != y for x, y in ins))
    top = {r.i: r.strongest for r in interval.strongest_between(p, v.withColumn("w", F.col("j") * 1.5), ["chr"], "a", "b", "s", "w", 25, ["i"]).collect()}
    assert top == {i: max((j * 1.5 for j, d, s, _ in iv if d == c and a < s < b), default=None) for i, c, a, b in prs}
    left = spark.createDataFrame([(i, c, a, a + 15) for i, c, a, _ in prs], "i int, chr string, s int, e int")
    one = {r.i: r.j for r in interval.overlap_unique(left, v, ["chr"], "s", "e", "i", 9, ["j"]).collect()}
    want = {i: [j for j, d, s, e in good if d == c and s <= a + 15 and e >= a] for i, c, a, _ in prs}
    assert one == {i: w[0] for i, w in want.items() if len(w) == 1}
    rp = {(r.i1, r.i2) for r in interval.range_pairs(p.select("i", "chr", "a"), ["chr"], "a", "i", 20).collect()}
    assert rp == {(x[0], y[0]) for x in prs for y in prs if x[1] == y[1] and 0 <= y[2] - x[2] <= 20 and ((y[2], y[0]) > (x[2], x[0]))}


def test_random_partners_are_valid_and_repeatable(spark):
    pool = spark.range(200).select(F.lit("1").alias("part"), F.pmod("id", F.lit(2)).cast("int").alias("q"), F.col("id").alias("g"), F.col("id").cast("int").alias("rank"))
    p = spark.range(50).select(F.struct(F.lit("1").alias("part"), F.lit(0).alias("q")).alias("s1"), F.struct(F.lit("1").alias("part"), F.lit(1).alias("q")).alias("s2"), "id")
    a = interval.random_partners(p, pool, ["part", "q"], ["g"], "rank", 50, 20, 3).collect()
    b = interval.random_partners(p.repartition(7), pool.repartition(3), ["part", "q"], ["g"], "rank", 50, 20, 3).collect()
    assert {(r.id, r.u.g, r.v.g) for r in a} == {(r.id, r.u.g, r.v.g) for r in b} and len(a) >= 48
    assert all(r.u.g % 2 == 0 and r.v.g % 2 == 1 and abs(r.u.g - r.v.g) > 50 for r in a)


# ------------------------------------------------------------------------------------------ pairs


def test_colocalisation_and_prediction_match_nested_loops(spark):
    rng = random.Random(8)
    sets = [(g, c, v, round(rng.random(), 2), round(rng.random() / 2, 2), rng.choice([None, float("nan"), -1.0, 0.5, 2.0])) for g in "abcd" for c in (1, 2) for v in "uvwxyz" if rng.random() < 0.6]
    prs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")]
    s = spark.createDataFrame(sets, "gene string, cs int, variant string, pip double, af double, effect double")
    p = spark.createDataFrame(prs, "g1 string, g2 string")
    got = {(r.g1, r.g2): r for r in pairs.colocalisation(p, s).collect()}
    pred = {(r.g1, r.g2): r for r in pairs.genetic_prediction(p, s, 0.0).collect()}
    ok = lambda e: e is not None and not math.isnan(e)
    for g1, g2 in prs:
        best, direction, total = 0.0, None, 0.0
        for c1 in (1, 2):
            for c2 in (1, 2):
                a = {v: (q, f, e) for g, c, v, q, f, e in sets if g == g1 and c == c1}
                b = {v: (q, f, e) for g, c, v, q, f, e in sets if g == g2 and c == c2}
                sh = sorted(a.keys() & b.keys(), key=lambda v: (-a[v][0] * b[v][0], v))
                score = sum(a[v][0] * b[v][0] for v in sh)
                lead = [v for v in sh if ok(a[v][2]) and ok(b[v][2])]
                sign = math.copysign(1, a[lead[0]][2] * b[lead[0]][2]) if lead else None
                if score > best + 1e-12:
                    best, direction = score, sign
                if lead:
                    v = lead[0]
                    total += score * 2 * a[v][1] * (1 - a[v][1]) * a[v][2] / 2 * b[v][2] / 2
        assert abs(got[g1, g2].p_coloc - best) < 1e-9 and got[g1, g2].direction == direction
        if (g1, g2) in pred and pred[g1, g2].pred_r is not None:
            assert abs(pred[g1, g2].pred_r - total) < 1e-9
    assert (got["d", "e"].fm1, got["d", "e"].fm2, got["d", "e"].p_coloc) == (True, False, 0.0)


def test_closed_forms(spark):
    one = spark.range(1)
    f = lambda c: one.select(c).first()[0]
    L = lambda v: F.lit(float(v))
    assert f(pairs.predicted_genetic_covariance(L(0.5), L(0.4), L(-0.5))) == pytest.approx(-0.1)
    assert f(pairs.saturation_exponent(L(0), 3)) == 1 and f(pairs.saturation_exponent(L(1e12), 3)) < 1e-9
    assert f(pairs.gc_layer_correlation(L(0.04), L(1), L(-2), L(0.5), L(0.4))) == pytest.approx(-0.4)
    assert f(pairs.gc_layer_correlation(L(0.04), L(1), L(-2), L(0), L(0.4))) is None


def test_lags_of_pairs_and_triples(spark):
    g = spark.createDataFrame([("1", 5, "b"), ("1", 5, "a"), ("1", 9, "c"), ("2", 1, "z")], "part string, start int, g string")
    p = lag.adjacent_pairs(g, ["part"], ["start", "g"], ["g"]).collect()
    assert [(r.g1, r.g2) for r in p] == [("a", "b"), ("b", "c")]
    assert [(r.g1, r.g2, r.g3) for r in lag.triples(g, ["part"], ["start", "g"], ["g"]).collect()] == [("a", "b", "c")]


def test_decay_length_is_recovered(spark):
    rows = [("u", k, math.exp(-k / 6)) for k in range(0, 40)] + [("v", 1, 0.5)]
    got = {r.unit: r.decay_length for r in lag.decay_length(spark.createDataFrame(rows, "unit string, lag int, v double"), ["unit"], "lag", "v", F.lit(0.01), 30, 3).collect()}
    assert abs(got["u"] - 6) < 1e-9 and got["v"] is None


def test_simulation_is_the_same_for_a_seed(spark):
    a = simulate.simulate_genome(spark, 20, 2, 3, seed=5).orderBy("sample", "part", "rank").collect()
    b = simulate.simulate_genome(spark, 20, 2, 3, seed=5).repartition(5).orderBy("sample", "part", "rank").collect()
    assert a == b and a != simulate.simulate_genome(spark, 20, 2, 3, seed=6).orderBy("sample", "part", "rank").collect()


def test_covariate_bias_is_predicted_and_removed(spark):
    x = simulate.simulate_genome(spark, 300, 2, 120, gc_bias_sd=0.5, cis_sd=0.0, noise_sd=0.3, seed=3).cache()
    s = x.select("unit", "sample", "part", "rank", "value")
    track = x.select("part", "rank", F.col("gc").alias("covariate")).distinct()
    raw = {r.lag: r.correlation for r in lag.lag_profile(s, 10).collect()}
    clean = {r.lag: r.correlation for r in lag.lag_profile(resid.remove_trend(s, resid.trend_basis(s, track, 1)), 10).collect()}
    assert raw[1] > 0.3 and abs(clean[1]) < 0.5 * raw[1] and abs(clean[10]) < 0.5 * raw[10]


def test_pair_correlations_with_holes(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20, 4))
    s = long(spark, x).where("NOT (sample = 's003' AND rank = 1)")
    pairs_ = spark.createDataFrame([("u", "0", 0, 1), ("u", "0", 0, 3), ("u", "0", 2, 9)], "unit string, part string, rank1 int, rank2 int")
    got = {(r.rank1, r.rank2): (r.r, r.n_samples) for r in lag.pair_correlations(s, pairs_).collect()}
    z = lambda v: (v - v.mean()) / (v.std() + 1e-9)
    keep = np.arange(20) != 3
    assert got[0, 1][1] == 19 and got[0, 1][0] == pytest.approx(float((z(x[:, 0])[keep] * z(x[keep, 1])).mean()), abs=1e-9)
    assert got[0, 3][0] == pytest.approx(float((z(x[:, 0]) * z(x[:, 3])).mean()), abs=1e-9)
    assert (2, 9) not in got


def test_simulated_layers_have_the_moments_of_the_model(spark):
    x = simulate.simulate_genome(spark, 2000, 2, 70, 4.0, gc_phi=0.9, gc_bias_sd=0.3, cis_sd=0.6, noise_sd=0.4, seed=12).toPandas()
    assert len(x) == 2 * 2000 * 70 and x.groupby("sample").gc_slope.nunique().max() == 1
    rest = x.value - x.landscape - x.gc_slope * x.gc - x.cis
    assert rest.std() == pytest.approx(0.4, rel=0.02) and abs(rest.mean()) < 0.01
    assert x.cis.std() == pytest.approx(0.6, rel=0.03)
    assert x.landscape.mean() == pytest.approx(1.3 * 3, rel=0.1)
    cis = x.sort_values(["sample", "part", "rank"]).cis.to_numpy().reshape(140, 2000)
    for k in (1, 4, 9):
        assert (cis[:, k:] * cis[:, :-k]).mean() / (cis**2).mean() == pytest.approx(math.exp(-k / 4), abs=0.03)
    track = x[(x["sample"] == "s00000") & (x.part == "1")].sort_values("rank").gc.to_numpy()
    assert abs(track.mean()) < 1e-9 and track.std() == pytest.approx(1, abs=1e-9)
    assert (track[1:] * track[:-1]).mean() == pytest.approx(0.9, abs=0.05)


def test_a_filter_by_doubling_is_the_recursion():
    rng = np.random.default_rng(2)
    start, steps = rng.normal(size=3), rng.normal(size=(3, 36))
    x = simulate.autoregression(start, steps, 0.8)
    want = start
    for i in range(36):
        want = 0.8 * want + steps[:, i]
        assert np.allclose(x[:, i + 1], want)
    assert np.allclose(simulate.autoregression(start, steps, 0.0)[:, 1:], steps)


def test_a_mixture_keeps_the_variance_of_its_local_layer(spark):
    x = simulate.mixture_with_covariate(spark, 0.5, seed=3, n_genes=400, n_chrom=1, n_samples=200, noise_sd=0.0).toPandas()
    local = x.value - x.landscape
    assert local.std() == pytest.approx(0.6, rel=0.12)
    assert np.corrcoef(local, x.cis)[0, 1] == pytest.approx(math.sqrt(0.5), abs=0.06)
