"""Regression, tests, resampling and fits against numpy; stores and readers on small files."""

import gzip
import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.functions import tails
from lattica.operators import fit, ranks, regress, resample, store
from lattica.sources import readers


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(0)
    n = 400
    df = pd.DataFrame({"i": range(n), "g": rng.integers(0, 12, n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    df["y"] = 1 + 2 * df.a - df.b + 0.3 * df.g + rng.normal(size=n) * (1 + abs(df.a))
    return df


def test_tails():
    assert tails.normal_sf(1.959963985) == pytest.approx(0.025, abs=1e-9)
    assert tails.normal_ppf(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert tails.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert tails.f_sf(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert tails.beta_inc(2, 3, 0.4) == pytest.approx(0.5248)
    assert math.isnan(tails.t_two_sided(1.0, 0))


def test_ols_and_fixed_effects(spark, table):
    df = spark.createDataFrame(table)
    x = np.column_stack([np.ones(len(table)), table.a, table.b])
    beta, rss, *_ = np.linalg.lstsq(x, table.y, rcond=None)
    got = {r.term: r for r in regress.ols(df, "y", ["a", "b"]).collect()}
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / (len(x) - 3))
    for i, t in enumerate(["intercept", "a", "b"]):
        assert got[t].coef == pytest.approx(beta[i]) and got[t].se == pytest.approx(se[i])
    d = pd.get_dummies(table.g).to_numpy(float)
    want = np.linalg.lstsq(np.column_stack([table.a, table.b, d]), table.y, rcond=None)[0]
    fe = {r.term: r.coef for r in regress.fixed_effect(df, "y", ["a", "b"], ["g"]).collect()}
    assert fe["a"] == pytest.approx(want[0]) and fe["b"] == pytest.approx(want[1])
    one = np.linalg.lstsq(np.column_stack([table.a, d]), table.y, rcond=None)[0][0]
    assert regress.fe_slope(df, "y", "a", ["g"]).first().slope == pytest.approx(one)
    holes = df.withColumn("y", F.when(F.col("i") % 7 != 0, F.col("y"))).withColumn("a", F.when(F.col("i") % 5 != 0, F.col("a")).otherwise(float("nan")))
    assert regress.ols(holes, "y", ["a"]).first().n == sum(i % 7 != 0 and i % 5 != 0 for i in range(400))
    assert regress.ols(df.where("false"), "y", ["a"]).count() == 0


def test_robust_errors(spark, table):
    x = np.column_stack([np.ones(len(table)), table.a, table.b])
    inv = np.linalg.inv(x.T @ x)
    e = table.y.to_numpy() - x @ (inv @ x.T @ table.y.to_numpy())
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    hc3 = np.sqrt(np.diag(inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv))
    df = spark.createDataFrame(table)
    got = [r.se for r in regress.robust(df, "y", ["a", "b"]).collect()]
    assert np.allclose(got, hc3)
    u = np.array([(x * e[:, None])[table.g == g].sum(0) for g in range(12)])
    n, p = x.shape
    cl = np.sqrt(np.diag(inv @ (u.T @ u) @ inv) * 12 / 11 * (n - 1) / (n - p))
    assert np.allclose([r.se for r in regress.robust(df, "y", ["a", "b"], "g").collect()], cl)
    assert regress.robust(df.limit(2), "y", ["a", "b"]).count() == 0


def test_spline_basis_sums_to_one_with_its_first_column():
    x = np.linspace(0, 1, 50)
    b = regress.spline_basis(x, 5)
    assert b.shape == (50, 5) and (b >= -1e-12).all() and (b.sum(1) <= 1 + 1e-12).all()
    cubic = np.column_stack([np.ones(50), b])
    fitted = cubic @ np.linalg.lstsq(cubic, x**3, rcond=None)[0]
    assert np.allclose(fitted, x**3, atol=1e-9)


def test_two_samples_and_anova(spark, table):
    df = spark.createDataFrame(table).withColumn("h", F.col("g") < 4)
    a, b = table.y[table.g < 4], table.y[table.g >= 4]
    w = regress.welch(df, "y", "h").first()
    va, vb = a.var() / len(a), b.var() / len(b)
    assert w.t == pytest.approx((a.mean() - b.mean()) / math.sqrt(va + vb))
    assert w.df == pytest.approx((va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1)))
    f = regress.anova(df, "y", "g").first()
    gm = table.groupby("g").y.transform("mean")
    between, within = ((gm - table.y.mean()) ** 2).sum(), ((table.y - gm) ** 2).sum()
    assert f.f == pytest.approx(between / 11 / (within / 388)) and 0 < f.p < 1e-3
    e = regress.eta_squared(df, "y", "g").first()
    assert e.eta2 == pytest.approx(between / (between + within)) and e.groups == 12
    u = ranks.mann_whitney(df, "y", "h").first()
    assert u.u == sum((a.to_numpy()[:, None] > b.to_numpy()[None]).sum(1))
    one = regress.welch(df.limit(1), "y", "h").first()
    assert one.t is None


def test_meta_and_equivalence(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 1.0)], "e double, s double")
    m = regress.meta_analysis(df, "e", "s").first()
    assert m.estimate == pytest.approx(1.2) and m.se == pytest.approx(1 / math.sqrt(5)) and m.cochran_q == pytest.approx(0.8)
    assert m.p_heterogeneity == pytest.approx(math.erfc(math.sqrt(0.4)))
    p = df.select(regress.tost(F.lit(0.0), F.lit(1.0), F.lit(1.644853627)).alias("p")).first().p
    assert p == pytest.approx(0.05, abs=1e-6)


def test_block_bootstrap_equals_resampled_rows(spark, table):
    df = spark.createDataFrame(table)
    got = {r.term: r for r in resample.block_bootstrap(df, "y", ["a", "b"], "g", 40, 5).collect()}
    blocks = sorted(table.g.astype(str).unique())
    groups = [table[table.g.astype(str) == b] for b in blocks]
    draws = []
    for rep in range(40):
        rng = np.random.default_rng([5, rep])
        rows = pd.concat([groups[k] for k in rng.integers(0, 12, 12)])
        draws.append(np.linalg.lstsq(np.column_stack([np.ones(len(rows)), rows.a, rows.b]), rows.y, rcond=None)[0])
    draws = np.array(draws)
    for i, t in enumerate(["intercept", "a", "b"]):
        assert got[t].boot_se == pytest.approx(draws[:, i].std(), rel=1e-8)
        assert got[t].ci_low == pytest.approx(np.percentile(draws[:, i], 2.5), rel=1e-8)
    assert resample.block_bootstrap(df.where("false"), "y", ["a"], "g").count() == 0


def test_position_blocks(spark):
    df = spark.createDataFrame([("1", 25, "x"), ("1", None, "y"), (None, 3, "z")], "p string, s int, g string")
    got = [r[0] for r in df.select(resample.position_block(F.col("p"), F.col("s"), 10, F.col("g"))).collect()]
    assert got == ["1:2", "unplaced:y", "unplaced:z"]


def test_permutation_tests(spark):
    rng = np.random.default_rng(1)
    n = 60
    x = (np.arange(n) < 20).astype(float)
    s = pd.DataFrame({"x": x, "z": rng.normal(size=n)})
    s["y"] = 3 * s.x + s.z + rng.normal(size=n)
    strong = resample.freedman_lane(s, "y", "x", ["z"], spark, 200, 1)
    assert strong["p"] == pytest.approx(1 / 201) and strong["effect"] == pytest.approx(3, abs=1)
    s["y"] = rng.normal(size=n)
    assert resample.freedman_lane(s, "y", "x", ["z"], spark, 200, 1)["p"] > 0.02
    lab = resample.label_permutation(np.r_[np.ones(10) * 5, np.zeros(20)], np.r_[np.ones(10), np.zeros(20)], spark, 300)
    assert lab["p"] == pytest.approx(1 / 301)
    peak = resample.block_permutation_peak(np.sin(np.arange(200)), 10, 50)
    assert peak > 0
    null = resample.window_mean_null(np.arange(10.0), 3, spark, 500)
    assert null.min() >= 1 and null.max() <= 8


def test_donor_and_block_bootstrap(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(12, 30))
    pairs = pd.DataFrame({"i": range(11), "j": range(1, 12), "block": np.arange(11) // 3})
    mean = lambda p, r, w: {"mean": float(np.average(r, weights=w)) if w.sum() else float("nan")}
    log = resample.double_bootstrap(pairs, z, np.arange(30) // 2, mean, 60, 3, spark)
    c = np.corrcoef(z)
    assert log["mean"].iloc[0] == pytest.approx(np.mean([c[i, i + 1] for i in range(11)]), abs=1e-6)
    out = resample.replicate_summary(spark.createDataFrame(log.assign(k="x")), ["k"], "mean").first()
    assert out.replicates == 60 and out.ci_low <= out.estimate <= out.ci_high


def test_medians_halves_and_random_sets(spark):
    df = spark.createDataFrame([(i, float(i % 10 + (5 if i < 50 else 0)), i < 50) for i in range(100)], "i int, v double, g boolean")
    m = resample.median_contrast(df, "v", "g", "i", 400)
    assert m["difference"] == 5 and m["ci_low"] > 2 and m["p"] == pytest.approx(1 / 400)
    h = resample.ranked_halves(df.withColumn("u", F.lit("a")), "i", ["u"], 3).groupBy("half").count().collect()
    assert {r.half: r["count"] for r in h} == {0: 50, 1: 50}
    cand = spark.range(100).select(F.lit("s").alias("s"), (F.col("id") % 20).cast("string").alias("seg"), F.col("id").alias("k"))
    z = resample.gene_set_null(cand.where("seg IN ('1', '2')"), cand, ["s"], "seg", "k", 60).first()
    assert z.observed == 2 and 1 < z.expected < 3 and z.sd > 0


def test_median_contrast_of_any_number_of_values(spark, monkeypatch):
    n = resample.MOST_BLOCKS + 2
    even = F.col("id") % 2 == 0
    df = spark.range(n).select(even.alias("g"), (F.col("id") / 4 + F.when(even, 10).otherwise(0)).alias("v"))
    m = resample.median_contrast(df, "v", "g", replicates=400)
    spread = n / 4 / 2 / (n / 2) ** 0.5 * 2**0.5  # the standard error of the difference of two medians of uniform values
    assert m["difference"] == 9.75 and m["ci_low"] < 9.75 < m["ci_high"] and m["p"] > 0.5
    assert m["ci_high"] - m["ci_low"] == pytest.approx(2 * 1.96 * spread, rel=0.2)
    monkeypatch.setattr("lattica.operators.ranks.MOST_SORTED", 1000)  # the way of more values
    assert resample.median_contrast(df, "v", "g", replicates=400) == m
    one = resample.median_contrast(df.where("g"), "v", "g")
    assert all(np.isnan(v) for v in one.values())


@pytest.mark.parametrize("n", [1, 2, 5, 6])
def test_middle_places_are_those_of_resamples(n):
    rng, reps = np.random.default_rng(5), 100_000
    drawn = np.sort(rng.integers(0, n, (reps, n)), 1)[:, [(n - 1) // 2, n // 2]]
    share = lambda at: np.bincount(at[:, 0] * n + at[:, 1], minlength=n * n) / reps
    assert np.abs(share(resample._middle_places(rng, n, reps)) - share(drawn)).max() < 0.01


def test_fits_recover_parameters():
    c = np.logspace(0, 3, 20)
    rng = np.random.default_rng(3)
    f = fit.fit_contact_law(c, 0.002 + 0.02 * c**0.5 + rng.normal(0, 0.003, 20), np.full(20, 0.003))
    assert f["power_law"]["k"] == pytest.approx(0.5, abs=0.05) and f["power_law"]["chi2"] < f["hub"]["chi2"]
    hub = 0.005 + 0.2 * (1 + (60 / c) ** (2 / 3)) ** -1.5
    wins = 0
    for _ in range(10):
        g = fit.fit_contact_law(c, hub + rng.normal(0, 0.001, 20), np.full(20, 0.001))
        wins += g["hub"]["chi2"] < g["power_law"]["chi2"]
    assert wins >= 9
    lag = np.arange(1, 31.0)
    e = fit.exponential_fits(lag, 0.3 * np.exp(-lag / 2) + 0.1 * np.exp(-lag / 25))
    assert e["length_short"] == pytest.approx(2, rel=0.15) and e["length_long"] == pytest.approx(25, rel=0.15) and e["rss_two"] < e["rss_one"]
    freq = np.linspace(0.003, 0.5, 60)
    lor = lambda a, u: a / (1 + (2 * np.pi * freq * u) ** 2)
    s = fit.lorentzian_fits(freq, lor(5, 8) + 0.2, np.full(60, 50.0))
    assert s["length_one"] == pytest.approx(8, rel=0.1)
    w = fit.whittle(freq, (lor(5, 8) + 0.2) * rng.exponential(1, 60))
    assert 2 < w["length_one"] < 40 and w["aic_one"] < w["aic_power"] + 6
    x, v = fit.nelder_mead(lambda p: (p[0] - 1) ** 2 + (p[1] + 2) ** 2, [0, 0])
    assert np.allclose(x, [1, -2], atol=1e-3) and v < 1e-6


def test_failed_fits_say_why(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "u string, x double")

    def broken(x):
        raise ValueError("no minimum")

    r = fit.per_group(df, ["u"], ["x"], broken, ["k"]).first()
    assert r.k is None and r.failure == "ValueError: no minimum"


# ------------------------------------------------------------------------------------------ stores


def test_upsert_keeps_other_rows_and_refuses_duplicates(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "tissue string, pair string, v long")
    store.upsert(make([("a", "x", 1), ("b", "x", 2)]), path, ["tissue", "pair"])
    store.upsert(make([("b", "x", 3), ("b", None, 4)]), path, ["tissue", "pair"])
    got = store.upsert(make([("b", None, 5)]), path, ["tissue", "pair"])
    assert sorted(got.collect(), key=str) == sorted(make([("a", "x", 1), ("b", "x", 3), ("b", None, 5)]).collect(), key=str)
    with pytest.raises(ValueError):
        store.upsert(make([("c", "x", 1), ("c", "x", 2)]), path, ["tissue", "pair"])
    assert store.read(spark, path).count() == 3


def test_replaced_groups_lose_their_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "tissue string, v long")
    store.publish(make([("a", 1), ("a", 2), ("b", 3), (None, 9)]), path)
    got = store.replace_groups(make([("a", 7)]), path, "tissue", ["a", "b"], ["tissue", "v"])
    assert sorted((r.tissue or "", r.v) for r in got.collect()) == [("", 9), ("a", 7)]
    with pytest.raises(ValueError):
        store.replace_groups(make([("c", 7)]), path, "tissue", ["a"])
    with pytest.raises(ValueError):
        store.replace_groups(make([("a", 7), ("a", 7)]), path, "tissue", ["a"], ["tissue", "v"])
    assert store.pending(["a", "b"], spark, path, "tissue") == ["b"]
    assert store.pending(["a", "b"], spark, path, "tissue", resume=False) == ["a", "b"]
    assert store.one_row(store.read(spark, path).where("tissue = 'a'")).v == 7
    with pytest.raises(ValueError):
        store.one_row(store.read(spark, path))


# ------------------------------------------------------------------------------------------ readers


def test_count_matrix(spark, tmp_path):
    p = tmp_path / "u1.gct.gz"
    p.write_bytes(gzip.compress(b"#1.2\n2\t2\nName\tDescription\tS-1\tS-2\nE1.4\tx\t5\t6\nE2.1\ty\t7\tbad\nE1.9\tz\t1\t1\n"))
    got = {(r.gene_id, r.sample_id): r.value for r in readers.gct(spark, str(p), "u1").collect()}
    assert got == {("E1", "S-1"): 5, ("E1", "S-2"): 6, ("E2", "S-1"): 7, ("E2", "S-2"): None}
    short = tmp_path / "s.gct"
    short.write_text("#1.2\n")
    with pytest.raises(ValueError):
        readers.gct(spark, str(short))


def test_delimited_readers(spark, tmp_path):
    a = tmp_path / "a.tsv"
    a.write_text(" chr1 \tx1\tchr2\ty2\torientation_1\torientation_2\n1\t5\t1\t9\tp\tn\n1\t5\t2\t9\tp\tn\n2\tq\t2\t9\tp\tn\n")
    assert [tuple(r) for r in readers.loops(spark, str(a)).collect()] == [("1", 5, 9), ("2", None, 9)]
    b = tmp_path / "b.bed"
    b.write_text("1\t10\t20\n")
    assert readers.bed(spark, str(b)).first().asDict() == {"chr": "1", "start": 10, "end": 20}
    e = tmp_path / "e.bed"
    e.write_text("#c\ts\te\tid\tA\tB\n1\t1\t2\tG1.3\t0.5\tx\n")
    assert sorted(tuple(r) for r in readers.expression_bed(spark, str(e)).collect()) == [("G1", "A", 0.5), ("G1", "B", None)]
    for u in ("lung", "liver"):
        (tmp_path / f"pairs_{u}.csv").write_text(f"g1,v\n{u[0]},1\n")
    got = readers.per_unit(spark, str(tmp_path / "pairs_*.csv"), r"pairs_(\w+)\.csv")
    assert sorted((r.g1, r.unit) for r in got.collect()) == [("l", "liver"), ("l", "lung")]
    c = tmp_path / "c.tsv"
    c.write_text("k\tBA1\tBA2\tother\ng\t1\t2\t3\n")
    assert readers.prefixed_counts(spark, str(c), "k", "BA").count() == 2
    m = tmp_path / "m.txt"
    m.write_text('!Series_title\t"A study"\n!Sample_id\t"x"\t"y"\ndata\t1\n')
    assert [(r.field, r.position, r.value) for r in readers.series_metadata(spark, str(m)).collect()] == [("Series_title", 0, "A study"), ("Sample_id", 0, "x"), ("Sample_id", 1, "y")]
    assert readers.fuzzy_column(readers.tsv(spark, str(c)), "the") == "other"


def test_sparse_contacts_in_bins_or_base_pairs(spark, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("chr\tb1\tb2\to\te\n1\t3\t5\t7\t2\n")
    b.write_text("1\t120000\t1\t200000\t7\t2\tx\n")
    want = [("1", 3, 2, 7.0, 2.0)]
    assert [tuple(r) for r in readers.sparse_contacts(spark, str(a), 40000).collect()] == want
    assert [tuple(r) for r in readers.sparse_contacts(spark, str(b), 40000).collect()] == want


def test_archives(spark, tmp_path):
    z = tmp_path / "m.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("x.tsv", "id\tS1\tS2\nG1.2\t1\t2\nG2\t3\tq\n")
    got = sorted((r.gene_id, r.sample_id, r.value) for r in readers.zipped_matrix(spark, str(z), "x.tsv", samples=["S1"]).collect())
    assert got == [("G1", "S1", 1.0), ("G2", "S1", 3.0)]
    np.savez(tmp_path / "a.npz", X=np.arange(4.0).reshape(2, 2), genes=np.array(["g", "h"]), samples=np.array(["s", "t"]))
    assert readers.npz(spark, str(tmp_path / "a.npz")).where("row = 'h' AND column = 't'").first().value == 3.0
    x = tmp_path / "b.xlsx"
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(x, "w") as f:
        f.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        f.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>4</v></c></row></sheetData></worksheet>')
    assert readers.sheets(str(x)).to_dict("records") == [{"name": "ab", "n": "4"}]


def test_parquet_members(spark, tmp_path):
    p = str(tmp_path / "p")
    spark.range(10).withColumn("x", F.col("id") * 2).write.parquet(p)
    keep = spark.createDataFrame([(3,), (3,), (None,), (99,)], "id long")
    assert [tuple(r) for r in readers.parquet(spark, p, ["id", "x"], keep, "id").collect()] == [(3, 6)]


def test_decay_fits_follow_the_table(spark, tmp_path):
    from lattica.plans import catalog_joins

    rng = np.random.default_rng(3)
    rows, n = [], 160
    for unit, length in (("near", 2.0), ("far", 8.0), ("alone", 2.0)):
        for s in range(1 if unit == "alone" else 40):
            a, v = math.exp(-1 / length), rng.normal()
            for k in range(n):
                v = a * v + math.sqrt(1 - a * a) * rng.normal() if k else v
                if rng.random() > 0.02:  # some values are missing
                    rows.append((unit, f"GTEX-S{s}", "1", f"ENSG{k:05d}.2", k, float(1000 * 2**v)))
    spark.createDataFrame(rows, "unit string, sample_id string, chr string, gene_id string, gene_rank int, expr_value double").write.parquet(f"{tmp_path}/expr_signal.parquet")
    genes = [(k, f"ENSG{k:05d}", "1", k, k + 1, "+", "N", "b", float(40 + 10 * math.sin(k))) for k in range(n)]
    spark.createDataFrame(genes, "row_id long, gene_id string, chr string, gene_start long, gene_end long, strand string, gene_name string, biotype string, gc double").write.parquet(f"{tmp_path}/gene.parquet")
    got = {r.unit: r for r in catalog_joins.decay_fits(spark, str(tmp_path)).collect()}
    assert set(got) == {"near", "far", "alone"} and got["near"].lags == 60
    for unit, length in (("near", 2.0), ("far", 8.0)):
        r = got[unit]
        assert (r.failure, r.lorentzian_failure, r.whittle_failure) == (None, None, None)
        for found in (r.length_one, r.lorentzian_length_one, r.whittle_length_one):
            assert 0.6 * length < found < 1.6 * length, (unit, found)
        assert r.whittle_aic_one < r.whittle_aic_power
    assert got["alone"].whittle_failure and got["alone"].lorentzian_failure  # one sample has no deviations
