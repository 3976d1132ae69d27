"""Problems 3 to 6: against brute force on small cases, with nulls, ties, empty tables, clashing names."""

import csv
import datetime as dt
import io
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.functions.keys import canonical_gene, canonical_key, leading_tokens
from lattica.operators import hotkeys, orphans, quality
from lattica.plans import problems
from lattica.session import written
from lattica.sources import lines


def T(day):
    return None if day is None else dt.datetime(2025, 1, 1) + dt.timedelta(days=day)


def test_canonical_keys(spark):
    df = spark.createDataFrame([(" GTEX.AB1_cd–9 ", "ENSG001.12"), (None, None), ("a--b", " ensg7 "), ("-x-", "ENSG7.1 ")], "a string, b string")
    got = df.select(canonical_key(F.col("a")), canonical_gene(F.col("b")), leading_tokens(F.col("a"), 2)).collect()
    assert [tuple(r) for r in got] == [("gtex-ab1-cd-9", "ensg001", "gtex-ab1"), (None, None, None), ("a-b", "ensg7", "a-b"), ("x", "ensg7", "x")]


# ------------------------------------------------------------------------------------------ problem 3


@pytest.mark.parametrize("block_rows,chunk_rows", [(7, 3), (1000, 5), (5, 1000)])
def test_offset_chunks_match_brute_force(spark, tmp_path, block_rows, chunk_rows):
    rng = random.Random(block_rows)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([True, True, True, False, None])) for i in range(400)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "i int, k string, f boolean").coalesce(1).write.parquet(path)
    blocks = hotkeys.read_blocks(spark, path, ["i", "k", "f"], block_rows)
    numbered = hotkeys.number_rows(blocks, "k").select("k", "i", "_no").collect()
    order = defaultdict(list)
    for i, k, _ in rows:
        order[k].append(i)
    assert {(r.k, r.i): r["_no"] for r in numbered} == {(k, i): n for k, v in order.items() for n, i in enumerate(v)}
    got = {r.k: r for r in hotkeys.per_key(blocks, "k", {"n_f": F.col("f")}, F.col("f"), chunk_rows).collect()}
    for k in order:
        flags = [f for _, kk, f in rows if kk == k]
        longest = run = 0
        for f in flags:
            run = run + 1 if f else 0
            longest = max(longest, run)
        assert (got[k].n_rows, got[k].n_f, got[k].longest_run) == (len(flags), sum(map(bool, flags)), longest)
        assert got[k].chunks == -(-len(flags) // chunk_rows)


def test_offset_chunks_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([], "k string, f boolean").write.parquet(path)
    assert hotkeys.per_key(hotkeys.read_blocks(spark, path, ["k", "f"]), "k", {}, F.col("f")).count() == 0


def test_no_chunk_holds_more_than_its_share(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("k")).write.parquet(path)
    n = hotkeys.number_rows(hotkeys.read_blocks(spark, path, ["k"], 512), "k")
    assert n.groupBy("k", F.floor(F.col("_no") / 100)).count().agg(F.max("count")).first()[0] == 100


# ------------------------------------------------------------------------------------------ problem 4


def _brute(children, parents, match, dated):
    out = []
    for row in children:
        *key, at = row[1:]
        if all(k is None for k in key):
            continue
        if match == "simple" and any(k is None for k in key):
            continue
        if match == "full" and any(k is None for k in key):
            out.append(row[0])
            continue
        hit = False
        for p in parents:
            *pk, s, e = p
            if all(k is None or k == q for k, q in zip(key, pk)):
                if not dated or (at is not None and s is not None and s <= at and (e is None or at < e)):
                    hit = True
        if not hit:
            out.append(row[0])
    return sorted(out)


@pytest.mark.parametrize("match", orphans.MATCH)
@pytest.mark.parametrize("dated", [True, False])
@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_orphans_match_brute_force(spark, match, dated, limit):
    rng = random.Random(3)
    pick = lambda: rng.choice(["x", "y", "z", None])
    day = lambda: rng.choice([None, *range(0, 20)])
    children = [(i, "x" if i % 3 == 0 else pick(), pick(), T(day())) for i in range(150)]
    parents = [(pick(), pick(), T(day()), T(day())) for _ in range(12)] + [("x", "y", T(0), T(4)), ("x", "y", T(3), T(9)), ("x", "y", T(9), T(9))]
    kid = spark.createDataFrame(children, "id int, a string, b string, at timestamp")
    par = spark.createDataFrame(parents, "a string, b string, s timestamp, e timestamp")
    time = dict(at="at", start="s", end="e") if dated else {}
    got = orphans.find_orphans(kid, par, [(F.col("a"), F.col("a")), (F.col("b"), F.col("b"))], match=match, broadcast_bytes=limit, **time)
    assert got.columns == kid.columns
    assert sorted(r.id for r in got.collect()) == _brute(children, parents, match, dated)


def test_orphans_of_empty_tables_and_clashing_names(spark):
    kid = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, None, 5)], "id int, k string, _ref int")
    none = spark.createDataFrame([], "k string, id int")
    key = [(F.col("k"), F.col("k"))]
    assert [tuple(r) for r in orphans.find_orphans(kid, none, key).collect()] == [(1, "a", 5)] * 2
    assert orphans.find_orphans(kid.where("false"), none, key).count() == 0


def test_periods_become_disjoint(spark):
    rows = [("a", T(0), T(2)), ("a", T(1), T(5)), ("a", T(5), T(6)), ("a", T(8), None), ("a", T(9), T(11)), ("b", T(3), T(3)), (None, T(1), None)]
    df = orphans.disjoint_periods(spark.createDataFrame(rows, "k string, s timestamp, e timestamp"), ["k"], "s", "e")
    assert sorted((r.k, r.s, r.e or T(99)) for r in df.collect()) == [("a", T(0), T(6)), ("a", T(8), T(99))]


# ------------------------------------------------------------------------------------------ problem 5

RULES = [quality.FieldRule("x", low=0, high=10, null_rate=0.5, low_median=0.5, high_median=2), quality.FieldRule("c", pattern=r"A-\d", null_rate=0.5, top_share=0.5)]


def _median(v):
    v = sorted(v)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if v else None


def test_profile_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(1, 4), rng.choice([None, -1.0, float("nan"), *[round(rng.random() * 10, 1) for _ in range(9)]]), rng.choice([None, "A-1", "A-2", "B", "A-1\n", ""])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, load int, x double, c string")
    counts = quality.value_counts(df, RULES, "load")
    got = {(r.group_key, r.field): r for r in quality.profile(counts).collect()}
    for load in range(1, 5):
        xs = [r[2] for r in rows if r[1] == load]
        ok = [x for x in xs if x is not None and 0 <= x <= 10]
        g = got[load, "x"]
        assert (g.n_rows, g.n_null, g.n_valid) == (len(xs), xs.count(None), len(ok))
        assert g.n_invalid == len(xs) - xs.count(None) - len(ok)
        assert abs(g["median"] - _median(ok)) < 1e-12
        assert g.n_distinct == len({repr(x) for x in xs if x is not None})
        cs = [r[3] for r in rows if r[1] == load]
        good = Counter(c for c in cs if c is not None and re.fullmatch(r"A-\d", c))
        g = got[load, "c"]
        assert g.n_valid == sum(good.values()) and g.top_n == max(good.values())
        assert g.top_value == min(v for v, n in good.items() if n == g.top_n)
    bad = {(r.key_id, r.field_name) for r in quality.invalid_rows(df, counts, RULES, "id").collect()}
    assert bad == {(i, "x") for i, _, x, _ in rows if x is not None and not 0 <= x <= 10} | {(i, "c") for i, *_, c in rows if c is not None and not re.fullmatch(r"A-\d", c)}


def test_departing_loads_are_named(spark):
    rows = [(1, 5.0, f"A-{i % 5}") for i in range(40)] + [(2, None if i % 2 else 5.0, f"A-{i % 5}") for i in range(40)] + [(3, 1.0, "A-1") for _ in range(10)] + [(4, None, None)] * 3
    counts = quality.value_counts(spark.createDataFrame(rows, "load int, x double, c string"), RULES, "load")
    got = {(r.group_key, r.field): sorted(r.reasons) for r in quality.departures(counts, RULES).collect()}
    assert got == {(2, "x"): ["null_rate"], (3, "x"): ["low_median"], (3, "c"): ["one_value"], (4, "x"): ["null_rate"], (4, "c"): ["null_rate"]}
    drift = {(r.group_key, r.field): r for r in quality.drift(counts, RULES).collect()}
    assert drift[3, "c"].psi > drift[1, "c"].psi and drift[3, "c"].chi_square > 10


def test_profile_of_an_empty_table(spark):
    counts = quality.value_counts(spark.createDataFrame([], "load int, x double, c string"), RULES, "load")
    assert quality.profile(counts).count() == 0 and quality.departures(counts, RULES).count() == 0


def test_every_column_is_profiled_and_compared(spark):
    rows = [(load, None if i % 5 == 0 else f"GTEX.{load}_{i}" if i % 7 else "GTEX", "liver" if load < 3 else "lung", i / 2, T(10 * load + i % 9), T(i).date()) for load in (1, 2, 3) for i in range(40)]
    df = spark.createDataFrame(rows, "load int, sample_id string, tissue string, x double, at timestamp_ntz, day date")
    rules = quality.rules_of(df, [RULES[0], problems.SAMPLE_ID], "load")
    counts = quality.value_counts(df, rules, "load")
    got = {(r.group_key, r.field): r for r in quality.profile(counts).collect()}
    assert set(got) == {(load, f) for load in (1, 2, 3) for f in ("sample_id", "tissue", "x", "at", "day")}
    for load in (1, 2, 3):
        mine = [r for r in rows if r[0] == load]
        g = got[load, "sample_id"]
        ids = [r[1] for r in mine if r[1] is not None]
        assert (g.n_null, g.n_distinct, g.n_invalid) == (8, len(set(ids)), ids.count("GTEX"))
        assert (got[load, "tissue"].top_value, got[load, "tissue"].n_invalid) == (mine[0][2], 0)
        assert got[load, "x"].n_invalid == sum(not 0 <= r[3] <= 10 for r in mine)
        seconds = [(r[4] - dt.datetime(1970, 1, 1)).total_seconds() for r in mine]
        g = got[load, "at"]
        assert (g.min_text, g.min_number, g["median"]) == (str(min(r[4] for r in mine)), min(seconds), _median(seconds))
        assert got[load, "day"].max_text == "2025-02-09"
    drift = {(r.group_key, r.field): r for r in quality.drift(counts, rules).collect()}
    assert {f for _, f in drift} == {"sample_id", "tissue", "x", "at", "day"}
    assert drift[3, "tissue"].psi > 5 > drift[1, "day"].psi and drift[3, "at"].psi > 5


def test_queries_of_sample_attr_leave_no_column_out(spark, small):
    want = {c for c in spark.read.parquet(f"{small}/sample_attr.parquet").columns if c != "load_no"}
    for f in (problems.p5_profile_columns, problems.p5_drift):
        got = f(spark, small)
        assert {r.field_name for r in got.select("field_name").distinct().collect()} == want
    four = {r.name for r in problems.RULES}
    own, columns = (f(spark, small).where(F.col("field_name").isin(*four)) for f in (problems.p5_profile, problems.p5_profile_columns))
    assert own.exceptAll(columns).count() == columns.exceptAll(own).count() == 0


def test_drift_counts_null_loads_lost_values_and_empty_loads(spark):
    values = {None: ["a", "b"] * 10 + [None], 1: ["a"] * 900 + ["c"] * 100, 2: ["b"] * 30, 3: [None] * 5, 4: ["a", "b", "d", "x1"]}
    df = spark.createDataFrame([(load, v) for load, vs in values.items() for v in vs], "load int, t string")
    rules = quality.rules_of(df, [], "load")
    got = {r.group_key: r for r in quality.drift(written(quality.value_counts(df, rules, "load")), rules).collect()}
    assert set(got) == set(values)
    assert (got[3].load_n, got[3].cells, got[3].psi, got[3].psi_present, got[3].chi_square) == (0, 0, None, None, None)
    known = {load: [v for v in vs if v] for load, vs in values.items()}
    every = [v for vs in known.values() for v in vs]
    for load in (None, 1, 2, 4):
        own, rest, psi, chi, present = known[load], len(every) - len(known[load]), 0, 0, 0
        for v in set(every):
            n, all_n = own.count(v), every.count(v)
            a, b = max(n / len(own), 1e-4), max((all_n - n) / rest, 1e-4)
            psi, present = psi + (a - b) * math.log(a / b), present + (n > 0) * (a - b) * math.log(a / b)
            want = all_n * len(own) / len(every)
            chi += (n - want) ** 2 / want
        g = got[load]
        assert (g.load_n, g.cells) == (len(own), len(set(own)))
        assert (g.psi, g.psi_present, g.chi_square) == (pytest.approx(psi), pytest.approx(present), pytest.approx(chi))
    assert got[2].psi > got[2].psi_present + 5  # most others have "a", which load 2 lost


def test_drift_of_a_null_load_equals_its_sql(spark, small, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = spark.read.parquet(f"{small}/sample_attr.parquet").withColumn("load_no", F.when(F.col("row_id") % 5 != 0, F.col("load_no")))
    rows.write.parquet(f"{tmp_path}/sample_attr.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW sample_attr AS SELECT * FROM read_parquet('{tmp_path}/sample_attr.parquet/*.parquet')")
    for f in (problems.p5_drift, problems.p5_drift_whole):
        got = f(spark, str(tmp_path))
        own, want = ({(r[0], r[1]): r[2:] for r in data} for data in (got.collect(), con.execute(problems.SQL[f.__name__]).fetchall()))
        assert set(own) == set(want) and any(load is None for load, _ in own)
        assert all(own[k] == pytest.approx(want[k]) for k in own)


# ------------------------------------------------------------------------------------------ problem 6

TERMS = ["stop_gained", "intron_variant"]


def _split(line, sep):
    """The fields of a line, or None for broken quoting; written from the rules, character by character."""
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, cell = i + 1, ""
            while True:
                if j >= len(line):
                    return None
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        cell, j = cell + '"', j + 2
                        continue
                    break
                cell, j = cell + line[j], j + 1
            j += 1
            if j < len(line) and line[j] != sep:
                return None
        else:
            j = i
            while j < len(line) and line[j] != sep:
                if line[j] == '"':
                    return None
                j += 1
            cell = line[i:j]
        out.append(cell)
        if j >= len(line):
            return out
        i = j + 1


def _reason(feed, line):
    line = line[:-1] if line.endswith("\r") else line
    sep, n = {"mutect2": ("\t", 9), "sample_attributes": (",", 6), "beataml_counts": ("\t", 8)}[feed]
    f = _split(line, sep)
    if f is None:
        return "quoting"
    if len(f) != n:
        return "columns"
    f = [x.strip(" ") for x in f]
    integer = lambda x: re.fullmatch(r"[0-9]{1,12}", x)
    decimal = lambda x, a, b: x == "" or (re.fullmatch(r"[+-]?[0-9]+(\.[0-9]+)?", x) and a <= float(x) <= b)
    if feed == "mutect2":
        ok = f[0] and f[1] and f[8] and integer(f[3]) and integer(f[4]) and 1 <= int(f[3]) <= int(f[4]) and all(re.fullmatch(r"-|[ACGT]+", f[k]) for k in (5, 6)) and all(t in TERMS for t in f[7].split(";"))
    elif feed == "sample_attributes":
        ok = f[0] and decimal(f[1], -1440, 2880) and decimal(f[2], 1, 10)
    else:
        ok = re.fullmatch(r"ENSG[0-9]{11}(\.[0-9]+)?", f[0]) and all(integer(x) for x in f[4:])
    return None if ok else "value"


BASE = {
    "mutect2": "S-1\tG\tchr1\t5\t7\tA\t-\tstop_gained;intron_variant\tPASS",
    "sample_attributes": 'GTEX-1,"458",8.8,BP-1,L-2,"Skin, lower ""leg"""',
    "beataml_counts": "ENSG00000000001.2\tX\t\tmiRNA\t1\t2\t3\t44",
}


def test_lines_match_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(4000):
        feed = rng.choice(list(BASE))
        text = list(BASE[feed])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(text) + 1)
            what = rng.choice(['"', '""', "\t", ",", " ", "\r", "x", "9", "", "é", "-", "\n", "."])
            if what == "" and at < len(text):
                del text[at]
            else:
                text.insert(at, what)
        rows.append((i, feed, "".join(text) + rng.choice(["", "\r"])))
    rows += [(10_000 + k, f, t) for k, (f, t) in enumerate([("mutect2", ""), ("mutect2", "\r"), ("beataml_counts", "\t" * 7), ("sample_attributes", ",,,,,"), ("sample_attributes", 'a,,,,,"x"y'), ("mutect2", BASE["mutect2"] + "x" * 200_000)])]
    got = {r.raw_id: r.reason for r in lines.parse_lines(spark.createDataFrame(rows, "raw_id long, feed string, raw_text string"), lines.feeds_of_project(TERMS)).collect()}
    assert len(got) == len(rows)
    wrong = [(r, got[r[0]], _reason(r[1], r[2])) for r in rows if got[r[0]] != _reason(r[1], r[2])]
    assert not wrong, wrong[:3]


def test_valid_lines_come_typed_and_labelled(spark):
    rows = [(i, f, t) for i, (f, t) in enumerate(BASE.items())] + [(7, "sample_attributes", "GTEX-2,,99,a,b,c"), (8, "other", "x"), (9, None, "x"), (10, "mutect2", None)]
    df = spark.createDataFrame(rows, "raw_id long, feed string, raw_text string")
    feeds = lines.feeds_of_project(TERMS)
    parsed = lines.parse_lines(df, feeds)
    by = {r.raw_id: (r.reason, r.unfit) for r in parsed.collect()}
    assert by[7] == ("value", "smrin") and by[8][0] == by[9][0] == "feed" and by[10][0] == "columns"
    attr = lines.typed_rows(parsed, feeds[1]).collect()
    assert [tuple(r) for r in attr] == [(1, "GTEX-1", 458.0, 8.8, "BP-1", "L-2", 'Skin, lower "leg"')]
    assert lines.typed_rows(parsed, feeds[0]).first()["end"] == 7
    assert lines.parse_lines(df.where("false"), feeds).count() == 0


def test_fields_agree_with_a_csv_reader():
    feed = lines.feeds_of_project(TERMS)[1]
    _, _, fields = lines.parse_batch(feed, pa.array([BASE["sample_attributes"]]))
    assert fields[0] == next(csv.reader(io.StringIO(BASE["sample_attributes"])))


def test_every_character_of_a_valid_line_comes_out():
    feed = lines.Feed("f", ",", (lines.Cell("a"), lines.Cell("b")))
    chars = [chr(c) for c in range(0x80) if chr(c) not in ',"'] + ["\x85", "\u2028", "\ue000", "\ue001", "\U0010ffff"]
    texts = [f"A{c}B,x{c}y" for c in chars] + ['"q\n""z,\x1e",\x1f']
    reason, _, fields = lines.parse_batch(feed, pa.array(texts))
    assert reason == [None] * len(texts)
    assert fields == [[f"A{c}B", f"x{c}y"] for c in chars] + [['q\n"z,\x1e', "\x1f"]]


def test_stages_run_after_their_needs_and_resume(spark, tmp_path):
    from lattica.plans import stages

    made = []

    def stage(name, *needs):
        def make(*tables):
            made.append(name)
            return spark.range(1 + sum(t.count() for t in tables))

        return stages.Stage(name, make, needs)

    plan = [stage("c", "a", "b"), stage("b", "a"), stage("a"), stage("d")]
    assert [s.name for s in stages.in_order(plan, ["c"])] == ["a", "b", "c"]
    assert {n for n, (_, new) in stages.run(spark, plan, str(tmp_path), ["b"]).items() if new} == {"a", "b"}
    done = stages.run(spark, plan, str(tmp_path))
    assert made == ["a", "b", "c", "d"] and done["c"][0].count() == 4
    stages.run(spark, plan, str(tmp_path), ["a"], resume=False)
    assert made[4:] == ["a"]
    with pytest.raises(ValueError, match="need each other"):
        stages.in_order([stage("x", "y"), stage("y", "x")])
    with pytest.raises(ValueError, match="no stage"):
        stages.in_order(plan, ["e"])
