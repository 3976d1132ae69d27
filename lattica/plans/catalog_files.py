"""Query catalogue III: file sources and result stores.  Each query writes the project's tables in the format of a
source, reads them back with its reader, and is compared with SQL on the tables themselves."""

from __future__ import annotations

import io
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import resample, store
from lattica.operators import signal as sig
from lattica.plans import stages
from lattica.plans.catalog import query
from lattica.session import own_folder, table
from lattica.sources import readers

# ------------------------------------------------------------------------------------------ writers of fixtures


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    fs, path_of = store.file_system(spark, path)
    out = fs.create(path_of(path), True)
    out.write(bytearray(content))
    out.close()


def _text(rows: DataFrame, order: list[str], path: str, codec: str = "none") -> str:
    """The column ``line`` of ``rows`` as one text file ``path`` in the order of ``order``."""
    spark = rows.sparkSession
    rows.coalesce(1).sortWithinPartitions(*order).select("line").write.option("compression", codec).text(path + ".parts")
    fs, path_of = store.file_system(spark, path)
    part = next(str(s.getPath()) for s in fs.listStatus(path_of(path + ".parts")) if s.getPath().getName().startswith("part-"))
    fs.rename(path_of(part), path_of(path))
    fs.delete(path_of(path + ".parts"), True)
    return path


def _tsv(df: DataFrame, path: str, sep: str = "\t", header: list[str] | None = None, codec: str = "none") -> str:
    """``df`` as one delimited file, in the order of its first column, after a line of ``header`` (none if it is empty)."""
    line = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    rows = df.select(F.lit(1).alias("_no"), F.col(df.columns[0]).alias("_key"), line.alias("line"))
    head = df.sparkSession.createDataFrame([(0, sep.join(df.columns if header is None else header))], "_no int, line string")
    both = rows if header == [] else rows.unionByName(head.withColumn("_key", F.lit(None).cast(rows.schema["_key"].dataType)))
    return _text(both, ["_no", "_key"], path, codec)


# suppliers stand for genes, line numbers for samples
def _wide(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_linenumber", list(range(1, 8))).agg(F.sum("l_quantity"))


_LONG = "SELECT 'G' || l_suppkey AS gene_id, {prefix} || l_linenumber AS sample_id, sum(l_quantity) AS value FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7 GROUP BY 1, 2"
_FULL = """SELECT g.gene_id, s.sample_id, value FROM (SELECT DISTINCT 'G' || l_suppkey AS gene_id FROM lineitem) g CROSS JOIN (SELECT {prefix} || i AS sample_id FROM range(1, 8) r(i)) s
  LEFT JOIN (""" + _LONG + ") v ON v.gene_id = g.gene_id AND v.sample_id = s.sample_id"

# ------------------------------------------------------------------------------------------ matrices


@query("SELECT 'u1' AS unit, gene_id, sample_id, value FROM (" + _FULL.format(prefix="'S'") + ") f")
def source_count_matrix(spark, d):
    """A compressed matrix with two lines before its header, versions in its ids and one gene repeated at its end."""
    w = _wide(spark, d)
    cells = [F.coalesce(F.col(str(i)).cast("string"), F.lit("")) for i in range(1, 8)]
    rows = w.select(F.lit(3).alias("no"), F.col("l_suppkey").alias("key"), F.concat_ws("\t", F.concat(F.lit("G"), F.col("l_suppkey"), F.lit(".7")), F.lit("a name"), *cells).alias("line"))
    again = w.select(F.lit(4).alias("no"), F.col("l_suppkey").alias("key"), F.concat_ws("\t", F.concat(F.lit("G"), F.col("l_suppkey"), F.lit(".8")), F.lit("again"), *[F.lit("0")] * 7).alias("line"))
    head = spark.createDataFrame([(0, None, "#1.2"), (1, None, "9\t7"), (2, None, "\t".join(["Name", "Description", *[f"S{i}" for i in range(1, 8)]]))], "no int, key long, line string")
    path = _text(head.unionByName(rows).unionByName(again), ["no", "key"], own_folder(spark, "gct") + "/u1.gct.gz", "gzip")
    return readers.gct(spark, path, "u1")


@query(_FULL.format(prefix="'S'"))
def source_expression_bed(spark, d):
    w = _wide(spark, d)
    rows = w.select(F.col("l_suppkey").alias("#chr"), F.lit(5).alias("start"), F.lit(9).alias("end"), F.concat(F.lit("G"), F.col("l_suppkey"), F.lit(".1")).alias("gene_id"), *[F.col(str(i)).alias(f"S{i}") for i in range(1, 8)])
    return readers.expression_bed(spark, _tsv(rows, own_folder(spark, "bed") + "/e.bed"))


@query(_FULL.replace("g.gene_id,", "g.gene_id AS stable_id,").format(prefix="'BA'"))
def source_prefixed_counts(spark, d):
    w = _wide(spark, d)
    rows = w.select(F.concat(F.lit("G"), F.col("l_suppkey")).alias("stable_id"), F.lit("x").alias("biotype"), *[F.col(str(i)).alias(f"BA{i}") for i in range(1, 8)], F.lit(1).alias("other"))
    return readers.prefixed_counts(spark, _tsv(rows, own_folder(spark, "counts") + "/c.tsv"), "stable_id", "BA")


_NATIONS = "SELECT '{p}' || n_nationkey AS {row}, s.c AS {col}, cast(n_nationkey * s.k AS double) AS value FROM nation CROSS JOIN (VALUES ('one', 1), ('two', 2), ('five', 5)) s(c, k)"


def _nations(spark: SparkSession, d: str) -> list[int]:
    return sorted(r[0] for r in table(spark, d, "nation").select("n_nationkey").collect())  # a table of 25 rows


@query(_NATIONS.format(p="G", row="gene_id", col="sample_id") + " WHERE s.c <> 'two' AND n_nationkey <> 3")
def source_zipped_matrix(spark, d):
    """A matrix inside an archive, of which genes and samples are picked while it is read."""
    keys = _nations(spark, d)
    text = "gene\tone\ttwo\tfive\n" + "".join(f"G{k}.4\t{k}\t{2 * k}\t{5 * k}\n" for k in keys)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("inner/matrix.txt", text)
    path = own_folder(spark, "zip") + "/m.zip"
    _put(spark, path, packed.getvalue())
    return readers.zipped_matrix(spark, path, "inner/matrix.txt", [f"G{k}" for k in keys if k != 3], ["one", "five"])


@query(_NATIONS.format(p="G", row='"row"', col='"column"'))
def source_matrix_archive(spark, d):
    keys = np.array(_nations(spark, d))
    packed = io.BytesIO()
    np.savez_compressed(packed, X=np.outer(keys, [1.0, 2.0, 5.0]), genes=np.array([f"G{k}" for k in keys]), samples=np.array(["one", "two", "five"]))
    path = own_folder(spark, "npz") + "/m.npz"
    _put(spark, path, packed.getvalue())
    return readers.npz(spark, path)


@query("SELECT cast(n_nationkey AS varchar) AS key, n_name AS name, cast(n_regionkey AS varchar) AS region FROM nation")
def source_sheet(spark, d):
    """A workbook with shared strings and numbers."""
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()  # a table of 25 rows
    texts = ["key", "name", "region", *[r["n_name"] for r in rows]]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda at, v, kind="": f'<c r="{at}"{kind}><v>{v}</v></c>'
    shared = lambda at, i: cell(at, i, ' t="s"')
    body = "<row>" + "".join(shared(f"{c}1", i) for i, c in enumerate("ABC")) + "</row>"
    body += "".join(f"<row>{cell(f'A{k}', r['n_nationkey'])}{shared(f'B{k}', k + 1)}{cell(f'C{k}', r['n_regionkey'])}</row>" for k, r in enumerate(rows, 2))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    path = own_folder(spark, "sheet") + "/n.xlsx"
    _put(spark, path, packed.getvalue())
    return readers.sheet_table(spark, path)


# ------------------------------------------------------------------------------------------ delimited tables


@query("SELECT c_custkey AS sample_id, c_acctbal AS rin, c_mktsegment AS batch FROM customer")
def source_attributes(spark, d):
    """Some columns of a table, with blanks around the names in its header, typed and renamed."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = _tsv(c, own_folder(spark, "attributes") + "/a.tsv", header=["SAMPID ", "SUBJECT", " SMRIN", "SMNABTCH"])
    names = {"SAMPID": "sample_id", "SMRIN": "rin", "SMNABTCH": "batch"}
    return readers.tsv(spark, path, list(names), names, {"SAMPID": "bigint", "SMRIN": "double"})


@query("SELECT gid, gc FROM (SELECT p_brand AS gid, p_retailprice AS gc, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) p WHERE rn = 1")
def source_covariates(spark, d):
    """Renamed columns, and one row of each repeated key."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    path = _tsv(p, own_folder(spark, "covariates") + "/g.tsv", header=["No", "Gene stable ID", "Gene % GC content"])
    df = readers.tsv(spark, path, rename={"No": "no", "Gene stable ID": "gid", "Gene % GC content": "gc"}, types={"No": "bigint", "Gene % GC content": "double"})
    return sig.keep_first(df, ["gid"], ["no"]).select("gid", "gc")


@query("SELECT gene_id, chr, gc FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY row_id) AS rn FROM gene) g WHERE rn = 1")
def source_annotation(spark, d):
    g = readers.parquet(spark, f"{d}/gene.parquet", ["row_id", "gene_id", "chr", "gc"])
    return sig.keep_first(g, ["gene_id"], ["row_id"]).select("gene_id", "chr", "gc")


@query("SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def source_row_groups(spark, d):
    """Three columns of a large table, only rows of listed keys."""
    members = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return readers.parquet(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_suppkey", "l_quantity"], members, "l_suppkey")


@query("SELECT cast(o_custkey AS varchar) AS o_custkey, cast(o_orderkey AS varchar) AS o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def source_members(spark, d):
    path = _tsv(table(spark, d, "orders").select("o_orderkey", "o_custkey"), own_folder(spark, "members") + "/o.tsv")
    members = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("o_custkey"))
    return readers.members_only(readers.tsv(spark, path), members, "o_custkey").select("o_custkey", "o_orderkey")


def _unit_files(spark: SparkSession, d: str, sep: str, name: str) -> str:
    """A file per region with its nations."""
    n, folder = table(spark, d, "nation"), own_folder(spark, "units")
    for r in sorted(r[0] for r in table(spark, d, "region").select("r_regionkey").collect()):  # five regions
        _tsv(n.where(F.col("n_regionkey") == r).select("n_nationkey", "n_name"), f"{folder}/{name.format(r)}", sep, codec="gzip")
    return folder


@query("SELECT cast(n_nationkey AS varchar) AS n_nationkey, n_name, 'region' || n_regionkey AS unit FROM nation")
def source_units(spark, d):
    """Compressed files of units that are named by their files."""
    return readers.per_unit(spark, _unit_files(spark, d, ",", "pairs_region{}.csv.gz") + "/pairs_*.csv.gz", r"pairs_(\w+)\.csv")


@query("SELECT cast(n_regionkey AS varchar) AS sample, count(*) AS nations, cast(sum(n_nationkey) AS double) AS total FROM nation GROUP BY 1")
def source_per_sample(spark, d):
    """Files of samples, keyed by a pattern on their names and aggregated."""
    df = readers.per_unit(spark, _unit_files(spark, d, "\t", "GSM{}_quant.tsv.gz") + "/GSM*_quant.tsv.gz", r"GSM(\d+)_", "\t")
    return df.groupBy(F.col("unit").alias("sample")).agg(F.count("*").alias("nations"), F.sum(F.col("n_nationkey").cast("double")).alias("total"))


@query("SELECT chr, gene_start AS start, gene_end AS \"end\" FROM gene WHERE chr IS NOT NULL AND gene_start IS NOT NULL AND gene_end IS NOT NULL")
def source_intervals(spark, d):
    g = table(spark, d, "gene").select("chr", "gene_start", "gene_end").dropna()
    return readers.bed(spark, _tsv(g, own_folder(spark, "intervals") + "/g.bed", header=[]))


@query("SELECT p_partkey AS loc, p_size AS strength FROM part")
def source_boundaries(spark, d):
    """An interval table with a header, found by a pattern."""
    folder = own_folder(spark, "boundaries")
    _tsv(table(spark, d, "part").select("p_partkey", "p_size"), folder + "/K562_boundaries.bed", header=["loc", "stability_percentile"])
    return readers.tsv(spark, folder + "/*_boundaries.bed", rename={"stability_percentile": "strength"}, types={"loc": "bigint", "stability_percentile": "int"})


@query("""SELECT 'c' || l_linenumber AS chr, l_partkey AS start, l_partkey + l_suppkey AS "end" FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05 AND l_returnflag <> 'R'""")
def source_loops(spark, d):
    other = F.when(F.col("l_returnflag") == "R", F.lit("x")).otherwise(F.concat(F.lit("c"), F.col("l_linenumber")))
    li = table(spark, d, "lineitem").select(F.concat(F.lit("c"), F.col("l_linenumber")).alias("a"), "l_partkey", other.alias("b"), (F.col("l_partkey") + F.col("l_suppkey")).alias("e"), F.when(F.col("l_quantity") > 25, "p").otherwise("n").alias("o1"), F.when(F.col("l_discount") < 0.05, "n").otherwise("p").alias("o2"))
    return readers.loops(spark, _tsv(li, own_folder(spark, "loops") + "/l.tsv", header=[" chr1", "x1 ", "chr2", " y2", "orientation_1 ", "orientation_2"]))


_CELLS = """SELECT 'c' || l_linenumber AS chr, cast(least(l_suppkey, l_partkey) AS int) AS lo, cast(abs(l_suppkey - l_partkey) AS int) AS k, max(l_quantity) AS observed, max(l_extendedprice) AS expected
  FROM lineitem GROUP BY 1, 2, 3"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = F.least("l_suppkey", "l_partkey"), F.greatest("l_suppkey", "l_partkey")
    return table(spark, d, "lineitem").groupBy(F.concat(F.lit("c"), F.col("l_linenumber")).alias("chr"), lo.alias("lo"), hi.alias("hi")).agg(F.max("l_quantity").alias("o"), F.max("l_extendedprice").alias("e"))


@query(_CELLS)
def source_sparse_bins(spark, d):
    """Sparse contacts in bins, five columns and no header."""
    return readers.sparse_contacts(spark, _tsv(_cells(spark, d), own_folder(spark, "bins") + "/c.txt", header=[]), 40_000)


@query(_CELLS)
def source_sparse_places(spark, d):
    """Sparse contacts in base pairs, seven columns with a header."""
    c = _cells(spark, d).select("chr", (F.col("lo") * 40_000).alias("p1"), F.col("chr").alias("chr2"), (F.col("hi") * 40_000).alias("p2"), "o", "e", F.lit(0).alias("q"))
    # the layout is told by the first line: one whose places lie apart
    path = _tsv(c.withColumn("far", -F.col("p2")).select("far", *c.columns), own_folder(spark, "places") + "/c.txt.all")
    rows = spark.read.text(path).withColumn("key", F.split("value", "\t")).select(F.when(F.col("key")[0] == "far", F.lit(-1e300)).otherwise(F.col("key")[0].try_cast("double")).alias("no"), F.array_join(F.slice("key", 2, 7), "\t").alias("line"))
    return readers.sparse_contacts(spark, _text(rows, ["no"], path.removesuffix(".all")), 40_000)


@query("SELECT chr, lo, hi, min(value) AS value FROM (SELECT l_returnflag AS chr, least(l_suppkey, l_partkey) AS lo, greatest(l_suppkey, l_partkey) AS hi, l_quantity AS value FROM lineitem) l WHERE hi - lo <= 500 GROUP BY 1, 2, 3")
def source_contact_windows(spark, d):
    """Text exports of overlapping windows: contacts in the overlap stand in two files, beyond the band they go."""
    li, folder = table(spark, d, "lineitem"), own_folder(spark, "windows")
    for k, cond in enumerate(("l_suppkey <= 60", "l_suppkey >= 40")):
        _tsv(li.where(cond).select("l_returnflag", "l_suppkey", "l_partkey", "l_quantity"), f"{folder}/w{k}.txt", header=[])
    return readers.contact_windows(spark, folder + "/w*.txt", 500)


@query("SELECT cast(s_suppkey AS varchar) AS s_suppkey, cast(s_nationkey AS varchar) AS s_nationkey FROM supplier")
def source_known_columns(spark, d):
    """The columns of a list that a file has, by its header."""
    return readers.tsv(spark, _tsv(table(spark, d, "supplier"), own_folder(spark, "known") + "/s.tsv"), ["s_suppkey", "not_there", "s_nationkey"])


@query(
    """SELECT field, cast(row_number() OVER (PARTITION BY field ORDER BY k) - 1 AS int) AS position, value FROM (SELECT 'Sample_title' AS field, n_nationkey AS k, n_name AS value FROM nation
  UNION ALL SELECT 'Sample_channel_count', n_nationkey, cast(n_regionkey AS varchar) FROM nation UNION ALL SELECT 'Series_title', 0, 'A study') x"""
)
def source_series_metadata(spark, d):
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()  # a table of 25 rows
    quoted = lambda xs: "\t".join(f'"{x}"' for x in xs)
    text = '!Series_title\t"A study"\n!Sample_title\t' + quoted(r["n_name"] for r in rows) + "\nID_REF\t1\n!Sample_channel_count\t" + quoted(r["n_regionkey"] for r in rows) + "\n!series_matrix_table_begin\n"
    path = own_folder(spark, "series") + "/s.txt"
    _put(spark, path, text.encode())
    return readers.series_metadata(spark, path)


@query("SELECT s_name AS project, count(*) AS n FROM supplier GROUP BY 1")
def source_fuzzy_column(spark, d):
    path = _tsv(table(spark, d, "supplier").select("s_suppkey", "s_name"), own_folder(spark, "phenotype") + "/p.tsv", header=["sample", "cases.project_id"])
    df = readers.tsv(spark, path)
    return df.groupBy(F.col(f"`{readers.fuzzy_column(df, 'project')}`").alias("project")).agg(F.count("*").alias("n"))


@query("SELECT 'a' AS data, 'b' AS out, true AS resume, 2000000.0::double AS block, 300 AS replicates")
def run_configuration(spark, d):
    c = readers.RunConfig(data="a", out="b", resume=True, block=2e6)
    return spark.createDataFrame([(c.data, c.out, c.resume, c.block, c.replicates)], "data string, out string, resume boolean, block double, replicates int")


# ------------------------------------------------------------------------------------------ stores


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def store_csv(spark, d):
    """Overwritten by a second write, compressed."""
    path, s = own_folder(spark, "csv"), table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    store.write_csv(s.where("false"), path)
    store.write_csv(s, path, "gzip")
    return spark.read.schema(s.schema).option("header", True).csv(path)


@query("SELECT n_nationkey AS unit FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def store_pending(spark, d):
    """The units that a resumed run still has to do."""
    path = own_folder(spark, "resume")
    store.publish(table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("unit"), "s_suppkey"), path)
    left = store.pending(_nations(spark, d), spark, path, "unit")
    assert store.pending(_nations(spark, d), spark, path, "unit", resume=False) == _nations(spark, d)
    return spark.createDataFrame([(u,) for u in left], "unit int")


@query("SELECT s_suppkey, s_name FROM supplier")
def store_once(spark, d):
    """What is there already is not made again."""
    path, s = own_folder(spark, "once"), table(spark, d, "supplier").select("s_suppkey", "s_name")
    store.once(spark, path, lambda: s)
    return store.once(spark, path, lambda: s.where("false"))


@query("SELECT s_nationkey AS unit, CASE WHEN s_nationkey < 5 THEN -s_acctbal ELSE s_acctbal END AS value FROM supplier")
def store_units(spark, d):
    """A folder per unit; units written again are replaced, others stay."""
    path, s = own_folder(spark, "by_unit"), table(spark, d, "supplier").select(F.col("s_nationkey").alias("unit"), F.col("s_acctbal").alias("value"))
    store.write_units(s, path)
    store.write_units(s.where("unit < 5").withColumn("value", -F.col("value")), path)
    return spark.read.parquet(path).select("unit", "value")


@query(
    """SELECT l_returnflag AS term, max(v) FILTER (rep = -1) AS estimate, round(quantile_cont(v, 0.025) FILTER (rep >= 0), 6) AS ci_low, round(quantile_cont(v, 0.975) FILTER (rep >= 0), 6) AS ci_high,
  round(stddev_pop(v) FILTER (rep >= 0), 6) AS boot_se, count(*) FILTER (rep >= 0) AS replicates FROM (SELECT l_returnflag, l_suppkey - 2 AS rep, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) r GROUP BY 1"""
)
def store_replicates(spark, d):
    """A log of replicates, written anew, and its summary; replicate -1 is the estimate."""
    path = own_folder(spark, "replicates")
    log = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("term"), (F.col("l_suppkey") - 2).alias("rep")).agg(F.sum("l_quantity").alias("v"))
    store.write_replicates(log.where("false"), path)
    store.write_replicates(log, path)
    got = resample.replicate_summary(spark.read.parquet(path), ["term"], "v")
    return got.select("term", "estimate", *[F.round(c, 6).alias(c) for c in ("ci_low", "ci_high", "boot_se")], "replicates")


@query("SELECT r_regionkey AS key, r_name AS name FROM region WHERE r_regionkey = 2")
def store_one_row(spark, d):
    row = store.one_row(table(spark, d, "region").where("r_regionkey = 2"))
    return spark.createDataFrame([(row["r_regionkey"], row["r_name"])], "key int, name string")


@query(
    """SELECT * FROM (VALUES (1, 'first', 'suppliers', true), (1, 'first', 'totals', true), (2, 'again', 'suppliers', false), (2, 'again', 'totals', false), (2, 'again', 'shares', true)) v(run, name, stage, made)
  CROSS JOIN (SELECT count(*) AS suppliers FROM supplier) s"""
)
def stage_runs(spark, d):
    """Stages in the order of their needs: a part of them, and then all, of which only what is missing is made."""
    folder = own_folder(spark, "stages")
    plan = [
        stages.Stage("shares", lambda s, t: s.join(t, "s_nationkey").withColumn("share", F.col("s_acctbal") / F.col("total")), ("suppliers", "totals")),
        stages.Stage("totals", lambda s: s.groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("total")), ("suppliers",)),
        stages.Stage("suppliers", lambda: table(spark, d, "supplier")),
    ]
    first = stages.run(spark, plan, folder, ["totals"])
    again = stages.run(spark, plan, folder)
    n = again["shares"][0].count()
    rows = [(k, name, stage, made, n) for k, name, done in ((1, "first", first), (2, "again", again)) for stage, (_, made) in done.items()]
    return spark.createDataFrame(rows, "run int, name string, stage string, made boolean, suppliers long")
