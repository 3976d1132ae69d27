"""Readers of the file formats that studies of ordered signals come in.

Each returns a lazy DataFrame, in long form where the file is a matrix.  Headers are read on the driver
(one line), data only in tasks.  Not offered: pickles, ``.h5ad`` and binary ``.hic`` matrices (convert them to
Parquet or text first; :func:`contact_windows` reads text exports of the latter).
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.session import q


#: Cells of an archive's matrix that leave a task at once.
MOST_CELLS = 200_000


def first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first lines of a (possibly compressed) text file, or of the first of several."""
    return [r[0] for r in spark.read.text(path).limit(n).collect()]


def no_version(key):
    """An identifier without its trailing ``.version``."""
    return F.substring_index(key, ".", 1)


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], variable: str, value: str) -> DataFrame:
    return df.unpivot([q(c) for c in ids], [q(c) for c in columns], variable, value)


def tsv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, rename: dict[str, str] | None = None, types: dict[str, str] | None = None, sep: str = "\t", header: bool = True) -> DataFrame:
    """A delimited table as strings, pruned to ``columns`` that exist (blanks around header names do not
    count), cast by ``types`` (values that do not fit become null) and renamed."""
    df = spark.read.option("sep", sep).option("header", header).csv(path)
    names = {c.strip(): c for c in df.columns}
    keep = [c for c in (columns or names) if c in names]
    cols = []
    for c in keep:
        v = q(names[c])
        if types and c in types:
            v = v.try_cast(types[c])
        cols.append(v.alias((rename or {}).get(c, c)))
    return df.select(*cols)


def gct(spark: SparkSession, path: str, unit: str | None = None, types: str = "double") -> DataFrame:
    """A count matrix with two lines before its header: (unit, gene_id, sample_id, value), versions stripped,
    the first row of a repeated gene kept.  ``unit`` defaults to the file's name."""
    lines = first_lines(spark, path, 3)
    if len(lines) < 3:
        raise ValueError(f"{path} is no count matrix: it has {len(lines)} lines")
    head = lines[2].split("\t")
    samples = [c for c in head if c not in ("Name", "Description", "id")]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in head])
    rows = spark.read.schema(schema).option("sep", "\t").option("mode", "PERMISSIVE").csv(path)
    skip = {x.split("\t")[0] for x in lines}
    df = rows.where(~q(head[0]).isin(*skip)).withColumn("_pos", F.monotonically_increasing_id())
    df = df.withColumn("gene_id", no_version(q(head[0])))
    first = df.groupBy("gene_id").agg(F.min_by(F.struct(*[q(s) for s in samples]), "_pos").alias("v"))
    wide = first.select("gene_id", *[F.col("v")[s].alias(s) for s in samples])
    long = melt(wide, ["gene_id"], samples, "sample_id", "value").withColumn("value", F.col("value").try_cast(types))
    return long.select(F.lit(unit or os.path.basename(path)).alias("unit"), "gene_id", "sample_id", "value")


def bed(spark: SparkSession, path: str, names: Sequence[str] = ("chr", "start", "end")) -> DataFrame:
    """A headerless interval file: the named columns, the second and third as whole numbers."""
    fields = [T.StructField(n, T.LongType() if n in ("start", "end", "s", "e") else T.StringType()) for n in names]
    return spark.read.schema(T.StructType(fields)).option("sep", "\t").csv(path)


def expression_bed(spark: SparkSession, path: str) -> DataFrame:
    """A normalised matrix whose fourth column is the gene and the rest samples: (gene_id, sample_id, value)."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    key, samples = df.columns[3], df.columns[4:]
    long = melt(df.withColumn("gene_id", no_version(q(key))), ["gene_id"], samples, "sample_id", "value")
    picked = long.groupBy("gene_id", "sample_id").agg(F.first("value").alias("value"))
    return picked.withColumn("value", F.col("value").try_cast("double"))


def prefixed_counts(spark: SparkSession, path: str, key: str, prefix: str) -> DataFrame:
    """A wide count table; only the sample columns that start with ``prefix``: (key, sample_id, value)."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    return melt(df, [key], [c for c in df.columns if c.startswith(prefix)], "sample_id", "value").withColumn("value", F.col("value").try_cast("double"))


def per_unit(spark: SparkSession, pattern: str, name: str, sep: str = ",") -> DataFrame:
    """Delimited files of one folder pattern, with ``unit`` taken from each file's name by the regular
    expression ``name`` (its first group)."""
    df = spark.read.option("header", True).option("sep", sep).csv(pattern)
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return df.select(*[q(c) for c in df.columns], F.nullif(F.regexp_extract(file, name, 1), F.lit("")).alias("unit"))


def parquet(spark: SparkSession, path: str, columns: Sequence[str], members: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Columns of a Parquet table, only rows whose ``key`` occurs in ``members``: pruning and splitting by
    row groups are the scan's own."""
    df = spark.read.parquet(path).select(*columns)
    return df.join(members.select(q(key)).distinct(), key, "left_semi") if members is not None else df


def members_only(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows of a large table whose key is listed: the filter that chunked readers apply per chunk."""
    return df.join(members.select(q(key)).distinct(), key, "left_semi")


def zipped_matrix(spark: SparkSession, path: str, member: str, genes: Sequence[str] | None = None, samples: Sequence[str] | None = None) -> DataFrame:
    """A TSV inside a ZIP, read line by line in a task and cut to the wanted rows and columns: (gene_id,
    sample_id, value)."""
    want_g, want_s = set(genes) if genes is not None else None, set(samples) if samples is not None else None

    def frame(genes: list[str], lines: list[list[str]], cols: list[tuple[int, str]]) -> pd.DataFrame:
        cells = pd.Series([line[i] if i < len(line) else "" for line in lines for i, _ in cols], dtype=object)
        return pd.DataFrame({"gene_id": np.repeat(genes, len(cols)), "sample_id": [c for _, c in cols] * len(genes), "value": pd.to_numeric(cells, errors="coerce").astype(float)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for content in (c for f in frames for c in f["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as raw:
                text = io.TextIOWrapper(raw, "utf-8")
                head = next(text).rstrip("\r\n").split("\t")
                cols = [(i, c) for i, c in enumerate(head) if i and (want_s is None or c in want_s)]
                most, held = max(1, MOST_CELLS // max(1, len(cols))), ([], [])
                for line in text:
                    cells = line.rstrip("\r\n").split("\t")
                    gene = cells[0].split(".")[0]
                    if want_g is None or gene in want_g:
                        held[0].append(gene)
                        held[1].append(cells)
                    if len(held[0]) >= most:
                        yield frame(*held, cols)
                        held = ([], [])
                if held[0] and cols:
                    yield frame(*held, cols)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "gene_id string, sample_id string, value double")


def npz(spark: SparkSession, path: str, matrix: str = "X", rows: str = "genes", columns: str = "samples") -> DataFrame:
    """A named matrix archive as (row, column, value), a task per archive; object arrays are refused."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for content in (c for f in frames for c in f["content"]):
            with np.load(io.BytesIO(content), allow_pickle=False) as z:
                m, r, c = np.asarray(z[matrix], float), z[rows].astype(str), z[columns].astype(str)
            step = max(1, MOST_CELLS // max(1, len(c)))
            for i in range(0, len(r), step):
                part = r[i : i + step]
                yield pd.DataFrame({"row": np.repeat(part, len(c)), "column": np.tile(c, len(part)), "value": m[i : i + step].ravel()})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row string, column string, value double")


def contact_windows(spark: SparkSession, path: str, band: int) -> DataFrame:
    """Contacts exported as text (chr, x, y, value without a header) from windows that overlap along a chromosome:
    each contact of at most ``band`` between its places once, whatever windows it stands in; null and NaN values go."""
    df = spark.read.schema("chr string, x bigint, y bigint, value double").option("sep", "\t").csv(path)
    lo, hi = F.least("x", "y"), F.greatest("x", "y")
    near = df.where((hi - lo <= band) & F.col("value").isNotNull() & ~F.isnan("value")).select("chr", lo.alias("lo"), hi.alias("hi"), "value")
    return near.groupBy("chr", "lo", "hi").agg(F.min("value").alias("value"))


def loops(spark: SparkSession, path: str) -> DataFrame:
    """A loop list: header names trimmed, loops within one chromosome with a forward and a reverse anchor:
    (chr, start, end)."""
    df = tsv(spark, path, types={"x1": "bigint", "y2": "bigint"})
    good = (F.col("orientation_1") == "p") & (F.col("orientation_2") == "n") & (F.col("chr1") == F.col("chr2"))
    return df.where(good).select(F.col("chr1").alias("chr"), F.col("x1").alias("start"), F.col("y2").alias("end"))


def sparse_contacts(spark: SparkSession, path: str, bin_size: int) -> DataFrame:
    """Sparse contacts (chr, lo, k, observed, expected) from a five- or seven-column file, with or without a
    header, with positions in bins or in base pairs (told by the first data line)."""
    lines = [x.split("\t") for x in first_lines(spark, path, 2)]
    numeric = lambda x: bool(re.fullmatch(r"[+-]?\d+(\.\d+)?", x))
    has_header = not numeric(lines[0][1])
    data = lines[1] if has_header else lines[0]
    both = len(data) >= 7  # chr1 pos1 chr2 pos2 ..
    a, b = (1, 3) if both else (1, 2)
    o, e = (4, 5) if both else (3, 4)
    df = spark.read.option("sep", "\t").option("header", False).csv(path)
    c = [F.col(f"_c{i}") for i in range(len(data))]
    scale = 1 if max(int(float(data[a])), int(float(data[b]))) < 1_000_000 and int(float(data[b])) - int(float(data[a])) < bin_size else bin_size
    pos = lambda x: F.floor(x.try_cast("double") / scale).cast("int")
    rows = df.where(pos(c[a]).isNotNull())
    lo, hi = F.least(pos(c[a]), pos(c[b])), F.greatest(pos(c[a]), pos(c[b]))
    return rows.select(c[0].alias("chr"), lo.alias("lo"), (hi - lo).alias("k"), c[o].try_cast("double").alias("observed"), c[e].try_cast("double").alias("expected")).groupBy("chr", "lo", "k").agg(F.first("observed").alias("observed"), F.first("expected").alias("expected"))


def series_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Line-oriented study metadata: (field, position, value) of every ``!field<TAB>value...`` line, quotes off."""
    lines = spark.read.text(path).where(F.col("value").startswith("!"))
    cells = F.split("value", "\t")
    return lines.select(F.regexp_extract("value", r"^!([^\t=]+?)\s*(?:=|\t|$)", 1).alias("field"), F.posexplode(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))).alias("position", "raw")).select("field", "position", F.regexp_replace("raw", r'^"|"$', "").alias("value"))


def sheet_table(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """:func:`sheets` of a workbook in any file system."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    table = sheets(io.BytesIO(bytes(content)), sheet)
    return spark.createDataFrame(list(table.astype(object).where(table.notna(), None).itertuples(index=False, name=None)), ", ".join(f"`{c}` string" for c in table.columns))


def sheets(path: str | io.BytesIO, sheet: int = 1) -> pd.DataFrame:
    """A sheet of an Excel workbook as strings (first row: names), read with the standard library on the
    driver.  For dimension tables; shared and inline strings and plain values."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    rows = []
    for r in root.iter(f"{{{ns['m']}}}row"):
        row: dict[int, str] = {}
        for c in r.findall("m:c", ns):
            letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
            at = 0
            for ch in letters:
                at = at * 26 + ord(ch) - 64
            v, kind = c.find("m:v", ns), c.get("t")
            text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
            row[at - 1] = text
        rows.append(row)
    width = max((max(r, default=-1) for r in rows), default=-1) + 1
    table = [[r.get(i) for i in range(width)] for r in rows]
    return pd.DataFrame(table[1:], columns=table[0]) if table else pd.DataFrame()


def fuzzy_column(df: DataFrame, part: str) -> str:
    """The first column whose name contains ``part``; KeyError without one."""
    for c in df.columns:
        if part in c:
            return c
    raise KeyError(part)


@dataclass
class RunConfig:
    """Where a run reads and writes, its units and replicates, and whether it resumes; from the environment
    (``LATTICA_*``) unless given."""

    data: str = field(default_factory=lambda: os.environ.get("LATTICA_DATA", "data"))
    out: str = field(default_factory=lambda: os.environ.get("LATTICA_OUT", "results"))
    resume: bool = field(default_factory=lambda: os.environ.get("LATTICA_RESUME", "0") == "1")
    block: float = field(default_factory=lambda: float(os.environ.get("LATTICA_BLOCK_MB", "10")) * 1e6)
    units: tuple[str, ...] = ()
    replicates: int = 300
