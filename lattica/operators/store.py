"""Result tables that can be written again: upsert by key, replacement by unit, resume.

A table is a folder of versions; a small pointer file names the current one and is replaced last, so a
reader sees the old or the new table and a failed write leaves the old one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.session import q


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the class of paths."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _current(spark: SparkSession, path: str) -> str | None:
    fs, path_of = file_system(spark, path)
    pointer = path_of(f"{path}/CURRENT")
    if not fs.exists(pointer):
        return None
    return spark.read.text(f"{path}/CURRENT").first()[0]


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version, or None before the first write."""
    name = _current(spark, path)
    return spark.read.parquet(f"{path}/{name}") if name else None


def publish(df: DataFrame, path: str) -> DataFrame:
    """Writes a version and makes it the current one."""
    spark = df.sparkSession
    fs, path_of = file_system(spark, path)
    old, new = _current(spark, path), f"v-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{path}/{new}")
    out = fs.create(path_of(f"{path}/CURRENT.new"), True)
    out.write(bytearray(new.encode()))
    out.close()
    fs.delete(path_of(f"{path}/CURRENT"), False)
    fs.rename(path_of(f"{path}/CURRENT.new"), path_of(f"{path}/CURRENT"))
    if old:
        fs.delete(path_of(f"{path}/{old}"), True)
    return spark.read.parquet(f"{path}/{new}")


def require_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``df``, or ValueError with an example if a key occurs twice (null keys too)."""
    twice = df.groupBy(*[q(c) for c in key]).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate key {twice[0].asDict()}")
    return df


def one_row(df: DataFrame):
    """The only row of ``df``; ValueError if there is none or more."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("expected exactly one row")
    return rows[0]


def upserted(old: DataFrame | None, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows whose key is not in ``new``, then ``new``.  Keys with nulls match by null-safe equality."""
    if old is None:
        return new
    tags = [f"_u{i}" for i in range(len(key))]
    side = new.select(*[q(c).alias(t) for c, t in zip(key, tags)]).distinct()
    match = None
    for c, t in zip(key, tags):
        m = q(c).eqNullSafe(F.col(t))
        match = m if match is None else match & m
    return old.join(side, match, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(df: DataFrame, path: str, key: Sequence[str]) -> DataFrame:
    """Writes the upserted table and returns it; duplicate keys in the result raise and change nothing."""
    merged = upserted(read(df.sparkSession, path), df, key)
    return publish(require_unique(merged, key), path)


def replaced(old: DataFrame | None, new: DataFrame, by: str, groups: Sequence) -> DataFrame:
    """All old rows of the listed groups dropped, even of those without new rows, then ``new``."""
    return new if old is None else old.where(~q(by).isin(*groups) | q(by).isNull()).unionByName(new, allowMissingColumns=True)


def replace_groups(df: DataFrame, path: str, by: str, groups: Sequence, key: Sequence[str] | None = None) -> DataFrame:
    """Writes the table with the groups replaced; rows of other groups in ``df`` are an error, as are
    duplicates of ``key``."""
    stray = df.where(~q(by).isin(*groups)).limit(1).count()
    if stray:
        raise ValueError(f"rows of groups that are not replaced: {by}")
    merged = replaced(read(df.sparkSession, path), df, by, groups)
    return publish(require_unique(merged, key) if key else merged, path)


def pending(units: Sequence, spark: SparkSession, path: str, by: str, resume: bool = True) -> list:
    """The units still to be done: all of them, or with ``resume`` those that the table does not have."""
    old = read(spark, path) if resume else None
    have = {r[0] for r in old.select(q(by)).distinct().where(q(by).isin(*units)).collect()} if old is not None and units else set()
    return [u for u in units if u not in have]


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; only if there is none yet, ``make()`` is written there first."""
    old = read(spark, path)
    return publish(make(), path) if old is None else old


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """Overwrites a folder of CSV with a header; ``compression='gzip'`` for .csv.gz."""
    df.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def write_units(df: DataFrame, path: str, unit: str = "unit") -> None:
    """Arrays or long tables as Parquet, one folder per unit; units present in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(unit).parquet(path)


def write_replicates(df: DataFrame, path: str) -> None:
    """A replicate log (rep -1: the point estimate), written anew."""
    df.write.mode("overwrite").parquet(path)
