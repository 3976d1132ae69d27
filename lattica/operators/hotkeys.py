"""Per-key results where a few keys hold most rows (problem 3).

Exact offset chunking.  The input's rows lie in *blocks*: runs of ``block_rows`` consecutive rows of a
file, known from the scan's own file name and row index and so the same whenever and wherever a scan is
repeated.  Then

1. count the keys of each block (map-side, no row moves);
2. prefix-sum those counts over the blocks of a key: the offset of each (block, key);
3. number the rows inside each (block, key), which never holds more than ``block_rows`` rows, and add
   the offset: the exact position of every row among all rows of its key;
4. cut each key at equal positions into chunks of ``chunk_rows`` and reduce every chunk on its own;
   the tasks get equal work whatever the keys' sizes;
5. merge the states of a key's chunks in order.  A chunk's state keeps what lies on its boundary (first
   and last value, runs that touch an end), so results that depend on the order of rows come out exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_ROWS, CHUNK_ROWS = 1 << 17, 1 << 16
BLOCK, AT = "_block", "_at"


def read_blocks(spark: SparkSession, path: str, columns: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The named columns of a Parquet table with each row's block and place in it."""
    rows = spark.read.parquet(path)
    path_col = F.col("_metadata.file_path")
    where = F.struct(F.substring_index(path_col, "/", -1).alias("name"), F.xxhash64(path_col).alias("path"), F.floor(F.col("_metadata.row_index") / block_rows).alias("part"))
    return rows.select(*columns, where.alias(BLOCK), F.pmod(F.col("_metadata.row_index"), F.lit(block_rows)).cast("int").alias(AT))


def number_rows(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_no``: the place of each row, from 0, among all rows of its key.  Null keys form a
    key of their own.  No task sees more rows of one key than a block holds."""
    counts = rows.groupBy(BLOCK, key).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(BLOCK).alias("_b"), F.col(key).alias("_k"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(BLOCK, key).orderBy(AT)
    numbered = rows.withColumn("_in", F.row_number().over(inside) - 1)
    # both sides are shuffled by (block, key) already; a merge join needs no further exchange of the rows
    joined = numbered.join(offsets.hint("merge"), (F.col(BLOCK) == F.col("_b")) & F.col(key).eqNullSafe(F.col("_k")))
    return joined.withColumn("_no", F.col("_in") + F.col("_offset")).drop("_in", "_offset", "_b", "_k")


def chunk_states(numbered: DataFrame, key: str, flags: dict[str, Column], run_of: Column, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One state per (key, chunk): rows, the sum of every flag, and of the longest unbroken run of rows
    with ``run_of`` true: its length, that of the run at the front, and that at the back."""
    cut = numbered.withColumn("_chunk", F.floor(F.col("_no") / chunk_rows)).withColumn("_hit", F.coalesce(run_of, F.lit(False)))
    cut = cut.select(key, "_chunk", "_no", "_hit", *[F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in flags.items()])
    order = Window.partitionBy(key, "_chunk").orderBy("_no")
    # a miss ends a run: rows since the last miss, by the place of that miss
    last_miss = F.max(F.when(~F.col("_hit"), F.col("_no"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    cut = cut.withColumn("_run", F.when(F.col("_hit"), F.col("_no") - F.coalesce(last_miss, F.floor(F.col("_no") / chunk_rows) * chunk_rows - 1)).otherwise(0))
    return cut.groupBy(key, "_chunk").agg(
        F.count("*").alias("_n"),
        *[F.sum(n).alias(n) for n in flags],
        F.max("_run").alias("_longest"),
        F.coalesce(F.min(F.when(~F.col("_hit"), F.col("_no"))) - F.min("_no"), F.count("*")).alias("_front"),
        F.max_by("_run", "_no").alias("_back"),
    )


def merge_states(states: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """The states of each key merged in the order of its chunks.  A run may go through any number of
    chunks that it fills: between two chunks with a miss, the run is back + full chunks + front."""
    order = Window.partitionBy(key).orderBy("_chunk")
    full = F.col("_front") == F.col("_n")
    # number the stretches of chunks that are joined by full ones
    broken = F.sum((~full).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    s = states.withColumn("_stretch", F.coalesce(broken, F.lit(0))).withColumn("_full", full)
    # stretch k: full chunks, then one chunk whose front closes the run; the back of the previous stretch's last chunk opens it
    runs = s.groupBy(key, "_stretch").agg(
        F.sum(F.when(F.col("_full"), F.col("_n")).otherwise(F.col("_front"))).alias("_span"),
        F.max("_longest").alias("_longest"),
        F.max(F.when(~F.col("_full"), F.col("_back"))).alias("_out"),
        F.sum("_n").alias("_n"),
        F.count("*").alias("_chunks"),
        *[F.sum(n).alias(n) for n in flags],
    )
    into = F.coalesce(F.lag("_out").over(Window.partitionBy(key).orderBy("_stretch")), F.lit(0))
    runs = runs.withColumn("_through", F.col("_span") + into)
    return runs.groupBy(key).agg(
        F.sum("_n").alias("n_rows"), *[F.sum(n).alias(n) for n in flags], F.max(F.greatest("_longest", "_through")).alias("longest_run"), F.sum("_chunks").alias("chunks")
    )


def per_key(rows: DataFrame, key: str, flags: dict[str, Column], run_of: Column, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Exact per-key counts, flag sums and longest run, by offset chunking; ``rows`` from
    :func:`read_blocks`.  An empty table gives no rows; null keys give a row with a null key; a flag that
    is null for a row counts as false."""
    states = chunk_states(number_rows(rows, key), key, flags, run_of, chunk_rows)
    return merge_states(states, key, list(flags))
