"""Session, table access and lineage cuts.

Nothing here touches a machine-local folder on a cluster: lineage is cut with tables written under
``spark.checkpoint.dir``.  Only where that setting is absent (unit tests, a laptop) a private folder
is made.
"""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# functions of this package go to the Python workers by value: executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules["lattica"])

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Largest side, in bytes as estimated from a counted table, that may be broadcast.
BROADCAST_BYTES = 48 << 20


def local_session(app: str = "lattica", cores: str = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller's own session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where it is unset."""
    there = spark.sparkContext.getConf().get(CHECKPOINT_KEY, None) or spark.conf.get(CHECKPOINT_KEY, None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lattica-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set(CHECKPOINT_KEY, own)
    return own


def written(df: DataFrame, label: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, and losing an
    executor costs no recomputation.  The folder is removed when the driver's process ends."""
    return df.sparkSession.read.schema(df.schema).parquet(written_path(df, label, partition_by))


def written_path(df: DataFrame, label: str = "t", partition_by: list[str] | None = None) -> str:
    """The path of ``df`` written as by :func:`written`."""
    path = own_folder(df.sparkSession, label)
    df.write.parquet(path, partitionBy=partition_by)
    return path


def own_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        if path.startswith("/") or path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        else:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone; the folder then stays to the shared folder's own clean-up
        pass


def row_bytes(df: DataFrame) -> int:
    """A generous size of one row in memory, from the types alone."""
    fixed = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}
    return 16 + sum(fixed.get(kind, 64) + 8 for _, kind in df.dtypes)


def small_enough(df: DataFrame, limit: int = BROADCAST_BYTES, counted: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """``(df, True)`` with a broadcast hint if its counted rows fit ``limit``; else ``(df, False)``.
    ``df`` should be cheap to count (written, or a footer count), or ``counted`` be so and have as many rows."""
    most = limit // row_bytes(df)
    if (df if counted is None else counted).limit(most + 1).count() <= most:
        return F.broadcast(df), True
    return df, False


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


def colname(*taken: list[str], base: str) -> str:
    """A column name starting with ``base`` that none of the inputs has."""
    used = {c.lower() for cols in taken for c in cols}
    name, k = base, 0
    while name.lower() in used:
        k += 1
        name = f"{base}_{k}"
    return name


def q(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_dir(scale: str = "0.001") -> str:
    return os.environ.get("LATTICA_DATA", f"/root/testdata/sf{scale}")
