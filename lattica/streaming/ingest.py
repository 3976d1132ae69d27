"""Streams into the same operators: undecoded lines parsed as they arrive, and windowed counts.

The batch operators have no streaming counterpart of their own; these two are what continuous loads need.
Parsing is stateless, so a stream's rows are judged exactly as a batch's.  Counts are held per window and
key until the watermark passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.session import q
from lattica.sources.lines import Feed, parse_lines


def parquet_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """The files of a folder as they come, with the schema of those already there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def parsed_lines(stream: DataFrame, feeds: list[Feed]) -> DataFrame:
    """As the batch parser, over a stream of (raw_id, feed, raw_text)."""
    return parse_lines(stream, feeds)


def windowed_counts(stream: DataFrame, time: str, keys: Sequence[str], window: str, late: str, value: str | None = None) -> DataFrame:
    """(start, end, keys..., n[, mean]): tumbling windows; rows later than ``late`` behind the newest are
    dropped, as are rows without a time.  Times without a zone are taken as the session's."""
    timed = stream.withColumn("_time", q(time).cast("timestamp")).withWatermark("_time", late)
    aggs = [F.count("*").alias("n"), *([F.avg(q(value)).alias("mean")] if value else [])]
    out = timed.groupBy(F.window("_time", window), *[q(c) for c in keys]).agg(*aggs)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[q(c) for c in keys], "n", *(["mean"] if value else []))


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what is there as Parquet and ends; a later call goes on where this one stopped."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
