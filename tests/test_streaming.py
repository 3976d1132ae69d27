"""Streams give what batches give, across restarts."""

import datetime as dt

from lattica.sources import lines
from lattica.streaming import ingest


def test_lines_stream_as_in_batch(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    rows = [(i, "beataml_counts", f"ENSG0000000000{i}\tA\t\tx\t1\t2\t3\t{'4' if i % 2 else 'no'}") for i in range(8)]
    schema = "raw_id long, feed string, raw_text string"
    feeds = lines.feeds_of_project(["stop_gained"])
    spark.createDataFrame(rows[:5], schema).write.parquet(src)
    ingest.run_once(ingest.parsed_lines(ingest.parquet_stream(spark, src), feeds), out, cp)
    spark.createDataFrame(rows[5:], schema).write.mode("append").parquet(src)
    ingest.run_once(ingest.parsed_lines(ingest.parquet_stream(spark, src), feeds), out, cp)
    got = {r.raw_id: r.reason for r in spark.read.parquet(out).collect()}
    assert got == {i: None if i % 2 else "value" for i in range(8)}


def test_windows_close_behind_the_watermark(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    t = lambda m: dt.datetime(2025, 1, 1) + dt.timedelta(minutes=m)
    make = lambda rows: spark.createDataFrame(rows, "ts timestamp_ntz, k string, v double")
    run = lambda: ingest.run_once(ingest.windowed_counts(ingest.parquet_stream(spark, src), "ts", ["k"], "10 minutes", "5 minutes", "v"), out, cp)
    make([(t(1), "a", 1.0), (t(2), "a", 3.0), (t(3), "b", 5.0), (None, "a", 9.0)]).write.parquet(src)
    run()
    make([(t(40), "a", 1.0)]).write.mode("append").parquet(src)
    run()
    make([(t(4), "a", 100.0), (t(90), "a", 1.0)]).write.mode("append").parquet(src)  # the first is too late
    run()
    got = {(r.k, r.start.minute, r.n, r["mean"]) for r in spark.read.parquet(out).collect()}
    assert ("a", 0, 2, 2.0) in got and ("b", 0, 1, 5.0) in got and not any(r[3] and r[3] > 50 for r in got)
