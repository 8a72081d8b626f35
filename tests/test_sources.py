"""Sinks, scans and the stream's files, where a query on the test tables doesn't reach a case."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tandem.plans import source_queries
from tandem.sources import files
from tandem.sources.scratch import remove, scratch_path
from tandem.streaming.minima import latest_minima, start_minima, streaming_minima

SCHEMA = "ts timestamp, node bigint, value double"


def at(day, hour):
    return dt.datetime(2020, 1, day, hour)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_the_stream_counts_nothing_twice_after_a_restart(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = [(at(1, 1), 1, 5.0), (at(1, 3), 1, 4.0), (at(2, 2), 2, 7.0), (at(1, 9), 1, 0.0)]
    second = [(at(1, 5), 1, 3.0), (at(3, 0), 2, 1.0)]  # late by less than the watermark allows
    run = lambda: start_minima(spark.readStream.schema(SCHEMA).parquet(source), out).awaitTermination()
    spark.createDataFrame(first, SCHEMA).write.parquet(source)
    run()
    spark.createDataFrame(second, SCHEMA).write.mode("append").parquet(source)
    run()
    run()  # nothing new
    want = streaming_minima(spark.createDataFrame(first + second, SCHEMA)).select("node", "day", "min_value", "n")
    assert rows_of(latest_minima(spark, out)) == rows_of(want)


def test_rows_beyond_the_watermark_are_left_out(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: start_minima(spark.readStream.schema(SCHEMA).parquet(source), out).awaitTermination()
    for rows in ([(at(10, 1), 1, 5.0)], [(at(20, 1), 1, 6.0)], [(at(1, 1), 1, 0.0)]):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(source)
        run()
    assert [r["day"].day for r in latest_minima(spark, out).orderBy("day").collect()] == [10, 20]


def test_a_single_file_replaces_what_was_there(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    files.write_table(spark.range(100).repartition(4), path)  # a folder of several files
    files.write_single_file(spark.range(5), path)
    assert files.count_files(spark, path) == 1 and spark.read.parquet(path).count() == 5
    files.write_single_file(spark.range(0), path)
    assert spark.read.parquet(path).count() == 0
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t.parquet"]


def test_a_failed_write_leaves_the_former_file(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    files.write_single_file(spark.range(5), path)
    with pytest.raises(Exception):
        files.write_single_file(spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("x")), path)
    assert spark.read.parquet(path).count() == 5


def test_scratch_paths_are_own_and_go(spark):
    one, two = scratch_path(spark, "a"), scratch_path(spark, "a")
    assert one != two
    files.write_table(spark.range(1), one)
    remove(spark, one)
    assert not files.exists(spark, one)


def test_yearly_scans_report_years_without_a_file(spark):
    got = source_queries.yearly_scan(spark, "/root/testdata/sf0.001")
    assert got.where("year < 1992 and n > 0").isEmpty() and got.count() == 16
