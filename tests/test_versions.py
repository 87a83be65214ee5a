"""Rewrites in place, files of different columns, incremental writes."""

import datetime as dt
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from heatframe.sources import catalogue
from heatframe.sources.increments import IncrementalWriter
from heatframe.sources.versions import VersionConflict, VersionedTable


def test_rewrite_replaces_the_version_readers_see(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.current() is None
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.write(spark.range(3)) == 0
    assert table.rewrite(lambda df: df.select((F.col("id") * 2).alias("double"))) == 1
    again = VersionedTable(spark, str(tmp_path / "t"))
    assert sorted(r["double"] for r in again.read().collect()) == [0, 2, 4]
    assert sorted(r["id"] for r in again.read(0).collect()) == [0, 1, 2]


def test_a_write_that_dies_leaves_the_old_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(3))
    with pytest.raises(Exception):  # dies while the data are written
        table.rewrite(lambda df: df.select(F.raise_error(F.lit("no"))))
    table._stage(spark.range(9))  # dies between data and record
    assert table.current() == 0 and table.read().count() == 3
    assert table.rewrite(lambda df: df.where("id > 0")) == 1 and table.read().count() == 2


def test_two_writers_conflict(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(3))

    def slow(df):
        VersionedTable(spark, str(tmp_path / "t")).write(spark.range(5))
        return df

    with pytest.raises(VersionConflict):
        table.rewrite(slow)
    assert table.current() == 1 and table.read().count() == 5


def test_expired_versions_go(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    for n in range(3):
        table.write(spark.range(n + 1))
    assert table.expire(keep=2) == [0] and sorted(table.history()) == [1, 2] and table.read().count() == 3
    with pytest.raises(FileNotFoundError):
        table.read(0)
    with pytest.raises(ValueError):
        table.expire(keep=0)


def test_files_of_three_layouts_and_two_that_are_none(spark, tmp_path):
    (tmp_path / "paris_1990.csv").write_text("Valid_Time,t\n2020-01-01 00:00:00,1\n")
    (tmp_path / "lyon_1990.csv").write_text("t,timestamp,p\nx,2020-01-02 00:00:00,9\n")
    (tmp_path / "nice_1990.csv").write_text("obs_time,t\n2020-01-03 00:00:00,NaN\n")
    (tmp_path / "brest_1990.csv").write_text("day,t\n2020-01-03,4\n")
    (tmp_path / "blank_1990.csv").write_text("\n1\n")
    (tmp_path / "empty_1990.csv").write_text("")
    got, listed = catalogue.read_mixed_series(spark, str(tmp_path), "csv", ["t", "p"])
    rows = {r["city"]: (r["timestamp"], r["t"], r["p"]) for r in got.collect()}
    assert rows == {"paris": (dt.datetime(2020, 1, 1), 1.0, None), "lyon": (dt.datetime(2020, 1, 2), None, 9.0),
                    "nice": (dt.datetime(2020, 1, 3), None, None)}
    bad = {r["path"].rsplit("/", 1)[-1]: r["problem"] for r in listed.where("problem IS NOT NULL").collect()}
    assert bad == {"brest_1990.csv": catalogue.NO_TIME, "blank_1990.csv": catalogue.NO_COLUMNS}


def test_parquet_files_of_different_columns(spark, tmp_path):
    at = [dt.datetime(2020, 1, 1)]
    pq.write_table(pa.table({"time": at, "t": [1.5]}), tmp_path / "paris_a.parquet")
    pq.write_table(pa.table({"Valid_Time": at, "t": [2]}), tmp_path / "lyon_a.parquet")
    pq.write_table(pa.table({"t": [3]}), tmp_path / "nice_a.parquet")
    (tmp_path / "brest_a.parquet").write_text("no parquet")
    got, listed = catalogue.read_mixed_series(spark, str(tmp_path), "parquet", ["t"])
    assert sorted((r["city"], r["timestamp"], r["t"]) for r in got.collect()) == [("lyon", at[0], 2.0), ("paris", at[0], 1.5)]
    assert listed.where("problem IS NOT NULL").count() == 2
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "nice_b.csv").write_text("a\n1\n")
    assert catalogue.read_mixed_series(spark, str(tmp_path / "none"), "csv", ["a"])[0] is None


@pytest.fixture
def monthly(spark, tmp_path):
    rows = [("01", dt.date(2020, m, 1), d) for m in (1, 2, 3) for d in (1, 2)] + [(None, dt.date(2020, 1, 1), 7)]
    source = spark.createDataFrame(rows, "city string, month date, v long")
    outputs = {"all": lambda df: df, "odd": lambda df: df.where("v % 2 = 1 AND month <> DATE '2020-03-01'")}
    return source, IncrementalWriter(spark, str(tmp_path / "out"), ["city", "month"], outputs), tmp_path / "out"


def test_second_run_writes_nothing(monthly):
    source, writer, _ = monthly
    assert writer.write(source).count() == 4
    assert writer.write(source).count() == 0
    assert writer.complete(source).count() == 4


def test_a_lost_output_is_written_again_alone(spark, monthly):
    source, writer, path = monthly
    writer.write(source)
    before = {p: p.stat().st_mtime_ns for p in path.rglob("part-*") if "_todo" not in str(p) and "_ledger" not in str(p)}
    shutil.rmtree(path / "odd" / "city=01" / "month=2020-02-01")
    assert [(r["city"], r["month"]) for r in writer.write(source).collect()] == [("01", dt.date(2020, 2, 1))]
    kept = [p for p in before if p.exists()]
    assert all(p.stat().st_mtime_ns == before[p] for p in kept) and not any("2020-02-01" in str(p) for p in kept)
    assert spark.read.parquet(str(path / "all")).count() == 7 and spark.read.parquet(str(path / "odd")).count() == 3


def test_a_run_that_dies_is_done_again(spark, monthly):
    source, writer, path = monthly
    good = writer.outputs
    writer.outputs = good | {"odd": lambda df: df.withColumn("v", F.raise_error(F.lit("no")).cast("long"))}
    with pytest.raises(Exception):
        writer.write(source)
    writer.outputs = good
    assert writer.write(source).count() == 4 and spark.read.parquet(str(path / "all")).count() == 7
