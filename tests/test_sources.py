"""Readers, writers and manifests on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from heatframe.sources import files, grid, manifest
from heatframe.sources.schema import SITES
from heatframe.session import new_path, shared_folder

CSV = "NUM_POSTE; NOM_USUEL ;LAT;LON;AAAAMMJJ;TX;QTX\n1;A;48.7;2.2;20200229;31.5;1\n1;A;48.7;2.2;20201399;30.0;1\n2;B;;2.2;20200301;x;1\n"


@pytest.fixture
def station_file(tmp_path):
    path = tmp_path / "city.csv"
    path.write_text(CSV)
    return str(path)


def test_station_csv(spark, station_file):
    got = files.read_station_csv(spark, station_file, ["TX", "LAT"])
    rows = {r["NUM_POSTE"]: r for r in got.collect()}
    assert len(rows) == 2 and "AAAAMMJJ" not in got.columns and "NOM_USUEL" in got.columns
    assert rows["1"]["date"] == dt.date(2020, 2, 29) and rows["2"]["TX"] is None


def test_station_csv_subset(spark, station_file):
    got = files.read_station_csv(
        spark, station_file, ["TX", "LAT"], columns=["NUM_POSTE", "LAT", "TX"], required=["LAT", "TX", "date"]
    )
    assert sorted(got.columns) == ["LAT", "NUM_POSTE", "TX", "date"] and got.count() == 1


def test_strict_dates_fail(spark, station_file):
    with pytest.raises(Exception):
        files.read_station_csv(spark, station_file, ["TX"], strict=True).collect()


def test_series_takes_entity_and_time_from_the_file(spark, tmp_path):
    path = tmp_path / "Paris_1990-2025.csv"
    path.write_text("Valid_Time,v\n2020-01-01 00:00:00,1\n")
    row = files.read_series(spark, str(path), "csv").first()
    assert row["city"] == "paris" and row["timestamp"] == dt.datetime(2020, 1, 1)
    other = tmp_path / "lyon_x.csv"
    other.write_text("a,v\n1,1\n")
    assert files.read_series(spark, str(other), "csv") is None


def test_tagged_files_and_swapped_names(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("v\n1\n")
    got = files.read_tagged(spark, {t: str(tmp_path / f"{t}.csv") for t in "ab"}, header=True)
    assert sorted((r["city"], r["v"]) for r in got.collect()) == [("a", "1"), ("b", "1")]
    assert files.tag_mismatches({"Lyon": "x/temp_marseille.csv", "Paris": "x/temp_paris.csv"}) == ["Lyon"]


def test_manifest_roundtrip(spark, tmp_path):
    df = spark.createDataFrame(
        [("paris", dt.datetime(1990, 1, 1), 1.0), ("paris", dt.datetime(2025, 12, 31, 23), 2.0), ("lyon", dt.datetime(1991, 1, 1), 1.0)],
        "city string, ts timestamp_ntz, t double",
    )
    made = manifest.series_manifest(df, "city", "ts")
    path = str(tmp_path / "manifest")
    manifest.write_manifest(made, "city", path)
    back = {r["city"]: r for r in manifest.read_manifest(spark, path).collect()}
    assert back["paris"]["end_exact"] == "2025-12-31 23:00:00" and back["paris"]["variables"] == ["t"]
    names = {r["city"]: r["base_name"] for r in made.collect()}
    assert names["paris"] == "paris_1990-2025_vars1_v1"
    assert made.select(manifest.name_count_matches(F.col("base_name"), F.col("var_count"))).first()[0]
    data = str(tmp_path / "data")
    df.where("city = 'paris'").write.parquet(data)
    loaded, report = manifest.load_by_manifest(spark, path, data)
    assert loaded.count() == 2
    assert {r["city"]: r["status"] for r in report.collect()} == {"paris": "loaded", "lyon": "missing"}


def test_hand_written_manifest(spark, tmp_path):
    record = {"city": "x", "time_frame": {"start_exact": "a", "end_exact": "b", "rows": 3}, "variables": {"count": 1, "list": ["t"]}}
    (tmp_path / "m.json").write_text(json.dumps(record, indent=4))
    assert manifest.read_manifest(spark, str(tmp_path / "m.json"), one_per_file=True).first()["rows"] == 3


def test_export_and_rewrite(spark, tmp_path):
    df = spark.createDataFrame([("a", n, 1.0 * n) for n in range(50)] + [("b", 1, 2.0)], "city string, n int, v double")
    first, second = str(tmp_path / "v1"), str(tmp_path / "v2")
    files.export_partitioned(df, first, "city", ["n", "v"], "parquet")
    changed = files.rewrite_columns(spark, first, second, lambda d: d.withColumn("v", F.col("v") * 2))
    assert changed.count() == 51 and changed.agg(F.sum("v")).first()[0] == df.agg(F.sum("v")).first()[0] * 2
    assert spark.read.parquet(first).agg(F.sum("v")).first()[0] == df.agg(F.sum("v")).first()[0]


def test_chunks_keep_the_first_copy(spark):
    one = spark.createDataFrame([(1, "a"), (2, "a")], "id int, v string")
    two = spark.createDataFrame([(2, "b"), (3, "b")], "id int, v string")
    got = {r["id"]: r["v"] for r in files.concat_time_chunks([one, two], ["id"]).collect()}
    assert got == {1: "a", 2: "a", 3: "b"}


def test_chunks_made_by_aggregates_are_sorted_in_tasks_of_their_own(spark):
    """A task that made both chunks and sorted their rows held all three (F6)."""
    rows = spark.range(400).select(F.col("id") % 50, F.col("id") % 7).toDF("id", "v")
    daily = rows.groupBy("id").agg(F.max("v").alias("v"))
    out = files.concat_time_chunks([daily.where("id < 30"), daily.where("id >= 20").withColumn("v", F.col("v") + 100)], ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2
    got = {r["id"]: r["v"] for r in out.collect()}
    assert got == {k: max(j % 7 for j in range(k, 400, 50)) + (100 if k >= 30 else 0) for k in range(50)}


def test_nearest_cell_per_axis(spark):
    cells = [(la, lo, 1.0) for la in (43.25, 45.0, 48.75) for lo in (-0.5, 2.25, 5.25)]
    found = {r["name"]: (r["lat"], r["lon"]) for r in grid.nearest_cells(spark.createDataFrame(cells, "lat double, lon double, v double"), SITES).collect()}
    assert found["paris"] == (48.75, 2.25) and found["lyon"] == (45.0, 5.25) and found["bordeaux"] == (45.0, -0.5)


def test_shared_folder_follows_the_session(spark):
    folder = shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir") == folder and new_path(spark, "x").startswith(folder)
