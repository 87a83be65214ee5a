"""Zip archives as a source: members, headers, empty and broken ones."""

import datetime as dt
import zipfile

import pytest

from heatframe.sources.files import read_station_csv
from heatframe.sources.zipped import read_zipped, write_zipped

ROWS = " NUM_POSTE ;NOM;AAAAMMJJ;TX\n1;\"A;B\";20200101;10.5\n1;;20201399;11\n2;é;20200103;\n"


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return str(path)


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_members_headers_and_empty_members(spark, tmp_path):
    one = archive(tmp_path / "a.zip", {"x/one.csv": ROWS, "two.csv": "NUM_POSTE;RR\r\n7;0.1\r\n", "none.csv": "", "head.csv": "NUM_POSTE;TN\n", "read.me": "x"})
    df = read_zipped(spark, one)
    assert df.columns == ["NUM_POSTE", "NOM", "AAAAMMJJ", "TX", "RR", "TN"] and {t for _, t in df.dtypes} == {"string"}
    assert values(df.select("NUM_POSTE", "NOM", "TX", "RR")) == sorted(
        [("1", "A;B", "10.5", None), ("1", None, "11", None), ("2", "é", None, None), ("7", None, None, "0.1")], key=repr)
    assert df.rdd.getNumPartitions() == 4
    assert read_zipped(spark, one, "TX string, other string").where("TX IS NOT NULL").count() == 2


def test_station_files_of_both_kinds(spark, tmp_path):
    packed = archive(tmp_path / "a.zip", {"one.csv": ROWS})
    (tmp_path / "b.csv").write_text("NUM_POSTE;AAAAMMJJ;TX\n3;20200104;1\n")
    got = values(read_station_csv(spark, [packed, str(tmp_path / "b.csv")], ["TX"], columns=["NUM_POSTE", "TX"]))
    assert got == sorted([("1", 10.5, dt.date(2020, 1, 1)), ("2", None, dt.date(2020, 1, 3)), ("3", 1.0, dt.date(2020, 1, 4))], key=repr)
    assert values(read_station_csv(spark, packed, ["TX"], required=["TX"]).select("TX")) == [(10.5,)]


def test_a_folder_and_a_long_member(spark, tmp_path):
    long = "k;v\n" + "".join(f"{k};{'x' * 50}\n" for k in range(60_000))
    archive(tmp_path / "a.zip", {"long.csv": long})
    (tmp_path / "sub").mkdir()
    archive(tmp_path / "sub" / "b.ZIP", {"short.csv": "k;v\n-1;y\n"})
    df = read_zipped(spark, str(tmp_path))
    assert df.count() == 60_001 and df.selectExpr("sum(k)").first()[0] == 60_000 * 59_999 / 2 - 1


def test_truncated_archives_and_members(spark, tmp_path):
    whole = archive(tmp_path / "whole.zip", {"one.csv": ROWS})
    cut = tmp_path / "cut.zip"
    cut.write_bytes((tmp_path / "whole.zip").read_bytes()[:-30])
    noise = "k\n" + "".join(f"{hash(str(k))}\n" for k in range(50_000))
    bad = archive(tmp_path / "bad.zip", {"good.csv": "k\n1\n", "bad.csv": noise})
    data = bytearray((tmp_path / "bad.zip").read_bytes())
    data[len(data) // 2] ^= 0xFF
    (tmp_path / "bad.zip").write_bytes(data)
    with pytest.raises(Exception, match="no whole zip archive"):
        read_zipped(spark, [whole, str(cut)])
    with pytest.raises(Exception):
        read_zipped(spark, bad).count()
    assert read_zipped(spark, [whole, str(cut)], broken="skip").count() == 3
    assert values(read_zipped(spark, bad, broken="skip")) == [("1",)]
    assert read_zipped(spark, str(cut), "k string", broken="skip").count() == 0


def test_written_archives_read_back(spark, tmp_path):
    df = spark.range(0, 1000, 1, 3).selectExpr("cast(id as string) k", "if(id % 7 = 0, null, concat('a;\"', id)) v")
    paths = write_zipped(df, f"file://{tmp_path}/z", member_rows=150)
    assert len(paths) == 3 and values(read_zipped(spark, paths)) == values(df)
    with zipfile.ZipFile(paths[0].removeprefix("file://")) as z:
        assert len(z.namelist()) == 3
    assert write_zipped(df.limit(0), f"file://{tmp_path}/none") == []
