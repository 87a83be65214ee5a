"""Delimited text inside zip archives as a Spark data source: one partition per archive member, read as a stream."""

from __future__ import annotations

import csv
import json
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import csv as arrow_csv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

BLOCK_BYTES = 1 << 20
LISTERS = 16
MEMBER_ROWS = 50_000


class Member(InputPartition):
    def __init__(self, archive: str, name: str):
        super().__init__((archive, name))


def archives(paths: Iterable[str]) -> list[str]:
    """The archives among paths; a folder stands for every .zip below it."""
    out = []
    for path in paths:
        system, name = fs.FileSystem.from_uri(path)
        if system.get_file_info(name).type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(name, recursive=True))
            names = sorted(f.path for f in found if f.is_file and f.path.lower().endswith(".zip"))
            out += [path.rstrip("/") + f[len(name.rstrip("/")):] for f in names]
        else:
            out.append(path)
    return out


def open_archive(path: str) -> zipfile.ZipFile:
    system, name = fs.FileSystem.from_uri(path)
    try:
        return zipfile.ZipFile(system.open_input_file(name))
    except zipfile.BadZipFile as error:
        raise ValueError(f"{path} is no whole zip archive: {error}") from error


def header(stream, sep: str, encoding: str) -> list[str]:
    """Trimmed names of the first line, which is consumed; empty for an empty member."""
    line = stream.readline().decode(encoding).lstrip("\ufeff").rstrip("\r\n")
    names = [c.strip() for c in next(csv.reader([line], delimiter=sep), [])]
    if len(set(names)) < len(names):
        raise ValueError(f"repeated column names: {names}")
    return names


class ZippedCsv(DataSource):
    """Format ``zipped_csv``. Options: paths (a JSON list), sep, encoding, member (a file name pattern), broken.

    All columns are strings, an empty field is NULL. Without a given schema the columns are those of all members'
    headers, in the order in which they come; a column that a member does not have is NULL there. ``broken`` is "fail"
    (default: an archive or a member that cannot be read to its end is an error) or "skip" (it has no rows; members are
    then read twice, so that none comes in part).
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def __init__(self, options):
        super().__init__(options)
        self.paths = json.loads(options["paths"])
        self.sep, self.encoding = options.get("sep", ";"), options.get("encoding", "utf8")
        self.member, self.skip = options.get("member", "*.csv"), options.get("broken", "fail") == "skip"

    def members(self) -> list[tuple[str, str, list[str]]]:
        """archive, member, column names of every member, archives in turn."""
        def listed(path: str) -> list[tuple[str, str, list[str]]]:
            try:
                with open_archive(path) as archive:
                    out = []
                    for info in archive.infolist():
                        if not info.is_dir() and fnmatch(info.filename.rsplit("/", 1)[-1], self.member):
                            with archive.open(info) as stream:
                                out.append((path, info.filename, header(stream, self.sep, self.encoding)))
                    return out
            except (ValueError, zipfile.BadZipFile, EOFError):
                if self.skip:
                    return []
                raise

        with ThreadPoolExecutor(LISTERS) as pool:
            return [m for found in pool.map(listed, archives(self.paths)) for m in found]

    def schema(self) -> StructType:
        names = dict.fromkeys(c for *_, columns in self.members() for c in columns)
        return StructType([StructField(c, StringType()) for c in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZippedReader(self, schema.names)


class ZippedReader(DataSourceReader):
    def __init__(self, source: ZippedCsv, names: list[str]):
        self.source, self.names = source, names

    def partitions(self) -> list[InputPartition]:
        # a source without members has one empty partition
        return [Member(a, m) for a, m, _ in self.source.members()] or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        path, name = partition.value
        if not path:
            return
        source = self.source
        with open_archive(path) as archive:
            if source.skip and not _whole(archive, name):
                return
            with archive.open(name) as stream:
                columns = header(stream, source.sep, source.encoding)
                if not columns or not stream.peek(1):
                    return
                batches = arrow_csv.open_csv(
                    stream, arrow_csv.ReadOptions(column_names=columns, block_size=BLOCK_BYTES, encoding=source.encoding),
                    arrow_csv.ParseOptions(delimiter=source.sep),
                    arrow_csv.ConvertOptions(column_types={c: pa.string() for c in columns}, strings_can_be_null=True,
                                             null_values=[""], quoted_strings_can_be_null=True))
                for b in batches:
                    yield pa.record_batch([b.column(c) if c in columns else pa.nulls(b.num_rows, pa.string()) for c in self.names], self.names)


def _whole(archive: zipfile.ZipFile, name: str) -> bool:
    """Whether a member can be read to its end and has its checksum."""
    try:
        with archive.open(name) as stream:
            while stream.read(BLOCK_BYTES):
                pass
    except (zipfile.BadZipFile, EOFError, OSError, ValueError):
        return False
    except Exception as error:  # zlib.error has no base but Exception
        if type(error).__module__ != "zlib":
            raise
        return False
    return True


def read_zipped(spark: SparkSession, paths: str | list[str], schema: StructType | str | None = None, **options) -> DataFrame:
    """Rows of all members of zip archives (see ``ZippedCsv``)."""
    spark.dataSource.register(ZippedCsv)
    reader = spark.read.format("zipped_csv").option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths)))
    reader = reader.options(**options)
    return (reader.schema(schema) if schema is not None else reader).load()


def write_zipped(df: DataFrame, folder: str, stem: str = "part", sep: str = ";", member_rows: int = MEMBER_ROWS) -> list[str]:
    """Writes df as zip archives, one for each task that has rows, with members of up to ``member_rows`` rows.

    Every attempt of a task writes a file of its own; only the paths returned count.
    """
    def write(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        archive, stream, members, rows, writer = None, None, 0, 0, None
        name = f"{stem}-{uuid.uuid4().hex}.zip"
        for b in incoming:
            at = 0
            while at < b.num_rows:
                if archive is None:
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(f"{base}/{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                if writer is None:
                    stream = archive.open(f"{stem}_{members}.csv", "w")
                    writer = arrow_csv.CSVWriter(stream, b.schema, write_options=arrow_csv.WriteOptions(delimiter=sep, quoting_style="needed"))
                part = b.slice(at, member_rows - rows)
                writer.write_batch(part)
                at, rows = at + part.num_rows, rows + part.num_rows
                if rows == member_rows:
                    writer.close()
                    stream.close()
                    members, rows, writer = members + 1, 0, None
        if writer is not None:
            writer.close()
            stream.close()
        if archive is not None:
            archive.close()
            out.close()
            yield pa.record_batch([[f"{folder}/{name}"]], ["path"])

    return sorted(r.path for r in df.mapInArrow(write, "path string").collect())  # one path a task
