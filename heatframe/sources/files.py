"""Readers and writers: station CSV, series files, tagged unions, versioned exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatframe.functions.scalar import entity_from_name, null_nan
from heatframe.sources.schema import DATE_COLUMN, DATE_FORMAT
from heatframe.sources.zipped import read_zipped


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def parse_station_rows(
    df: DataFrame, numeric: list[str], date_column: str = DATE_COLUMN, strict: bool = False, ts: str = "date"
) -> DataFrame:
    """Trims names, parses yyyymmdd and numbers, drops the raw date.

    Values that do not parse become NULL; rows with a bad date are dropped unless
    ``strict``, where a bad date is an error.
    """
    clean = strip_names(df)
    raw = F.col(date_column).cast("string")
    parsed = F.to_date(raw, DATE_FORMAT) if strict else F.try_to_date(raw, DATE_FORMAT)
    numbers = {c: null_nan(F.col(c).try_cast("double")) for c in numeric}
    typed = clean.withColumns({ts: parsed, **numbers}).drop(date_column)
    return typed if strict else typed.where(F.col(ts).isNotNull())


def read_station_csv(
    spark: SparkSession,
    paths: str | list[str],
    numeric: list[str],
    columns: list[str] | None = None,
    required: list[str] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Semicolon station files (plain, .gz, .bz2, or members of .zip archives).

    All columns are read as text by header name, so nothing is inferred; ``columns``
    prunes the scan, ``required`` drops rows without those values.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    packed = [p for p in listed if p.lower().endswith(".zip")]
    plain = [p for p in listed if p not in packed]
    frames = [strip_names(spark.read.csv(plain, sep=";", header=True, inferSchema=False))] if plain else []
    if packed:
        frames.append(strip_names(read_zipped(spark, packed)))
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if columns:
        raw = raw.select(*[c for c in raw.columns if c in {*columns, DATE_COLUMN}])
    out = parse_station_rows(raw, [c for c in numeric if c in raw.columns], strict=strict)
    return out.dropna("any", subset=required) if required else out


def tag(df: DataFrame, value: str, name: str = "city") -> DataFrame:
    return df.withColumn(name, F.lit(value))


def union_tagged(frames: dict[str, DataFrame], name: str = "city") -> DataFrame:
    """All frames under each other with their tag; absent columns are NULL."""
    tagged = [tag(df, t, name) for t, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_tagged(spark: SparkSession, files: dict[str, str], fmt: str = "csv", name: str = "city", **options) -> DataFrame:
    """Reads one file (set) per tag. A tag that the file name does not mention is
    reported by ``tag_mismatches``."""
    frames = {t: spark.read.format(fmt).options(**options).load(p) for t, p in files.items()}
    return union_tagged(frames, name)


def tag_mismatches(files: dict[str, str]) -> list[str]:
    """Tags that do not occur in their file name (swapped files)."""
    return [t for t, p in files.items() if t.lower() not in p.rsplit("/", 1)[-1].lower()]


def time_column(columns: list[str]) -> str | None:
    """``timestamp`` itself, else the first column whose name contains "time"."""
    if "timestamp" in columns:
        return "timestamp"
    return next((c for c in columns if "time" in c.lower()), None)


def standardise_time(df: DataFrame) -> DataFrame | None:
    """Renames and casts the time column to ``timestamp``; None when there is none."""
    found = time_column(df.columns)
    if found is None:
        return None
    return df.withColumnRenamed(found, "timestamp").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def read_series(spark: SparkSession, paths: str | list[str], fmt: str) -> DataFrame | None:
    """CSV or Parquet series with the entity taken from the file name."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(paths)
    if time_column(df.columns) is None:
        return None
    return standardise_time(df.withColumn("city", entity_from_name(F.col("_metadata.file_name"))))


def concat_time_chunks(chunks: list[DataFrame], keys: list[str]) -> DataFrame:
    """Chunks along time under each other; a key present twice is kept once (the row
    of the earliest chunk).

    Each chunk is shuffled once more, into twice the session's partitions: the number keeps Spark from leaving the
    shuffle out, so no task holds the state that makes two chunks and their sorted rows at once.
    """
    parts = 2 * int(chunks[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = [c.repartition(parts, *keys).withColumn("_chunk", F.lit(n)) for n, c in enumerate(chunks)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    rest = [c for c in stacked.columns if c not in (*keys, "_chunk")]
    first = stacked.groupBy(*keys).agg(F.min(F.struct("_chunk", *rest)).alias("_row"))
    return first.select(*keys, *[f"_row.{c}" for c in rest])


def export_partitioned(df: DataFrame, path: str, by: str, columns: list[str], fmt: str = "csv") -> None:
    """One folder per value of ``by``.

    Rows are range-partitioned by (by, row hash): a task writes few folders, and a value
    that holds a third of the rows is cut over as many tasks as its size asks for.
    """
    spread = df.select(by, *columns).repartitionByRange(F.col(by), F.xxhash64(*columns))
    writer = spread.write.partitionBy(by).mode("errorifexists")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def rewrite_columns(spark: SparkSession, path: str, new_path: str, change, fmt: str = "parquet") -> DataFrame:
    """Applies ``change`` to a dataset and writes it as a new version next to the old
    one (Spark cannot overwrite a path it reads); returns the new version."""
    change(spark.read.format(fmt).load(path)).write.format(fmt).mode("errorifexists").save(new_path)
    return spark.read.format(fmt).load(new_path)
