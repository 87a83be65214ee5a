"""Manifests: what each series file should contain, and checks against what it does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatframe.functions.scalar import stamp
from heatframe.sources.schema import MANIFEST_SCHEMA


def series_manifest(df: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, start_exact, end_exact, rows, var_count, variables, base_name)."""
    variables = [c for c in df.columns if c not in (key, ts)]
    spans = df.groupBy(key).agg(F.min(ts).alias("_start"), F.max(ts).alias("_end"), F.count("*").alias("rows"))
    name = F.format_string(
        f"%s_%d-%d_vars{len(variables)}_v1", F.lower(key), F.year("_start"), F.year("_end")
    )
    return spans.select(
        key, stamp(F.col("_start")).alias("start_exact"), stamp(F.col("_end")).alias("end_exact"), "rows",
        F.lit(len(variables)).alias("var_count"), F.array(*[F.lit(v) for v in variables]).alias("variables"),
        name.alias("base_name"),
    )


def nested(manifest: DataFrame, key: str) -> DataFrame:
    """The file layout of a manifest: time frame and variables as structs."""
    return manifest.select(
        F.col(key).alias("city"),
        F.struct("start_exact", "end_exact", "rows").alias("time_frame"),
        F.struct(F.col("var_count").alias("count"), F.col("variables").alias("list")).alias("variables"),
    )


def write_manifest(manifest: DataFrame, key: str, path: str) -> None:
    nested(manifest, key).write.mode("errorifexists").json(path)


def read_manifest(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """``one_per_file`` reads indented files of one manifest each, otherwise one per line."""
    raw = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", one_per_file).json(path)
    return raw.select(
        "city", "time_frame.*", F.col("variables.count").alias("var_count"), F.col("variables.list").alias("variables")
    )


def manifest_audit(manifest: DataFrame, present: DataFrame, key: str, rows: str = "rows") -> DataFrame:
    """Left join of the manifest with the entities found: status loaded or missing."""
    found = present.select(key, F.col(rows).alias("found_rows"))
    status = F.when(F.col("found_rows").isNull(), "missing").otherwise("loaded")
    return manifest.join(found, key, "left").select(key, "found_rows", status.alias("status"))


def load_by_manifest(spark: SparkSession, manifest_path: str, data_path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(series of the entities the manifest lists, report with missing entities)."""
    manifest = read_manifest(spark, manifest_path)
    data = spark.read.format(fmt).load(data_path)
    counts = data.groupBy("city").agg(F.count("*").alias("rows"))
    return data.join(manifest.select("city"), "city", "left_semi"), manifest_audit(manifest.select("city"), counts, "city")


def variable_set(listed: Column) -> Column:
    return F.array_sort(F.array_distinct(listed))


def manifest_validate(df: DataFrame, listed: str, found: str, removed: str, required: list[str]) -> DataFrame:
    """Adds the set checks of a manifest's variable list against the columns found.

    ``removed`` must be gone and ``required`` present; both lists must be the same set.
    """
    need = F.array(*[F.lit(v) for v in required])
    missing, extra = F.array_except(listed, found), F.array_except(found, listed)
    return df.withColumns(
        {
            "n_missing": F.size(missing),
            "n_extra": F.size(extra),
            "old_removed": ~F.array_contains(found, removed),
            "new_present": F.size(F.array_except(need, F.col(found))) == 0,
            "in_sync": (F.size(missing) == 0) & (F.size(extra) == 0),
        }
    )


def variable_catalog(df: DataFrame, variables: str) -> DataFrame:
    """(variable, n_entities): every variable of any manifest."""
    return df.select(F.explode(F.array_distinct(variables)).alias("variable")).groupBy("variable").agg(
        F.count("*").alias("n_entities")
    )


def name_count_matches(base_name: Column, var_count: Column) -> Column:
    """Does the variable count in a versioned file name equal the manifest's count?"""
    return F.regexp_extract(base_name, r"_vars(\d+)_", 1).try_cast("int") == var_count
