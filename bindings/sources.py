"""Ingestion, manifest and grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.inputs import Inputs
from bindings.registry import query
from bindings.text import r, rd, round_doubles
from heatframe.functions.scalar import entity_from_name
from heatframe.session import new_path
from heatframe.sources import catalogue, files, grid, manifest, zipped
from heatframe.sources.increments import IncrementalWriter
from heatframe.sources.schema import SITES
from heatframe.sources.versions import VersionedTable


STATION_SQL = """
    SELECT CAST(station_id AS VARCHAR) AS "NUM_POSTE", obs_date AS date, tx AS "TX" FROM daily_obs
    WHERE NOT (station_id % 10 = 3 AND day(obs_date) = 1)"""


def station_text(i: Inputs):
    """Station rows as text, some with a date that is none."""
    broken = (F.col("station_id") % 10 == 3) & (F.dayofmonth("obs_date") == 1)
    text = F.when(broken, "20001399").otherwise(F.date_format("obs_date", "yyyyMMdd"))
    return i.daily_obs().select(
        F.col("station_id").cast("string").alias(" NUM_POSTE "), text.alias("AAAAMMJJ "),
        F.col("tx").cast("string").alias("TX"),
    )


@query("ingest_station_daily", STATION_SQL)
def _(i: Inputs):
    return files.parse_station_rows(station_text(i), ["TX"])


@query("ingest_station_zip", STATION_SQL)
def _(i: Inputs):
    """The same rows out of zip archives of several members."""
    paths = zipped.write_zipped(station_text(i), new_path(i.spark, "archives"), "stations")
    return files.read_station_csv(i.spark, paths, ["TX"])


@query("ingest_clean_subset", """
    SELECT station_id, CASE WHEN station_id % 9 = 4 THEN NULL ELSE lat END AS lat, lon, obs_date, tx
    FROM station_daily WHERE station_id % 9 <> 4 AND NOT (wind_gust IS NULL)""")
def _(i: Inputs):
    raw = i.station_daily().select(
        "station_id",
        F.when(F.col("station_id") % 9 != 4, F.col("lat")).cast("string").alias("lat"),
        F.col("lon").cast("string").alias("lon"),
        F.date_format("obs_date", "yyyyMMdd").alias("AAAAMMJJ"),
        F.when(F.col("wind_gust").isNull(), "n/a").otherwise(F.col("tx").cast("string")).alias("tx"),
    )
    parsed = files.parse_station_rows(raw, ["lat", "lon", "tx"], ts="obs_date")
    return parsed.dropna("any", subset=["lat", "lon", "tx", "obs_date"])


@query("tagged_union", """
    SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS value, CAST(NULL AS INT) AS size FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier
    UNION ALL SELECT 'part', p_partkey, p_retailprice, p_size FROM part""")
def _(i: Inputs):
    frames = {
        "customer": i.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")),
        "supplier": i.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value")),
        "part": i.table("part").select(
            F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("value"), F.col("p_size").alias("size")
        ),
    }
    return files.union_tagged(frames, "source")


@query("time_chunks_union", """
    SELECT station_id, obs_date, tx FROM daily_obs""")
def _(i: Inputs):
    daily = i.daily_obs().select("station_id", "obs_date", "tx")
    first, second = daily.where(F.dayofmonth("obs_date") <= 15), daily.where(F.dayofmonth("obs_date") >= 15)
    return files.concat_time_chunks([first, second], ["station_id", "obs_date"])


@query("infer_time_column", "SELECT event_id, ts AS timestamp, value FROM events")
def _(i: Inputs):
    raw = i.table("events").select("event_id", F.col("ts").cast("string").alias("Valid_Time"), "value")
    return files.standardise_time(raw)


@query("mixed_series_files", """
    SELECT station_id, CAST(obs_date AS TIMESTAMP) AS timestamp, CASE WHEN station_id % 4 <> 2 THEN tx END AS tx
    FROM daily_obs WHERE station_id % 4 <> 3""")
def _(i: Inputs):
    """CSV files of three layouts, and some without a time column, read back through their catalogue."""
    day = F.col("obs_date").cast("string")
    layouts = [["station_id", day.alias("Valid_Time"), "tx"], [day.alias("timestamp"), "tx", "station_id"],
               ["station_id", day.alias("obs_time")], ["station_id", "tx"]]
    paths = []
    for n, columns in enumerate(layouts):
        paths.append(new_path(i.spark, f"layout-{n}"))
        i.daily_obs().where(F.col("station_id") % 4 == n).select(*columns).write.option("header", True).csv(paths[-1])
    series, _ = catalogue.read_mixed_series(i.spark, paths, "csv", ["station_id", "tx"])
    return series.select(F.col("station_id").cast("bigint").alias("station_id"), "timestamp", "tx")


@query("entity_from_name", """
    SELECT p_partkey, lower(split_part(replace(p_name, ' ', '_') || '_1990-2025.parquet', '_', 1)) AS entity FROM part""")
def _(i: Inputs):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_1990-2025.parquet"))
    return i.table("part").select("p_partkey", entity_from_name(name).alias("entity"))


@query("series_manifest", """
    SELECT city, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS start_exact, strftime(MAX(ts), '%Y-%m-%d %H:%M:%S') AS end_exact,
           COUNT(*) AS rows, 2 AS var_count, 'temperature_2m,pressure_msl' AS variables,
           lower(city) || '_' || year(MIN(ts)) || '-' || year(MAX(ts)) || '_vars2_v1' AS base_name
    FROM hourly_sparse GROUP BY city""")
def _(i: Inputs):
    hourly = i.hourly_sparse().select("city", "ts", "temperature_2m", "pressure_msl")
    return manifest.series_manifest(hourly, "city", "ts").withColumn("variables", F.array_join("variables", ","))


@query("manifest_audit", """
    SELECT c_custkey, o.n AS found_rows, CASE WHEN o.n IS NULL THEN 'missing' ELSE 'loaded' END AS status
    FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def _(i: Inputs):
    counts = i.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("rows"))
    return manifest.manifest_audit(i.table("customer").select("c_custkey"), counts, "c_custkey")


@query("manifest_validate", """
    WITH v AS (SELECT l_suppkey AS station_id, list_distinct(list('var_' || l_linenumber)) AS listed,
                      list_distinct(list('var_' || l_linenumber) FILTER (l_returnflag = 'R' AND l_tax > 0.07)) AS found
               FROM lineitem GROUP BY 1)
    SELECT station_id, CAST(len(list_filter(listed, lambda x: NOT list_contains(found, x))) AS INT) AS n_missing,
           CAST(len(list_filter(found, lambda x: NOT list_contains(listed, x))) AS INT) AS n_extra,
           NOT list_contains(found, 'var_7') AS old_removed,
           list_contains(found, 'var_1') AND list_contains(found, 'var_2') AS new_present,
           len(list_filter(listed, lambda x: NOT list_contains(found, x))) = 0 AS in_sync
    FROM (SELECT station_id, listed, coalesce(found, []) AS found FROM v)""")
def _(i: Inputs):
    variable = F.concat(F.lit("var_"), F.col("l_linenumber").cast("string"))
    kept = (F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.07)
    sets = i.table("lineitem").groupBy(F.col("l_suppkey").alias("station_id")).agg(
        F.collect_set(variable).alias("listed"), F.collect_set(F.when(kept, variable)).alias("found")
    )
    checked = manifest.manifest_validate(sets, "listed", "found", "var_7", ["var_1", "var_2"])
    return checked.drop("listed", "found")


@query("variable_catalog", """
    SELECT 'var_' || l_linenumber AS variable, COUNT(DISTINCT l_suppkey) AS n_entities FROM lineitem GROUP BY 1""")
def _(i: Inputs):
    variable = F.concat(F.lit("var_"), F.col("l_linenumber").cast("string"))
    sets = i.table("lineitem").groupBy("l_suppkey").agg(F.collect_set(variable).alias("variables"))
    return manifest.variable_catalog(sets, "variables")


@query("export_roundtrip", f"""
    SELECT city, COUNT(*) AS rows, MIN(obs_date) AS first_date, {r('SUM(tx)', 3)} AS sum_tx FROM station_daily GROUP BY city""")
def _(i: Inputs):
    path = new_path(i.spark, "export")
    daily = i.station_daily()
    files.export_partitioned(daily, path, "city", ["obs_date", "station_id", "tx"], "csv")
    schema = "obs_date date, station_id bigint, tx double, city string"
    back = i.spark.read.schema(schema).option("header", True).csv(path)
    return back.groupBy("city").agg(
        F.count("*").alias("rows"), F.min("obs_date").alias("first_date"), rd(F.sum("tx"), 3).alias("sum_tx")
    )


@query("rewrite_in_place", f"""
    SELECT station_id, obs_date, {r('tx * 1.8 + 32', 3)} AS tx_f FROM daily_obs WHERE tx IS NOT NULL""")
def _(i: Inputs):
    table = VersionedTable(i.spark, new_path(i.spark, "versioned"))
    table.write(i.daily_obs().select("station_id", "obs_date", "tx"))
    table.rewrite(lambda df: df.withColumn("tx_f", rd(F.col("tx") * 1.8 + 32, 3)).drop("tx"))
    table.rewrite(lambda df: df.where("tx_f IS NOT NULL"))
    return table.read()


GRID_SQL = """
    WITH grid AS (SELECT CAST(l_shipdate AS DATE) AS valid_date, 500 + 350 * (l_linenumber % 2) AS level,
               42.0 + (l_suppkey % 30) * 0.25 AS lat, -1.0 + (l_partkey % 30) * 0.25 AS lon,
               273.15 + l_quantity AS t, l_discount * 100 AS u FROM lineitem)
    """


def _grid(i: Inputs):
    return i.table("lineitem").select(
        F.col("l_shipdate").cast("date").alias("valid_date"),
        (500 + 350 * (F.col("l_linenumber") % 2)).alias("level"),
        (42.0 + (F.col("l_suppkey") % 30) * 0.25).alias("lat"),
        (-1.0 + (F.col("l_partkey") % 30) * 0.25).alias("lon"),
        (273.15 + F.col("l_quantity")).alias("t"),
        (F.col("l_discount") * 100).alias("u"),
    )


SITE_SQL = ", ".join(f"('{n}', {la}, {lo})" for n, la, lo in SITES)


@query("nearest_grid_point", GRID_SQL + f""",
    sites(name, lat, lon) AS (VALUES {SITE_SQL}),
    lats AS (SELECT name, g.lat, ROW_NUMBER() OVER (PARTITION BY name ORDER BY abs(g.lat - s.lat), g.lat) AS n
             FROM sites s, (SELECT DISTINCT lat FROM grid) g),
    lons AS (SELECT name, g.lon, ROW_NUMBER() OVER (PARTITION BY name ORDER BY abs(g.lon - s.lon), g.lon) AS n
             FROM sites s, (SELECT DISTINCT lon FROM grid) g),
    cells AS (SELECT name, lat, lon FROM (SELECT * FROM lats WHERE n = 1) JOIN (SELECT * FROM lons WHERE n = 1) USING (name))
    SELECT name, level, COUNT(*) AS n, {r('AVG(t)')} AS t_mean, {r('MAX(u)')} AS u_max
    FROM grid JOIN cells USING (lat, lon) GROUP BY name, level""")
def _(i: Inputs):
    points = grid.grid_to_points(_grid(i), SITES)
    return points.groupBy("name", "level").agg(
        F.count("*").alias("n"), rd(F.avg("t")).alias("t_mean"), rd(F.max("u")).alias("u_max")
    )


@query("level_pivot", GRID_SQL + f"""
    SELECT valid_date, {r('MAX(t) FILTER (level = 500)')} AS "t_500hPa", {r('MAX(t) FILTER (level = 850)')} AS "t_850hPa",
           {r('MAX(u) FILTER (level = 500)')} AS "u_500hPa", {r('MAX(u) FILTER (level = 850)')} AS "u_850hPa"
    FROM grid GROUP BY valid_date""")
def _(i: Inputs):
    out = grid.levels_to_columns(_grid(i), ["valid_date"], "level", ["t", "u"], [500, 850])
    return round_doubles(out, "t_500hPa", "t_850hPa", "u_500hPa", "u_850hPa")


@query("incremental_missing_partitions", """
    WITH present AS (SELECT DISTINCT station_id, CAST(date_trunc('month', obs_date) AS DATE) AS month
                     FROM daily_obs WHERE tx >= 30),
    wanted AS (SELECT station_id, CAST(unnest(generate_series(date_trunc('month', MIN(obs_date)),
                      date_trunc('month', MAX(obs_date)), INTERVAL 1 MONTH)) AS DATE) AS month
               FROM daily_obs GROUP BY station_id)
    SELECT station_id, month FROM wanted ANTI JOIN present USING (station_id, month)""")
def _(i: Inputs):
    daily = i.daily_obs()
    month = F.trunc("obs_date", "month")
    span = F.sequence(F.min(month), F.max(month), F.expr("INTERVAL 1 MONTH"))
    wanted = daily.groupBy("station_id").agg(span.alias("months")).select("station_id", F.explode("months").alias("month"))
    present = daily.where("tx >= 30").select("station_id", month.alias("month")).distinct()
    return grid.missing_partitions(wanted, present, ["station_id", "month"])


@query("incremental_write", """
    SELECT CAST(date_trunc('month', obs_date) AS DATE) AS month, COUNT(*) AS n, COUNT(*) FILTER (tx >= 30) AS n_hot,
           CASE WHEN month(ANY_VALUE(obs_date)) <= 6 THEN 1 ELSE 2 END AS run
    FROM daily_obs GROUP BY 1""")
def _(i: Inputs):
    """Months up to June in one run, then all: the second run writes the others alone; both outputs read back."""
    path = new_path(i.spark, "increments")
    daily = i.daily_obs().select(F.trunc("obs_date", "month").alias("month"), "station_id", "tx")
    outputs = {"all": lambda df: df, "hot": lambda df: df.where("tx >= 30")}
    writer = IncrementalWriter(i.spark, path, ["month"], outputs)
    writer.write(daily.where(F.month("month") <= 6))
    writer.write(daily)
    ledger = i.spark.read.parquet(f"{path}/_ledger").groupBy("month").agg(F.max("run").cast("int").alias("run"))

    def rows(name: str, count: str):
        return i.spark.read.schema(daily.schema).parquet(f"{path}/{name}").groupBy("month").agg(F.count("*").alias(count))

    return ledger.join(rows("all", "n"), "month").join(rows("hot", "n_hot"), "month", "left").select(
        "month", "n", F.coalesce("n_hot", F.lit(0)).alias("n_hot"), "run")


@query("bounding_box", """
    SELECT MAX(lat) AS north, MIN(lon) AS west, MIN(lat) AS south, MAX(lon) AS east FROM stations""")
def _(i: Inputs):
    return grid.bounding_box(i.stations())
