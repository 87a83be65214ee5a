"""Station, series and score tables derived from the given tables.

Every input exists twice: as a DataFrame method and as SQL text that a query's SQL
may reference by name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heatframe.operators.series import Series, densify

DAILY = Series(("station_id",), "obs_date", "day")
CITY_DAILY = Series(("city",), "obs_date", "day")
HOURLY = Series(("city",), "ts", "hour", dense=True)
HOURLY_VARS = [
    "temperature_2m", "pressure_msl", "relative_humidity_2m", "wind_speed_10m",
    "t_850hPa", "v_850hPa", "t_500hPa", "soil_moisture",
]
USERS_PER_CITY = 150  # more users make more cities, so hours grow with the scale

CTES = {
    "daily_obs": """
        SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS obs_date,
               MAX(l_extendedprice) / 2500.0 AS tx, MAX(l_quantity) AS wind_mean,
               MAX(CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END) AS wind_gust
        FROM lineitem GROUP BY 1, 2""",
    "stations": """
        SELECT s_suppkey AS station_id, s_name AS station_name, r_name AS city,
               CAST(43 + s_suppkey % 7 AS DOUBLE) AS lat, CAST(-1 + s_suppkey % 9 AS DOUBLE) AS lon
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "station_daily": """
        SELECT d.*, s.station_name, s.city, s.lat, s.lon FROM daily_obs d JOIN stations s USING (station_id)""",
    "region_daily": """
        SELECT r_name AS city, CAST(o_orderdate AS DATE) AS obs_date, MAX(o_totalprice) / 12500.0 AS tx
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "hourly_sparse": """
        SELECT CASE WHEN user_id < 150 THEN event_type ELSE event_type || '_' || (user_id // 150) END AS city,
               date_trunc('hour', ts) AS ts, MAX(value) AS temperature_2m,
               round(AVG(value) + 1.3e-8, 6) AS pressure_msl,
               MAX(CAST(json_extract_string(props, '$.k') AS INT)) AS relative_humidity_2m,
               COUNT(*) AS wind_speed_10m, round(273.15 + MIN(value) / 10, 3) AS "t_850hPa",
               round(AVG(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END) + 1.3e-8, 6) AS "v_850hPa",
               250.0 + MAX(user_id % 50) / 5.0 AS "t_500hPa",
               MIN(CAST(json_extract_string(props, '$.k') AS INT)) / 100.0 AS soil_moisture
        FROM events GROUP BY 1, 2""",
    "hourly_obs": """
        SELECT g.city, g.ts, h.* EXCLUDE (city, ts)
        FROM (SELECT city, unnest(generate_series(MIN(ts), MAX(ts), INTERVAL 1 HOUR)) AS ts FROM hourly_sparse GROUP BY city) g
        LEFT JOIN hourly_sparse h ON h.city = g.city AND h.ts = g.ts""",
    "hourly_gaps": """
        SELECT * REPLACE (CASE WHEN hour(ts) % 7 <> 3 THEN soil_moisture END AS soil_moisture,
                          CASE WHEN day(ts) % 5 <> 2 THEN "t_500hPa" END AS "t_500hPa",
                          CASE WHEN hour(ts) % 4 <> 1 THEN relative_humidity_2m END AS relative_humidity_2m)
        FROM hourly_obs""",
    "scored": """
        SELECT l.doc_id, d.lang AS city, l.quality AS y,
               round(((l.doc_id * 7919) % 1000) / 1000.0 * 0.6 + l.quality * 0.3, 6) AS prob,
               CAST(CASE WHEN round(((l.doc_id * 7919) % 1000) / 1000.0 * 0.6 + l.quality * 0.3, 6) >= 0.5
                    THEN 1 ELSE 0 END AS INT) AS pred,
               l.toxic, d.n_chars
        FROM labels l JOIN documents d USING (doc_id)""",
}


def with_inputs(sql: str) -> str:
    """Prepends the inputs a statement names, dependencies first."""
    order: list[str] = []

    def need(text: str) -> None:
        for name, body in CTES.items():
            if name not in order and re.search(rf"\b{name}\b", text):
                need(body)
                order.append(name)

    need(sql)
    if not order:
        return sql
    ctes = ",\n".join(f"{name} AS ({CTES[name]})" for name in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    return f"WITH {ctes},\n{body[len('WITH'):]}" if body.upper().startswith("WITH") else f"WITH {ctes}\n{body}"


SCHEMAS: dict[str, StructType] = {}


class Inputs:
    """The given tables of one scale and the tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        """A given table; its schema is read from the file footer once per path."""
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in SCHEMAS:
            SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(SCHEMAS[path]).parquet(path)

    def daily_obs(self) -> DataFrame:
        gust = F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity"))
        return (
            self.table("lineitem")
            .groupBy(F.col("l_suppkey").alias("station_id"), F.col("l_shipdate").cast("date").alias("obs_date"))
            .agg(
                (F.max("l_extendedprice") / 2500.0).alias("tx"),
                F.max("l_quantity").alias("wind_mean"),
                F.max(gust).alias("wind_gust"),
            )
        )

    def places(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")

    def stations(self) -> DataFrame:
        supplier = self.table("supplier")
        key = F.col("s_suppkey")
        return supplier.join(self.places(), F.col("s_nationkey") == F.col("n_nationkey")).select(
            key.alias("station_id"),
            F.col("s_name").alias("station_name"),
            F.col("r_name").alias("city"),
            (43 + key % 7).cast("double").alias("lat"),
            (-1 + key % 9).cast("double").alias("lon"),
        )

    def station_daily(self) -> DataFrame:
        return self.daily_obs().join(self.stations(), "station_id")

    def region_daily(self) -> DataFrame:
        customer = self.table("customer").join(self.places(), F.col("c_nationkey") == F.col("n_nationkey"))
        return (
            self.table("orders")
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("r_name").alias("city"), F.col("o_orderdate").cast("date").alias("obs_date"))
            .agg((F.max("o_totalprice") / 12500.0).alias("tx"))
        )

    def hourly_sparse(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        signed = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))
        bucket = F.floor(F.col("user_id") / USERS_PER_CITY).cast("string")
        city = F.when(F.col("user_id") < USERS_PER_CITY, F.col("event_type")).otherwise(F.concat_ws("_", "event_type", bucket))
        return (
            self.table("events")
            .groupBy(city.alias("city"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
            .agg(
                F.max("value").alias("temperature_2m"),
                F.round(F.avg("value") + 1.3e-8, 6).alias("pressure_msl"),
                F.max(k).alias("relative_humidity_2m"),
                F.count("*").alias("wind_speed_10m"),
                F.round(273.15 + F.min("value") / 10, 3).alias("t_850hPa"),
                F.round(F.avg(signed) + 1.3e-8, 6).alias("v_850hPa"),
                (250.0 + F.max(F.col("user_id") % 50) / 5.0).alias("t_500hPa"),
                (F.min(k) / 100.0).alias("soil_moisture"),
            )
        )

    def hourly_obs(self) -> DataFrame:
        return densify(self.hourly_sparse(), HOURLY)

    def hourly_gaps(self) -> DataFrame:
        """The hours with variables that are missing at different times."""
        ts = F.col("ts")
        kept = {
            "soil_moisture": F.hour(ts) % 7 != 3, "t_500hPa": F.dayofmonth(ts) % 5 != 2,
            "relative_humidity_2m": F.hour(ts) % 4 != 1,
        }
        return self.hourly_obs().withColumns({c: F.when(there, F.col(c)) for c, there in kept.items()})

    def scored(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "lang", "n_chars")
        prob = F.round(((F.col("doc_id") * 7919) % 1000) / 1000.0 * 0.6 + F.col("quality") * 0.3, 6)
        return (
            self.table("labels")
            .join(docs, "doc_id")
            .select(
                "doc_id", F.col("lang").alias("city"), F.col("quality").alias("y"), prob.alias("prob"),
                (prob >= 0.5).cast("int").alias("pred"), "toxic", "n_chars",
            )
        )
