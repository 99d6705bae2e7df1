"""The library's input tables, derived from the test tables; Spark and DuckDB text of each.

Sites are the users of ``events``, variables its event types, members its event ids; readings
above 150 count as failed sensor readings (null), the others enter as square roots, so that means
never sit on a rounding tie. Nothing is cut down: every table is read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreunc.functions.random import Draws
from foreunc.functions.scalar import KELVIN_OFFSET
from foreunc.operators import prepare
from foreunc.operators.design import DesignSpec, spread
from foreunc.plans.ar_forecast import daily_drivers
from foreunc.session import ensure_checkpoint_dir

DRAWS = Draws(42)
FORECAST_DATE = "2024-01-16"
HORIZON = 13
STEPS = HORIZON + 1
TARGET = "purchase"
LIMIT = 150.0
DRIVER_OF = {
    "view": "air_temperature",
    "signup": "relative_humidity",
    "click": "precipitation_flux",
    "error": "surface_downwelling_shortwave_flux_in_air",
}
VARIABLES = list(DRIVER_OF.values())
USED = ["air_temperature", "relative_humidity"]
MEMBERS = 8
NAMES = ["intercept", "ar1", "b_air_temperature", "b_relative_humidity"]
MEAN = [5.5, 0.4, 0.06, 0.05]
COV = [
    [0.04, 0.001, 0.0002, 0.0001],
    [0.001, 0.0025, 0.0001, 0.0],
    [0.0002, 0.0001, 0.0004, 0.0001],
    [0.0001, 0.0, 0.0001, 0.0004],
]
IC_MEAN, IC_SD, SIGMA2 = 6.2, 0.4, 0.16


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """New folder for tables a query writes, on the storage the executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/checks-{uuid.uuid4().hex}"


def site(column: str = "user_id"):
    return F.concat(F.lit("S"), F.col(column).cast("string"))


def targets(spark: SparkSession, sf: str) -> DataFrame:
    valid = F.when(F.col("value") <= LIMIT, F.sqrt("value"))
    return (
        table(spark, sf, "events")
        .groupBy(F.to_date("ts").alias("datetime"), "user_id", "event_type")
        .agg(F.avg(valid).alias("observation"))
        .select("datetime", site().alias("site_id"), F.col("event_type").alias("variable"),
                "observation")
    )


TARGETS = f"""targets AS (
  SELECT CAST(ts AS DATE) datetime, 'S' || user_id site_id, event_type variable,
         avg(CASE WHEN value <= {LIMIT} THEN sqrt(value) END) observation
  FROM events GROUP BY 1, 2, 3)"""


def region_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Daily mean of the target over all sites."""
    valid = F.when(F.col("value") <= LIMIT, F.sqrt("value"))
    return (
        table(spark, sf, "events")
        .where(F.col("event_type") == TARGET)
        .groupBy(F.to_date("ts").alias("datetime"))
        .agg(F.avg(valid).alias("observation"))
    )


REGION_TARGETS = f"""region_targets AS (
  SELECT CAST(ts AS DATE) datetime, avg(CASE WHEN value <= {LIMIT} THEN sqrt(value) END) observation
  FROM events WHERE event_type = '{TARGET}' GROUP BY 1)"""


def driver_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Raw driver ensemble, long."""
    renamed = F.create_map(*[F.lit(x) for pair in DRIVER_OF.items() for x in pair])
    value = F.when(F.col("value") <= LIMIT, F.sqrt("value"))
    return (
        table(spark, sf, "events")
        .where(F.col("event_type").isin(list(DRIVER_OF)))
        .select(
            site().alias("site_id"),
            F.col("ts").alias("datetime"),
            renamed[F.col("event_type")].alias("variable"),
            ((F.col("event_id") % 7).cast("int") + 1).alias("parameter"),
            F.when(F.col("event_type") == "view", value + KELVIN_OFFSET)
            .otherwise(value)
            .alias("prediction"),
        )
    )


_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DRIVER_OF.items())
READINGS = f"""readings AS (
  SELECT 'S' || user_id site_id, ts datetime, CASE event_type {_CASE} END variable,
         CAST(event_id % 7 AS INT) + 1 parameter,
         CASE WHEN value > {LIMIT} THEN NULL WHEN event_type = 'view'
              THEN sqrt(value) + {KELVIN_OFFSET} ELSE sqrt(value) END prediction
  FROM events WHERE event_type IN ({", ".join(f"'{k}'" for k in DRIVER_OF)}))"""


def region_drivers(spark: SparkSession, sf: str) -> DataFrame:
    """Daily driver ensemble from the forecast date on, over all sites."""
    readings = prepare.future(driver_readings(spark, sf), FORECAST_DATE)
    return daily_drivers(readings, USED, strict=False)


REGION_DRIVERS = f"""region_drivers AS (
  SELECT CAST(datetime AS DATE) datetime, parameter,
         avg(CASE WHEN variable = 'air_temperature' THEN prediction END) - {KELVIN_OFFSET}
           air_temperature,
         avg(CASE WHEN variable = 'relative_humidity' THEN prediction END) relative_humidity
  FROM readings WHERE CAST(datetime AS DATE) >= DATE '{FORECAST_DATE}'
    AND variable IN ('air_temperature', 'relative_humidity') GROUP BY 1, 2)"""


def site_metadata(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        site("s_suppkey").alias("field_site_id"),
        (key % 2).cast("int").alias("phenology"),
        (key % 3 == 0).cast("int").alias("terrestrial"),
        (key % 5 == 0).cast("int").alias("aquatics"),
    )


METADATA = """metadata AS (
  SELECT 'S' || s_suppkey field_site_id, CAST(s_suppkey % 2 AS INT) phenology,
         CAST(s_suppkey % 3 = 0 AS INT) terrestrial, CAST(s_suppkey % 5 = 0 AS INT) aquatics
  FROM supplier)"""


def monthly_series(spark: SparkSession, sf: str) -> DataFrame:
    """One monthly series per supplier."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("series_id"),
            F.trunc(F.to_date("l_shipdate"), "month").alias("datetime"),
        )
        .agg(
            F.avg(F.sqrt("l_extendedprice")).alias("y"),
            F.avg(F.sqrt("l_quantity")).alias("x1"),
            F.avg(F.sqrt("l_discount")).alias("x2"),
        )
    )


MONTHLY = """monthly AS (
  SELECT l_suppkey series_id, CAST(date_trunc('month', l_shipdate) AS DATE) datetime,
         avg(sqrt(l_extendedprice)) y, avg(sqrt(l_quantity)) x1, avg(sqrt(l_discount)) x2
  FROM lineitem GROUP BY 1, 2)"""


#: Origin of the monthly forecasts, their horizon and the samples of each series.
ORIGIN, MONTHS, SERIES_SAMPLES = "2000-11-01", 12, 1000
FIRST_MONTH = "2000-12-01"
LINES = 7
#: Initial state, mean and sd, of a series that wasn't fitted.
MONTH_IC = (190.0, 6.0)


def monthly_drivers(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly driver ensemble that all series share: one member per line number."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.trunc(F.to_date("l_shipdate"), "month").alias("datetime"),
            F.col("l_linenumber").alias("parameter"),
        )
        .agg(F.avg(F.sqrt("l_quantity")).alias("x1"), F.avg(F.sqrt("l_discount")).alias("x2"))
    )


MONTHLY_DRIVERS = """monthly_drivers AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) datetime, l_linenumber parameter,
         avg(sqrt(l_quantity)) x1, avg(sqrt(l_discount)) x2
  FROM lineitem GROUP BY 1, 2)"""

# A recursion of three lags.
LAG_NAMES = ["ar1", "ar2", "ar3", "intercept", "b_air_temperature", "b_relative_humidity"]
LAG_MEAN = [0.4, 0.2, -0.1, 5.5, 0.06, 0.05]
LAG_COV = [
    [0.0025, -0.0004, 0.0001, 0.001, 0.0001, 0.0],
    [-0.0004, 0.0016, -0.0002, 0.0, 0.0, 0.0],
    [0.0001, -0.0002, 0.0009, 0.0, 0.0, 0.0001],
    [0.001, 0.0, 0.0, 0.04, 0.0002, 0.0001],
    [0.0001, 0.0, 0.0, 0.0002, 0.0004, 0.0001],
    [0.0, 0.0, 0.0001, 0.0001, 0.0001, 0.0004],
]
LAG_IC = {"lag2": (6.0, 0.4), "lag1": (6.3, 0.43), "dayof": (6.2, 0.45)}


def lag_spec(spark: SparkSession, sf: str) -> DesignSpec:
    rows = samples(spark, sf).agg(F.max("sample_id")).scalar()
    return DesignSpec(
        LAG_NAMES, LAG_MEAN, LAG_COV, [m for m, _ in LAG_IC.values()], [d for _, d in LAG_IC.values()],
        members=MEMBERS, sigma2=SIGMA2, noise_rows=rows, ic_names=list(LAG_IC),
    )


#: Rows drawn from each date's ensemble, and groups of users that count as a zone.
DATE_SAMPLES, ZONES = 1000, 5
#: A day that the driver ensemble is taken to lack.
GAP_DAY = "2024-01-20"


def monthly_means(spark: SparkSession, sf: str, keys: list[str]) -> DataFrame:
    """Monthly means by ``keys``: a target and three predictors."""
    month = F.trunc(F.to_date("l_shipdate"), "month").alias("datetime")
    return (
        table(spark, sf, "lineitem")
        .groupBy(month, *keys)
        .agg(
            F.avg(F.sqrt("l_extendedprice")).alias("gcc_90"),
            F.avg(F.sqrt("l_quantity")).alias("quantity"),
            F.avg(F.sqrt("l_discount")).alias("discount"),
            F.avg(F.sqrt("l_tax")).alias("tax"),
        )
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """One ensemble sample per order."""
    return spread(table(spark, sf, "orders").select((F.col("o_orderkey") + 1).alias("sample_id")))


def spec(spark: SparkSession, sf: str) -> DesignSpec:
    rows = samples(spark, sf).agg(F.max("sample_id")).scalar()
    return DesignSpec(
        NAMES, MEAN, COV, [IC_MEAN], [IC_SD], members=MEMBERS, sigma2=SIGMA2, noise_rows=rows
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and no negative zeros, for a value comparison across engines."""
    return df.withColumns(
        {
            f.name: F.round(F.col(f.name), digits) + F.lit(0.0)
            for f in df.schema.fields
            if f.dataType.simpleString() == "double"
        }
    )
