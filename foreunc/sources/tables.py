"""Readers and writers for targets, site metadata, driver ensembles, caches, reports and models.

All roots are paths (local, HDFS or object store through the Hadoop connectors); schemas are fixed,
nothing is inferred from data, and every filter reaches the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The themes a target table exists for.
THEMES = (
    "aquatics",
    "beetles",
    "phenology",
    "terrestrial_30min",
    "terrestrial_daily",
    "ticks",
)

TARGET_SCHEMA = T.StructType(
    [
        T.StructField("datetime", T.DateType()),
        T.StructField("site_id", T.StringType()),
        T.StructField("variable", T.StringType()),
        T.StructField("observation", T.DoubleType()),
    ]
)

DRIVER_SCHEMA = T.StructType(
    [
        T.StructField("site_id", T.StringType()),
        T.StructField("datetime", T.TimestampNTZType()),
        T.StructField("variable", T.StringType()),
        T.StructField("parameter", T.IntegerType()),
        T.StructField("prediction", T.DoubleType()),
    ]
)


def check_theme(theme: str) -> str:
    if theme not in THEMES:
        raise ValueError(f"unknown theme {theme!r}; expected one of {', '.join(THEMES)}")
    return theme


def targets_path(root: str, theme: str) -> str:
    return f"{root.rstrip('/')}/{check_theme(theme)}/{theme}-targets.csv.gz"


def target_schema(theme: str) -> T.StructType:
    """Column types of a theme: dates, or times of the day where the theme is half-hourly."""
    if check_theme(theme) != "terrestrial_30min":
        return TARGET_SCHEMA
    return T.StructType([T.StructField("datetime", T.TimestampNTZType()), *TARGET_SCHEMA.fields[1:]])


def read_targets(
    spark: SparkSession,
    root: str,
    theme: str,
    sites: Sequence[str] | None = None,
    malformed: str = "null",
) -> DataFrame:
    """Observations of a theme, columns taken by header name with the fixed types.

    A cell that doesn't parse becomes null, with ``malformed="fail"`` an error; a date in a half-hourly
    theme is its midnight. ``NA`` is a missing value. A gzip file is read by one task whatever its size; convert big targets once with
    :func:`read_or_build` and read Parquet from then on.
    """
    path = targets_path(root, theme)
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    renames = {"siteID": "site_id", "time": "datetime"}
    raw = raw.withColumnsRenamed({k: v for k, v in renames.items() if k in raw.columns})
    if malformed not in ("null", "fail"):
        raise ValueError("malformed is 'null' or 'fail'")

    def typed_cell(field: T.StructField):
        given = F.when(F.col(field.name) != "NA", F.col(field.name))
        parsed = given.try_cast(field.dataType)
        if malformed == "fail":
            message = F.concat(F.lit(f"{field.name} doesn't parse: "), given)
            broken = F.raise_error(message).cast(field.dataType)
            parsed = F.when(given.isNotNull() & parsed.isNull(), broken).otherwise(parsed)
        return parsed.alias(field.name)

    typed = raw.select(*[typed_cell(f) for f in target_schema(theme).fields])
    return typed.where(F.col("site_id").isin(list(sites))) if sites else typed


def read_site_metadata(
    spark: SparkSession, path: str, flags: Sequence[str], key: str = "field_site_id"
) -> DataFrame:
    """One row per site with its 0/1 theme flags."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        F.col(key), *[F.col(flag).try_cast("int").alias(flag) for flag in flags]
    )


def read_driver_forecast(
    spark: SparkSession,
    root: str,
    reference_date: str,
    sites: Sequence[str] | None = None,
    variables: Sequence[str] | None = None,
    start: str | None = None,
) -> DataFrame:
    """Ensemble of one issue date: the path prunes the date, the rest is pushed to the scan."""
    df = spark.read.schema(DRIVER_SCHEMA).parquet(f"{root.rstrip('/')}/{reference_date}")
    return _restrict(df, sites, variables, F.col("datetime") >= F.lit(start) if start else None)


def read_driver_history(
    spark: SparkSession,
    root: str,
    sites: Sequence[str] | None = None,
    variables: Sequence[str] | None = None,
    end: str | None = None,
) -> DataFrame:
    """Driver history kept as ``site_id=...`` partitions; many sites are one scan, not a loop."""
    df = spark.read.schema(DRIVER_SCHEMA).parquet(root)
    return _restrict(df, sites, variables, F.col("datetime") < F.lit(end) if end else None)


def _restrict(df, sites, variables, extra):
    if sites is not None:
        df = df.where(F.col("site_id").isin(list(sites)))
    if variables is not None:
        df = df.where(F.col("variable").isin(list(dict.fromkeys(variables))))
    return df if extra is None else df.where(extra)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(hadoop_path))


def read_or_build(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Read the Parquet table at ``path``; when no complete one is there, build and write it."""
    if not path_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def write_summary(df: DataFrame, folder: str, day: str) -> str:
    """Report of one row per trained model, as a dated CSV folder with a single part file."""
    path = f"{folder.rstrip('/')}/model_training_summaries-{day}.csv"
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def model_path(folder: str, theme: str, variable: str, day: str) -> str:
    return f"{folder.rstrip('/')}/{theme}-{variable}-trained-{day}"


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
