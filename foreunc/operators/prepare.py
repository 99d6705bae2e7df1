"""Table preparation: filters, reshaping, joins and daily time grids."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foreunc.functions.scalar import strict_mean, strict_mean_where, theme_flag

# -- names, columns, filters ---------------------------------------------------------------------


def harmonise_names(df: DataFrame) -> DataFrame:
    """Older target files say ``siteID`` and ``time``; rename them where present."""
    renames = {"siteID": "site_id", "time": "datetime"}
    return df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Select by list; a name given twice is kept once."""
    return df.select(*dict.fromkeys(names))


def any_flag(df: DataFrame, pattern: str, value: int = 1) -> DataFrame:
    """Rows where any column whose name matches ``pattern`` (case ignored) equals ``value``."""
    names = [c for c in df.columns if re.search(pattern, c, re.IGNORECASE)]
    if not names:
        raise ValueError(f"no column matches {pattern!r}")
    return df.where(reduce(lambda a, b: a | b, [F.col(c) == value for c in names]))


def sites_of_theme(metadata: DataFrame, theme: str, key: str = "field_site_id") -> DataFrame:
    """Site ids whose theme flag is set."""
    return metadata.where(F.col(theme_flag(theme)) == 1).select(F.col(key).alias("site_id"))


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct().orderBy(*keys)


def history(df: DataFrame, day, time: str = "datetime") -> DataFrame:
    return df.where(F.col(time) < _day(day))


def future(df: DataFrame, day, time: str = "datetime") -> DataFrame:
    return df.where(F.col(time) >= _day(day))


def evaluation_window(df: DataFrame, day, horizon: int, time: str = "datetime") -> DataFrame:
    """Forecast date to forecast date + horizon + 1, both included."""
    return df.where(F.col(time).between(_day(day), F.date_add(_day(day), horizon + 1)))


def complete_cases(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset else None)


def _day(day) -> Column:
    return day if isinstance(day, Column) else F.lit(day).cast("date")


# -- aggregation and reshape ---------------------------------------------------------------------


def daily_mean(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "prediction",
    time: str = "datetime",
    strict: bool = True,
) -> DataFrame:
    """Mean per day and ``keys``; ``strict`` turns a day with a missing value into null."""
    day = F.to_date(time).alias(time)
    mean = strict_mean(value) if strict else F.avg(value)
    return df.groupBy(day, *keys).agg(mean.alias(value))


def widen(
    df: DataFrame,
    keys: Sequence[str],
    names: Sequence[str],
    name: str = "variable",
    value: str = "prediction",
    prefix: str = "",
) -> DataFrame:
    """Long to wide with the columns given, in one shuffle. Two values for a cell are an error."""

    def cell(n):
        hit = F.col(name) == n
        return (
            F.when(F.count_if(hit) > 1, F.raise_error(F.lit(f"more than one value for {n}")))
            .otherwise(F.max(F.when(hit, F.col(value))))
            .alias(prefix + n)
        )

    names = list(dict.fromkeys(names))
    return df.where(F.col(name).isin(names)).groupBy(*keys).agg(*[cell(n) for n in names])


def daily_wide(
    df: DataFrame,
    keys: Sequence[str],
    names: Sequence[str],
    name: str = "variable",
    value: str = "prediction",
    time: str = "datetime",
    strict: bool = True,
) -> DataFrame:
    """:func:`daily_mean` and :func:`widen` together: one aggregation, hence one shuffle."""
    names = list(dict.fromkeys(names))
    mean = strict_mean_where if strict else (lambda hit, x: F.avg(F.when(hit, F.col(x))))
    return (
        df.where(F.col(name).isin(names))
        .groupBy(F.to_date(time).alias(time), *keys)
        .agg(*[mean(F.col(name) == n, value).alias(n) for n in names])
    )


def freeze_at_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace columns by their whole-table mean (scalar subqueries over one aggregate)."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns])
    return df.withColumns({c: means.select(c).scalar() for c in columns})


# -- joins ---------------------------------------------------------------------------------------


def attach_history(targets: DataFrame, drivers: DataFrame) -> DataFrame:
    """Targets left-joined to driver history by day and site; one row per ensemble member."""
    return targets.join(drivers, ["datetime", "site_id"], "left")


def attach_targets(targets: DataFrame, drivers: DataFrame) -> DataFrame:
    """Every driver day kept, targets where there are any; also by site when both have it."""
    on = ["datetime"] + (["site_id"] if "site_id" in drivers.columns else [])
    return targets.join(drivers, on, "right")


def active_only(df: DataFrame, sites: DataFrame) -> DataFrame:
    return df.join(sites.select("site_id").distinct(), "site_id", "left_semi")


# -- time grid -----------------------------------------------------------------------------------


def complete_grid(
    df: DataFrame, keys: Sequence[str] = ("site_id",), time: str = "datetime", step: int = 1
) -> DataFrame:
    """Every ``step``-th day from the table's first to its last, for every key; gaps are null."""
    bounds = df.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    days = F.sequence(
        bounds.select("lo").scalar(), bounds.select("hi").scalar(), F.make_dt_interval(F.lit(step))
    )
    grid = df.select(*keys).distinct().withColumn(time, F.explode(days))
    return grid.join(df, [*keys, time], "left")


def effective_horizon(
    df: DataFrame, forecast_date, horizon: int, keys: Sequence[str] = (), time: str = "datetime"
) -> DataFrame:
    """Days from the last observation to the end of the forecast."""
    last = F.max(time)
    return df.groupBy(*keys).agg(
        last.alias("last_date"),
        (F.datediff(_day(forecast_date), last) + F.lit(horizon)).alias("h"),
    )


def issue_date(forecast_date) -> Column:
    """Drivers are those issued the day before the forecast."""
    return F.date_sub(_day(forecast_date), 1)


def first_n(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First ``n`` rows per key by ``order``.

    The rank is bounded, so Spark trims each partition to ``n`` rows per key before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


# -- guards --------------------------------------------------------------------------------------


def target_status(
    df: DataFrame, target: str, driver: str = "air_temperature", keys: Sequence[str] = ("site_id",)
) -> DataFrame:
    """Can a model be fitted: ``ok``, ``no_target`` or ``no_overlap``; are there negatives?"""
    has_target = F.col(target).isNotNull()
    both = has_target & F.col(driver).isNotNull()
    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(has_target).alias("n_target"),
            F.count_if(both).alias("n_overlap"),
            F.count_if(F.col(target) < 0).alias("n_negative"),
        )
        .withColumn(
            "status",
            F.when(F.col("n_target") == 0, "no_target")
            .when(F.col("n_overlap") == 0, "no_overlap")
            .otherwise("ok"),
        )
        .withColumn("has_negative", F.col("n_negative") > 0)
    )


# -- union ---------------------------------------------------------------------------------------


def append_complete(*tables: DataFrame | None) -> DataFrame:
    """Append by column name, skip absent results, drop incomplete rows."""
    present = [t for t in tables if t is not None]
    if not present:
        raise ValueError("nothing to append")
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)
    return joined.na.drop("any")


def union_registered(spark: SparkSession, suffix: str = "_mod_summaries") -> DataFrame:
    """Union of every table or view whose name ends in ``suffix``."""
    listed = spark.catalog.listTables(pattern=f"*{suffix}")
    names = sorted(t.name for t in listed if t.name.endswith(suffix))
    if not names:
        raise ValueError(f"no table named *{suffix}")
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.table(n) for n in names]
    )


def order_inputs(df: DataFrame, rename: dict[str, str], last: str, column: str = "input"):
    """Recode input labels and give a sort position that puts ``last`` (its old label) at the end."""
    label = F.col(column)
    for old, new in rename.items():
        label = F.when(F.col(column) == old, F.lit(new)).otherwise(label)
    position = F.when(F.col(column) == last, 1).otherwise(0)
    return df.withColumns({column: label, "input_order": position})
