"""Exact ranks of values inside groups of any size.

A group may hold a third of all rows, so its values are not sorted in one task. Equal values are
counted first; every group of more than a bin's rows is cut at many quantiles of a sketch, and between
two of them evenly; each bin is ranked on its own and shifted by the counts of the bins below. The
bins only balance the work: the ranks are exact whatever the bins are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BIN = 200_000
# Quantiles a group is cut at; a power of two, for the search by halving.
CUTS = 256


def ranked_values(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    rows_per_bin: int = ROWS_PER_BIN,
    attach: DataFrame | None = None,
) -> DataFrame:
    """Rows ``(keys, value, copies, below, n)``: how often a value occurs, how many lie below it,
    and the group size. Null and NaN values are missing and left out; null keys form groups.

    ``attach`` has one row per group; its other columns are added to every row of the group (null
    where it has none).

    Two exchanges move the values: by (keys, value) to count copies, by (keys, bin) to rank. Group
    layouts, bin offsets and attached columns come in by tables of one row per group or bin.
    """
    keys = list(keys)
    # Structs compare null fields as equal, so rows of a null key find their group.
    counted = (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(F.struct(*keys).alias("_key"), value)
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    layout = _layout(counted, value, rows_per_bin)
    binned = counted.join(layout, "_key", "left").select(
        "_key", value, "copies", F.coalesce(_bin(value), F.lit(0).cast("bigint")).alias("_bin")
    )
    group = Window.partitionBy("_key")
    lower_bins = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        binned.groupBy("_key", "_bin")
        .agg(F.sum("copies").alias("_rows"))
        .select(
            "_key",
            "_bin",
            F.coalesce(F.sum("_rows").over(lower_bins), F.lit(0)).alias("_offset"),
            F.sum("_rows").over(group).alias("n"),
        )
    )
    extra = []
    if attach is not None:
        extra = [c for c in attach.columns if c not in keys]
        bins = bins.join(attach.select(F.struct(*keys).alias("_key"), *extra), "_key", "left")
    inside = (
        Window.partitionBy("_key", "_bin")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        binned.withColumn("_inside", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .join(bins.hint("shuffle_hash"), ["_key", "_bin"])
        .select(
            *[F.col(f"_key.{k}").alias(k) for k in keys],
            value,
            "copies",
            (F.col("_inside") + F.col("_offset")).alias("below"),
            "n",
            *extra,
        )
    )


def _layout(counted: DataFrame, value: str, rows_per_bin: int) -> DataFrame:
    """Quantiles of every group with more than a bin's rows, and bins between two of them.

    It reads every column of ``counted``, so that the optimizer reuses that exchange as it is.
    """
    shares = [i / CUTS for i in range(CUTS + 1)]
    return (
        counted.groupBy("_key")
        .agg(
            F.sum("copies").alias("_n"),
            F.count(F.lit(1)).alias("_values"),
            F.percentile_approx(F.col(value).cast("double"), shares, 10 * CUTS).alias("_cuts"),
        )
        .where(F.col("_n") > rows_per_bin)
        .select("_key", "_cuts", F.ceil(F.col("_values") / (CUTS * rows_per_bin)).alias("_parts"))
    )


def _bin(value: str) -> Column:
    """Bin of a value: the last quantile at or below it, found by halving, and the part after it."""
    spot, cut = F.col(value).cast("double"), F.col("_cuts")
    halves = F.array(*[F.lit(CUTS >> i) for i in range(1, CUTS.bit_length())])
    at = F.aggregate(
        halves, F.lit(0), lambda i, half: F.when(F.get(cut, i + half) <= spot, i + half).otherwise(i)
    )
    low, high = F.get(cut, at), F.get(cut, at + 1)
    part = F.floor((spot - low) / (high - low) * F.col("_parts"))
    part = F.when(high > low, F.greatest(F.lit(0), F.least(part, F.col("_parts") - 1))).otherwise(0)
    return at * F.col("_parts") + part


def quantile_columns(value: str, probabilities: dict[str, float]) -> list:
    """Aggregates over :func:`ranked_values` rows: quantiles interpolated at ``(n - 1) p``."""
    out = []
    for name, p in probabilities.items():
        spot = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.floor(spot), F.ceil(spot)

        def at(rank):
            holds = (F.col("below") <= rank) & (rank < F.col("below") + F.col("copies"))
            return F.max(F.when(holds, F.col(value)))

        part = F.max(spot - low)
        out.append((at(low) + (at(high) - at(low)) * part).alias(name))
    return out


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    rows_per_bin: int = ROWS_PER_BIN,
) -> DataFrame:
    """Exact quantiles per group without holding a group in one task."""
    ranked = ranked_values(df, keys, value, rows_per_bin)
    return ranked.groupBy(*keys).agg(*quantile_columns(value, probabilities))
