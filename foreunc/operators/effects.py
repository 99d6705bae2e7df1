"""Sources of uncertainty between and beside series: random effects, and errors of observation.

Series differ: the variance of a coefficient between series is what its estimates vary beyond their own
sampling variance (method of moments, one row per series). Observations err: a fit's residual variance
is split into process and observation error by the likelihood of a linear-Gaussian filter on a grid
of ratios. The filter's steps compose, so a long series is cut into blocks of dates: each block is
condensed by itself, the few blocks of a series hand on their state, and each is read once more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foreunc.operators.propagate import steps_between

#: Dates of a block.
DATES = 512
#: Shares of the observation error in the residual variance that are tried.
RATIOS = tuple(k / 10 for k in range(10))
#: Least value of 1 - ar1^2, which the variance before the first date is taken from.
STATIONARY = 1e-3


# -- random effects --------------------------------------------------------------------------------


def _terms(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, term, coef, variance), a row per coefficient of a fitted series."""
    entry = F.arrays_zip("names", "coef", F.transform("vcov", lambda row, i: row[i]).alias("variance"))
    rows = fits.where("coef IS NOT NULL").select(*keys, F.explode(entry).alias("t"))
    return rows.select(*keys, F.col("t.names").alias("term"), F.col("t.coef").alias("coef"), F.col("t")["variance"].alias("variance"))


def effect_variances(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(term, n_series, mean, between, within): how a coefficient varies between series.

    ``within`` is the mean sampling variance, ``between`` what the estimates vary beyond it, at least 0
    (0 for a single series). Series without a fit, and terms a fit lacks, don't count.
    """
    found = _terms(fits, keys).groupBy("term").agg(
        F.count("coef").alias("n_series"), F.avg("coef").alias("mean"),
        F.var_samp("coef").alias("_all"), F.avg("variance").alias("within"),
    )
    between = F.greatest(F.coalesce(F.col("_all"), F.lit(0.0)) - F.col("within"), F.lit(0.0))
    return found.select("term", "n_series", "mean", between.alias("between"), "within")


def shrunken_coefficients(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, term, coef, shrunken, se): each estimate drawn towards the mean of all series.

    The weight of the estimate is the share of the variance between series in that and its own; ``se``
    belongs to the shrunken value. The variances are a row per term, which the planner broadcasts.
    """
    weight = F.coalesce(F.try_divide(F.col("between"), F.col("between") + F.col("variance")), F.lit(1.0))
    return (
        _terms(fits, keys)
        .join(F.broadcast(effect_variances(fits, keys)), "term")
        .select(
            *keys, "term", "coef",
            (F.col("mean") + weight * (F.col("coef") - F.col("mean"))).alias("shrunken"),
            F.sqrt(weight * F.col("variance")).alias("se"),
        )
    )


# -- process and observation error -----------------------------------------------------------------


def step_elements(y, drift, rho, ratios):
    """Filter step of a date for rows x ratios, as (A, b, C, eta, J); ``y`` nan: nothing observed.

    Unit scale: the process error has variance 1 - ratio, the observation error the ratio.
    """
    q, r = 1.0 - ratios, ratios
    f, u, e = rho[:, None], drift[:, None], (y - drift)[:, None]
    total = q + r
    gain = q / total
    seen = ~np.isnan(e)
    e = np.where(seen, e, 0.0)
    return (
        np.where(seen, (1 - gain) * f, f), np.where(seen, u + gain * e, u), np.where(seen, (1 - gain) * q, q),
        np.where(seen, f * e / total, 0.0), np.where(seen, f * f / total, 0.0),
    )


def composed(first, second):
    """The two filter steps one after the other; this is associative."""
    a1, b1, c1, n1, j1 = first
    a2, b2, c2, n2, j2 = second
    d = 1.0 + c1 * j2
    return (
        a2 * a1 / d, a2 * (b1 + c1 * n2) / d + b2, a2 * a2 * c1 / d + c2, a1 * (n2 - j2 * b1) / d + n1, a1 * a1 * j2 / d + j1,
    )


def block_elements(y: np.ndarray, drift: np.ndarray, inside: np.ndarray, rho: np.ndarray, ratios: np.ndarray):
    """All dates of each block (rows of ``y``) as one step; dates not ``inside`` the series change nothing."""
    shape = (len(y), len(ratios))
    total = (np.ones(shape), np.zeros(shape), np.zeros(shape), np.zeros(shape), np.zeros(shape))
    for t in range(y.shape[1]):
        new = composed(total, step_elements(y[:, t], drift[:, t], rho, ratios))
        total = tuple(np.where(inside[:, t, None], n, o) for n, o in zip(new, total))
    return total


def filtered(y, drift, inside, rho, ratios, mean, variance):
    """Sums over each block's observations: their number, squared standardised errors, log variances."""
    n, squares, logs = (np.zeros(mean.shape) for _ in range(3))
    q, r = 1.0 - ratios, ratios
    for t in range(y.shape[1]):
        ahead = rho[:, None] * mean + drift[:, t, None]
        spread = rho[:, None] ** 2 * variance + q
        here = inside[:, t, None] & np.ones(mean.shape, dtype=bool)
        seen = here & ~np.isnan(y[:, t])[:, None]
        e, s = np.where(seen, y[:, t, None] - ahead, 0.0), spread + r
        gain = np.where(seen, spread / s, 0.0)
        n += seen
        squares += np.where(seen, e * e / s, 0.0)
        logs += np.where(seen, np.log(s), 0.0)
        mean = np.where(here, ahead + gain * e, mean)
        variance = np.where(here, (1 - gain) * spread, variance)
    return n, squares, logs


def error_split(
    observed: DataFrame,
    fits: DataFrame,
    keys: Sequence[str],
    y: str,
    covariates: Sequence[str],
    ratios: Sequence[float] = RATIOS,
    time: str = "datetime",
    step: str = "day",
) -> DataFrame:
    """(keys, n, ratio, process_sigma2, observation_sigma2, log_likelihood) of every series of at most one lag.

    ``ratio`` is the share of ``ratios`` of greatest likelihood, the least of equal ones; the scale follows
    from the standardised errors. The state is y less the intercept, with the fit's ``ar1`` and slopes;
    dates without a row or value are stepped over, a missing covariate counts as its mean. Two rows of a
    date are an error; series without a fit or observation have no row.
    """
    keys, covariates, grid = list(keys), list(covariates), np.array(ratios, dtype=float)
    coefficient = F.map_from_arrays("names", "coef")
    known = fits.where("coef IS NOT NULL").select(
        *keys, F.coalesce(coefficient["ar1"], F.lit(0.0)).alias("_rho"), coefficient["intercept"].alias("_c"),
        *[F.coalesce(coefficient[f"b_{v}"], F.lit(0.0)).alias(f"_b{i}") for i, v in enumerate(covariates)],
    )
    epoch = F.lit("1970-01-01").cast("date")
    rows = observed.select(
        *keys, steps_between(F.col(time), epoch, step).alias("_t"), F.col(y).cast("double").alias("_y"),
        *[F.col(v).cast("double").alias(f"_x{i}") for i, v in enumerate(covariates)],
    )
    series = rows.groupBy(*keys).agg(
        F.min("_t").alias("_first"), F.max("_t").alias("_last"),
        *[F.avg(f"_x{i}").alias(f"_m{i}") for i in range(len(covariates))],
    ).join(known, keys)
    entry = F.struct("_t", "_y", *[f"_x{i}" for i in range(len(covariates))])
    gathered = rows.groupBy(*keys, F.floor(F.col("_t") / DATES).alias("_block")).agg(F.collect_list(entry).alias("_rows"))
    whole = F.sequence(F.floor(F.col("_first") / DATES), F.floor(F.col("_last") / DATES))
    blocks = series.withColumn("_block", F.explode(whole)).join(gathered, [*keys, "_block"], "left")
    size = len(covariates)

    def read(batch: pa.RecordBatch):
        table = batch.to_pylist()
        shape = (len(table), DATES)
        values, drift, inside = np.full(shape, np.nan), np.zeros(shape), np.zeros(shape, dtype=bool)
        for i, r in enumerate(table):
            places = np.arange(DATES) + r["_block"] * DATES
            inside[i] = (places >= r["_first"]) & (places <= r["_last"])
            means = [r[f"_m{k}"] or 0.0 for k in range(size)]
            drift[i] = sum(r[f"_b{k}"] * means[k] for k in range(size))
            seen = set()
            for row in r["_rows"] or []:
                at = row["_t"] - r["_block"] * DATES
                if at in seen:
                    raise ValueError("a series has two rows of one date")
                seen.add(at)
                xs = [means[k] if row[f"_x{k}"] is None else row[f"_x{k}"] for k in range(size)]
                drift[i, at] = sum(r[f"_b{k}"] * xs[k] for k in range(size))
                values[i, at] = np.nan if row["_y"] is None else row["_y"] - r["_c"]
        return values, drift, inside, np.array([r["_rho"] for r in table])

    fields = [T.StructField(k, rows.schema[k].dataType) for k in keys]
    numbers = T.ArrayType(T.DoubleType())
    parts = ("a", "b", "c", "eta", "j")
    element_schema = T.StructType(
        [*fields, T.StructField("_block", T.LongType()), T.StructField("_rho", T.DoubleType()), *[T.StructField(p, numbers) for p in parts]]
    )

    def condense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values, drift, inside, rho = read(batch)
                found = block_elements(values, drift, inside, rho, grid)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in [*keys, "_block", "_rho"]), *(pa.array(list(v)) for v in found)],
                    names=element_schema.names,
                )

    start_schema = T.StructType(
        [*fields, T.StructField("_block", T.LongType()), T.StructField("_mean", numbers), T.StructField("_variance", numbers)]
    )

    def hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r in enumerate(batch.to_pylist()):
                rho = r["_rho"]
                before = (0.0, np.zeros(len(grid)), (1.0 - grid) / max(1.0 - rho * rho, STATIONARY), 0.0, 0.0)
                found = []
                for part in r["_parts"]:
                    found.append((part["_block"], before[1].tolist(), before[2].tolist()))
                    before = composed(before, tuple(np.array(part[p]) for p in parts))
                again = pa.array(np.full(len(found), i))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(again) for k in keys), *(pa.array(c) for c in zip(*found, strict=True))],
                    names=start_schema.names,
                )

    sum_schema = T.StructType(
        [*fields, T.StructField("pos", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("n", "squares", "logs")]]
    )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values, drift, inside, rho = read(batch)
                mean, variance = (np.stack(batch.column(c).to_pandas().to_numpy()) for c in ("_mean", "_variance"))
                found = filtered(values, drift, inside, rho, grid, mean, variance)
                again = pa.array(np.repeat(np.arange(batch.num_rows), len(grid)))
                place = pa.array(np.tile(np.arange(len(grid), dtype=np.int32), batch.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(again) for k in keys), place, *(pa.array(v.ravel()) for v in found)],
                    names=sum_schema.names,
                )

    elements = blocks.mapInArrow(condense, element_schema)
    # A series has a row per DATES dates here.
    listed = F.array_sort(F.collect_list(F.struct("_block", *parts))).alias("_parts")
    starts = elements.groupBy(*keys).agg(F.first("_rho").alias("_rho"), listed).mapInArrow(hand_on, start_schema)
    totals = (
        blocks.join(starts, [*keys, "_block"]).mapInArrow(sums, sum_schema).groupBy(*keys, "pos")
        .agg(*[F.sum(c).alias(c) for c in ("n", "squares", "logs")])
    )
    scale = F.col("squares") / F.col("n")
    likelihood = -0.5 * (F.col("n") * (F.log(scale) + 1.0 + F.lit(float(np.log(2 * np.pi)))) + F.col("logs"))
    rated = totals.where("n > 0").select(
        *keys, "pos", "n", scale.alias("_scale"), likelihood.alias("log_likelihood")
    )
    best = rated.groupBy(*keys).agg(F.max(F.struct("log_likelihood", (-F.col("pos")).alias("_p"), "n", "_scale")).alias("_best"))
    ratio = F.element_at(F.array(*[F.lit(float(v)) for v in grid]), 1 - F.col("_best._p"))
    return best.select(
        *keys, F.col("_best.n").cast("bigint").alias("n"), ratio.alias("ratio"),
        (F.col("_best._scale") * (1.0 - ratio)).alias("process_sigma2"), (F.col("_best._scale") * ratio).alias("observation_sigma2"),
        F.col("_best.log_likelihood").alias("log_likelihood"),
    )
