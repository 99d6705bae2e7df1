"""Forecast evaluation by lead: intervals, residuals, predictive quantiles, CRPS, skill curves.

An *ensemble* is long: ``(keys..., lead, y)``, one row per sample. Observations have one row per
``(keys..., lead)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreunc.functions.scalar import rmse
from foreunc.operators.ranking import quantile_columns, ranked_values
from foreunc.session import materialised

# The 95 % interval and the median.
INTERVAL = {"q025": 0.025, "q500": 0.5, "q975": 0.975}


def observations_by_lead(
    obs: DataFrame, forecast_date, horizon: int, keys: Sequence[str] = (), value: str = "observation"
) -> DataFrame:
    """Observations of the evaluation window with ``lead = date - forecast date``."""
    start = F.lit(forecast_date).cast("date")
    return obs.where(F.col("datetime").between(start, F.date_add(start, horizon + 1))).select(
        *keys,
        F.datediff("datetime", start).alias("lead"),
        "datetime",
        F.col(value).alias("obs"),
    )


def with_dates(df: DataFrame, forecast_date) -> DataFrame:
    """Date a lead stands for."""
    return df.withColumn("datetime", F.date_add(F.lit(forecast_date).cast("date"), F.col("lead")))


def scores(
    ensemble: DataFrame,
    observations: DataFrame,
    keys: Sequence[str] = ("lead",),
    y: str = "y",
) -> DataFrame:
    """All scores of a forecast in one ranked pass.

    ``q025, q500, q975``; ``resid`` = median - obs; ``pit`` = share of members at or below the
    observation; ``crps`` = mean|x - obs| - mean|x - x'| / 2; ``covered`` = obs inside the interval.
    A missing observation leaves the observation-based scores null, an observation without members
    leaves all scores null. Null and NaN members don't count. Two observations of one key are an
    error.
    """
    keys = list(keys)
    known_obs = single_observations(observations, keys)
    rows = ranked_values(ensemble, keys, y, attach=known_obs)
    n, copies = F.col("n"), F.col("copies")
    # Pairwise spread from ranks; taken against the observation, which cancels in the sum.
    lever = copies * (2 * F.col("below") + copies - n)
    away = F.col(y) - F.col("obs")
    agg = rows.groupBy(*keys).agg(
        F.max("obs").alias("obs"),
        F.max("n").alias("n"),
        *quantile_columns(y, INTERVAL),
        (F.sum(F.when(F.col(y) <= F.col("obs"), copies).otherwise(0)) / F.max("n")).alias("_pit"),
        (F.sum(copies * F.abs(away)) / F.max("n")).alias("_error"),
        (F.sum(lever * away) / (F.max("n") * F.max("n").cast("double"))).alias("_half_spread"),
    )
    known = F.col("obs").isNotNull()
    scored = agg.select(
        *keys,
        "obs",
        "n",
        *INTERVAL,
        (F.col("q500") - F.col("obs")).alias("resid"),
        F.when(known, F.col("_pit")).alias("pit"),
        F.when(known, F.col("_error") - F.col("_half_spread")).alias("crps"),
        F.when(known, F.col("obs").between(F.col("q025"), F.col("q975"))).alias("covered"),
    )
    # One outer join adds the observations without members; a second look at the ranked rows would rank them again.
    every = known_obs.select(F.struct(*keys).alias("_key"), F.col("obs").alias("_obs"))
    joined = scored.withColumn("_key", F.struct(*keys)).drop(*keys).join(every, "_key", "full")
    filled = {"obs": F.coalesce("obs", "_obs"), "n": F.coalesce("n", F.lit(0).cast("bigint"))}
    return joined.withColumns(filled).select(*[F.col(f"_key.{k}").alias(k) for k in keys], *scored.columns[len(keys):])


def single_observations(observations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, obs)``, an error where a key has two observations."""
    twice = F.raise_error(F.lit("two observations of one key"))
    return observations.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) > 1, twice.cast("double")).otherwise(F.max("obs")).alias("obs")
    )


def pit(
    ensemble: DataFrame,
    observations: DataFrame,
    keys: Sequence[str] = ("lead",),
    y: str = "y",
) -> DataFrame:
    """Predictive quantile alone: a conditional count, no ranking.

    Null and NaN members don't count; two observations of one key are an error. The join is left to
    the optimizer, which knows the observations' size at run time.
    """
    obs = single_observations(observations, keys)
    member = F.when(~F.isnan(F.col(y).cast("double")), F.col(y))
    return (
        ensemble.join(obs, list(keys), "left")
        .groupBy(*keys)
        .agg(F.avg((member <= F.col("obs")).cast("double")).alias("pit"))
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts of values in [0, 1] in ``bins`` equal bins; 1 falls in the last, empty bins stay."""
    bin_of = F.least(F.floor(F.col(value) * bins) + 1, F.lit(bins)).cast("int")
    counts = (
        df.where(F.col(value).between(0, 1))
        .groupBy(bin_of.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def rmse_by(df: DataFrame, keys: Sequence[str], prediction: str, truth: str) -> DataFrame:
    return df.groupBy(*keys).agg(rmse(prediction, truth).alias("rmse"))


def rmse_by_lead(score_table: DataFrame) -> DataFrame:
    """Residuals of many forecasts averaged by lead."""
    return score_table.groupBy("lead").agg(F.sqrt(F.avg(F.pow("resid", F.lit(2)))).alias("rmse"))


def coverage(score_table: DataFrame, keys: Sequence[str] = ("lead",)) -> DataFrame:
    """Share of observations inside the 95 % interval."""
    return score_table.groupBy(*keys).agg(
        F.avg(F.col("covered").cast("double")).alias("coverage"),
        F.count("covered").alias("n_obs"),
    )


def error_by_bin(df: DataFrame, predictor: str, error: str, width: float) -> DataFrame:
    """Forecast error across a predictor, in bins of fixed width."""
    return df.groupBy(F.floor(F.col(predictor) / width).cast("bigint").alias("bin")).agg(
        F.count(error).alias("n"),
        F.avg(error).alias("bias"),
        F.avg(F.abs(F.col(error))).alias("mae"),
        F.sqrt(F.avg(F.pow(error, F.lit(2)))).alias("rmse"),
    )


# -- smooth of skill over lead time ----------------------------------------------------------------


def cubic_basis(x: Column, knots: Sequence[float], scale: float) -> list[Column]:
    """1, x, x^2, x^3 and one truncated cubic per knot, on ``x / scale``."""
    z = x / F.lit(float(scale))
    powers = [F.lit(1.0), z, z * z, z * z * z]
    hinges = [F.pow(F.greatest(z - F.lit(k / scale), F.lit(0.0)), F.lit(3.0)) for k in knots]
    return powers + hinges


def cyclic_basis(x: Column, period: float, pairs: int) -> list[Column]:
    """Sines and cosines of ``pairs`` harmonics: a smooth that meets itself after ``period``, such as a year."""
    turn = x * F.lit(2.0 * math.pi / float(period))
    return [f(turn * F.lit(float(k))) for k in range(1, pairs + 1) for f in (F.sin, F.cos)]


#: Levels of a factor that get columns of their own; one with more goes to ``within``.
MOST_LEVELS = 100


def factor_columns(df: DataFrame, factor: str) -> list[Column]:
    """0/1 columns of all levels of ``factor`` but the first; null is a level."""
    rows = df.select(factor).distinct().orderBy(F.col(factor).asc_nulls_first()).limit(MOST_LEVELS + 1).collect()
    if len(rows) > MOST_LEVELS:
        raise ValueError(f"{factor} has more than {MOST_LEVELS} levels; take it as within")
    return [F.col(factor).eqNullSafe(F.lit(r[0])).cast("double") for r in rows[1:]]


def skill_curve(
    df: DataFrame,
    x: str = "lead",
    y: str = "crps",
    knots: Sequence[float] = (),
    scale: float = 1.0,
    factors: Sequence[str] = (),
    penalties: Sequence[float] | None = None,
    categories: Sequence[str] = (),
    within: Sequence[str] = (),
    cyclic: tuple[str, float, int] | None = None,
) -> tuple[dict, DataFrame]:
    """Penalised cubic spline of skill on lead, with extra factors.

    ``factors`` are numeric columns, ``categories`` columns of few levels (a model), ``cyclic`` a column, its period
    and a number of harmonics (the day of the year). Every combination of ``within`` (the sites, however
    many) has a level of its own, which is eliminated: its cross-products with itself are a diagonal, so
    the rest is fitted on what varies inside the levels, one row of sums each.

    Spark reduces the table to the (K x K) cross-products of the basis; the penalty (ridge on the
    hinges) is chosen by generalised cross-validation from those sums alone. ``penalties=[0]`` is
    plain least squares. Returns the fit and ``df`` with ``smooth`` added, null where a value is missing.
    """
    basis = cubic_basis(F.col(x).cast("double"), knots, scale) if knots else [
        F.lit(1.0),
        F.col(x).cast("double"),
    ]
    columns = basis + [F.col(f).cast("double") for f in factors]
    if cyclic:
        columns += cyclic_basis(F.col(cyclic[0]).cast("double"), cyclic[1], cyclic[2])
    needed = [x, *factors, *([cyclic[0]] if cyclic else [])]
    if within:
        # The sums, the levels and the result each read the table: it is made once.
        df = materialised(df, "skill")
    used = df.where(F.col(y).isNotNull()).na.drop("any", subset=needed)
    for category in categories:
        columns += factor_columns(used, category)
    k = len(columns)
    named = used.select(*within, *[c.alias(f"_c{i}") for i, c in enumerate([*columns, F.col(y)])])
    cells = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    if within:
        # Centred products of a level, which covar_pop keeps without losing digits.
        levels = named.groupBy(*within).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(f"_c{i}").alias(f"m_{i}") for i in range(k + 1)],
            *[(F.covar_pop(f"_c{i}", f"_c{j}") * F.count(F.lit(1))).alias(f"s_{i}_{j}") for i, j in cells],
        )
        totals = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("levels")]
        sums = levels.agg(*totals, *[F.sum(f"s_{i}_{j}").alias(f"s_{i}_{j}") for i, j in cells]).first()
    else:
        products = [F.sum(F.col(f"_c{i}") * F.col(f"_c{j}")).alias(f"s_{i}_{j}") for i, j in cells]
        sums = named.agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("levels"), *products).first()
    n = sums["n"] or 0
    gram = np.zeros((k + 1, k + 1))
    for i, j in cells:
        gram[i, j] = gram[j, i] = sums[f"s_{i}_{j}"] or 0.0
    xtx, xty, yty = gram[:k, :k], gram[:k, k], gram[k, k]
    ridge = np.zeros(k)
    ridge[4 : 4 + len(knots)] = 1.0 if knots else 0.0
    best = None
    for lam in penalties if penalties is not None else np.logspace(-6, 4, 21):
        inverse = np.linalg.pinv(xtx + lam * np.diag(ridge), hermitian=True)
        coef = inverse @ xty
        rss = max(float(yty - 2 * coef @ xty + coef @ xtx @ coef), 0.0)
        edf = float(np.trace(inverse @ xtx)) + sums["levels"]
        gcv = n * rss / (n - edf) ** 2 if n > edf else np.inf
        if best is None or gcv < best["gcv"]:
            best = {"penalty": float(lam), "coef": coef, "edf": edf, "rss": rss, "gcv": gcv, "n": n}
    fitted = sum((F.lit(float(b)) * c for b, c in zip(best["coef"], columns)), F.lit(0.0))
    if not within:
        return best, df.withColumn("smooth", fitted)
    rest = sum((F.lit(float(b)) * F.col(f"m_{i}") for i, b in enumerate(best["coef"])), F.lit(0.0))
    effects = levels.select(*[F.col(w).alias(f"_w{i}") for i, w in enumerate(within)], (F.col(f"m_{k}") - rest).alias("_level"))
    same = [F.col(w).eqNullSafe(F.col(f"_w{i}")) for i, w in enumerate(within)]
    joined = df.join(effects, reduce(Column.__and__, same), "left").withColumn("smooth", F.col("_level") + fitted)
    return best, joined.select(*df.columns, "smooth")


def top_by_metric(df: DataFrame, keys: Sequence[str], metric: str, fields: Sequence[str]):
    """Candidate with the smallest metric per key; ties go to the smaller fields."""
    choice = F.min(F.struct(metric, *fields))
    return df.groupBy(*keys).agg(choice.alias("_best")).select(*keys, "_best.*")


def order_statistics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Values of small groups (an ensemble) with their rank."""
    w = Window.partitionBy(*keys).orderBy(value)
    return df.withColumn("rank", F.row_number().over(w))
