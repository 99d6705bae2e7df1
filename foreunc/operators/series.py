"""Autoregression with covariates for many series at once.

``y_t - c = sum_k rho_k (y_(t-k) - c) + sum_v b_v x_(v,t) + e_t`` by conditional least squares on
complete rows: the recursion the propagation step simulates. A regression with autoregressive
*errors* is another parameterisation, so its coefficients differ from these.

Spark reduces every series to the centred cross-products of its regression columns; the solve then
works on one row per series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lagged_rows(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    covariates: Sequence[str],
    order: int,
    time: str = "datetime",
    step: str = "day",
) -> DataFrame:
    """``y`` with its values 1..order steps back and the covariates of the same date.

    Each observation is sent to the dates that need it and the copies are put together by
    (series, date). Unlike a window over a series this never puts a long series in one task, and a
    missing date is a missing lag without completing the grid first. Two rows of one date are an error.
    """
    shift = {"day": lambda k: F.date_add(F.col(time), k), "month": lambda k: F.add_months(time, k)}
    at = shift[step]
    copies = F.array(*[F.struct(F.lit(k).alias("_lag"), at(k).alias("_at")) for k in range(order + 1)])
    spread = df.select(*keys, y, *covariates, F.inline(copies))
    here = F.col("_lag") == 0
    twice = F.raise_error(F.lit("a series has two rows of one date")).cast("double")
    single = F.count(F.when(here, 1)) <= 1
    return spread.groupBy(*keys, F.col("_at").alias(time)).agg(
        F.when(single, F.max(F.when(here, F.col(y)))).otherwise(twice).alias(y),
        *[F.max(F.when(F.col("_lag") == k, F.col(y))).alias(f"lag{k}") for k in range(1, order + 1)],
        *[F.max(F.when(here, F.col(v))).alias(v) for v in covariates],
    )


def series_moments(
    rows: DataFrame, keys: Sequence[str], y: str, regressors: Sequence[str]
) -> DataFrame:
    """Count, means and centred cross-products per series over complete rows.

    ``covar_pop`` updates centred sums, so large means cost no precision.
    """
    names = [y, *regressors]
    complete = rows.na.drop("any", subset=names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    return complete.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in names]).alias("means"),
        F.array(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).alias("products"),
    )


def solve_series(moments: DataFrame, keys: Sequence[str], order: int, covariates: Sequence[str]):
    """Fit every series from its moments, orders 0..``order`` compared by AICc on the same rows.

    Returns ``keys, n, ar_order, names, coef, vcov, sigma2, aicc``; coefficients are named
    ``ar1.., intercept, b_<covariate>`` and ``vcov`` is theirs (delta method for the intercept).
    """
    return _solve(moments, keys, range(order + 1), order, covariates)


def solve_fixed_order(
    moments: DataFrame, keys: Sequence[str], order: int, covariates: Sequence[str]
) -> DataFrame:
    return _solve(moments, keys, [order], order, covariates)


def _solve(moments, keys, orders, max_order, covariates) -> DataFrame:
    orders, covariates = list(orders), list(covariates)
    fields = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in moments.select(*keys).schema.fields
    )
    schema = (
        f"{fields}, n bigint, ar_order int, names array<string>, coef array<double>, "
        "vcov array<array<double>>, sigma2 double, aicc double"
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            fits = best_fits(
                frame["n"].to_numpy(), np.stack(frame["means"]), np.stack(frame["products"]),
                orders, max_order, covariates,
            )
            out = pd.DataFrame(fits, columns=["ar_order", "names", "coef", "vcov", "sigma2", "aicc"])
            out["ar_order"] = out["ar_order"].astype("Int32")
            head = frame[[*keys, "n"]].reset_index(drop=True)
            yield pd.concat([head, out], axis=1)

    return moments.mapInPandas(run, schema)


def best_fits(n, means, products, orders, max_order: int, covariates: Sequence[str]) -> list[tuple]:
    """Least-squares fits of a batch of series from centred products, all solved together.

    One tuple per series, of the lowest AICc among ``orders`` (the first of equal ones); of nulls where
    no order has enough rows and regressors of full rank.
    """
    count, size = len(n), 1 + max_order + len(covariates)
    upper = np.triu_indices(size)
    centred = np.zeros((count, size, size))
    centred[:, upper[0], upper[1]] = products * n[:, None]
    centred += np.triu(centred, 1).transpose(0, 2, 1)
    best: list[tuple] = [(None,) * 6] * count
    lowest = np.full(count, np.inf)
    chosen = np.zeros(count, dtype=bool)
    for p in orders:
        use = [*range(1, 1 + p), *range(1 + max_order, size)]
        k = len(use) + 1
        able = n > k + 1
        sxx, sxy = centred[:, use][:, :, use], centred[:, use, 0]
        if use:
            able &= np.linalg.matrix_rank(sxx, hermitian=True) == len(use)
        rows = np.flatnonzero(able)
        if not len(rows):
            continue
        sxx, sxy, m, length = sxx[rows], sxy[rows], means[rows], n[rows].astype(float)
        inverse = np.linalg.inv(sxx) if use else sxx
        slopes = np.einsum("sij,sj->si", inverse, sxy)
        rss = np.maximum(centred[rows, 0, 0] - np.einsum("si,si->s", slopes, sxy), 0.0)
        sigma2 = rss / (length - k)
        aicc = length * np.log(np.maximum(rss, 1e-300) / length) + 2 * (k + 1)
        spare = length - k - 2
        aicc += np.where(spare > 0, 2 * (k + 1) * (k + 2) / np.where(spare > 0, spare, 1), np.inf)
        better = ~chosen[rows] | (aicc < lowest[rows])
        mx = m[:, use]
        a = m[:, 0] - np.einsum("si,si->s", slopes, mx)
        gap = 1.0 - slopes[:, :p].sum(axis=1)
        leverage = np.einsum("sij,sj->si", inverse, mx)
        full = np.zeros((len(rows), k, k))
        full[:, :-1, :-1] = sigma2[:, None, None] * inverse
        full[:, :-1, -1] = full[:, -1, :-1] = -sigma2[:, None] * leverage
        full[:, -1, -1] = sigma2 * (1.0 / length + np.einsum("si,si->s", mx, leverage))
        # (slopes, a) -> (rho, intercept = a / gap, b)
        jac = np.zeros((len(rows), k, k))
        jac[:, :p, :p] = np.eye(p)
        jac[:, p, :p] = (a / gap**2)[:, None]
        jac[:, p, -1] = 1.0 / gap
        jac[:, p + 1 :, p : k - 1] = np.eye(len(covariates))
        vcov = jac @ full @ jac.transpose(0, 2, 1)
        coef = np.concatenate([slopes[:, :p], (a / gap)[:, None], slopes[:, p:]], axis=1)
        names = [f"ar{i}" for i in range(1, p + 1)] + ["intercept", *(f"b_{v}" for v in covariates)]
        for j in np.flatnonzero(better):
            best[rows[j]] = (p, names, coef[j].tolist(), vcov[j].tolist(), float(sigma2[j]), float(aicc[j]))
        lowest[rows[better]], chosen[rows] = aicc[better], True
    return best


def fit_series(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    covariates: Sequence[str] = (),
    max_order: int = 1,
    fixed: bool = False,
    time: str = "datetime",
    step: str = "day",
) -> DataFrame:
    """Lags, moments and solve in one go; ``fixed`` keeps ``max_order`` instead of choosing."""
    rows = lagged_rows(df, keys, y, covariates, max_order, time, step)
    regressors = [*[f"lag{k}" for k in range(1, max_order + 1)], *covariates]
    moments = series_moments(rows, keys, y, regressors)
    solve = solve_fixed_order if fixed else solve_series
    return solve(moments, keys, max_order, covariates)


def fit_with_fallback(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    covariates: Sequence[str],
    max_order: int = 1,
    time: str = "datetime",
    step: str = "day",
) -> DataFrame:
    """Covariate model for series without negative targets, pure autoregression for the others.

    The lagged rows are shuffled once and reduced twice.
    """
    rows = lagged_rows(df, keys, y, covariates, max_order, time, step)
    lags = [f"lag{k}" for k in range(1, max_order + 1)]
    # The fallback model ignores the covariates, so their gaps must not cost it rows.
    signs = rows.groupBy(*keys).agg(F.count_if(F.col(y) < 0).alias("n_negative"))
    with_x = series_moments(rows, keys, y, [*lags, *covariates])
    without = series_moments(rows, keys, y, lags)
    regular = solve_series(
        with_x.join(signs.where("n_negative = 0").select(*keys), list(keys), "left_semi"),
        keys, max_order, covariates,
    ).withColumn("covariates", F.lit(True))
    fallback = solve_series(
        without.join(signs.where("n_negative > 0").select(*keys), list(keys), "left_semi"),
        keys, max_order, [],
    ).withColumn("covariates", F.lit(False))
    return regular.unionByName(fallback)
