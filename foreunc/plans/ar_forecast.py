"""The autoregressive forecast end to end: drivers, fit, design, ensemble, attribution, scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreunc.functions.random import Draws
from foreunc.functions.scalar import kelvin_to_celsius
from foreunc.operators import attribution, evaluate, many, prepare, propagate
from foreunc.operators.design import DesignSpec, design_matrix, design_pair
from foreunc.operators.series import fit_series

TEMPERATURE = "air_temperature"


def daily_drivers(
    forecast: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("parameter",),
    strict: bool = True,
) -> DataFrame:
    """Daily means per member, one column per variable, temperature in Celsius."""
    wide = prepare.daily_wide(forecast, keys, variables, strict=strict)
    return wide.withColumn(TEMPERATURE, kelvin_to_celsius(TEMPERATURE))


def spec_from_fit(
    fit: DataFrame, states: DataFrame, members: int, noise_rows: int | Column
) -> DesignSpec:
    """Design of one fitted series: tables of a single row of a few numbers, else an error.

    ``states`` holds its initial values, see :func:`foreunc.operators.many.origin_states`, one per lag at
    least. For many series see :func:`foreunc.operators.many.series_designs`.
    """
    rows, starts = fit.take(2), states.take(2)
    if len(rows) != 1 or len(starts) != 1:
        raise ValueError("a design is made from exactly one fitted series")
    row, start = rows[0], starts[0]
    if len(start["ic_mean"]) < len(propagate.lag_names(row["names"])):
        raise ValueError("the recursion needs one initial value per lag")
    return DesignSpec(
        names=row["names"],
        mean=row["coef"],
        cov=np.array(row["vcov"]),
        ic_mean=start["ic_mean"],
        ic_sd=start["ic_sd"],
        members=members,
        sigma2=row["sigma2"],
        noise_rows=noise_rows,
        ic_names=many.ic_names(len(start["ic_mean"])),
    )


def ar_blocks(spec: DesignSpec, variables: Sequence[str]) -> attribution.Blocks:
    """Inputs of the recursion; all drivers of a member and a whole noise row are one input each.

    So are the random effects of all coefficients, and a row of observation errors, where there are any.
    """
    blocks = {name: [name] for name in [*spec.names, *spec.ic_names]}
    if spec.effect_sd:
        blocks["random_effect"] = [f"u_{name}" for name, _ in zip(spec.names, spec.effect_sd)]
    blocks["member"] = [f"met_{v}" for v in variables]
    blocks["noise"] = ["eps"]
    if spec.observation_sigma2:
        blocks["observation"] = ["obs"]
    return blocks


def error_rows(spec: DesignSpec, draws: Draws, horizon: int, values, side: str = "", out: str = "") -> None:
    """Noise, and errors of observation if there are any, of the rows that a side's ids name."""
    ids = values[f"{side}noise_id"]
    values[f"{out or side}eps"] = propagate.noise_block(draws, spec.sigma2, ids, horizon, stream=spec.stream)
    if spec.observation_sigma2:
        values[f"{out or side}obs"] = propagate.noise_block(
            draws, spec.observation_sigma2, values[f"{side}obs_id"], horizon, stream=spec.stream,
            purpose=propagate.OBSERVATION,
        )


def population_spec(
    effects: DataFrame, names: Sequence[str], ic_mean: float, ic_sd: float, sigma2: float, members: int,
    noise_rows: int | Column,
) -> DesignSpec:
    """Design of a series that wasn't fitted: the mean of all series, and random effects around it.

    ``effects`` holds the variances of :func:`foreunc.operators.effects.effect_variances`, one row per
    coefficient. The mean's own variance is that of the estimates over the number of series.
    """
    rows = {r["term"]: r for r in effects.where(F.col("term").isin(list(names))).collect()}
    if set(rows) != set(names):
        raise ValueError("every coefficient needs its row of effects")
    spread = [(rows[n]["between"] + rows[n]["within"]) / rows[n]["n_series"] for n in names]
    return DesignSpec(
        names=list(names), mean=[rows[n]["mean"] for n in names], cov=np.diag(spread), ic_mean=[ic_mean], ic_sd=[ic_sd],
        members=members, sigma2=sigma2, noise_rows=noise_rows, effect_sd=[float(np.sqrt(rows[n]["between"])) for n in names],
    )


def ar_pair(
    samples: DataFrame, spec: DesignSpec, draws: Draws, drivers: DataFrame,
    variables: Sequence[str], horizon: int, **calendar,
) -> DataFrame:
    """Both design matrices with their driver arrays attached; ``calendar`` as in ``forcing_table``."""
    pair = design_pair(samples, spec, draws)
    forcing = propagate.forcing_table(
        drivers, pair, variables, horizon, member_columns=["a_member", "b_member"], **calendar
    )
    return propagate.with_forcing(
        pair, forcing, variables, sides=["a_", "b_"]
    ).drop("a_member", "b_member")


def sobol_of_ar_model(
    samples: DataFrame, spec: DesignSpec, draws: Draws, drivers: DataFrame,
    variables: Sequence[str], horizon: int, clamp: bool = False, **calendar,
) -> DataFrame:
    """First and total order indices by lead of every parameter, the initial condition, the drivers
    and the process error; and of random effects and errors of observation, if the design has them."""

    ic_names = list(spec.ic_names)
    # Tasks can't carry columns, as noise_rows may be.
    errors = replace(spec, noise_rows=0)

    def noise(values):
        for side in ("a_", "b_"):
            error_rows(errors, draws, horizon, values, side)
        return values

    pair = ar_pair(samples, spec, draws, drivers, variables, horizon, **calendar).drop(*samples.columns)
    return attribution.sobol_paths(
        pair,
        ar_blocks(spec, variables),
        lambda inputs: propagate.ar_paths(inputs, variables, ic_names),
        noise,
        clamp,
    )


def one_at_a_time_of_ar_model(
    samples: DataFrame, spec: DesignSpec, draws: Draws, drivers: DataFrame,
    variables: Sequence[str], horizon: int, per_date: bool = False,
) -> DataFrame:
    """Variance by lead with no source, one source, and all sources of uncertainty.

    Frozen parameters and initial condition sit at their sample mean, frozen noise at 0, frozen
    drivers at the mean over all dates and members (``per_date``: over the members of the date).
    """
    design = design_matrix(samples, spec, draws, "A")
    forcing = propagate.forcing_table(drivers, design, variables, horizon)
    rows = propagate.with_forcing(design, forcing, variables)
    ids = [c for c in spec.columns if c in ("noise_id", "obs_id")]
    rows = rows.select(*spec.scalars, *ids, *[f"met_{v}" for v in variables])
    pair = attribution.frozen_side(rows, spec.scalars)
    pair = pair.withColumnsRenamed({f"met_{v}": f"a_met_{v}" for v in variables})
    if not variables:
        frozen = {}
    elif per_date:
        by_date = drivers.groupBy("datetime").agg(*[F.avg(v).alias(v) for v in variables])
        frozen = many.calendar_arrays(by_date, variables, horizon)
    else:
        means = drivers.agg(*[F.avg(v).alias(v) for v in variables])
        frozen = {v: F.array_repeat(means.select(v).scalar(), horizon) for v in variables}
    pair = pair.withColumns({f"b_met_{v}": frozen[v] for v in variables})

    ic_names = list(spec.ic_names)
    errors = replace(spec, noise_rows=0)

    def noise(values):
        error_rows(errors, draws, horizon, values, out="a_")
        for name in ("eps", "obs"):
            if f"a_{name}" in values:
                values[f"b_{name}"] = np.zeros_like(values[f"a_{name}"])
        return values

    return attribution.one_at_a_time_paths(
        pair, ar_blocks(spec, variables), lambda i: propagate.ar_paths(i, variables, ic_names), noise
    )


def memoryless_pair_rows(
    samples: DataFrame, spec: DesignSpec, draws: Draws, drivers: DataFrame,
    variables: Sequence[str], horizon: int,
) -> DataFrame:
    """Long pair (one row per sample and lead) for the model without memory."""
    pair = design_pair(samples, spec, draws)
    forcing = propagate.forcing_table(
        drivers, pair, variables, horizon, member_columns=["a_member", "b_member"]
    )
    rows = propagate.with_forcing_at_lead(
        propagate.explode_leads(pair, horizon), forcing, variables,
        sides=["a_", "b_"],
    )
    return rows.withColumns(
        {f"{s}_eps": propagate.noise_at(draws, spec.sigma2, f"{s}_noise_id") for s in ("a", "b")}
    )


def sobol_of_memoryless_model(
    samples: DataFrame, spec: DesignSpec, draws: Draws, drivers: DataFrame,
    variables: Sequence[str], horizon: int, clamp: bool = False,
) -> DataFrame:
    """The same indices for the model without memory, as column expressions only."""
    rows = memoryless_pair_rows(samples, spec, draws, drivers, variables, horizon)
    model = attribution.column_model(lambda i: propagate.memoryless_y(i, variables))
    return attribution.sobol(
        rows, ar_blocks(spec, variables), model, ["lead"], shared=["lead"], clamp=clamp
    )


def forecast_rows(
    samples: DataFrame, spec: DesignSpec, draws: Draws, drivers: DataFrame,
    variables: Sequence[str], horizon: int,
) -> DataFrame:
    """Ensemble forecast ``(sample_id, lead, y)``."""
    design = design_matrix(samples, spec, draws, "A")
    forcing = propagate.forcing_table(drivers, design, variables, horizon)
    return propagate.leads_to_rows(
        propagate.propagate_autoregressive(
            design, forcing, variables, horizon, draws, spec.sigma2,
            ic_names=spec.ic_names, stream=spec.stream, observation_sigma2=spec.observation_sigma2,
        )
    )


def fit_region(
    targets: DataFrame, drivers: DataFrame, variables: Sequence[str], max_order: int = 1
) -> DataFrame:
    """Fit one regional series from daily targets and member-mean drivers."""
    joined = prepare.attach_targets(targets, drivers).withColumn("series", F.lit("region"))
    return fit_series(joined, ["series"], "observation", variables, max_order)


def score_forecast(
    ensemble: DataFrame, targets: DataFrame, forecast_date: str, horizon: int,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Scores by lead, with the date each lead stands for."""
    obs = evaluate.observations_by_lead(targets, forecast_date, horizon, keys)
    return evaluate.with_dates(
        evaluate.scores(ensemble, obs, [*keys, "lead"]), forecast_date
    )
