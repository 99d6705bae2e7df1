"""Forward propagation of a design through a forecast model.

``x_0 = ic - intercept``; ``x_t = sum_k ar_k * x_(t-k) + sum_v b_v * driver_v[t, member] + noise[t]``;
``y_t = x_t + intercept``. Lead 0 is the initial condition, the newest of as many initial values as
the recursion has lags; lead t uses the drivers t - 1 days after the first one.
Without an ``ar1`` column the state has no memory and y is a plain column expression.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foreunc.functions.random import Draws
from foreunc.session import compiled_stages, materialised

NOISE, OBSERVATION = "noise", "observation"


def steps_between(time: Column, start: Column, step: str = "day") -> Column:
    """Whole days or calendar months from ``start`` to ``time``."""
    if step == "day":
        return F.date_diff(F.to_date(time), F.to_date(start))
    if step == "month":
        months = [F.year(t) * 12 + F.month(t) for t in (time, start)]
        return months[0] - months[1]
    raise ValueError("a step is a day or a month")


def forcing_table(
    drivers: DataFrame,
    design: DataFrame,
    variables: Sequence[str],
    horizon: int,
    keys: Sequence[str] = (),
    member_columns: Sequence[str] = ("member",),
    time: str = "datetime",
    order: str = "parameter",
    driver_keys: Sequence[str] | None = None,
    first: str | Column | None = None,
    driver_offset: int = 0,
    step: str = "day",
) -> DataFrame:
    """Driver values by (keys, member position, lead) for every member the design drew.

    The position is the rank of the row inside its date; a position past the last row has no value.
    Missing values take the mean over that date's *sampled* rows, that is the mean over positions
    weighted by how often the design drew them. The result has members x horizon rows per key.

    Leads count along the calendar in steps of a day or month: lead k uses the date k - 1 +
    ``driver_offset`` steps after ``first``, by default the earliest date of all drivers. A date
    without rows leaves its lead empty and moves no other. ``driver_keys`` are those of ``keys`` that
    the drivers have, all by default; with none, every key uses the same drivers.
    """
    keys = list(keys)
    shared = keys if driver_keys is None else list(driver_keys)
    if first is None:
        start = drivers.agg(F.min(time)).scalar()
    else:
        start = F.to_date(F.lit(first)) if isinstance(first, str) else first
    by_date = Window.partitionBy(*shared, time).orderBy(order)
    placed = drivers.select(
        *shared,
        (steps_between(F.col(time), start, step) + F.lit(1 - int(driver_offset))).cast("int").alias("lead"),
        F.row_number().over(by_date).cast("bigint").alias("member"),
        *variables,
    ).where(F.col("lead").between(1, int(horizon)))
    picked = F.explode(F.array(*[F.col(c) for c in member_columns])).alias("member")
    picks = design.select(*keys, picked).groupBy(*keys, "member").agg(
        F.count(F.lit(1)).alias("_draws")
    )
    slots = picks.withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(int(horizon)))))
    filled = slots.join(placed, [*shared, "member", "lead"], "left")
    at_lead = Window.partitionBy(*keys, "lead")

    def gap_filled(v):
        weight = F.sum(F.when(F.col(v).isNotNull(), F.col("_draws"))).over(at_lead)
        mean = F.sum(F.col(v) * F.col("_draws")).over(at_lead) / weight
        return F.coalesce(F.col(v), mean).alias(v)

    return filled.select(*keys, "member", "lead", *[gap_filled(v) for v in variables])


def forcing_arrays(
    forcing: DataFrame, variables: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """One row per member with an array over leads for each variable (``met_<variable>``)."""
    row = F.struct("lead", *variables)
    return (
        forcing.groupBy(*keys, "member")
        .agg(F.array_sort(F.collect_list(row)).alias("_rows"))
        .select(*keys, "member", *[F.col(f"_rows.{v}").alias(f"met_{v}") for v in variables])
    )


def with_forcing(
    design: DataFrame,
    forcing: DataFrame,
    variables: Sequence[str],
    keys: Sequence[str] = (),
    sides: Sequence[str] = ("",),
) -> DataFrame:
    """Attach driver arrays to each design row by its member number (``a_``/``b_`` sides too).

    The lookup, a row per key and member, is written first, so that its size is known and the planner
    broadcasts it up to its threshold: then no sample is shuffled.
    """
    arrays = materialised(forcing_arrays(forcing, variables, keys), "forcing")
    for side in sides:
        lookup = arrays.withColumnsRenamed(
            {"member": f"{side}member", **{f"met_{v}": f"{side}met_{v}" for v in variables}}
        )
        design = design.join(lookup, [*keys, f"{side}member"], "left")
    return design


def with_forcing_at_lead(
    rows: DataFrame,
    forcing: DataFrame,
    variables: Sequence[str],
    keys: Sequence[str] = (),
    sides: Sequence[str] = ("",),
) -> DataFrame:
    """The same lookup for long rows that already carry ``lead``."""
    forcing = materialised(forcing, "forcing")
    for side in sides:
        lookup = forcing.withColumnsRenamed(
            {"member": f"{side}member", **{v: f"{side}met_{v}" for v in variables}}
        )
        rows = rows.join(lookup, [*keys, f"{side}member", "lead"], "left")
    return rows


def explode_leads(design: DataFrame, horizon: int, first: int = 0) -> DataFrame:
    leads = F.sequence(F.lit(int(first)), F.lit(int(horizon)))
    return design.withColumn("lead", F.explode(leads))


# -- memoryless model: column expressions --------------------------------------------------------


def noise_at(draws: Draws, sigma2: float, noise_id: str = "noise_id", lead: str = "lead") -> Column:
    """Process error of a noise row at a lead: a pure function of both, no noise table."""
    return F.lit(float(np.sqrt(sigma2))) * draws.normal(NOISE, noise_id, lead)


def memoryless_y(inputs: dict[str, Column], variables: Sequence[str]) -> Column:
    """``y`` of the model without memory; lead 0 is the initial condition."""
    effect = sum((inputs[f"b_{v}"] * inputs[f"met_{v}"] for v in variables), F.lit(0.0))
    return F.when(inputs["lead"] == 0, inputs["ic"]).otherwise(
        inputs["intercept"] + effect + inputs["eps"]
    )


def propagate_memoryless(
    design: DataFrame,
    forcing: DataFrame,
    variables: Sequence[str],
    horizon: int,
    draws: Draws,
    sigma2: float,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Long forecast ``(keys, sample_id, lead, y)`` of the model without memory; the ensemble isn't
    shuffled where the drivers are small enough to be broadcast."""
    compiled_stages(design.sparkSession)
    rows = with_forcing_at_lead(
        explode_leads(design, horizon), forcing, variables, keys
    ).withColumn("eps", noise_at(draws, sigma2))
    names = ["lead", "ic", "intercept", "eps"]
    names += [f"{p}{v}" for v in variables for p in ("b_", "met_")]
    y = memoryless_y({n: F.col(n) for n in names}, variables)
    return rows.select(*keys, "sample_id", "lead", y.alias("y"))


# -- autoregressive model: one batch of samples at a time ----------------------------------------


def noise_block(
    draws: Draws,
    sigma2: float,
    noise_id: np.ndarray,
    horizon: int,
    phi: float = 0.0,
    stream: Sequence[int] = (),
    purpose: str = NOISE,
) -> np.ndarray:
    """Noise rows (samples x leads); ``phi`` correlates consecutive leads, variance unchanged."""
    leads = np.arange(1, horizon + 1)
    # A lead's values lie side by side, as the recursion takes them.
    eps = (np.sqrt(sigma2) * draws.normal_values(purpose, *stream, noise_id[None, :], leads[:, None])).T
    for t in range(1, horizon if phi else 0):
        eps[:, t] = phi * eps[:, t - 1] + np.sqrt(1.0 - phi * phi) * eps[:, t]
    return eps


def lag_names(names: Sequence[str]) -> list[str]:
    """The autoregressive terms among ``names``, ``ar1`` first; a gap between them is an error."""
    found = sorted((n for n in names if n.startswith("ar") and n[2:].isdigit()), key=lambda n: int(n[2:]))
    if found != [f"ar{k}" for k in range(1, len(found) + 1)]:
        raise ValueError("autoregressive terms must be ar1, ar2, ... without gaps")
    return found


def ar_paths(
    inputs: dict[str, np.ndarray], variables: Sequence[str], ic_names: Sequence[str] = ("ic",)
) -> np.ndarray:
    """The recursion for a block of samples: vectorised over samples, sequential in lead.

    The state holds the last values of x, the newest first, one per lag; ``ic_names`` name its start, the
    oldest first. Fewer initial values than lags are an error. A random effect ``u_<coefficient>`` adds to
    its coefficient; ``obs``, an error per lead, to the outcome only.
    """
    inputs = {n: v + inputs[f"u_{n}"] if f"u_{n}" in inputs else v for n, v in inputs.items()}
    lags = lag_names(list(inputs))
    if len(ic_names) < len(lags):
        raise ValueError("the recursion needs one initial value per lag")
    eps = inputs["eps"]
    intercept = inputs["intercept"]
    y = np.empty((eps.shape[1] + 1, eps.shape[0])).T
    state = [inputs[n] - intercept for n in reversed(ic_names)]
    y[:, 0] = inputs[ic_names[-1]]
    for t in range(eps.shape[1]):
        x = eps[:, t]
        for name, before in zip(lags, state):
            x = x + inputs[name] * before
        for v in variables:
            x = x + inputs[f"b_{v}"] * inputs[f"met_{v}"][:, t]
        state = [x, *state[:-1]]
        y[:, t + 1] = x + intercept
    if "obs" in inputs:
        y[:, 1:] += inputs["obs"]
    return y


def column_values(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """Column of an Arrow batch as an array; array columns become a matrix (rows x leads)."""
    column = batch.column(name)
    if pa.types.is_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def propagate_autoregressive(
    design: DataFrame,
    forcing: DataFrame,
    variables: Sequence[str],
    horizon: int,
    draws: Draws,
    sigma2: float,
    keys: Sequence[str] = (),
    noise_phi: float = 0.0,
    ic_names: Sequence[str] = ("ic",),
    stream: Sequence[int] = (),
    observation_sigma2: float = 0.0,
) -> DataFrame:
    """Forecast ``(keys, sample_id, y)`` with ``y`` an array over leads 0..horizon; narrow.

    A lead without its driver value, and all leads after it, are null. The design's columns ``ar1, ar2, ...``
    are the lags, ``u_<coefficient>`` random effects, ``ic_names`` its initial values, the oldest first. With
    ``observation_sigma2`` the errors of the rows ``obs_id`` add to the outcome.
    """
    keys, variables, ic_names = list(keys), list(variables), list(ic_names)
    inputs = ["intercept", *ic_names, *[f"b_{v}" for v in variables], *lag_names(design.columns)]
    inputs += [c for c in design.columns if c.startswith("u_") and c[2:] in inputs]
    ids = ["noise_id", *(["obs_id"] if observation_sigma2 else [])]
    rows = with_forcing(design, forcing, variables, keys).select(
        *keys, "sample_id", *ids, *inputs, *[f"met_{v}" for v in variables]
    )
    fields = [rows.schema[c] for c in [*keys, "sample_id"]]
    schema = T.StructType([*fields, T.StructField("y", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values = {n: column_values(batch, n) for n in inputs}
            values.update({f"met_{v}": column_values(batch, f"met_{v}") for v in variables})
            noise_id = column_values(batch, "noise_id")
            values["eps"] = noise_block(draws, sigma2, noise_id, horizon, noise_phi, stream)
            if observation_sigma2:
                obs_id = column_values(batch, "obs_id")
                values["obs"] = noise_block(draws, observation_sigma2, obs_id, horizon, 0.0, stream, OBSERVATION)
            y = ar_paths(values, variables, ic_names)
            missing = np.isnan(y.ravel())
            ends = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
            paths = pa.ListArray.from_arrays(ends, pa.array(y.ravel(), mask=missing))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in fields], paths], names=schema.names
            )

    return rows.mapInArrow(run, schema)


def leads_to_rows(forecast: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Array form to long rows ``(keys, lead, y)``."""
    return forecast.select(*keys, F.posexplode("y").alias("lead", "y"))


def rows_to_leads(rows: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Long rows to the array form (an array holds one value per lead of the horizon)."""
    pairs = F.array_sort(F.collect_list(F.struct("lead", "y")))
    return rows.groupBy(*keys).agg(pairs.alias("_p")).select(*keys, F.col("_p.y").alias("y"))
