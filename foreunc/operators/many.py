"""Forecasts of many fitted series in one plan: initial states, designs, ensembles and attribution.

A fit is a row: its coefficients, covariance factor and initial state are array columns of a keyed
table, so a thousand series are drawn, propagated and attributed by one job. The samples of a series are
cut into blocks of BLOCK, dealt over all tasks; a block draws its samples from (series, sample id), runs
the recursion over all variants and leaves its moments by lead as one row. Only these are shuffled, and
put together by series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foreunc.functions.random import Draws
from foreunc.operators import attribution, propagate
from foreunc.operators.design import HALF_WIDTH_68, cholesky, spread

#: Samples of a series that one task evaluates at a time.
BLOCK = 4096
LAST_VALUE = "dayof"


def ic_names(lags: int) -> list[str]:
    """Names of the initial values, the oldest first: ``lag2, lag1, dayof`` for three, ``ic`` for one."""
    return ["ic"] if lags == 1 else [*(f"lag{k}" for k in range(lags - 1, 0, -1)), LAST_VALUE]


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(k, df.schema[k].dataType) for k in keys]


def _doubles(depth: int = 1) -> T.DataType:
    kind: T.DataType = T.DoubleType()
    for _ in range(depth):
        kind = T.ArrayType(kind)
    return kind


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column, missing values as nan."""
    out = np.full((len(column), width), np.nan)
    for i, row in enumerate(column.to_pylist()):
        if row:
            out[i, : len(row)] = [np.nan if v is None else v for v in row]
    return out


def _aligned(names: Sequence[str], wanted: Sequence[str], values: np.ndarray) -> np.ndarray:
    """Coefficients or their covariance in the order ``wanted``, 0 for terms a fit doesn't have."""
    if not set(names) <= set(wanted):
        raise ValueError(f"a fit has terms beyond the lags and covariates asked for: {', '.join(names)}")
    out = np.zeros((len(wanted),) * values.ndim)
    place = [list(wanted).index(n) for n in names]
    out[np.ix_(*[place] * values.ndim)] = values
    return out


def parameter_names(lags: int, variables: Sequence[str]) -> list[str]:
    return [*(f"ar{k}" for k in range(1, lags + 1)), "intercept", *(f"b_{v}" for v in variables)]


# -- state at the forecast origin ----------------------------------------------------------------


def origin_states(
    observed: DataFrame,
    fits: DataFrame,
    keys: Sequence[str],
    y: str,
    covariates: Sequence[str],
    origin: str | Column,
    lags: int = 1,
    lookback: int = 30,
    time: str = "datetime",
    step: str = "day",
) -> DataFrame:
    """(keys, ic_mean, ic_sd) of every fit: the ``lags`` values up to the date ``origin``, oldest first.

    They are the first forecasts after the observations that end ``lags`` steps before the origin; the
    spread of one is half the width of its central 68 % interval. The recursion starts ``lookback``
    steps earlier from the intercept, takes the observed values, and where one is missing its own
    prediction. A missing covariate counts as its mean over the dates read. A row per key of ``fits``;
    null arrays where there is no fit; two rows of a date are an error. A series gives at most
    ``lookback + lags`` of its rows, so no history is gathered whole.
    """
    keys, covariates = list(keys), list(covariates)
    width = lookback + lags
    start = F.to_date(F.lit(origin)) if isinstance(origin, str) else origin
    place = propagate.steps_between(F.col(time), start, step) + F.lit(width)
    near = (
        observed.select(*keys, place.alias("_place"), F.col(y).cast("double").alias("_y"),
                        *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(covariates)])
        .where(F.col("_place").between(1, width))
        .groupBy(*keys, "_place")
        .agg(F.count(F.lit(1)).alias("_rows"), F.max("_y").alias("_y"),
             *[F.max(f"_x{i}").alias(f"_x{i}") for i in range(len(covariates))])
        .withColumn("_place", F.when(F.col("_rows") == 1, F.col("_place")).otherwise(
            F.raise_error(F.lit("a series has two rows of one date")).cast("int")))
    )
    entry = F.struct("_place", "_y", *[f"_x{i}" for i in range(len(covariates))])
    gathered = near.groupBy(*keys).agg(F.collect_list(entry).alias("_rows"))
    rows = fits.select(*keys, "names", "coef", "sigma2").join(gathered, keys, "left")
    schema = T.StructType(
        [*_key_fields(fits, keys), T.StructField("ic_mean", _doubles()), T.StructField("ic_sd", _doubles())]
    )
    wanted = parameter_names(lags, covariates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            read = batch.select(["names", "coef", "sigma2", "_rows"]).to_pylist()
            series = np.full((len(read), width, 1 + len(covariates)), np.nan)
            coef, sigma2 = np.zeros((len(read), len(wanted))), np.zeros(len(read))
            fitted = np.array([r["coef"] is not None for r in read])
            for i, r in enumerate(read):
                if fitted[i]:
                    coef[i], sigma2[i] = _aligned(r["names"], wanted, np.array(r["coef"])), r["sigma2"]
                for row in r["_rows"] or []:
                    values = [row["_y"], *(row[f"_x{k}"] for k in range(len(covariates)))]
                    series[i, row["_place"] - 1] = [np.nan if v is None else v for v in values]
            mean, sd = forecast_state(series[:, :, 0], series[:, :, 1:], coef, sigma2, lags)
            out = [[m.tolist() if f else None for m, f in zip(v, fitted)] for v in (mean, sd)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), *(pa.array(v, type=pa.list_(pa.float64())) for v in out)],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)


def forecast_state(
    y: np.ndarray, x: np.ndarray, coef: np.ndarray, sigma2: np.ndarray, lags: int
) -> tuple[np.ndarray, np.ndarray]:
    """Mean and half 68 % width of the last ``lags`` columns of ``y`` (series x dates), which aren't read."""
    rho, intercept, slopes = coef[:, :lags], coef[:, lags], coef[:, lags + 1 :]
    present = ~np.isnan(x)
    count = present.sum(axis=1)
    centre = np.where(count > 0, np.where(present, x, 0.0).sum(axis=1) / np.maximum(count, 1), np.nan)
    effect = np.einsum("stv,sv->st", np.where(present, x, centre[:, None, :]), slopes)
    state = np.zeros((y.shape[1] + lags, len(y)))
    for t in range(y.shape[1]):
        ahead = sum((rho[:, k] * state[t + lags - 1 - k] for k in range(lags)), effect[:, t])
        seen = ~np.isnan(y[:, t]) if t < y.shape[1] - lags else np.zeros(len(y), dtype=bool)
        state[t + lags] = np.where(seen, y[:, t] - intercept, ahead)
    weights = np.zeros((lags + lags, len(y)))
    weights[lags] = 1.0
    for j in range(1, lags):
        weights[lags + j] = sum(rho[:, k] * weights[lags + j - 1 - k] for k in range(lags))
    variance = sigma2 * np.cumsum(weights[lags:] ** 2, axis=0)
    return (state[-lags:] + intercept).T, (HALF_WIDTH_68 * np.sqrt(variance)).T


# -- designs -----------------------------------------------------------------------------------------


def series_designs(
    fits: DataFrame, states: DataFrame, keys: Sequence[str], variables: Sequence[str], lags: int = 1,
    number: Column | None = None,
) -> DataFrame:
    """(keys, series_no, mean, factor, ic_mean, ic_sd, sigma2): the design of every fitted series.

    ``mean`` follows :func:`parameter_names`; ``factor`` is the lower Cholesky factor of the covariance.
    A term that a fit lacks, being of lower order, is a constant 0. ``series_no`` numbers the draws:
    ``number``, by default a hash of the keys, so that a series has the same draws in whatever company,
    not negative. Series without a fit or
    with a state that isn't finite have no row. A fit of more than ``lags`` lags is an error.
    """
    keys, variables = list(keys), list(variables)
    wanted = parameter_names(lags, variables)
    number = F.xxhash64(*keys).bitwiseAND((1 << 62) - 1) if number is None else number
    joined = fits.where("coef IS NOT NULL").select(
        *keys, number.cast("bigint").alias("series_no"), "names", "coef", "vcov", "sigma2"
    ).join(states, keys)
    finite = F.forall("ic_mean", lambda v: v.isNotNull() & ~F.isnan(v))
    joined = joined.where(finite)
    fields = _key_fields(joined, keys)
    schema = T.StructType([
        *fields, T.StructField("series_no", T.LongType()), T.StructField("mean", _doubles()),
        T.StructField("factor", _doubles(2)), T.StructField("ic_mean", _doubles()),
        T.StructField("ic_sd", _doubles()), T.StructField("sigma2", T.DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means, factors = [], []
            for r in batch.select(["names", "coef", "vcov"]).to_pylist():
                means.append(_aligned(r["names"], wanted, np.array(r["coef"])).tolist())
                factors.append(cholesky(_aligned(r["names"], wanted, np.array(r["vcov"]))).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in [*keys, "series_no"]),
                    pa.array(means, type=pa.list_(pa.float64())),
                    pa.array(factors, type=pa.list_(pa.list_(pa.float64()))),
                    *(batch.column(c) for c in ("ic_mean", "ic_sd", "sigma2")),
                ],
                names=schema.names,
            )

    return joined.mapInArrow(run, schema)


def series_samples(designs: DataFrame, keys: Sequence[str], samples: int) -> DataFrame:
    """(keys, series_no, sample_id): ids 1..samples of every series, block by block over all tasks."""
    return _blocks(designs.select(*keys, "series_no"), samples).select(
        *keys, "series_no", F.explode(F.sequence("_low", "_high")).alias("sample_id")
    )


def _blocks(designs: DataFrame, samples: int) -> DataFrame:
    starts = F.sequence(F.lit(1).cast("bigint"), F.lit(int(samples)).cast("bigint"), F.lit(BLOCK).cast("bigint"))
    blocks = designs.withColumn("_low", F.explode(starts))
    return spread(blocks.withColumn("_high", F.least(F.col("_low") + (BLOCK - 1), F.lit(int(samples)))))


def member_draws(draws: Draws, members: int, sides: Sequence[str] = ("a", "b")) -> dict[str, Column]:
    """Member columns of a table of (series_no, sample_id)."""
    return {f"{s}_member": draws.index(f"member:{s}", members, "series_no", "sample_id") for s in sides}


def with_forcing(
    designs: DataFrame, drivers: DataFrame, keys: Sequence[str], variables: Sequence[str], horizon: int,
    samples: int, members: int, draws: Draws, sides: Sequence[str] = ("a", "b"), **calendar,
) -> DataFrame:
    """Designs with column ``forcing``, the driver values of every member and lead.

    Gaps are filled as in :func:`foreunc.operators.propagate.forcing_table`, by the mean over the rows that
    the series' own samples drew, whose counts are summed before they are shuffled. ``calendar`` goes
    there too (``first``, ``driver_offset``, ``step``, ``driver_keys``). A row per series holds members x
    horizon values of each variable.
    """
    drawn = series_samples(designs, keys, samples).withColumns(member_draws(draws, members, sides))
    table = propagate.forcing_table(
        drivers, drawn, variables, horizon, keys, [f"{s}_member" for s in sides], **calendar
    )
    entry = F.struct("member", "lead", *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(variables)])
    arrays = table.groupBy(*keys).agg(F.collect_list(entry).alias("_f")).select(
        *keys,
        F.struct(F.col("_f.member").alias("member"), F.col("_f.lead").alias("lead"),
                 *[F.col(f"_f._v{i}").alias(f"v{i}") for i in range(len(variables))]).alias("forcing"),
    )
    return designs.join(arrays, list(keys))


class SeriesBlock:
    """The samples low..high of one series: their inputs, drawn as arrays."""

    def __init__(self, row: dict, variables: Sequence[str], members: int, horizon: int, samples: int, draws: Draws):
        self.variables, self.members, self.samples = list(variables), members, samples
        self.horizon, self.draws = horizon, draws
        self.number, self.sigma2 = row["series_no"], row["sigma2"]
        self.mean, self.factor = np.array(row["mean"]), np.array(row["factor"])
        self.ic_mean, self.ic_sd = np.array(row["ic_mean"]), np.array(row["ic_sd"])
        self.ic_names = ic_names(len(self.ic_mean))
        self.names = parameter_names(len(self.mean) - 1 - len(self.variables), self.variables)
        self.ids = np.arange(row["_low"], row["_high"] + 1)
        self.tables = {}
        forcing = row.get("forcing")
        if forcing:
            at = (np.array(forcing["member"]) - 1, np.array(forcing["lead"]) - 1)
            for i, v in enumerate(self.variables):
                table = np.full((members, horizon), np.nan)
                table[at] = [np.nan if x is None else x for x in forcing[f"v{i}"]]
                self.tables[v] = table

    def parameters(self, tag: str) -> dict[str, np.ndarray]:
        """Coefficients and initial values of the samples on side ``a`` or ``b``."""
        keys = (self.number, self.ids)
        z = np.stack([self.draws.normal_values(f"param:{tag}:{i}", *keys) for i in range(len(self.mean))])
        out = dict(zip(self.names, self.mean[:, None] + self.factor @ z, strict=True))
        for name, mean, sd in zip(self.ic_names, self.ic_mean, self.ic_sd, strict=True):
            out[name] = mean + sd * self.draws.normal_values(f"ic:{tag}:{name}", *keys)
        return out

    def inputs(self, tag: str) -> dict[str, np.ndarray]:
        """All inputs of a side: coefficients, initial values, drivers and noise."""
        keys = (self.number, self.ids)
        out = self.parameters(tag)
        member = np.floor(self.draws.uniform_values(f"member:{tag}", *keys) * self.members).astype(np.int64)
        noise_id = self.ids
        if tag != "a":
            noise_id = np.floor(self.draws.uniform_values(f"noise_row:{tag}", *keys) * self.samples).astype(np.int64) + 1
        for v, table in self.tables.items():
            out[f"met_{v}"] = table.T.take(member, axis=1).T
        out["eps"] = propagate.noise_block(
            self.draws, self.sigma2, noise_id, self.horizon, stream=(self.number,)
        )
        return out

    def paths(self, inputs: dict[str, np.ndarray]) -> np.ndarray:
        return propagate.ar_paths(inputs, self.variables, self.ic_names)


def series_blocks(lags: int, variables: Sequence[str]) -> attribution.Blocks:
    """What counts as one input."""
    out = {name: [name] for name in [*parameter_names(lags, variables), *ic_names(lags)]}
    return {**out, "member": [f"met_{v}" for v in variables], "noise": ["eps"]}


def _per_block(
    rows: DataFrame, keys: Sequence[str], fields: str, samples: int, make: Callable[[dict], pa.RecordBatch]
) -> DataFrame:
    """What ``make`` gives for every block of every series, with its keys."""
    keys = list(keys)
    kinds = T.StructType([*_key_fields(rows, keys), *T._parse_datatype_string(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = batch.select(keys)
            for i in range(batch.num_rows):
                found = make(batch.slice(i, 1).to_pylist()[0])
                repeat = pa.array(np.full(found.num_rows, i))
                yield pa.RecordBatch.from_arrays(
                    [*(head.column(k).take(repeat) for k in keys), *found.columns], names=kinds.names
                )

    return _blocks(rows, samples).mapInArrow(run, kinds)


MOMENTS = "_low bigint, n array<bigint>, mean array<double>, m2 array<double>"


def sobol_of_series(
    designs: DataFrame, keys: Sequence[str], variables: Sequence[str], horizon: int, samples: int,
    members: int, draws: Draws, lags: int = 1, clamp: bool = False,
) -> DataFrame:
    """First and total order indices by (keys, lead, input) of designs :func:`with_forcing`.

    ``lags`` is that of the designs. The inputs are every coefficient and initial value, ``member`` (the drivers) and ``noise``; the estimators
    those of :func:`foreunc.operators.attribution.sobol`. A series gives the same indices as alone with
    its ``series_no`` as the design's ``stream``.
    """
    blocks = series_blocks(lags, variables)
    variants = attribution.sobol_variants(blocks)

    def make(row: dict) -> pa.RecordBatch:
        block = SeriesBlock(row, variables, members, horizon, samples, draws)
        values = {f"{s}_{n}": v for s in ("a", "b") for n, v in block.inputs(s).items()}
        y = {n: block.paths({i: values[c] for i, c in chosen.items()}) for n, chosen in variants.items()}
        return _moment_row(row["_low"], attribution.sobol_terms(y, blocks))

    def found(n: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> list[np.ndarray]:
        return [_variance(n[0], m2[0]), *np.where(n[1:] > 0, mean[1:], np.nan)]

    names = ["v", *(f"{o}_{k}" for k in blocks for o in ("first", "total"))]
    moments = _merged(_per_block(designs, keys, MOMENTS, samples, make), keys, names, horizon, found)
    terms = [(k, F.col(f"first_{k}"), F.col(f"total_{k}")) for k in blocks]
    return attribution.table_of_indices(moments, terms, [*keys, "lead"], clamp)


def one_at_a_time_of_series(
    designs: DataFrame, frozen: DataFrame, keys: Sequence[str], variables: Sequence[str], horizon: int,
    samples: int, members: int, draws: Draws, lags: int = 1,
) -> DataFrame:
    """Variance by (keys, lead) with no source, one source, and all sources of uncertainty.

    Frozen coefficients and initial values sit at the mean of the series' own samples, frozen noise at 0;
    ``frozen`` (keys, and an array over leads per variable) holds the frozen drivers.
    """
    keys, variables = list(keys), list(variables)
    blocks = series_blocks(lags, variables)
    variants = attribution.oat_variants(blocks)
    scalars = [*parameter_names(lags, variables), *ic_names(lags)]

    def sums(row: dict) -> pa.RecordBatch:
        block = SeriesBlock(row, variables, members, horizon, samples, draws)
        found = block.parameters("a")
        return pa.RecordBatch.from_arrays(
            [pa.array([float(found[n].sum())]) for n in scalars], names=scalars
        )

    met = F.array(*[F.col(v) for v in variables]).alias("_frozen")
    rows = designs.join(frozen.select(*keys, met), keys)
    whole = samples <= BLOCK
    if not whole:
        fields = ", ".join(f"`{n}` double" for n in scalars)
        centres = _per_block(designs.drop("forcing"), keys, fields, samples, sums).groupBy(*keys).agg(
            F.array(*[F.sum(f"`{n}`") / samples for n in scalars]).alias("_centre")
        )
        rows = rows.join(centres, keys)

    def make(row: dict) -> pa.RecordBatch:
        block = SeriesBlock(row, variables, members, horizon, samples, draws)
        a = block.inputs("a")
        shape = a["eps"].shape
        # A block that holds the whole series knows its means.
        centre = [a[n].sum() / samples for n in scalars] if whole else row["_centre"]
        b = {n: np.full(shape[0], v) for n, v in zip(scalars, centre, strict=True)}
        b["eps"] = np.zeros(shape)
        for v, values in zip(variables, row["_frozen"], strict=True):
            b[f"met_{v}"] = np.broadcast_to(np.array(values, dtype=float), shape)
        values = {**{f"a_{n}": v for n, v in a.items()}, **{f"b_{n}": v for n, v in b.items()}}
        return _moment_row(
            row["_low"], {n: block.paths({i: values[c] for i, c in chosen.items()}) for n, chosen in variants.items()}
        )

    def found(n: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> list[np.ndarray]:
        return list(_variance(n, m2))

    moments = _merged(_per_block(rows, keys, MOMENTS, samples, make), keys, list(variants), horizon, found)
    return attribution.table_of_variances(moments, variants, [*keys, "lead"])


def forecast_of_series(
    designs: DataFrame, keys: Sequence[str], variables: Sequence[str], horizon: int, samples: int,
    members: int, draws: Draws,
) -> DataFrame:
    """Ensembles (keys, sample_id, y), ``y`` an array over leads 0..horizon, of designs :func:`with_forcing`."""

    def make(row: dict) -> pa.RecordBatch:
        block = SeriesBlock(row, variables, members, horizon, samples, draws)
        y = block.paths(block.inputs("a"))
        ends = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
        paths = pa.ListArray.from_arrays(ends, pa.array(y.ravel(), mask=np.isnan(y.ravel())))
        return pa.RecordBatch.from_arrays([pa.array(block.ids), paths], names=["sample_id", "y"])

    return _per_block(designs, keys, "sample_id bigint, y array<double>", samples, make)


def _moment_row(low: int, terms: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Moments of a block as one row: leads of the first term, then of the next."""
    found = [np.concatenate(x) for x in zip(*(attribution.moments_of(matrix) for matrix in terms.values()))]
    lists = [pa.array([x]) for x in (found[0].astype(np.int64), *found[1:])]
    return pa.RecordBatch.from_arrays([pa.array([low]), *lists], names=["_low", "n", "mean", "m2"])


def _variance(n: np.ndarray, m2: np.ndarray) -> np.ndarray:
    return np.where(n > 1, m2 / np.maximum(n - 1, 1), np.nan)


def _merged(
    partials: DataFrame, keys: Sequence[str], names: Sequence[str], horizon: int,
    found: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]],
) -> DataFrame:
    """(keys, lead, names) from the moments of all blocks of a series, one row a block.

    Means and squares around them are merged as in :func:`foreunc.operators.attribution.merged_moments`;
    ``found`` makes the columns ``names`` of n, mean and m2 (terms x leads). What isn't a number is null.
    """
    keys, names = list(keys), list(names)
    gathered = partials.groupBy(*keys).agg(F.collect_list(F.struct("_low", "n", "mean", "m2")).alias("_blocks"))
    schema = T.StructType([
        *_key_fields(partials, keys), T.StructField("lead", T.IntegerType()),
        *[T.StructField(n, T.DoubleType()) for n in names],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = []
            for blocks in batch.column("_blocks").to_pylist():
                blocks.sort(key=lambda b: b["_low"])
                n, mean, m2 = (np.array([b[c] for b in blocks]) for c in ("n", "mean", "m2"))
                total = n.sum(axis=0)
                centre = (n * mean).sum(axis=0) / np.maximum(total, 1)
                m2 = (m2 + n * (mean - centre) ** 2).sum(axis=0)
                tables.append(np.stack(found(*(x.reshape(-1, horizon + 1) for x in (total, centre, m2)))))
            if not tables:
                continue
            at = pa.array(np.repeat(np.arange(batch.num_rows), horizon + 1))
            values = np.concatenate(tables, axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).take(at) for k in keys),
                    pa.array(np.tile(np.arange(horizon + 1, dtype=np.int32), batch.num_rows)),
                    *(pa.array(v, mask=np.isnan(v)) for v in values),
                ],
                names=schema.names,
            )

    return gathered.mapInArrow(run, schema)


# -- frozen drivers --------------------------------------------------------------------------------


def calendar_arrays(
    by_date: DataFrame, variables: Sequence[str], horizon: int, time: str = "datetime",
    first: Column | None = None, driver_offset: int = 0, step: str = "day",
) -> dict[str, Column]:
    """Per variable the values of one driver row a date as an array over leads 1..horizon, null on a gap."""
    start = by_date.agg(F.min(time)).scalar() if first is None else first
    lead = propagate.steps_between(F.col(time), start, step) + F.lit(1 - int(driver_offset))
    placed = by_date.select(lead.alias("_lead"), *variables).where(F.col("_lead").between(1, int(horizon)))
    found = placed.agg(F.map_from_entries(F.collect_list(F.struct("_lead", F.struct(*variables)))).alias("_m"))
    at = [F.expr(f"transform(sequence(1, {int(horizon)}), k -> _m[k].`{v}`)").alias(v) for v in variables]
    out = found.select(*at)
    return {v: out.select(v).scalar() for v in variables}
