"""Sampling designs: parameters, initial conditions, ensemble members and noise rows.

A design column is an expression of ``sample_id`` (and a seed), so a design of any size is one
narrow projection over the table of ids: no shuffle and nothing positional.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreunc.functions.random import Draws
from foreunc.session import compiled_stages

# Half-width of the central 68 % interval of a standard normal.
HALF_WIDTH_68 = 0.994457883209753


@dataclass(frozen=True)
class DesignSpec:
    """What is uncertain: a fitted model's coefficients and covariance, the initial state, the
    number of driver ensemble members and the number of noise rows."""

    names: Sequence[str]
    mean: Sequence[float]
    cov: Sequence[Sequence[float]]
    ic_mean: Sequence[float]
    ic_sd: Sequence[float]
    members: int
    sigma2: float
    noise_rows: int | Column
    #: Initial values, the oldest first; as many as the recursion has lags.
    ic_names: Sequence[str] = field(default=("ic",))
    #: Number of the series whose draws these are, so that many series differ; none for a single one.
    stream: tuple[int, ...] = ()
    #: Standard deviations of the coefficients between series, in the order of ``names``; none for a fitted series.
    effect_sd: Sequence[float] = ()
    #: Variance of the error of observation, which adds to the state without entering it.
    observation_sigma2: float = 0.0

    @property
    def columns(self) -> list[str]:
        return [*self.scalars, "member", "noise_id", *(["obs_id"] if self.observation_sigma2 else [])]

    @property
    def scalars(self) -> list[str]:
        """Coefficients, random effects (``u_<coefficient>``) and initial values."""
        return [*self.names, *(f"u_{n}" for n, _ in zip(self.names, self.effect_sd)), *self.ic_names]


def normal_draws(
    draws: Draws, purpose: str, names: Sequence[str], mean, cov, *keys
) -> dict[str, Column]:
    """Multivariate normal columns: mean plus lower Cholesky factor times hash normals."""
    factor = cholesky(cov)
    z = [draws.normal(f"{purpose}:{i}", *keys) for i in range(len(names))]
    out = {}
    for i, name in enumerate(names):
        value = F.lit(float(mean[i]))
        for j in range(i + 1):
            if factor[i, j] != 0.0:
                value = value + F.lit(float(factor[i, j])) * z[j]
        out[name] = value
    return out


def cholesky(cov) -> np.ndarray:
    """Lower factor of a covariance; zero variances are allowed."""
    cov = np.asarray(cov, dtype=float)
    keep = np.flatnonzero(np.diag(cov) > 0)
    factor = np.zeros_like(cov)
    if len(keep):
        factor[np.ix_(keep, keep)] = np.linalg.cholesky(cov[np.ix_(keep, keep)])
    return factor


def interval_sd(lower, upper) -> Column:
    """Initial-state sd from a 68 % forecast interval: half its width."""
    return (F.col(upper) - F.col(lower)) / 2.0


def initial_state(sigma2: float) -> float:
    """Initial-state sd of a fit with innovation variance ``sigma2``."""
    return HALF_WIDTH_68 * float(np.sqrt(sigma2))


def spread(samples: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal a table of sample ids to ``partitions`` parts, by default one per core.

    A sample costs far more to simulate than to send, and a few-partition id table would leave most
    cores idle.
    """
    return samples.repartition(partitions or samples.sparkSession.sparkContext.defaultParallelism)


def design_columns(spec: DesignSpec, draws: Draws, matrix: str, key: str = "sample_id"):
    """Column expressions of matrix ``A`` or ``B``.

    In A the noise row is the sample's own id; in B it is drawn with replacement, so that swapping
    the column swaps the whole noise sequence.
    """
    tag = matrix.lower()
    keys = [*(str(number) for number in spec.stream), key]
    out = normal_draws(draws, f"param:{tag}", spec.names, spec.mean, spec.cov, *keys)
    for name, sd in zip(spec.names, spec.effect_sd):
        out[f"u_{name}"] = F.lit(float(sd)) * draws.normal(f"effect:{tag}:{name}", *keys)
    for name, mu, sd in zip(spec.ic_names, spec.ic_mean, spec.ic_sd):
        z = draws.normal(f"ic:{tag}:{name}", *keys)
        out[name] = F.lit(float(mu)) + F.lit(float(sd)) * z
    out["member"] = draws.index(f"member:{tag}", spec.members, *keys)
    out["noise_id"] = (
        F.col(key) if tag == "a" else draws.index(f"noise_row:{tag}", spec.noise_rows, *keys)
    )
    if spec.observation_sigma2:
        row = draws.index(f"observation_row:{tag}", spec.noise_rows, *keys)
        out["obs_id"] = F.col(key) if tag == "a" else row
    return out


def design_matrix(
    samples: DataFrame, spec: DesignSpec, draws: Draws, matrix: str = "A", key: str = "sample_id"
) -> DataFrame:
    """One design row per id of ``samples``."""
    compiled_stages(samples.sparkSession)
    return samples.withColumns(design_columns(spec, draws, matrix, key))


def design_pair(
    samples: DataFrame, spec: DesignSpec, draws: Draws, key: str = "sample_id"
) -> DataFrame:
    """Both matrices side by side, columns ``a_*`` and ``b_*``."""
    compiled_stages(samples.sparkSession)
    columns = {
        f"{m}_{name}": expr
        for m in ("a", "b")
        for name, expr in design_columns(spec, draws, m, key).items()
    }
    return samples.withColumns(columns)


# -- resampling designs inside groups ------------------------------------------------------------


def row_numbers(
    df: DataFrame,
    groups: Sequence[str],
    order: Column,
    ties: Sequence[str],
    name: str = "position",
    slices: int = 32,
) -> DataFrame:
    """Rank 1..n inside each group by a *uniform* (0, 1) expression, ties by the columns ``ties``.

    Every group is cut into equal slices of (0, 1), ranked per slice and shifted by the counts of
    the slices before, so that no group ends up in one task. With ``ties`` that name a row, a task
    that runs again gives the same ranks.
    """
    df = df.withColumn("_u", order).withColumn("_slice", F.floor(F.col("_u") * slices))
    counts = df.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy(*groups, "_slice").orderBy("_u", *ties)
    return (
        df.withColumn(name, F.row_number().over(inside))
        .join(offsets.drop("_n"), [*groups, "_slice"])
        .withColumn(name, F.col(name) + F.col("_offset"))
        .drop("_u", "_slice", "_offset")
    )


def group_keys(df: DataFrame, groups: Sequence[str]) -> list[str]:
    """Integer expressions that draws take a group by: days, integers as they are, hashes of others."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    whole = ("byte", "short", "integer", "long")
    return [
        f"unix_date({g})" if kinds[g] == "date" else f"{g}" if kinds[g] in whole else f"(xxhash64({g}) & {(1 << 62) - 1}L)"
        for g in groups
    ]


def named_groups(groups: str | Sequence[str]) -> list[str]:
    """One group column, or several that make a key together."""
    return [groups] if isinstance(groups, str) else list(groups)


def numbered(
    df: DataFrame, keys: str | Sequence[str], size: int, name: str, chunk: int = 100_000
) -> DataFrame:
    """Every row of ``df`` repeated with numbers 1..size.

    A long run is cut into chunks that are spread over the cluster before they are written out.
    """
    starts = F.sequence(F.lit(1), F.lit(int(size)), F.lit(chunk))
    chunked = df.withColumn("_start", F.explode(starts))
    chunked = chunked.repartition(*named_groups(keys), "_start")
    last = F.least(F.col("_start") + (chunk - 1), F.lit(int(size)))
    return chunked.withColumn(name, F.explode(F.sequence(F.col("_start"), last))).drop("_start")


def bootstrap_rows(
    rows: DataFrame,
    group: str | Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    size: int,
    draws: Draws,
) -> DataFrame:
    """``size`` rows per group (a date, or a site and date) drawn with replacement.

    ``rows`` holds one ensemble per group (a few members); draw ``k`` of a group picks position
    ``floor(u * count) + 1`` and looks the row up by (group, position).
    """
    groups = named_groups(group)
    w = Window.partitionBy(*groups).orderBy(*order)
    placed = rows.select(*groups, *columns, F.row_number().over(w).alias("_pos"))
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_count"))
    picks = numbered(sizes, groups, size, "draw").withColumn(
        "_pos", draws.index("bootstrap", F.col("_count"), *group_keys(rows, groups), "draw")
    )
    return picks.join(placed, [*groups, "_pos"]).drop("_pos", "_count")


def split_and_shuffle(
    drawn: DataFrame, group: str | Sequence[str], columns: Sequence[str], size: int, draws: Draws
) -> DataFrame:
    """A/B design from bootstrapped rows, columns ``a_*`` and ``b_*``, key (group, sample_id).

    A seed column ``parameter_seed`` (random permutation of 1..size) is added; rows with the lower
    half of the seeds form A and stay as they are, the upper half forms B and every column of it is
    permuted on its own, which breaks the correlation between inputs.
    """
    if size % 2:
        raise ValueError("size must be even: both halves need the same number of rows")
    half = size // 2
    groups = named_groups(group)
    keys = group_keys(drawn, groups)
    seeded = row_numbers(
        drawn, groups, draws.uniform("permutation", *keys, "draw"), ["draw"], "parameter_seed"
    )
    names = [*columns, "parameter_seed"]
    side_a = seeded.where(F.col("parameter_seed") <= half).select(
        *groups,
        F.col("parameter_seed").alias("sample_id"),
        *[F.col(c).cast("double").alias(f"a_{c}") for c in names],
    )
    entry = F.array(
        *[
            F.struct(
                F.lit(c).alias("input"),
                F.col(c).cast("double").alias("value"),
                draws.uniform(f"shuffle:{c}", *keys, "parameter_seed").alias("u"),
            )
            for c in names
        ]
    )
    long_b = seeded.where(F.col("parameter_seed") > half).select(*groups, "parameter_seed", F.inline(entry))
    ranked = row_numbers(long_b, [*groups, "input"], F.col("u"), ["parameter_seed"], "sample_id")
    side_b = ranked.groupBy(*groups, "sample_id").agg(
        *[F.max(F.when(F.col("input") == c, F.col("value"))).alias(f"b_{c}") for c in names]
    )
    return side_a.join(side_b, [*groups, "sample_id"])
