"""Variance attribution: one-at-a-time and Sobol indices by lead (or any other group).

Input is a *pair* table: one row per sample (and group) with side A in ``a_*`` and side B in
``b_*`` columns. ``blocks`` maps an input name to the columns that are swapped together, so a whole
correlated block (all drivers of a member, a noise sequence) counts as one input.

Two kinds of model are accepted:

* a table model ``model(df, inputs, out) -> df`` that adds column ``out`` computed from the columns
  named in ``inputs`` (see :func:`column_model` for models written as a column expression);
* an array model ``model(inputs) -> matrix (samples x leads)`` for recursions in time, run on Arrow
  batches; each batch is reduced to moments per lead before it leaves the worker.

Both evaluate all p+2 variants of a row together, so the ensemble is never shuffled: the only
exchange carries partial sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreunc.functions.scalar import clamp_negative
from foreunc.operators.propagate import column_values

TableModel = Callable[[DataFrame, dict[str, str], str], DataFrame]
ArrayModel = Callable[[dict[str, np.ndarray]], np.ndarray]
Blocks = dict[str, Sequence[str]]


def column_model(build: Callable[[dict[str, Column]], Column]) -> TableModel:
    """Table model from a function of columns."""

    def column(inputs: dict[str, str]) -> Column:
        return build({name: F.col(c) for name, c in inputs.items()})

    def model(df: DataFrame, inputs: dict[str, str], out: str) -> DataFrame:
        return df.withColumn(out, column(inputs))

    model.column = column
    return model


def _choices(blocks: Blocks, base: str, swapped: str | None = None) -> dict[str, str]:
    """Source column of every input: side ``base``, except one block from the other side."""
    other = "b" if base == "a" else "a"
    return {
        column: f"{other if block == swapped else base}_{column}"
        for block, columns in blocks.items()
        for column in columns
    }


def sobol_variants(blocks: Blocks) -> dict[str, dict[str, str]]:
    variants = {"a": _choices(blocks, "a"), "b": _choices(blocks, "b")}
    variants.update({f"ab_{k}": _choices(blocks, "a", k) for k in blocks})
    return variants


def oat_variants(blocks: Blocks) -> dict[str, dict[str, str]]:
    variants = {"none": _choices(blocks, "b"), "all": _choices(blocks, "a")}
    variants.update({f"only_{k}": _choices(blocks, "b", k) for k in blocks})
    return variants


# -- table models ----------------------------------------------------------------------------------


def _evaluate(pair: DataFrame, variants, model: TableModel, shared: Sequence[str]) -> DataFrame:
    named = {f"y_{n}": {**inputs, **{c: c for c in shared}} for n, inputs in variants.items()}
    if hasattr(model, "column"):
        return pair.withColumns({out: model.column(inputs) for out, inputs in named.items()})
    for out, inputs in named.items():
        pair = model(pair, inputs, out)
    return pair


def sobol(
    pair: DataFrame,
    blocks: Blocks,
    model: TableModel,
    groups: Sequence[str] = ("lead",),
    shared: Sequence[str] = (),
    clamp: bool = False,
) -> DataFrame:
    """First and total order indices (Jansen) per group and input.

    ``V = var(y_A)``; ``S_i = 1 - mean((y_B - y_ABi)^2) / 2V``; ``T_i = mean((y_A - y_ABi)^2) / 2V``
    with AB_i = A with block i from B. Zero variance gives null. ``shared`` names columns that are
    not inputs but that the model reads.
    """
    rows = _evaluate(pair, sobol_variants(blocks), model, shared)
    return _table_indices(rows, blocks, groups, clamp)


def sobol_by_row(
    pair: DataFrame,
    blocks: Blocks,
    model: Callable[[DataFrame], DataFrame],
    groups: Sequence[str],
    key: str = "sample_id",
    clamp: bool = False,
) -> DataFrame:
    """:func:`sobol` for a model that is costly to put into a plan, such as a fitted forest.

    ``model(rows)`` sees one row per variant, with the plain input names, and adds ``y``: it enters
    the plan once, not once per variant. ``(groups, key)`` identifies a sample. When the pair is
    already partitioned by these columns, bringing a sample's variants back together needs no
    exchange.
    """
    variants = sobol_variants(blocks)
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("variant"), *[F.col(c).alias(i) for i, c in inputs.items()]
            )
            for name, inputs in variants.items()
        ]
    )
    scored = model(pair.select(*groups, key, F.inline(entries)))
    together = scored.groupBy(*groups, key).agg(
        *[F.max(F.when(F.col("variant") == v, F.col("y"))).alias(f"y_{v}") for v in variants]
    )
    return _table_indices(together, blocks, groups, clamp)


def _table_indices(rows: DataFrame, blocks: Blocks, groups, clamp: bool) -> DataFrame:
    def gap(side, k):
        d = F.col(f"y_{side}") - F.col(f"y_ab_{k}")
        return F.avg(d * d)

    moments = rows.groupBy(*groups).agg(
        F.var_samp("y_a").alias("v"),
        *[gap("b", k).alias(f"first_{k}") for k in blocks],
        *[gap("a", k).alias(f"total_{k}") for k in blocks],
    )
    terms = [(k, F.col(f"first_{k}"), F.col(f"total_{k}")) for k in blocks]
    return table_of_indices(moments, terms, groups, clamp)


def table_of_indices(moments: DataFrame, terms, groups, clamp: bool) -> DataFrame:
    v = F.when(F.col("v") > 0, F.col("v"))
    entries = F.array(
        *[
            F.struct(
                F.lit(k).alias("input"),
                (1.0 - first / (2.0 * v)).alias("first_order"),
                (total / (2.0 * v)).alias("total_order"),
            )
            for k, first, total in terms
        ]
    )
    out = moments.select(*groups, F.inline(entries))
    return clamp_indices(out) if clamp else out


def clamp_indices(indices: DataFrame) -> DataFrame:
    """Small negative estimates become 0."""
    return indices.withColumns(
        {c: clamp_negative(c) for c in ("first_order", "total_order") if c in indices.columns}
    )


def with_interaction(indices: DataFrame) -> DataFrame:
    """Share of an input that acts through interactions: total minus first order."""
    return indices.withColumn("interaction", F.col("total_order") - F.col("first_order"))


def one_at_a_time(
    pair: DataFrame,
    blocks: Blocks,
    model: TableModel,
    groups: Sequence[str] = ("lead",),
    shared: Sequence[str] = (),
) -> DataFrame:
    """Variance with nothing, exactly one source, and everything uncertain.

    Side A holds the samples, side B the frozen values. Rows: source ``none``, one per block,
    ``all``; ``share`` is the part of the variance of ``all``.
    """
    variants = oat_variants(blocks)
    rows = _evaluate(pair, variants, model, shared)
    moments = rows.groupBy(*groups).agg(*[F.var_samp(f"y_{n}").alias(n) for n in variants])
    return table_of_variances(moments, variants, groups)


def table_of_variances(moments: DataFrame, variants, groups) -> DataFrame:
    whole = F.when(F.col("all") > 0, F.col("all"))
    entries = F.array(
        *[
            F.struct(
                F.lit(name.removeprefix("only_")).alias("source"),
                F.col(name).alias("variance"),
                (F.col(name) / whole).alias("share"),
            )
            for name in variants
        ]
    )
    return moments.select(*groups, F.inline(entries))


def frozen_side(
    samples: DataFrame, columns: Sequence[str], zero: Sequence[str] = ()
) -> DataFrame:
    """Pair for :func:`one_at_a_time`: A = the samples, B = whole-table means (or zero)."""
    means = samples.agg(*[F.avg(c).alias(c) for c in columns])
    side_b = {f"b_{c}": means.select(c).scalar() for c in columns}
    side_b.update({f"b_{c}": F.lit(0.0) for c in zero})
    renamed = samples.withColumnsRenamed({c: f"a_{c}" for c in [*columns, *zero]})
    return renamed.withColumns(side_b)


# -- array models ----------------------------------------------------------------------------------


def moments_of(matrix: np.ndarray):
    if len(matrix) and not np.isnan(matrix).any():
        mean = matrix.sum(axis=0) / len(matrix)
        return np.full(matrix.shape[1], len(matrix)), mean, ((matrix - mean) ** 2).sum(axis=0)
    present = ~np.isnan(matrix)
    n = present.sum(axis=0)
    mean = np.where(present, matrix, 0.0).sum(axis=0) / np.maximum(n, 1)
    return n, mean, np.where(present, (matrix - mean) ** 2, 0.0).sum(axis=0)


def _combine(left, right):
    """Moments of two disjoint sets together."""
    (n1, mean1, m1), (n2, mean2, m2) = left, right
    n = n1 + n2
    d = mean2 - mean1
    safe = np.maximum(n, 1)
    return n, mean1 + d * n2 / safe, m1 + m2 + d * d * n1 * n2 / safe


def moment_rows(term: str, n: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> pa.RecordBatch:
    """Moments of a term, one row per lead."""
    columns = [[term] * len(n), np.arange(len(n), dtype=np.int32), n.astype(np.int64), mean, m2]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["term", "lead", "n", "mean", "m2"])


def _partial_moments(
    pair: DataFrame,
    variants: dict[str, dict[str, str]],
    model: ArrayModel,
    prepare: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]] | None,
    terms: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]],
) -> DataFrame:
    """(term, lead, n, mean, m2), one row per task: exact pieces of mean and variance."""
    schema = "term string, lead int, n bigint, mean double, m2 double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values = {n: column_values(batch, n) for n in batch.schema.names}
            if prepare:
                values = prepare(values)
            outputs = {
                name: model({i: values[c] for i, c in inputs.items()})
                for name, inputs in variants.items()
            }
            for name, matrix in terms(outputs).items():
                new = moments_of(matrix)
                state[name] = _combine(state[name], new) if name in state else new
        for name, found in state.items():
            yield moment_rows(name, *found)

    return pair.mapInArrow(run, schema)


def merged_moments(partials: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Merge partial moments: M2 of all = inner M2 + spread of the partial means around the mean.

    The window and the aggregate share one exchange, of one row per task, term and lead.
    """
    n, mean = F.col("n"), F.col("mean")
    cell = Window.partitionBy(*keys, "term", "lead")
    centred = partials.withColumn("mean_all", F.try_divide(F.sum(n * mean).over(cell), F.sum("n").over(cell)))
    d = mean - F.col("mean_all")
    return centred.groupBy(*keys, "term", "lead").agg(
        F.sum("n").alias("n"),
        F.first("mean_all").alias("mean"),
        F.sum(F.col("m2") + n * d * d).alias("m2"),
    )


def sobol_paths(
    pair: DataFrame,
    blocks: Blocks,
    model: ArrayModel,
    prepare: Callable | None = None,
    clamp: bool = False,
) -> DataFrame:
    """:func:`sobol` by lead for an array model; ``prepare`` derives arrays once per batch."""
    variants = sobol_variants(blocks)
    partials = _partial_moments(pair, variants, model, prepare, lambda y: sobol_terms(y, blocks))
    return path_indices(merged_moments(partials), blocks, clamp)


def sobol_terms(y: dict[str, np.ndarray], blocks: Blocks) -> dict[str, np.ndarray]:
    """What the estimators average, from the outputs of all variants."""
    out = {"v": y["a"]}
    for k in blocks:
        out[f"first_{k}"] = (y["b"] - y[f"ab_{k}"]) ** 2
        out[f"total_{k}"] = (y["a"] - y[f"ab_{k}"]) ** 2
    return out


def path_indices(
    merged: DataFrame, blocks: Blocks, clamp: bool = False, keys: Sequence[str] = ()
) -> DataFrame:
    """Index table by (keys, lead) from merged moments."""
    pick = F.col("term")
    moments = merged.groupBy(*keys, "lead").agg(
        F.max(F.when(pick == "v", F.col("m2") / (F.col("n") - 1))).alias("v"),
        *[
            F.max(F.when(pick == f"{o}_{k}", F.col("mean"))).alias(f"{o}_{k}")
            for k in blocks
            for o in ("first", "total")
        ],
    )
    terms_out = [(k, F.col(f"first_{k}"), F.col(f"total_{k}")) for k in blocks]
    return table_of_indices(moments, terms_out, [*keys, "lead"], clamp)


def one_at_a_time_paths(
    pair: DataFrame, blocks: Blocks, model: ArrayModel, prepare: Callable | None = None
) -> DataFrame:
    """:func:`one_at_a_time` by lead for an array model."""
    variants = oat_variants(blocks)
    return path_variances(merged_moments(_partial_moments(pair, variants, model, prepare, lambda y: y)), blocks)


def path_variances(merged: DataFrame, blocks: Blocks, keys: Sequence[str] = ()) -> DataFrame:
    """Variance rows by (keys, lead) from merged moments of all one-at-a-time variants."""
    variants = oat_variants(blocks)
    variance = F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1))
    moments = merged.groupBy(*keys, "lead").agg(
        *[F.max(F.when(F.col("term") == n, variance)).alias(n) for n in variants]
    )
    return table_of_variances(moments, variants, [*keys, "lead"])
