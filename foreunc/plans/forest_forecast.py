"""The random-forest forecast end to end: training table, per-date designs, attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreunc.functions.random import Draws
from foreunc.operators import attribution, prepare
from foreunc.operators.attribution import TableModel
from foreunc.operators.design import bootstrap_rows, named_groups, split_and_shuffle
from foreunc.operators.forest import BaggedTrees, LittleBags, forecast_members

SEED = "parameter_seed"


def training_table(
    targets: DataFrame, drivers: DataFrame, sites: DataFrame, target: str
) -> DataFrame:
    """Observations of one target joined to driver history, complete rows only."""
    active = prepare.active_only(targets.where(F.col("variable") == target), sites)
    wide = prepare.widen(active, ["datetime", "site_id"], [target], value="observation")
    history = prepare.active_only(drivers, sites)
    return prepare.complete_cases(prepare.attach_history(wide, history))


def date_designs(
    drivers: DataFrame, predictors: Sequence[str], size: int, draws: Draws,
    time: str | Sequence[str] = "datetime", order: Sequence[str] = ("parameter",),
) -> DataFrame:
    """A/B pair per date: bootstrap the date's ensemble, add seeds, split, shuffle B by column.

    ``time`` may name several columns, as a site and a date: then every combination is a group.
    """
    drawn = bootstrap_rows(drivers, time, order, predictors, size, draws)
    return split_and_shuffle(drawn, time, predictors, size, draws)


def sobol_by_date(
    pair: DataFrame, predictors: Sequence[str], model: TableModel,
    time: str | Sequence[str] = "datetime", clamp: bool = False,
) -> DataFrame:
    """Indices per date of every driver and the seed, the latter as ``tree_uncertainty`` and last."""
    out = attribution.sobol(pair, _blocks(predictors), model, named_groups(time), clamp=clamp)
    return prepare.order_inputs(out, {SEED: "tree_uncertainty"}, last=SEED)


def forest_sobol_by_date(
    pair: DataFrame, predictors: Sequence[str], model: BaggedTrees | LittleBags, draws: Draws,
    se_method: str | None = None, time: str | Sequence[str] = "datetime", clamp: bool = False,
) -> DataFrame:
    """:func:`sobol_by_date` for a fitted forest with its predictive draw."""
    out = attribution.sobol_by_row(
        pair,
        _blocks(predictors),
        lambda rows: forecast_members(model, rows, draws, se_method),
        named_groups(time),
        clamp=clamp,
    )
    return prepare.order_inputs(out, {SEED: "tree_uncertainty"}, last=SEED)


def _blocks(predictors: Sequence[str]) -> attribution.Blocks:
    return {name: [name] for name in [*predictors, SEED]}
