"""Scalar and aggregate column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: offset between Kelvin and Celsius.
KELVIN_OFFSET = 273.15


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def kelvin_to_celsius(x) -> Column:
    return _col(x) - F.lit(KELVIN_OFFSET)


def box_cox(x, lam: float) -> Column:
    """``(x^lam - 1) / lam``; the logarithm at ``lam = 0``."""
    return F.ln(_col(x)) if lam == 0 else (F.pow(_col(x), F.lit(lam)) - 1.0) / F.lit(lam)


def inverse_box_cox(x, lam: float, shift: float = 0.0) -> Column:
    """Inverse of :func:`box_cox`, minus ``shift``."""
    back = F.exp(_col(x)) if lam == 0 else F.pow(_col(x) * lam + 1.0, F.lit(1.0 / lam))
    return back - shift if shift else back


def clamp_negative(x) -> Column:
    """Negative values become 0; null stays null."""
    return F.when(_col(x) < 0, F.lit(0.0)).otherwise(_col(x))


def strict_mean(x) -> Column:
    """Mean that is null as soon as one value of the group is null."""
    x = _col(x)
    return F.when(F.count(F.lit(1)) == F.count(x), F.avg(x))


def strict_mean_where(condition: Column, x) -> Column:
    """:func:`strict_mean` over the rows that satisfy ``condition``."""
    x = F.when(condition, _col(x))
    return F.when(F.count_if(condition) == F.count(x), F.avg(x))


def rmse(prediction, truth) -> Column:
    d = _col(prediction) - _col(truth)
    return F.sqrt(F.avg(d * d))


def theme_flag(theme: str) -> str:
    """Metadata flag of a theme; both terrestrial themes share one flag."""
    return "terrestrial" if theme.startswith("terrestrial") else theme
