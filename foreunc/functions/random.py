"""Reproducible random draws as column expressions.

Every draw is a pure function of ``(seed, purpose, keys)``: no state, no partition index. A task
that is re-run after an executor loss, or a plan with another number of partitions, gives the same
numbers. Spark's own ``rand``/``randn`` depend on the partition layout and are never used.

The generator is a chain of multiply-add steps in 64-bit integers that keeps the middle 32 bits of
each product, closed by two steps that first fold the state onto itself (without the folds the
chain is nearly linear and fails serial-correlation tests). It needs no overflow, stays inside
whole-stage code generation, and can be written in any SQL engine with 64-bit integers. Two chains with independent constants ("lanes") make one
draw: 52 bits for a uniform, 2 x 32 bits for a Box-Muller normal.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
SHIFT = 15
FOLD = 16
FINISH = 2


def step_constants(seed: int, purpose: str, lane: str, step: int) -> tuple[int, int]:
    """Odd multiplier below 2^30 and offset below 2^62, so that ``h * c + d`` fits a bigint."""
    digest = hashlib.sha256(f"{seed}:{purpose}:{lane}:{step}".encode()).digest()
    multiplier = (int.from_bytes(digest[:4], "big") >> 3) | (1 << 29) | 1
    offset = int.from_bytes(digest[8:16], "big") >> 2
    return multiplier, offset


class Draws:
    """Family of draws under one seed.

    Keys are columns or SQL expressions with non-negative integer values, given as text; they are
    absorbed in order, low and high half of each. A draw is built as one SQL expression: composing
    it call by call through the JVM gateway would take a hundred times longer.
    """

    def __init__(self, seed: int = 42):
        self.seed = int(seed)
        self._steps: dict[tuple, tuple[int, int]] = {}

    def _constants(self, purpose: str, lane: str, step: int) -> tuple[int, int]:
        at = (purpose, lane, step)
        if at not in self._steps:
            self._steps[at] = step_constants(self.seed, purpose, lane, step)
        return self._steps[at]

    def _lane(self, purpose: str, lane: str, keys) -> str:
        state, step = "", 0
        for key in keys:
            key = f"cast({key} as bigint)"
            for word in (f"({key} & {MASK32})", f"shiftright({key}, 32)"):
                mult, offset = step_constants(self.seed, purpose, lane, step)
                mixed = f"({state} ^ {word})" if step else word
                state = f"(shiftright({mixed} * {mult}L + {offset}L, {SHIFT}) & {MASK32})"
                step += 1
        for _ in range(FINISH):
            mult, offset = step_constants(self.seed, purpose, lane, step)
            folded = f"({state} ^ shiftright({state}, {FOLD}))"
            state = f"(shiftright({folded} * {mult}L + {offset}L, {SHIFT}) & {MASK32})"
            step += 1
        return state

    def uniform(self, purpose: str, *keys: str) -> Column:
        """Uniform on the open interval (0, 1), 52 bits."""
        high, low = self._lane(purpose, "a", keys), self._lane(purpose, "b", keys)
        return F.expr(f"({high} * {1 << 20}L + shiftright({low}, 12) + 0.5D) / {float(1 << 52)!r}D")

    def normal(self, purpose: str, *keys: str) -> Column:
        """Standard normal (Box-Muller)."""
        # The radius takes the 52 bits of a uniform, so that draws reach beyond 8 deviations.
        high, low = self._lane(purpose, "a", keys), self._lane(purpose, "c", keys)
        u1 = f"(({high} * {1 << 20}L + shiftright({low}, 12) + 0.5D) / {float(1 << 52)!r}D)"
        u2 = f"(({self._lane(purpose, 'b', keys)} + 0.5D) / {float(1 << 32)!r}D)"
        return F.expr(f"sqrt(-2.0D * ln({u1})) * cos({2.0 * math.pi!r}D * {u2})")

    def index(self, purpose: str, size, *keys: str) -> Column:
        """Integer 1..size, drawn with replacement. ``size`` is a number or a column."""
        size = size if isinstance(size, Column) else F.lit(size)
        return F.floor(self.uniform(purpose, *keys) * size).cast("bigint") + F.lit(1).cast("bigint")

    # -- the same draws for arrays inside an Arrow batch -------------------------------------

    def _lane_values(self, purpose: str, lane: str, keys) -> np.ndarray:
        state, step = None, 0
        for key in keys:
            key = np.asarray(key, dtype=np.int64)
            for word in (key & MASK32, key >> 32):
                mult, offset = self._constants(purpose, lane, step)
                mixed = word if state is None else state ^ word
                state = ((mixed * mult + offset) >> SHIFT) & MASK32
                step += 1
        for _ in range(FINISH):
            mult, offset = self._constants(purpose, lane, step)
            folded = state ^ (state >> FOLD)
            state = ((folded * mult + offset) >> SHIFT) & MASK32
            step += 1
        return state

    def normal_values(self, purpose: str, *keys) -> np.ndarray:
        """Standard normals for broadcastable integer arrays; equals :meth:`normal` row by row."""
        high, low = self._lane_values(purpose, "a", keys), self._lane_values(purpose, "c", keys)
        u1 = (high * (1 << 20) + (low >> 12) + 0.5) / float(1 << 52)
        u2 = (self._lane_values(purpose, "b", keys) + 0.5) / float(1 << 32)
        return np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * math.pi * u2)

    def uniform_values(self, purpose: str, *keys) -> np.ndarray:
        """Uniforms for broadcastable integer arrays; equals :meth:`uniform` row by row."""
        high = self._lane_values(purpose, "a", keys)
        low = self._lane_values(purpose, "b", keys)
        return (high * (1 << 20) + (low >> 12) + 0.5) / float(1 << 52)


#: P(count > 18) is below 2^-52.
POISSON_STEPS = 18


def poisson_one(u: str) -> Column:
    """Poisson(1) count of a uniform column by inverse distribution function.

    The steps end where the mass beyond is less than the uniform resolves. Take ``u`` from a column
    of an earlier projection: it is read once per step.
    """
    total, steps = 0.0, []
    for k in range(POISSON_STEPS):
        total += math.exp(-1.0) / math.factorial(k)
        steps.append(f"cast({u} > {total!r}D as int)")
    return F.expr(" + ".join(steps))
