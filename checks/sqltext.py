"""DuckDB text of the random draws, for the SQL side of the checks."""

from __future__ import annotations

import math

from foreunc.functions.random import FINISH, FOLD, MASK32, POISSON_STEPS, SHIFT, step_constants


def _lane(seed: int, purpose: str, lane: str, keys) -> str:
    state, step = "", 0
    for key in keys:
        key = f"CAST({key} AS BIGINT)"
        for word in (f"({key} & {MASK32})", f"({key} >> 32)"):
            mult, offset = step_constants(seed, purpose, lane, step)
            mixed = f"xor({state}, {word})" if step else word
            state = f"((({mixed} * {mult} + {offset}) >> {SHIFT}) & {MASK32})"
            step += 1
    for _ in range(FINISH):
        mult, offset = step_constants(seed, purpose, lane, step)
        folded = f"xor({state}, ({state} >> {FOLD}))"
        state = f"((({folded} * {mult} + {offset}) >> {SHIFT}) & {MASK32})"
        step += 1
    return state


def uniform(purpose: str, *keys: str, seed: int = 42) -> str:
    high, low = _lane(seed, purpose, "a", keys), _lane(seed, purpose, "b", keys)
    return f"(({high} * {1 << 20} + ({low} >> 12) + 0.5::DOUBLE) / {1 << 52}::DOUBLE)"


def normal(purpose: str, *keys: str, seed: int = 42) -> str:
    high, low = _lane(seed, purpose, "a", keys), _lane(seed, purpose, "c", keys)
    u1 = f"(({high} * {1 << 20} + ({low} >> 12) + 0.5::DOUBLE) / {1 << 52}::DOUBLE)"
    u2 = f"(({_lane(seed, purpose, 'b', keys)} + 0.5::DOUBLE) / {1 << 32}::DOUBLE)"
    return f"(sqrt(-2.0::DOUBLE * ln({u1})) * cos({2 * math.pi!r}::DOUBLE * {u2}))"


def index(purpose: str, size, *keys: str, seed: int = 42) -> str:
    return f"(CAST(floor({uniform(purpose, *keys, seed=seed)} * {size}) AS BIGINT) + 1)"


def poisson_one(purpose: str, *keys: str, seed: int = 42) -> str:
    u, total, parts = uniform(purpose, *keys, seed=seed), 0.0, []
    for k in range(POISSON_STEPS):
        total += math.exp(-1.0) / math.factorial(k)
        parts.append(f"(CASE WHEN {u} > {total!r}::DOUBLE THEN 1 ELSE 0 END)")
    return "(" + " + ".join(parts) + ")"
