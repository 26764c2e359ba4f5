"""Random draws as pure functions of keys, so results never depend on partitioning.

Every function returns SQL text: a draw is one expression over key columns.
"""

from __future__ import annotations

import math

HASH_MODULUS = 2147483647


def stable_hash(text: str) -> str:
    """First eight hex digits of MD5, modulo 2**31 - 1."""
    return f"(CAST(conv(substring(md5({text}), 1, 8), 16, 10) AS BIGINT) % {HASH_MODULUS})"


def hash_of(op: str, seed: int, *keys: str) -> str:
    return stable_hash(f"concat_ws('|', '{op}', '{seed}', {', '.join(f'CAST({k} AS STRING)' for k in keys)})")


def uniform(op: str, seed: int, *keys: str) -> str:
    """Uniform double in [0, 1) keyed by operation, seed and row keys."""
    return f"({hash_of(op, seed, *keys)} / {HASH_MODULUS}D)"


def uniform_int(op: str, seed: int, low, high, *keys: str) -> str:
    """Uniform integer in [low, high], both ends included."""
    return f"CAST(({low}) + floor({uniform(op, seed, *keys)} * (({high}) - ({low}) + 1)) AS INT)"


def normal(op: str, seed: int, *keys: str) -> str:
    """Standard normal by the Box-Muller transform of two keyed uniforms."""
    u, v = uniform(op + ".a", seed, *keys), uniform(op + ".b", seed, *keys)
    return f"(sqrt(-2D * ln(1D - {u})) * cos(2 * pi() * {v}))"


def nonzero_offset(op: str, seed: int, spread: int, sigma: float, *keys: str) -> str:
    """Rounded normal clipped to +-spread, given that it is not zero."""
    return discrete(nonzero_offset_cdf(spread, sigma), uniform(op, seed, *keys))


def discrete(cdf: list[tuple[int, float]], u: str) -> str:
    """Inverse CDF of a finite distribution at u."""
    whens = " ".join(f"WHEN {u} < {upto!r}D THEN {value}" for value, upto in cdf[:-1])
    return f"(CASE {whens} ELSE {cdf[-1][0]} END)" if whens else str(cdf[-1][0])


def phi(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def rounded_normal(mean: float, sigma: float, low: int, high: int, clip: bool) -> dict[int, float]:
    """Mass of round(N(mean, sigma)) on low..high; tails are folded into the ends when clipped."""
    mass = {}
    for k in range(low, high + 1):
        a = 0.0 if clip and k == low else phi((k - 0.5 - mean) / sigma)
        b = 1.0 if clip and k == high else phi((k + 0.5 - mean) / sigma)
        mass[k] = b - a
    return mass


def cumulated(mass: dict[int, float]) -> list[tuple[int, float]]:
    total = sum(mass.values())
    out, acc = [], 0.0
    for k in sorted(mass):
        acc += mass[k] / total
        out.append((k, round(acc, 12)))
    return out


def nonzero_offset_cdf(spread: int, sigma: float) -> list[tuple[int, float]]:
    """(value, cumulative probability) of the clipped rounded normal given it is not zero."""
    mass = rounded_normal(0.0, sigma, -spread, spread, clip=True)
    mass.pop(0)
    return cumulated(mass)


def poisson_cdf(lam: float) -> list[tuple[int, float]]:
    """max(1, Poisson(lam)) as (value, cumulative probability)."""
    mass: dict[int, float] = {}
    top = max(24, math.ceil(lam + 12 * math.sqrt(lam) + 12))  # the tail beyond is below rounding
    p = math.exp(-lam)
    for k in range(top + 1):
        mass[max(1, k)] = mass.get(max(1, k), 0.0) + p
        p *= lam / (k + 1)
    return cumulated(mass)
