"""The draws of mechanisms.drawn over arrays of grid positions and uniforms, for one budget at a time: sweeps draw every
value at tens of budgets, for which the methods that Spark generates are too long for the JVM to compile."""

from __future__ import annotations

import math

import numpy as np

from .mechanisms import M


def tail(u: np.ndarray) -> np.ndarray:
    """The logarithm that the Laplace law and the staircase invert a uniform by: the same at every budget."""
    return np.log(np.maximum(1 - np.abs(2 * u - 1), 1e-300))


def drawn(mechanism: str, t: np.ndarray, eps: float, u: np.ndarray, m: int = M, tails: np.ndarray | None = None) -> np.ndarray:
    """The grid index that `mechanism` draws at each position t with the uniform u, as doubles; NaN where t is.

    tails: tail(u), where many budgets are drawn with the same uniforms.
    """
    with np.errstate(all="ignore"):
        if mechanism == "exp":
            index = exponential(t, eps, u, m)
        elif mechanism == "blap":
            index = t - np.sign(u - 0.5) / eps * (tail(u) if tails is None else tails)
        elif mechanism == "stair":
            index = t + staircase_noise(eps, u, tail(u) if tails is None else tails)
        else:
            raise ValueError(f"mechanism {mechanism!r}: exp, blap or stair")
        return np.rint(np.clip(index, 0, m - 1))


def exponential(t: np.ndarray, eps: float, u: np.ndarray, m: int) -> np.ndarray:
    a = math.exp(-eps / 2)
    gap, ln_a, f = 1 - a, math.log(a), np.floor(t)
    power = lambda x: np.exp(x * ln_a)
    past, near = power(t + 1), power(t - f)  # a ** (f + 1 - t) is a / near
    left = (near - past) / gap
    c = u * (left + (1 - power(m - 1 - f)) * (a / gap) / near)
    low = c < left
    x = np.where(low, c * gap + past, 1 - (c - left) * near * (gap / a))
    steps = np.log(x) / ln_a
    found = np.where(low, np.floor(t - steps), f + np.floor(steps)) + 1
    some = x > 0
    return found if some.all() else np.where(some, found, np.where(low, 0.0, np.where(np.isnan(t), np.nan, m - 1.0)))


def staircase_noise(eps: float, u: np.ndarray, tails: np.ndarray) -> np.ndarray:
    p = math.exp(-eps)
    ln_p, gamma = math.log(p), math.sqrt(p) / (1 + math.sqrt(p))
    v = np.abs(2 * u - 1)
    g = np.floor(tails / ln_p)
    whole, half = np.exp(g * ln_p), np.exp((g + 0.5) * ln_p)
    rest, low = v - (1 - whole), whole - half
    part = np.where(rest < low, rest / ((1 - p) * np.exp((g - 0.5) * ln_p)), gamma + (rest - low) / ((1 - p) * half))
    return np.sign(u - 0.5) * (g + part)
