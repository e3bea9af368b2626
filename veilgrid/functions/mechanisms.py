"""Noise as SQL expressions. Every draw is a function of a key, so that retries and repeated evaluation release it once.

A value x on the domain [lo, hi] has the grid position t = (x - lo) / (hi - lo) * (m - 1); most mechanisms return a
grid index from 0 to m - 1. `u` arguments are uniforms in [0, 1).
"""

from __future__ import annotations

import math

from .dialect import Dialect

M = 1000
#: Beyond this the staircase likelihood has no valid normaliser: 2 ln((1 + sqrt 5) / 2), rounded down.
STAIRCASE_LIMIT = 0.962


def grid_position(d: Dialect, x: str, lo: str, hi: str, m: int = M) -> str:
    return f"(({x} - {lo}) / ({hi} - {lo}) * {d.num(m - 1)})"


def clip(x: str, lo: str, hi: str) -> str:
    return f"greatest(least({x}, {hi}), {lo})"


def index_of(d: Dialect, x: str, lo: str, hi: str, m: int = M) -> str:
    """The nearest grid index, clipped to the grid; 0 on a domain without width."""
    return f"CASE WHEN {hi} <= {lo} THEN {d.long('0')} ELSE {d.long(clip(d.rint(grid_position(d, x, lo, hi, m)), d.num(0), d.num(m - 1)))} END"


def value_of(d: Dialect, index: str, lo: str, hi: str, m: int = M) -> str:
    return f"({lo} + {index} * ({hi} - {lo}) / {d.num(m - 1)})"


def spacing(d: Dialect, lo: str, hi: str, m: int = M) -> str:
    return f"(({hi} - {lo}) / {d.num(m - 1)})"


def exponential(d: Dialect, t: str, eps: str, u: str, m: int = M) -> str:
    """The grid index drawn with probability in proportion to exp(-eps/2 * |s - t|), by the inverse of its sum.

    With a = exp(-eps/2), the weights up to floor(t) sum to (a^(t-f) - a^(t+1)) / (1 - a), those above to
    a^(f+1-t) (1 - a^(m-1-f)) / (1 - a); the draw lands on one side, where the geometric sum is inverted.
    """
    one = d.num(1)
    a = f"exp(-({eps}) / {d.num(2)})"
    gap = f"({one} - {a})"
    f = f"floor({t})"
    left = f"((power({a}, {t} - {f}) - power({a}, {t} + {one})) / {gap})"
    right = f"(power({a}, {f} + {one} - {t}) * ({one} - power({a}, {d.num(m - 1)} - {f})) / {gap})"
    c = f"({u} * ({left} + {right}))"
    under = f"({c} * {gap} + power({a}, {t} + {one}))"
    over = f"({one} - ({c} - {left}) * {gap} * power({a}, -({f} + {one} - {t})))"
    low = f"CASE WHEN {under} > 0 THEN floor({t} - ln({under}) / ln({a})) + {one} ELSE {d.num(0)} END"
    high = f"CASE WHEN {over} > 0 THEN {f} + floor(ln({over}) / ln({a})) + {one} ELSE {d.num(m - 1)} END"
    return d.long(clip(f"CASE WHEN {c} < {left} THEN {low} ELSE {high} END", d.num(0), d.num(m - 1)))


def laplace(d: Dialect, u: str, scale: str) -> str:
    v = f"({u} - {d.num(0.5)})"
    return f"(-sign({v}) * ({scale}) * ln(greatest({d.num(1)} - {d.num(2)} * abs({v}), {d.num(1e-300)})))"


def truncated_laplace(d: Dialect, x: str, eps: str, lo: str, hi: str, u: str) -> str:
    """In value space, with scale 1/eps, clipped to the domain."""
    return clip(f"({x} + {laplace(d, u, f'{d.num(1)} / ({eps})')})", lo, hi)


def bounded_laplace(d: Dialect, t: str, eps: str, u: str, m: int = M) -> str:
    """In index space, with scale 1/eps, clipped and rounded to the grid."""
    return d.long(d.rint(clip(f"({t} + {laplace(d, u, f'{d.num(1)} / ({eps})')})", d.num(0), d.num(m - 1))))


def staircase_noise(d: Dialect, eps: str, u: str) -> str:
    """Staircase noise of unit sensitivity, by the inverse of its distribution: whole steps, then one of two linear parts of a step."""
    one, half = d.num(1), d.num(0.5)
    p = f"exp(-({eps}))"
    gamma = f"(sqrt({p}) / ({one} + sqrt({p})))"
    v = f"abs({d.num(2)} * {u} - {one})"
    g = f"floor(ln(greatest({one} - {v}, {d.num(1e-300)})) / ln({p}))"
    rest = f"({v} - ({one} - power({p}, {g})))"
    low = f"(power({p}, {g}) - power({p}, {g} + {half}))"
    part = f"CASE WHEN {rest} < {low} THEN {rest} / (({one} - {p}) * power({p}, {g} - {half})) ELSE {gamma} + ({rest} - {low}) / (({one} - {p}) * power({p}, {g} + {half})) END"
    return f"(sign({u} - {half}) * ({g} + {part}))"


def staircase(d: Dialect, t: str, eps: str, u: str, m: int = M) -> str:
    return d.long(d.rint(clip(f"({t} + {staircase_noise(d, eps, u)})", d.num(0), d.num(m - 1))))


def simple_staircase(d: Dialect, t: str, eps: str, u1: str, u2: str, u3: str, m: int = M) -> str:
    """Geometric step, uniform place in the step (near part with probability 1 - gamma part), random sign; three uniforms."""
    one = d.num(1)
    p = f"exp(-({eps}))"
    gamma = f"({one} / ({one} + exp({eps} / {d.num(2)})))"
    step = f"floor(ln(greatest({one} - {u1}, {d.num(1e-300)})) / ln({p}))"
    near = f"({gamma} / ({gamma} + ({one} - {gamma}) * {p}))"
    place = f"CASE WHEN {u2} < {near} THEN {u2} / {near} * {gamma} ELSE {gamma} + ({u2} - {near}) / ({one} - {near}) * ({one} - {gamma}) END"
    noise = f"(CASE WHEN {u3} < {d.num(0.5)} THEN -{one} ELSE {one} END * ({step} + {place}))"
    return d.long(d.rint(clip(f"({t} + {noise})", d.num(0), d.num(m - 1))))


def gaussian(d: Dialect, x: str, eps: str, lo: str, hi: str, u1: str, u2: str, delta: float = 1e-5) -> str:
    """Sigma sqrt(2 ln(1.25/delta)) * width / eps; a normal deviate from two uniforms; clipped."""
    sigma = f"({d.num(math.sqrt(2 * math.log(1.25 / delta)))} * ({hi} - {lo}) / ({eps}))"
    normal = f"(sqrt(-{d.num(2)} * ln({d.num(1)} - {u1})) * cos({d.num(2 * math.pi)} * {u2}))"
    return clip(f"({x} + {sigma} * {normal})", lo, hi)


def noise_index(d: Dialect, mechanism: str, t: str, eps: str, *keys: str, m: int = M) -> str:
    """The index that `mechanism` (exp, blap, stair) draws at grid position t, keyed by SQL expressions."""
    return drawn(d, mechanism, t, eps, d.uniform(*keys), m)


def drawn(d: Dialect, mechanism: str, t: str, eps: str, u: str, m: int = M) -> str:
    """The same from a uniform that is at hand."""
    if mechanism == "exp":
        return exponential(d, t, eps, u, m)
    if mechanism == "blap":
        return bounded_laplace(d, t, eps, u, m)
    if mechanism == "stair":
        return staircase(d, t, eps, u, m)
    raise ValueError(f"mechanism {mechanism!r}: exp, blap or stair")


def steps(d: Dialect, mechanism: str, t: str, eps: str, u: str, tag: str = "", m: int = M) -> tuple[dict[str, str], dict[str, str], list[dict[str, str]], str]:
    """drawn() in steps that name what it repeats: columns of a value, columns of a budget, layers of columns over both, and the index from these.

    The same operations in the same order. As one expression, shared parts are worked out again in every branch, and
    the method that Spark generates is too long for the JVM to compile.
    """
    n = lambda x: f"_{x}{tag}"
    one, half, two, last = (d.num(x) for x in (1, 0.5, 2, m - 1))
    if mechanism == "exp":
        a, gap, ln_a, f, past, back, left, c, x = (n(k) for k in ("a", "gap", "ln_a", "f", "past", "back", "left", "c", "x"))
        base = f"exp(-({eps}) / {two})"
        layers = [
            {past: f"power({a}, {t} + {one})"},
            {left: f"((power({a}, {t} - {f}) - {past}) / {gap})"},
            {c: f"({u} * ({left} + (power({a}, {back}) * ({one} - power({a}, {last} - {f})) / {gap})))"},
            {x: f"CASE WHEN {c} < {left} THEN {c} * {gap} + {past} ELSE {one} - ({c} - {left}) * {gap} * power({a}, -{back}) END"},
        ]
        low = f"CASE WHEN {x} > 0 THEN floor({t} - ln({x}) / {ln_a}) + {one} ELSE {d.num(0)} END"
        high = f"CASE WHEN {x} > 0 THEN {f} + floor(ln({x}) / {ln_a}) + {one} ELSE {last} END"
        index = d.long(clip(f"CASE WHEN {c} < {left} THEN {low} ELSE {high} END", d.num(0), last))
        return {f: f"floor({t})", back: f"(floor({t}) + {one} - {t})"}, {a: base, gap: f"({one} - {base})", ln_a: f"ln({base})"}, layers, index
    if mechanism == "blap":
        v, side, level, scale = f"({u} - {half})", n("side"), n("level"), n("scale")
        value = {side: f"(-sign({v}))", level: f"ln(greatest({one} - {two} * abs({v}), {d.num(1e-300)}))"}
        return value, {scale: f"({one} / ({eps}))"}, [], d.long(d.rint(clip(f"({t} + ({side} * {scale} * {level}))", d.num(0), last)))
    if mechanism == "stair":
        v, level, side, p, ln_p, gamma, g, whole, rest, low = (n(k) for k in ("v", "level", "side", "p", "ln_p", "gamma", "g", "whole", "rest", "low"))
        size, base = f"abs({two} * {u} - {one})", f"exp(-({eps}))"
        value = {v: size, level: f"ln(greatest({one} - {size}, {d.num(1e-300)}))", side: f"sign({u} - {half})"}
        budget = {p: base, ln_p: f"ln({base})", gamma: f"(sqrt({base}) / ({one} + sqrt({base})))"}
        layers = [
            {g: f"floor({level} / {ln_p})"},
            {whole: f"power({p}, {g})"},
            {rest: f"({v} - ({one} - {whole}))", low: f"({whole} - power({p}, {g} + {half}))"},
        ]
        part = f"CASE WHEN {rest} < {low} THEN {rest} / (({one} - {p}) * power({p}, {g} - {half})) ELSE {gamma} + ({rest} - {low}) / (({one} - {p}) * power({p}, {g} + {half})) END"
        return value, budget, layers, d.long(d.rint(clip(f"({t} + ({side} * ({g} + {part})))", d.num(0), last)))
    raise ValueError(f"mechanism {mechanism!r}: exp, blap or stair")


def log_normaliser(d: Dialect, a: str, t: str, m: int = M) -> str:
    """ln of the sum of a^|s - t| over the grid, for an integer t."""
    one = d.num(1)
    return f"ln(({one} + {a} - power({a}, {t} + {one}) - power({a}, {d.num(m)} - {t})) / ({one} - {a}))"


def log_likelihood(d: Dialect, mechanism: str, s: str, t: str, eps: str, m: int = M) -> str:
    """ln probability of the index s at integer position t. Of the staircase: as a geometric law of the whole steps between them."""
    a = {"exp": f"exp(-({eps}) / {d.num(2)})", "blap": f"exp(-({eps}))", "stair": f"exp(-({eps}))"}[mechanism]
    return f"(ln({a}) * abs({s} - {t}) - {log_normaliser(d, a, t, m)})"


def summed_log_likelihood(d: Dialect, mechanism: str, distance: str, n: str, t: str, eps: str, m: int = M) -> str:
    """The sum of n log likelihoods at t, from the sum of the distances."""
    a = {"exp": f"exp(-({eps}) / {d.num(2)})", "blap": f"exp(-({eps}))", "stair": f"exp(-({eps}))"}[mechanism]
    return f"(ln({a}) * {distance} - {n} * {log_normaliser(d, a, t, m)})"
