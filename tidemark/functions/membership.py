"""Membership families. Each builder turns an expression and literal parameters into one degree expression."""

from __future__ import annotations

import math
from collections.abc import Sequence

from tidemark.functions.sqltext import case, num


def triangle(x: str, a: float, b: float, c: float) -> str:
    branches = [(f"{x} < {num(a)} OR {x} > {num(c)}", "0D"), (f"{x} = {num(b)}", "1D")]
    if b > a:
        branches.append((f"{x} < {num(b)}", f"({x} - {num(a)}) / {num(b - a)}"))
    return case(branches, f"1D - ({x} - {num(b)}) / {num(c - b)}" if c > b else "0D")


def trapezoid(x: str, a: float, b: float, c: float, d: float) -> str:
    branches = [(f"{x} < {num(a)} OR {x} > {num(d)}", "0D"), (f"{x} >= {num(b)} AND {x} <= {num(c)}", "1D")]
    if b > a:
        branches.append((f"{x} < {num(b)}", f"({x} - {num(a)}) / {num(b - a)}"))
    return case(branches, f"1D - ({x} - {num(c)}) / {num(d - c)}" if d > c else "0D")


def gaussian(x: str, mean: float, sd: float) -> str:
    return f"exp(-(({x} - {num(mean)}) * ({x} - {num(mean)})) / {num(2.0 * sd * sd)})"


def gaussian2(x: str, mean1: float, sd1: float, mean2: float, sd2: float) -> str:
    """Gaussian flanks joined by a plateau of 1 between the two means."""
    flanks = [(f"{x} < {num(mean1)}", gaussian(x, mean1, sd1)), (f"{x} > {num(mean2)}", gaussian(x, mean2, sd2))]
    return case(flanks, "1D")


def gen_bell(x: str, mean: float, width: float, slope: float) -> str:
    return f"(1D / (1D + pow(abs(({x} - {num(mean)}) / {num(width)}), {num(2.0 * slope)})))"


def sigmoid(x: str, gain: float, centre: float) -> str:
    return f"(1D / (1D + exp({num(-gain)} * ({x} - {num(centre)}))))"


def sigmoid_difference(x: str, gain1: float, centre1: float, gain2: float, centre2: float) -> str:
    return f"greatest({sigmoid(x, gain1, centre1)} - {sigmoid(x, gain2, centre2)}, 0D)"


def cosine(x: str, half_width: float, offset: float) -> str:
    away = f"({x} - {num(offset)})"
    inside = f"{away} >= {num(-half_width)} AND {away} <= {num(half_width)}"
    return case([(inside, f"(cos({away} * {num(math.pi / half_width)}) + 1D) / 2D")], "0D")


def piecewise(x: str, *points: Sequence[float]) -> str:
    """Straight lines through ``(x, y)`` points, flat outside the first and last one."""
    branches = [(f"{x} <= {num(points[0][0])}", num(points[0][1]))]
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        branches.append((f"{x} <= {num(x1)}", f"{num(y0)} + {num(y1 - y0)} * (({x} - {num(x0)}) / {num(x1 - x0)})"))
    return case(branches, num(points[-1][1]))


def singleton(x: str, at: float, height: float = 1.0) -> str:
    return case([(f"{x} = {num(at)}", num(height))], "0D")


def singletons(x: str, *points: Sequence[float]) -> str:
    """Exact hits only between the ends; the end values hold outside them."""
    branches = [(f"{x} <= {num(points[0][0])}", num(points[0][1])), (f"{x} > {num(points[-1][0])}", num(points[-1][1]))]
    branches += [(f"{x} = {num(at)}", num(height)) for at, height in points[1:]]
    return case(branches, "0D")


FAMILIES = {
    "triangle": triangle,
    "trapezoid": trapezoid,
    "gaussian": gaussian,
    "gaussian2": gaussian2,
    "gen_bell": gen_bell,
    "sigmoid": sigmoid,
    "sigmoid_difference": sigmoid_difference,
    "cosine": cosine,
    "piecewise": piecewise,
    "singleton": singleton,
    "singletons": singletons,
}


def degree(x: str, family: str, params: Sequence) -> str:
    """Degree of ``x``; a missing ``x`` (null or NaN) has none (null), whatever the family."""
    problem = check(family, params)
    if problem:
        raise ValueError(problem)
    return f"if(isnan(coalesce({x}, {num(math.nan)})), NULL, {FAMILIES[family](x, *params)})"


def check(family: str, params: Sequence) -> str | None:
    """Why the parameters are unusable, or None. Runs before any job starts."""
    if family not in FAMILIES:
        return f"unknown membership family {family!r}"
    if family in ("triangle", "trapezoid") and list(params) != sorted(params):
        return f"{family} feet must ascend: {list(params)}"
    if family in ("piecewise", "singletons"):
        xs = [p[0] for p in params]
        if not xs or any(b <= a for a, b in zip(xs, xs[1:])):
            return f"{family} points must have ascending x: {xs}"
    if family == "gaussian" and params[1] <= 0:
        return "gaussian needs a positive deviation"
    if family == "gaussian2" and (params[1] <= 0 or params[3] <= 0 or params[0] > params[2]):
        return "gaussian2 needs positive deviations and ordered means"
    if family in ("gen_bell",) and params[1] == 0:
        return "gen_bell needs a non-zero width"
    if family == "cosine" and params[0] <= 0:
        return "cosine needs a positive half width"
    return None


def _sigmoid_reach(gain: float, centre: float) -> tuple[float, float]:
    return centre - 9.0 / abs(gain), centre + 9.0 / abs(gain)


def _sigmoid_pair(gain1: float, centre1: float, gain2: float, centre2: float) -> tuple[float, float]:
    first, second = _sigmoid_reach(gain1, centre1), _sigmoid_reach(gain2, centre2)
    return min(first[0], second[0]), max(first[1], second[1])


def _gen_bell_reach(mean: float, width: float, slope: float) -> tuple[float, float]:
    reach = 999.0 ** (1.0 / (2.0 * slope)) * width
    return mean - reach, mean + reach


# Range of x each family matters on: feet, 4 deviations, or where the degree drops below about 0.001.
UNIVERSES = {
    "triangle": lambda *feet: (float(feet[0]), float(feet[-1])),
    "trapezoid": lambda *feet: (float(feet[0]), float(feet[-1])),
    "gaussian": lambda mean, sd: (mean - 4.0 * sd, mean + 4.0 * sd),
    "gaussian2": lambda mean1, sd1, mean2, sd2: (mean1 - 4.0 * sd1, mean2 + 4.0 * sd2),
    "gen_bell": _gen_bell_reach,
    "sigmoid": _sigmoid_reach,
    "sigmoid_difference": _sigmoid_pair,
    "cosine": lambda half_width, offset: (offset - half_width, offset + half_width),
    "piecewise": lambda *points: (float(points[0][0]), float(points[-1][0])),
    "singleton": lambda at, height=1.0: (float(at), float(at)),
    "singletons": lambda *points: (float(points[0][0]), float(points[-1][0])),
}


def universe(family: str, params: Sequence) -> tuple[float, float]:
    return UNIVERSES[family](*params)
