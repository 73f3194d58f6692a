"""Maximum-likelihood solvers. An evaluation is a pass over the rows, so line searches ask for several steps in one pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..errors import ComputationError
from ..functions.linalg import require_full_rank

SINGULAR = "the Hessian is singular and cannot be inverted"
#: What rounding may add to a sum of log-likelihoods, relative to it: values that are as near tell nothing about a step.
NOISE = 1e-12
#: A Newton step of this size, relative to coefficients of 1 or more, changes nothing that doubles could still show.
SETTLED = 1e-14


@dataclass
class Point:
    """The negative log-likelihood at theta with gradient and Hessian."""

    theta: np.ndarray
    value: float
    gradient: np.ndarray
    hessian: np.ndarray


Evaluate = Callable[[list[np.ndarray]], list[Point]]


def newton(evaluate: Evaluate, start: np.ndarray, max_iter: int, tol: float) -> tuple[Point, bool, int]:
    at = evaluate([start])[0]
    for i in range(max_iter):
        require_full_rank(at.hessian, SINGULAR)
        at = evaluate([at.theta - np.linalg.solve(at.hessian, at.gradient)])[0]
        if not np.isfinite(at.value) or not np.isfinite(at.gradient).all():
            raise ComputationError(SINGULAR)
        if np.linalg.norm(at.gradient) < tol:
            return at, True, i + 1
    return at, False, max_iter


def _settled(at: Point, tol: float) -> bool:
    """Whether the gradient vanishes, or what is left of it moves no coefficient: summed over very many rows, its rounding alone exceeds any fixed ``tol``."""
    if np.linalg.norm(at.gradient) < tol:
        return True
    try:
        return bool(np.linalg.norm(np.linalg.solve(at.hessian, at.gradient)) <= SETTLED * max(1.0, np.linalg.norm(at.theta)))
    except np.linalg.LinAlgError:
        return False


def _search(evaluate: Evaluate, at: Point, direction: np.ndarray) -> Point:
    """A step that meets the strong Wolfe conditions, or the best decrease found.

    Near the optimum a decrease is less than the rounding of the sum. Where values are that near, the slopes decide
    (the approximate Wolfe conditions): they keep their digits, and the functions are convex.
    """
    slope, room = float(at.gradient @ direction), NOISE * abs(at.value)
    steps, best = [1.0, 0.5, 0.25, 2.0, 4.0], None
    for _ in range(12):
        tried = list(zip(steps, evaluate([at.theta + s * direction for s in steps]), strict=True))
        slopes = [float(x.gradient @ direction) for _, x in tried]
        flat = [abs(g) <= 0.9 * abs(slope) for g in slopes]
        near = [np.isfinite(x.value) and abs(x.value - at.value) <= room and (f or g <= 0) for (_, x), g, f in zip(tried, slopes, flat, strict=True)]
        fits = [c or (np.isfinite(x.value) and x.value <= at.value + 1e-4 * s * slope) for (s, x), c in zip(tried, near, strict=True)]
        for (_s, x), ok, f in zip(tried, fits, flat, strict=True):
            if ok and f:
                return x
        good = [t for t, ok in zip(tried, fits, strict=True) if ok]
        if good:
            best = min((x for _, x in good), key=lambda x: x.value)
            top = max(s for s, _ in good)
            if top < max(steps):
                return best
            steps = [top * f for f in (2, 4, 8, 16)]
        elif best is not None:
            return best
        else:
            steps = [min(steps) * f for f in (0.5, 0.25, 0.125, 0.0625, 0.03125)]
    return best if best is not None else at


def bfgs(evaluate: Evaluate, start: np.ndarray, max_iter: int, tol: float) -> tuple[Point, bool, int]:
    at, inverse = evaluate([start])[0], np.eye(len(start))
    for i in range(max_iter):
        if _settled(at, tol):
            return at, True, i
        fresh = _search(evaluate, at, -inverse @ at.gradient)
        s, g = fresh.theta - at.theta, fresh.gradient - at.gradient
        if not s.any():
            return at, False, i
        if s @ g > 1e-300:
            if not i:
                inverse *= (s @ g) / (g @ g)
            left = np.eye(len(s)) - np.outer(s, g) / (s @ g)
            inverse = left @ inverse @ left.T + np.outer(s, s) / (s @ g)
        at = fresh
    return at, _settled(at, tol), max_iter


def lbfgs(evaluate: Evaluate, start: np.ndarray, max_iter: int, tol: float, memory: int = 7) -> tuple[Point, bool, int]:
    at, pairs = evaluate([start])[0], []
    for i in range(max_iter):
        if _settled(at, tol):
            return at, True, i
        q, shares = at.gradient.copy(), []
        for s, g in reversed(pairs):
            a = (s @ q) / (s @ g)
            shares.append(a)
            q -= a * g
        if pairs:
            s, g = pairs[-1]
            q *= (s @ g) / (g @ g)
        for (s, g), a in zip(pairs, reversed(shares), strict=True):
            q += s * (a - (g @ q) / (s @ g))
        fresh = _search(evaluate, at, -q)
        s, g = fresh.theta - at.theta, fresh.gradient - at.gradient
        if not s.any():
            return at, False, i
        if s @ g > 1e-300:
            pairs = [*pairs, (s, g)][-memory:]
        at = fresh
    return at, _settled(at, tol), max_iter


SOLVERS = {"newton": newton, "bfgs": bfgs, "lbfgs": lbfgs}
