"""Least squares on a triangular factor instead of the rows.

With W = [1, columns] and W = QR, any variable of a model is W c for a known vector c, and
any inner product of such variables is that of the vectors R c. So regressions, two-stage
least squares and their tests run on the few rows of R; only robust covariances need the
rows again, and all blocks a model wants share one pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from ..errors import ComputationError, ValidationError
from ..functions.distributions import f_sf, norm_ppf, norm_sf2, t_ppf, t_sf2
from ..functions.linalg import require_full_rank, wald
from ..operators.passes import Block, block_products
from ..sources.design import Design


@dataclass
class Fit:
    """y = X b + e with X = W B: coefficients, the residual as a vector over W, and the factor U of X."""

    b: np.ndarray
    basis: np.ndarray
    residual: np.ndarray
    u: np.ndarray
    ssr: float

    @property
    def k(self) -> int:
        return len(self.b)

    @property
    def whitened(self) -> np.ndarray:
        return self.basis @ np.linalg.inv(self.u)

    @property
    def block(self) -> Block:
        return self.whitened, self.residual

    def bread(self, middle: np.ndarray) -> np.ndarray:
        """U^-1 middle U^-T."""
        half = np.linalg.inv(self.u)
        return half @ middle @ half.T


def least_squares(r: np.ndarray, basis: np.ndarray, y: np.ndarray) -> Fit:
    x = r @ basis
    require_full_rank(x)
    q, u = np.linalg.qr(x)
    b = np.linalg.solve(u, q.T @ (r @ y))
    residual = y - basis @ b
    return Fit(b, basis, residual, u, float(np.sum((r @ residual) ** 2)))


def unit(size: int, *places: int) -> np.ndarray:
    """The unit vectors of these places as columns."""
    out = np.zeros((size, len(places)))
    out[list(places), range(len(places))] = 1
    return out


@dataclass
class Cov:
    """A covariance kind as asked for, with what it needs of the data."""

    kind: str  # classical, hc0 to hc3, hac, cluster
    given: str  # the option's own word
    lags: int = 0
    groups: int | None = None

    def factor(self, n: int, k: int) -> float:
        if self.kind == "hc1":
            return n / (n - k)
        if self.kind == "cluster":
            return self.groups / (self.groups - 1) * (n - 1) / (n - k)
        return 1.0


def automatic_lags(n: int) -> int:
    return math.floor(4 * (n / 100) ** (2 / 9))


def lags_for(hac_lags: int | None, n: int) -> int:
    if hac_lags is None:
        return automatic_lags(n)
    if not 0 <= hac_lags < n:
        raise ValidationError(f"hac_lags must be in the range [0, n): got {hac_lags}, n={n}")
    return hac_lags


def enough(n: int, k: int) -> None:
    if k == 0:
        raise ValidationError("no regressors: k=0 (include_intercept=false and no independent variables). At least one of the two is required")
    if n <= k:
        raise ValidationError(f"insufficient observations: n={n} must be greater than k={k} (number of independent variables, including the intercept)")


def count_clusters(groups: int) -> None:
    if groups < 2:
        raise ValidationError(f"cov_type='cluster' requires at least 2 clusters, got {groups}")


def covariances(design: Design, fits: list[Fit], cov: Cov, n: int) -> list[np.ndarray]:
    """The covariance of each fit's coefficients; one pass for all of them, none if classical."""
    if cov.kind == "classical":
        return [f.bread(np.eye(f.k)) * (f.ssr / (n - f.k)) for f in fits]
    middles, groups = block_products(design, [f.block for f in fits], cov.kind, cov.lags)
    if groups is not None:
        count_clusters(groups)
        cov.groups = groups
    return [f.bread(m) * cov.factor(n, f.k) for f, m in zip(fits, middles, strict=True)]


@dataclass
class Inference:
    se: np.ndarray
    stat: np.ndarray
    p: np.ndarray
    low: np.ndarray
    high: np.ndarray


def inference(b: np.ndarray, v: np.ndarray, level: float, df: float | None) -> Inference:
    """By the t distribution, or the normal where df is None."""
    var = np.diag(v)
    if not (np.isfinite(var).all() and (var >= 0).all()):
        raise ComputationError("computation failed: a variance is negative or not finite")
    se = np.sqrt(var)
    with np.errstate(divide="ignore", invalid="ignore"):
        stat = b / se
    tail, crit = (norm_sf2, norm_ppf((1 + level) / 2)) if df is None else (lambda s: t_sf2(s, df), t_ppf((1 + level) / 2, df))
    return Inference(se, stat, np.array([tail(s) for s in stat]), b - crit * se, b + crit * se)


def f_test(b: np.ndarray, v: np.ndarray, df: float) -> tuple[float, float]:
    """Wald F of all given coefficients; nan where there are none."""
    if not len(b):
        return math.nan, math.nan
    f = wald(b, v) / len(b)
    return f, f_sf(f, len(b), df)
