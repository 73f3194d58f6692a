"""Small dense algebra on the driver: rank by pivoted QR, and inverses behind a conditioning gate."""

from __future__ import annotations

import numpy as np

from ..errors import ComputationError

EPS = np.finfo(float).eps
SINGULAR = "design matrix is singular (perfect multicollinearity detected)"


def pivoted_diagonal(a: np.ndarray) -> np.ndarray:
    """|diagonal| of R of a column-pivoted QR, by modified Gram-Schmidt with a second sweep."""
    a = a.astype(float).copy()
    k = a.shape[1]
    out = np.zeros(k)
    for j in range(k):
        sizes = np.sqrt((a[:, j:] ** 2).sum(axis=0))
        best = j + int(np.argmax(np.where(np.isnan(sizes), np.inf, sizes)))
        a[:, [j, best]] = a[:, [best, j]]
        out[j] = np.sqrt((a[:, j] ** 2).sum())
        if not out[j] > 0:
            break
        q = a[:, j] / out[j]
        for _ in range(2):
            a[:, j + 1 :] -= np.outer(q, q @ a[:, j + 1 :])
    return out


def require_full_rank(a: np.ndarray, message: str = SINGULAR) -> None:
    d = pivoted_diagonal(a)
    if not (d > a.shape[1] * EPS * d.max(initial=0)).all():
        raise ComputationError(message)


def well_conditioned(m: np.ndarray) -> bool:
    if not np.isfinite(m).all():
        return False
    e = np.abs(np.linalg.eigvalsh(m))
    return bool((e > len(m) * EPS * e.max(initial=0)).all())


def spd_inverse(m: np.ndarray, message: str) -> np.ndarray:
    m = (m + m.T) / 2
    if not well_conditioned(m):
        raise ComputationError(message)
    try:
        half = np.linalg.inv(np.linalg.cholesky(m))
    except np.linalg.LinAlgError:
        raise ComputationError(message) from None
    return half.T @ half


def wald(b: np.ndarray, v: np.ndarray) -> float:
    """b' v^-1 b behind the same gate."""
    v = (v + v.T) / 2
    if not well_conditioned(v):
        raise ComputationError("computation failed: the covariance of the tested coefficients is singular")
    return float(b @ np.linalg.solve(v, b))
