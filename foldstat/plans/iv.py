"""Instrumental variables: two-stage least squares and GMM, both on the triangular factor of [1, x_exog, instruments, x_endog, y]."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from .. import options as o
from ..errors import ComputationError, ValidationError
from ..functions.distributions import chi2_sf, f_sf
from ..functions.linalg import spd_inverse, wald
from ..operators.passes import block_products, totals
from ..sources.design import Design, number
from .linear import Coefficients, OlsResults, _describe, canonical, linear_form, required_cluster
from .regression import Cov, Fit, count_clusters, covariances, enough, f_test, inference, lags_for, least_squares, unit


class IvResults(Coefficients):
    _stat_name = "stat"

    @property
    def stats(self) -> dict[str, float]:
        return self._stats()

    def first_stage(self) -> dict[str, OlsResults]:
        return self._first

    def residuals_df(self) -> DataFrame:
        """The data with the structural residual."""
        return self._df.withColumn("residual", number(self._df, self.dep_var_name) - linear_form(self._df, self._x, self._b, self._intercept))

    @property
    def residuals(self) -> DataFrame:
        return self.residuals_df().select("residual")

    def predict(self, new_data: DataFrame | None = None) -> DataFrame:
        df = self._df if new_data is None else new_data
        return df.withColumn("fitted", linear_form(df, self._x, self._b, self._intercept))

    def diagnostics(self) -> DataFrame:
        """(test, variable, stat, p_value) of the specification tests; null where a test does not apply."""
        rows = [("weak_instruments", v, f, self.weak_instrument_p_values[v]) for v, f in self.weak_instrument_f_statistics.items()]
        rows += [("overidentification", None, self.overid_statistic, self.overid_p_value), ("wu_hausman", None, self.wu_hausman_statistic, self.wu_hausman_p_value)]
        return self._spark.createDataFrame(rows, "test string, variable string, stat double, p_value double")


class _Problem:
    """Places of the roles in W = [1, x_exog, instruments, x_endog, y], and the totals of the data."""

    def __init__(self, df: DataFrame, y: str, exog: list[str], endog: list[str], extra: list[str], opt: o.IvOptions):
        self.method = o.one_of(opt.method, ("2sls", "gmm"), "unknown method: '{}'. Expected one of '2sls' or 'gmm'")
        for role, cols in (("x_exog", exog), ("x_endog", endog), ("instruments", extra)):
            o.no_repeats(role, cols)
        o.no_overlap([("y", y), ("x_exog", exog), ("x_endog", endog), ("instruments", extra)])
        o.no_const([*exog, *endog], opt.include_intercept)
        self.given = o.linear_cov(opt.cov_type)
        self.kind = canonical(self.given)
        self.weights = o.weight_type(opt.weight_type) if self.method == "gmm" else "unadjusted"
        if len(extra) < len(endog):
            raise ValidationError(f"insufficient instruments: {len(extra)} excluded instrument(s) for {len(endog)} endogenous variable(s); at least as many are needed")
        self.time_kind = "hac" if "hac" == self.kind or self.weights == "kernel" else ""
        self.cluster = opt.cluster_col if "cluster" in (self.kind, self.weights) else None
        self.y, self.exog, self.endog, self.extra, self.opt, self.df = y, exog, endog, extra, opt, df
        time = opt.time_col if self.time_kind else None
        self.design = Design(df, [*exog, *extra, *endog, y], None, time, self.cluster, tuple(opt.tie_cols) if time else ())
        e, z, m = len(exog), len(extra), len(endog)
        self.size = e + z + m + 2
        const = [0] if opt.include_intercept else []
        self.const = len(const)
        self.exog_at, self.extra_at, self.endog_at, self.y_at = [*const, *range(1, 1 + e)], [*range(1 + e, 1 + e + z)], [*range(1 + e + z, 1 + e + z + m)], self.size - 1
        self.z_at, self.x_at = self.exog_at + self.extra_at, self.exog_at + self.endog_at
        self.names = ["const"] * self.const + exog + endog

    def basis(self, places: list[int]) -> np.ndarray:
        return unit(self.size, *places)

    @property
    def target(self) -> np.ndarray:
        return unit(self.size, self.y_at)[:, 0]

    def cov(self, kind: str, given: str) -> Cov:
        return Cov(kind, given, lags_for(self.opt.hac_lags, self.t.n) if kind == "hac" else 0)

    def sst(self) -> float:
        return self.t.square[-1] + (0 if self.const else self.t.n * self.t.mean[-1] ** 2)


def _first_stage(p: _Problem, fits: list[Fit], variances: list[np.ndarray], cov: Cov, level: float) -> dict[str, OlsResults]:
    out = {}
    for i, (name, fit, v) in enumerate(zip(p.endog, fits, variances, strict=True)):
        at = len(p.exog) + len(p.extra) + i

        class _T:  # the totals of a regression of this endogenous column
            n, log_w, square, mean = p.t.n, 0.0, p.t.square[at : at + 1], p.t.mean[at : at + 1]

        r = out[name] = OlsResults()
        _describe(r, p.df, name, p.exog + p.extra, bool(p.const), _T, fit, v, cov, level, False)
    return out


def _weak(p: _Problem, fits: list[Fit]) -> tuple[dict[str, float], dict[str, float]]:
    """Partial F of the excluded instruments, always classical."""
    stats, tails = {}, {}
    q = len(p.extra)
    for name, place, fit in zip(p.endog, p.endog_at, fits, strict=True):
        x = p.t.r[:, place]
        if p.exog_at:
            q_, _ = np.linalg.qr(p.t.r[:, p.exog_at])
            x = x - q_ @ (q_.T @ x)
        df = p.t.n - fit.k
        stats[name] = float((x @ x - fit.ssr) / q / (fit.ssr / df)) if q and fit.ssr > 0 else math.inf if q else math.nan
        tails[name] = f_sf(stats[name], q, df) if q else math.nan
    return stats, tails


def _hausman(p: _Problem, first: list[Fit]) -> Fit | None:
    """The structural equation with the first-stage residuals added; None where it cannot be fitted."""
    basis = np.hstack([p.basis(p.x_at), np.array([f.residual for f in first]).T.reshape(p.size, -1)])
    try:
        enough(p.t.n, basis.shape[1])
        return least_squares(p.t.r, basis, p.target)
    except (ComputationError, ValidationError):
        return None


def _prefixed(what: str, call):
    try:
        return call()
    except (ValidationError, ComputationError) as e:
        raise type(e)(f"{what} failed: {e}") from None


def _fit(p: _Problem) -> IvResults:
    opt = p.opt
    level = o.level(opt.confidence_level)
    if p.method == "gmm":
        if opt.gmm_iterations < 1:
            raise ValidationError(f"gmm_iterations must be a positive integer: got {opt.gmm_iterations}")
        if opt.gmm_convergence is not None and opt.gmm_convergence <= 0:
            raise ValidationError(f"gmm_convergence must be a positive number, got {opt.gmm_convergence}")
        if p.weights == "cluster" and p.cluster is None:
            raise ValidationError("cov_type='cluster' requires cluster identifiers to be provided")
    required_cluster(p.kind, p.cluster)
    p.t = totals(p.design)
    if p.weights == "kernel":
        lags_for(opt.hac_lags, p.t.n)
    if p.weights == "cluster" and opt.gmm_iterations == 1 and p.kind != "cluster":  # no later pass would count them
        count_clusters(p.design.frame.select("_g").distinct().limit(2).count())
    n, z = p.t.n, p.basis(p.z_at)
    enough(n, len(p.x_at))

    def stage() -> list[Fit]:
        enough(n, len(p.z_at))
        return [least_squares(p.t.r, z, unit(p.size, at)[:, 0]) for at in p.endog_at]

    first = _prefixed("first-stage regression", stage) if p.endog else []
    out = IvResults()
    out._df, out._x, out._intercept = p.df, p.exog + p.endog, bool(p.const)
    out.dep_var_name, out.n_obs, out.cov_type, out.method = p.y, n, p.given, p.method
    out.weak_instrument_f_statistics, out.weak_instrument_p_values = _weak(p, first)
    out.wu_hausman_statistic = out.wu_hausman_p_value = out.overid_statistic = out.overid_p_value = None
    (_two_stage if p.method == "2sls" else _gmm)(p, out, first, level)
    return out


def _two_stage(p: _Problem, out: IvResults, first: list[Fit], level: float) -> None:
    n, t = p.t.n, p.t
    # Fitted endogenous columns are the columns less their first-stage residuals.
    fitted = [p.basis(p.exog_at)] + [(unit(p.size, at)[:, 0] - f.residual)[:, None] for at, f in zip(p.endog_at, first, strict=True)]
    hat = _prefixed("second-stage regression", lambda: least_squares(t.r, np.hstack(fitted), p.target))
    residual = p.target - p.basis(p.x_at) @ hat.b  # of the actual regressors
    structural = Fit(hat.b, hat.basis, residual, hat.u, float(np.sum((t.r @ residual) ** 2)))
    tested = _hausman(p, first) if p.endog else None
    cov = p.cov(p.kind, p.given)
    all_ = covariances(p.design, [structural, *first, *([tested] if tested else [])], cov, n)
    v, dof = all_[0], cov.groups - 1 if p.kind == "cluster" else n - structural.k
    out._first = _first_stage(p, first, all_[1 : 1 + len(first)], cov, level)
    out._fill(p.df.sparkSession, p.names, hat.b, v, inference(hat.b, v, level, dof))
    out.r_squared = 1 - structural.ssr / p.sst()
    out.r_squared_adj = 1 - (n - p.const) / (n - structural.k) * (1 - out.r_squared)
    out.f_statistic, out.f_p_value = f_test(hat.b[p.const :], v[p.const :, p.const :], dof)
    out.converged, out.n_iterations = True, 1
    out.df_resid, out.df_model = n - structural.k, structural.k - p.const
    if tested:
        q = len(first)
        try:
            out.wu_hausman_statistic, out.wu_hausman_p_value = f_test(tested.b[-q:], all_[-1][-q:, -q:], cov.groups - 1 if p.kind == "cluster" else n - tested.k)
        except ComputationError:
            pass
    free = len(p.extra) - len(p.endog)
    if free > 0:
        q, _ = np.linalg.qr(t.r[:, p.z_at])
        e = t.r @ residual
        out.overid_statistic = float(np.sum((q.T @ e) ** 2) / (structural.ssr / n))
        out.overid_p_value = chi2_sf(out.overid_statistic, free)


_BAD_WEIGHT = "computation failed: the GMM weight matrix is singular"


def _gmm(p: _Problem, out: IvResults, first: list[Fit], level: float) -> None:
    opt, n, t = p.opt, p.t.n, p.t
    z, x, y = t.r[:, p.z_at], t.r[:, p.x_at], t.r @ p.target
    _, u = np.linalg.qr(z)
    half = np.linalg.inv(u)
    white = p.basis(p.z_at) @ half  # whitened instruments: Z'Z is the identity there
    zx, zy = (z @ half).T @ x, (z @ half).T @ y
    k = len(p.x_at)

    def solve(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = spd_inverse(s, _BAD_WEIGHT)
        inv = spd_inverse(zx.T @ w @ zx, "computation failed: X'Z S^-1 Z'X is singular")
        return inv @ (zx.T @ (w @ zy)), w

    def residual_of(b: np.ndarray) -> np.ndarray:
        return p.target - p.basis(p.x_at) @ b

    def moments(b: np.ndarray) -> np.ndarray:
        c = residual_of(b)
        if p.weights == "unadjusted":
            return np.eye(z.shape[1]) * float(np.sum((t.r @ c) ** 2) / n)
        kind = {"robust": "hc0", "cluster": "cluster", "kernel": "hac"}[p.weights]
        (s,), groups = block_products(p.design, [(white, c)], kind, lags_for(opt.hac_lags, n) if kind == "hac" else 0)
        if groups is not None and groups < 2:
            raise ValidationError(f"cov_type='cluster' requires at least 2 clusters, got {groups}")
        return s

    _prefixed("second-stage regression", lambda: least_squares(t.r, np.hstack([p.basis(p.exog_at)] + [(unit(p.size, at)[:, 0] - f.residual)[:, None] for at, f in zip(p.endog_at, first, strict=True)]), p.target))
    b, w = solve(np.eye(z.shape[1]))
    c = residual_of(b)
    s_used = np.eye(z.shape[1]) * float(np.sum((t.r @ c) ** 2) / n)
    steps, converged = 1, opt.gmm_convergence is None or opt.gmm_iterations == 1
    while steps < opt.gmm_iterations:
        s_used = moments(b)
        fresh, w = solve(s_used)
        steps += 1
        if opt.gmm_convergence is not None:
            converged = bool((np.abs(fresh - b) <= np.maximum(opt.gmm_convergence * np.abs(b), 1e-8)).all())
        b = fresh
        if opt.gmm_convergence is not None and converged:
            break
    if not converged and opt.raise_on_non_convergence:
        raise ComputationError(f"GMM failed to converge after {steps} iterations. Set raise_on_non_convergence=False to receive the result anyway, or increase gmm_iterations")
    c = residual_of(b)
    ze = white.T @ t.r.T @ (t.r @ c)
    free = len(p.extra) - len(p.endog)
    if free > 0:
        out.overid_statistic = float(ze @ spd_inverse(s_used, _BAD_WEIGHT) @ ze)
        out.overid_p_value = chi2_sf(out.overid_statistic, free)
    # The sandwich, always in its general form; the first stage's covariances come from the same pass.
    cov = p.cov(p.kind, p.given)
    if p.kind == "classical":
        e = t.r @ c
        total = float(t.r[:, 0] @ e)  # the first column of W is 1, so this is the sum of residuals
        omega = np.eye(z.shape[1]) * (float(e @ e) - total**2 / n) / (n - k)
        firsts = covariances(p.design, first, cov, n)
    else:
        middles, groups = block_products(p.design, [(white, c), *[f.block for f in first]], p.kind, cov.lags)
        if groups is not None:
            if groups < 2:
                raise ValidationError(f"cov_type='cluster' requires at least 2 clusters, got {groups}")
            cov.groups = groups
        omega = middles[0] * cov.factor(n, k)
        firsts = [f.bread(m) * cov.factor(n, f.k) for f, m in zip(first, middles[1:], strict=True)]
    inv = spd_inverse(zx.T @ w @ zx, "computation failed: X'Z S^-1 Z'X is singular")
    v = inv @ (zx.T @ w @ omega @ w @ zx) @ inv
    v = (v + v.T) / 2
    out._first = _first_stage(p, first, firsts, cov, level)
    out._fill(p.df.sparkSession, p.names, b, v, inference(b, v, level, None))
    ssr = float(np.sum((t.r @ c) ** 2))
    out.r_squared = 1 - ssr / p.sst()
    out.r_squared_adj = 1 - (n - p.const) / (n - k) * (1 - out.r_squared)
    q = k - p.const
    out.f_statistic = wald(b[p.const :], v[p.const :, p.const :]) if q else math.nan  # chi-square, not divided by q
    out.f_p_value = chi2_sf(out.f_statistic, q) if q else math.nan
    out.converged, out.n_iterations = converged, steps
    out.df_resid, out.df_model = n - k, k - p.const


class IV:
    """Instrumental variables of column ``y``: ``instruments`` are the excluded ones, at least as many as ``x_endog``."""

    def __init__(self, data: DataFrame, y: str, x_exog: list[str], x_endog: list[str], instruments: list[str], options: o.IvOptions | None = None):
        self.data, self.y, self.options = data, y, options or o.IvOptions()
        self.x_exog, self.x_endog, self.instruments = list(x_exog), list(x_endog), list(instruments)

    def fit(self) -> IvResults:
        return _fit(_Problem(self.data, self.y, self.x_exog, self.x_endog, self.instruments, self.options))
