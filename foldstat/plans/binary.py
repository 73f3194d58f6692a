"""Logit and probit by maximum likelihood.

One pass validates and gives the columns' scales; the projected columns are then kept in
memory (spilling to disk), and each evaluation is one pass that returns log-likelihood,
gradient and Hessian together, for several parameter vectors if a line search asks.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import options as o
from ..errors import ComputationError, ValidationError
from ..functions import links
from ..functions.distributions import chi2_sf, norm_ppf, norm_sf2
from ..functions.linalg import spd_inverse
from ..operators.passes import cluster_products, medians, totals
from ..sources.design import Design, number
from .linear import Coefficients, Table, canonical, linear_form, required_cluster
from .regression import count_clusters, enough, inference
from .solvers import SINGULAR, SOLVERS, Point

#: A gradient near zero with standardised coefficients of this norm is separation, not convergence (fixed value).
SEPARATION = 100.0
_OPG = "the outer-product-of-gradients (OPG) matrix is singular and cannot be inverted"


def _regressors(m: np.ndarray, scale: np.ndarray, intercept: bool) -> np.ndarray:
    """[1, x] / scale of rows (y, x...)."""
    x = m[:, 1:] if not intercept else np.hstack([np.ones((len(m), 1)), m[:, 1:]])
    return x / scale


class BinaryResults(Coefficients):
    _stat_name = "z_stat"
    _link = links.Logit

    @property
    def z_stats(self) -> dict[str, float]:
        return self._stats()

    def _score(self, df: DataFrame):
        return self._link.column(linear_form(df, self._x, self._b, self._intercept))

    def predict(self, new_data: DataFrame | None = None) -> DataFrame:
        """The data (or new data) with a column ``probability``."""
        df = self._df if new_data is None else new_data
        if new_data is not None:
            totals(Design(df, self._x), factor=False)
        return df.withColumn("probability", self._score(df))

    def pred_counts(self, threshold: float = 0.5) -> list[list[int]]:
        """Counts by actual (y of 0.5 or more) and predicted (probability over the threshold) class."""
        actual = (number(self._df, self.dep_var_name) >= 0.5).cast("int").alias("actual")
        counted = self._df.select(actual, (self._score(self._df) > threshold).cast("int").alias("predicted")).groupBy("actual", "predicted").count().collect()
        out = [[0, 0], [0, 0]]
        for r in counted:
            out[r.actual][r.predicted] = r["count"]
        return out

    def pred_table(self, threshold: float = 0.5) -> DataFrame:
        c = self.pred_counts(threshold)
        return self._spark.createDataFrame([(i, c[i][0], c[i][1]) for i in (0, 1)], "actual int, predicted_0 long, predicted_1 long")

    def _effects(self, at: str, confidence_level: float) -> Table:
        at, level = o.effects_point(at), o.level(confidence_level)
        design, b, const, link = self._design, self._b, int(self._intercept), self._link
        one = np.ones(len(b))
        if at == "overall":

            def step(s, m, _):
                x = _regressors(m, one, bool(const))
                f1, f2 = link.slopes(x @ b)
                return s[0] + len(m), s[1] + f1.sum(), s[2] + f2 @ x

            n, w, s = design.fold(lambda: (0, 0.0, np.zeros(len(b))), step, lambda a, c: tuple(x + y for x, y in zip(a, c, strict=True)))
            w, s = w / n, s / n
        else:
            point = (medians(design) if at == "median" else totals(design, factor=False).mean)[1:]
            x = np.array([1.0] * const + [float(v) for v in point])
            f1, f2 = link.slopes(np.array([x @ b]))
            w, s = float(f1[0]), float(f2[0]) * x
        effect = w * b
        jacobian = np.outer(b, s) + w * np.eye(len(b))
        v = jacobian @ self._v @ jacobian.T
        se, crit = np.sqrt(np.diag(v)), norm_ppf((1 + level) / 2)
        rows = []
        for j in range(const, len(b)):
            z = effect[j] / se[j]
            rows.append((self.param_names[j], effect[j], se[j], z, norm_sf2(z), effect[j] - crit * se[j], effect[j] + crit * se[j]))
        return Table(["param", "dydx", "std_err", "z", "p_value", "conf_low", "conf_high"], rows)

    def marginal_effects(self, at: str = "overall", confidence_level: float = 0.95) -> DataFrame:
        return self._effects(at, confidence_level).to_df(self._spark)

    def marginal_effects_rows(self, at: str = "overall", confidence_level: float = 0.95) -> list[dict]:
        return self._effects(at, confidence_level).rows()


class LogitResults(BinaryResults):
    pass


class ProbitResults(BinaryResults):
    _link = links.Probit


def _fit(out: BinaryResults, df: DataFrame, y: str, x: list[str], opt: o.LogitOptions) -> BinaryResults:
    o.non_empty(x)
    o.no_overlap([("y", y), ("x", x)])
    o.no_repeats("x", x)
    o.no_const(x, opt.include_intercept)
    given, method = o.mle_cov(opt.cov_type), o.mle_method(opt.method)
    kind, const, link = canonical(given), int(opt.include_intercept), out._link
    cluster = opt.cluster_col if kind == "cluster" else None
    design = Design(df, [y, *x], cluster=cluster)
    level = o.level(opt.confidence_level)
    if opt.max_iter <= 0:
        raise ValidationError(f"max_iter must be a positive integer, got {opt.max_iter}")
    if opt.tol <= 0:
        raise ValidationError(f"tol must be a positive number, got {opt.tol}")
    t = totals(design, binary=True, factor=False)
    if t.not_binary:
        raise ValidationError(f"y must be coded as 0.0 or 1.0 (binary outcome); {t.not_binary} value(s) are not")
    n, k = t.n, len(x) + const
    enough(n, k)
    required_cluster(kind, cluster)
    scale = np.sqrt(t.square[1:] / n)
    scale = np.r_[np.ones(const), np.where(scale > 0, scale, 1.0)]
    if design.near is None:
        design.cached = design.numbers.persist(StorageLevel.MEMORY_AND_DISK)
    try:

        def evaluate(thetas: list[np.ndarray]) -> list[Point]:
            def step(s, m, _):
                z_x = _regressors(m, scale, bool(const))
                for i, theta in enumerate(thetas):
                    value, first, second = link.terms(m[:, 0], z_x @ theta)
                    s[i] = (s[i][0] - value.sum(), s[i][1] - first @ z_x, s[i][2] + (z_x * second[:, None]).T @ z_x)
                return s

            start = lambda: [(0.0, np.zeros(k), np.zeros((k, k))) for _ in thetas]
            done = design.fold(start, step, lambda a, b: [tuple(p + q for p, q in zip(u, v, strict=True)) for u, v in zip(a, b, strict=True)])
            return [Point(theta, float(v), g, h) for theta, (v, g, h) in zip(thetas, done, strict=True)]

        at, converged, steps = SOLVERS[method](evaluate, np.zeros(k), opt.max_iter, opt.tol)
        if converged and np.linalg.norm(at.theta) > SEPARATION:
            raise ComputationError("separation suspected: the coefficients grow without bound although the gradient vanishes")
        if not converged and opt.raise_on_non_convergence:
            raise ComputationError(f"failed to converge after {steps} iterations. Set raise_on_non_convergence=False to receive the result anyway, or increase max_iter")
        v, groups = _covariance(design, link, at, scale, const, kind, n)
    finally:
        if design.cached is not None:
            design.cached.unpersist()
        design.cached = None
    b, v = at.theta / scale, v / np.outer(scale, scale)
    out._fill(df.sparkSession, ["const"] * const + x, b, v, inference(b, v, level, None))
    out._df, out._x, out._intercept, out._design = df, x, bool(const), Design(df, [y, *x])
    ones = t.mean[0] * n
    null = sum(c * math.log(c / n) for c in (ones, n - ones) if c > 0)
    out.dep_var_name, out.n_obs, out.cov_type, out.method = y, n, given, method
    out.log_likelihood, out.log_likelihood_null = -at.value, null
    out.df_model, out.df_resid = k - 1, n - k
    out.lr_statistic = 2 * (out.log_likelihood - null)
    out.lr_p_value = chi2_sf(max(out.lr_statistic, 0.0), k - 1) if k > 1 else math.nan
    out.pseudo_r_squared = 1 - out.log_likelihood / null if null else math.nan
    out.aic, out.bic = -2 * out.log_likelihood + 2 * k, -2 * out.log_likelihood + k * math.log(n)
    out.converged, out.n_iter = converged, steps
    return out


def _covariance(design: Design, link, at: Point, scale: np.ndarray, const: int, kind: str, n: int) -> tuple[np.ndarray, int | None]:
    """The covariance of the standardised coefficients."""
    k = len(at.theta)

    def score(m: np.ndarray) -> list[np.ndarray]:
        z_x = _regressors(m, scale, bool(const))
        return [z_x * link.terms(m[:, 0], z_x @ at.theta)[1][:, None]]

    if kind in ("opg", "hc0", "hc1"):
        outer = design.fold(lambda: np.zeros((k, k)), lambda s, m, _: s + (x := score(m)[0]).T @ x, lambda a, b: a + b)
        if kind == "opg":
            return spd_inverse(outer, _OPG), None
        factor, groups = (n / (n - k) if kind == "hc1" else 1.0), None
    elif kind == "cluster":
        (outer,), groups = cluster_products(design, score, [k])
        count_clusters(groups)
        factor = groups / (groups - 1) * (n - 1) / (n - k)
    bread = spd_inverse(at.hessian, SINGULAR)
    if kind == "classical":
        return bread, None
    return bread @ outer @ bread * factor, groups


class Logit:
    """Logit of a 0/1 column ``y`` on columns ``x``."""

    def __init__(self, data: DataFrame, y: str, x: list[str], options: o.LogitOptions | None = None):
        self.data, self.y, self.x, self.options = data, y, list(x), options or o.LogitOptions()

    def fit(self) -> LogitResults:
        return _fit(LogitResults(), self.data, self.y, self.x, self.options)


class Probit:
    """Probit of a 0/1 column ``y`` on columns ``x``."""

    def __init__(self, data: DataFrame, y: str, x: list[str], options: o.ProbitOptions | None = None):
        self.data, self.y, self.x, self.options = data, y, list(x), options or o.ProbitOptions()

    def fit(self) -> ProbitResults:
        return _fit(ProbitResults(), self.data, self.y, self.x, self.options)
