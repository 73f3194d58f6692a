"""OLS and WLS."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import options as o
from ..errors import ValidationError
from ..operators.passes import totals
from ..sources.design import Design, number
from .regression import Cov, Fit, Inference, covariances, enough, f_test, inference, lags_for, least_squares, unit


def linear_form(df: DataFrame, names: list[str], params: np.ndarray, intercept: bool) -> Column:
    """The linear predictor as an expression over named columns, whatever they are called."""
    first = [F.lit(float(params[0]))] if intercept else []
    terms = first + [F.lit(float(b)) * number(df, n) for n, b in zip(names, params[int(intercept) :], strict=True)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def required_cluster(cov_type: str, cluster_col: str | None) -> str | None:
    if cov_type != "cluster":
        return None
    if cluster_col is None:
        raise ValidationError("cov_type='cluster' requires cluster identifiers to be provided")
    return cluster_col


def canonical(cov_type: str) -> str:
    return "classical" if cov_type == "nonrobust" else cov_type


class Table:
    """Coefficients as a small DataFrame, or as plain rows."""

    def __init__(self, names: list[str], rows: list[tuple]):
        self.names, self._rows = names, rows

    def rows(self) -> list[dict]:
        return [{n: x if isinstance(x, str) else float(x) for n, x in zip(self.names, r, strict=True)} for r in self._rows]

    def to_df(self, spark) -> DataFrame:
        kinds = ", ".join(f"{n} {'string' if n == 'param' else 'double'}" for n in self.names)
        return spark.createDataFrame([tuple(x if isinstance(x, str) else float(x) for x in r) for r in self._rows], kinds)


class Coefficients:
    """Dict accessors by parameter name that all results share."""

    _stat_name = "t_stat"

    def _fill(self, spark, names: list[str], b: np.ndarray, v: np.ndarray, inf: Inference) -> None:
        self._spark, self.param_names, self._b, self._v, self._inf = spark, names, b, v, inf

    def _by_name(self, values) -> dict[str, float]:
        return dict(zip(self.param_names, map(float, values), strict=True))

    @property
    def params(self) -> dict[str, float]:
        return self._by_name(self._b)

    @property
    def std_errors(self) -> dict[str, float]:
        return self._by_name(self._inf.se)

    @property
    def p_values(self) -> dict[str, float]:
        return self._by_name(self._inf.p)

    @property
    def conf_int(self) -> dict[str, tuple[float, float]]:
        return dict(zip(self.param_names, zip(map(float, self._inf.low), map(float, self._inf.high), strict=True), strict=True))

    @property
    def cov_params(self) -> np.ndarray:
        return self._v.copy()

    def _stats(self) -> dict[str, float]:
        return self._by_name(self._inf.stat)

    def _table(self) -> Table:
        i = self._inf
        names = ["param", "coef", "std_err", self._stat_name, "p_value", "conf_lower", "conf_upper"]
        return Table(names, list(zip(self.param_names, self._b, i.se, i.stat, i.p, i.low, i.high, strict=True)))

    def coef_rows(self) -> list[dict]:
        return self._table().rows()

    def coef_table(self) -> DataFrame:
        return self._table().to_df(self._spark)


class OlsResults(Coefficients):
    @property
    def t_stats(self) -> dict[str, float]:
        return self._stats()

    @property
    def residuals(self) -> DataFrame:
        return self.residuals_df().select("residual")

    def residuals_df(self) -> DataFrame:
        """The data with a column ``residual`` (on the scale of y, also for WLS)."""
        return self._df.withColumn("residual", number(self._df, self.dep_var_name) - linear_form(self._df, self._x, self._b, self._intercept))

    def predict(self, new_data: DataFrame | None = None) -> DataFrame:
        """The data, or new data with the same regressors, with a column ``fitted``."""
        df = self._df if new_data is None else new_data
        if new_data is not None:
            totals(Design(df, self._x), factor=False)  # missing and non-finite values are errors here too
        return df.withColumn("fitted", linear_form(df, self._x, self._b, self._intercept))


class WlsResults(OlsResults):
    pass


def _fit(df: DataFrame, y: str, x: list[str], weight: str | None, opt: o.OLSOptions) -> OlsResults:
    o.non_empty(x)
    o.no_overlap([("y", y), *([("weight", weight)] if weight else []), ("x", x)])
    o.no_repeats("x", x)
    o.no_const(x, opt.include_intercept)
    given = o.linear_cov(opt.cov_type)
    kind = canonical(given)
    cluster = opt.cluster_col if kind == "cluster" else None
    design = Design(df, [y, *x], weight, opt.time_col if kind == "hac" else None, cluster, tuple(opt.tie_cols) if kind == "hac" and opt.time_col else ())
    level = o.level(opt.confidence_level)
    t = totals(design)
    size = len(x) + 2
    basis = unit(size, *([0] if opt.include_intercept else []), *range(2, size))
    enough(t.n, basis.shape[1])
    fit = least_squares(t.r, basis, unit(size, 1)[:, 0])
    required_cluster(kind, cluster)
    cov = Cov(kind, given, lags_for(opt.hac_lags, t.n) if kind == "hac" else 0)
    v = covariances(design, [fit], cov, t.n)[0]
    out = WlsResults() if weight else OlsResults()
    _describe(out, df, y, x, opt.include_intercept, t, fit, v, cov, level, weight is not None)
    return out


def _describe(out: OlsResults, df, y: str, x: list[str], intercept: bool, t, fit: Fit, v: np.ndarray, cov: Cov, level: float, weighted: bool) -> None:
    n, k, const = t.n, fit.k, int(intercept)
    dof = cov.groups - 1 if cov.kind == "cluster" else n - k
    out._fill(df.sparkSession, ["const"] * const + x, fit.b, v, inference(fit.b, v, level, dof))
    out._df, out._x, out._intercept = df, x, intercept
    if weighted:
        sst = t.w_square[0] + (0 if intercept else t.sum_w * t.w_mean[0] ** 2)
    else:
        sst = t.square[0] + (0 if intercept else n * t.mean[0] ** 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        out.r_squared = float(1 - np.float64(fit.ssr) / sst)
        out.r_squared_adj = float(1 - (n - const) / (n - k) * (1 - out.r_squared))
        out.log_likelihood = float(-n / 2 * (math.log(2 * math.pi) + np.log(np.float64(fit.ssr) / n) + 1) + t.log_w / 2)
    out.aic, out.bic = -2 * out.log_likelihood + 2 * k, -2 * out.log_likelihood + k * math.log(n)
    out.f_statistic, out.f_p_value = f_test(fit.b[const:], v[const:, const:], dof)
    out.dep_var_name, out.n_obs, out.cov_type, out.ssr = y, n, cov.given, fit.ssr


class OLS:
    """Ordinary least squares of column ``y`` on columns ``x``."""

    def __init__(self, data: DataFrame, y: str, x: list[str], options: o.OLSOptions | None = None):
        self.data, self.y, self.x, self.options = data, y, list(x), options or o.OLSOptions()

    def fit(self) -> OlsResults:
        return _fit(self.data, self.y, self.x, None, self.options)


class WLS:
    """Weighted least squares with analytic weights in column ``weight``."""

    def __init__(self, data: DataFrame, y: str, x: list[str], weight: str, options: o.OLSOptions | None = None):
        self.data, self.y, self.x, self.weight, self.options = data, y, list(x), weight, options or o.OLSOptions()

    def fit(self) -> WlsResults:
        return _fit(self.data, self.y, self.x, self.weight, self.options)
