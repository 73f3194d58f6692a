"""OLS and WLS against plain numpy on the whole table."""

import math

import numpy as np
import pytest

from foldstat import OLS, WLS, ComputationError, OLSOptions, ValidationError

NAMES = ["y", "x1", "x2", "w", "t", "g"]


def data(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 2)) * [1, 30] + [0, 500]
    e = rng.standard_normal(n) * (0.5 + 2 * np.abs(x[:, 0]))
    return np.column_stack([1.5 + 2 * x[:, 0] - 0.05 * x[:, 1] + e, x, rng.uniform(0.5, 1.5, n), rng.permutation(n), np.arange(n) % 7])


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(*map(float, r[:5]), f"g{int(r[5])}") for r in data()]
    return spark.createDataFrame(rows, "y double, x1 double, x2 double, w double, t double, g string").repartition(5).cache()


def oracle(d, intercept, kind, lags=None, weight=False):
    y, x = d[:, 0], d[:, 1:3]
    x = np.column_stack([np.ones(len(d)), x]) if intercept else x
    w = np.sqrt(d[:, 3]) if weight else np.ones(len(d))
    x, y = x * w[:, None], y * w
    n, k = x.shape
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    a = np.linalg.inv(x.T @ x)
    h = ((x @ a) * x).sum(axis=1)
    s = x * e[:, None]
    if kind == "classical":
        return b, a * (e @ e) / (n - k)
    if kind == "cluster":
        sums = np.array([s[d[:, 5] == g].sum(axis=0) for g in range(7)])
        return b, a @ sums.T @ sums @ a * 7 / 6 * (n - 1) / (n - k)
    if kind == "hac":
        s = s[np.argsort(d[:, 4])]
        m = s.T @ s
        for lag in range(1, lags + 1):
            g = s[lag:].T @ s[:-lag]
            m += (1 - lag / (lags + 1)) * (g + g.T)
        return b, a @ m @ a
    f = {"hc0": 1, "hc1": n / (n - k), "hc2": 1 / (1 - h), "hc3": 1 / (1 - h) ** 2}[kind]
    return b, a @ (x.T * (e * e * f)) @ x @ a


@pytest.mark.parametrize("weight", [False, True])
@pytest.mark.parametrize("kind", ["classical", "hc0", "hc1", "hc2", "hc3", "cluster", "hac"])
def test_covariances(frame, kind, weight):
    for intercept in (True, False):
        opt = OLSOptions(cov_type=kind.upper(), include_intercept=intercept, cluster_col="g", time_col="t")
        r = (WLS(frame, "y", ["x1", "x2"], "w", opt) if weight else OLS(frame, "y", ["x1", "x2"], opt)).fit()
        b, v = oracle(data(), intercept, kind, math.floor(4 * 4 ** (2 / 9)), weight)
        np.testing.assert_allclose(list(r.params.values()), b, rtol=1e-9)
        np.testing.assert_allclose(r.cov_params, v, rtol=1e-8, atol=1e-14)
        assert r.cov_type == kind
        c = int(intercept)
        f = b[c:] @ np.linalg.inv(v[c:, c:]) @ b[c:] / 2
        assert r.f_statistic == pytest.approx(f, rel=1e-8)


@pytest.mark.parametrize("lags", [0, 1, 3, 60, 399])
def test_hac_over_small_partitions(frame, lags):
    many = frame.repartition(200)
    r = OLS(many, "y", ["x1", "x2"], OLSOptions(cov_type="hac", hac_lags=lags, time_col="t")).fit()
    _, v = oracle(data(), True, "hac", lags)
    np.testing.assert_allclose(r.cov_params, v, rtol=1e-7, atol=1e-12)


def test_hac_in_source_order(spark):
    d = data(90)
    d[:, 4] = np.arange(90)
    f = spark.createDataFrame([tuple(map(float, r[:3])) for r in d], "y double, x1 double, x2 double")
    r = OLS(f, "y", ["x1", "x2"], OLSOptions(cov_type="hac", hac_lags=40)).fit()
    np.testing.assert_allclose(r.cov_params, oracle(d, True, "hac", 40)[1], rtol=1e-7, atol=1e-12)


def test_fit_statistics(frame):
    d = data()
    r = OLS(frame, "y", ["x1", "x2"]).fit()
    b, v = oracle(d, True, "classical")
    n, k = 400, 3
    e = d[:, 0] - np.column_stack([np.ones(n), d[:, 1:3]]) @ b
    ssr, sst = e @ e, ((d[:, 0] - d[:, 0].mean()) ** 2).sum()
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(ssr / n) + 1)
    assert r.r_squared == pytest.approx(1 - ssr / sst, rel=1e-10)
    assert r.r_squared_adj == pytest.approx(1 - (n - 1) / (n - k) * ssr / sst, rel=1e-10)
    assert (r.log_likelihood, r.aic, r.bic) == pytest.approx((llf, -2 * llf + 2 * k, -2 * llf + k * math.log(n)), rel=1e-12)
    assert sum(x.residual for x in r.residuals.collect()) == pytest.approx(0, abs=1e-9)
    assert r.n_obs == n and r.param_names == ["const", "x1", "x2"]
    table = r.coef_table().collect()
    assert [t.param for t in table] == r.param_names and table[1].t_stat == pytest.approx(b[1] / math.sqrt(v[1, 1]))
    assert r.conf_int["x1"][0] < r.params["x1"] < r.conf_int["x1"][1]


def test_wls_statistics(frame):
    d = data()
    r = WLS(frame, "y", ["x1", "x2"], "w").fit()
    b, _ = oracle(d, True, "classical", weight=True)
    w, n = d[:, 3], 400
    e = d[:, 0] - np.column_stack([np.ones(n), d[:, 1:3]]) @ b
    mean = w @ d[:, 0] / w.sum()
    ssr = w @ (e * e)
    assert r.r_squared == pytest.approx(1 - ssr / (w @ (d[:, 0] - mean) ** 2), rel=1e-10)
    assert r.log_likelihood == pytest.approx(-n / 2 * (math.log(2 * math.pi) + math.log(ssr / n) + 1) + np.log(w).sum() / 2, rel=1e-12)
    got = {x.t: x.residual for x in r.residuals_df().collect()}
    np.testing.assert_allclose([got[t] for t in d[:, 4]], e, rtol=1e-7, atol=1e-9)


def test_wls_of_equal_weights_is_ols(frame):
    one = frame.selectExpr("*", "1 AS one")
    a, b = WLS(one, "y", ["x1", "x2"], "one").fit(), OLS(frame, "y", ["x1", "x2"]).fit()
    assert a.params == pytest.approx(b.params) and a.log_likelihood == pytest.approx(b.log_likelihood) and a.r_squared == pytest.approx(b.r_squared)


def test_predict_by_name(spark, frame):
    r = OLS(frame, "y", ["x2", "x1"]).fit()
    new = spark.createDataFrame([(1.0, "2", 5)], "x1 double, x2 string, fitted int").drop("fitted")
    assert r.predict(new).first().fitted == pytest.approx(r.params["const"] + r.params["x1"] + 2 * r.params["x2"])
    with pytest.raises(ValidationError):
        r.predict(new.selectExpr("x1", "cast(null AS double) AS x2"))


def test_repeat_is_identical(frame):
    opt = OLSOptions(cov_type="cluster", cluster_col="g")
    a, b = (OLS(frame, "y", ["x1", "x2"], opt).fit().std_errors for _ in range(2))
    assert a == b


@pytest.mark.parametrize(
    ("kwargs", "message"),
    [
        ({"x": []}, "x must contain at least one column name"), ({"x": ["x1", "x1"]}, "column 'x1' is specified more than once in x"),
        ({"x": ["y", "x1"]}, "the column 'y' specified as y is also included in x"), ({"x": ["nope"]}, "column 'nope' does not exist in the data"),
        ({"x": ["x1"], "options": OLSOptions(confidence_level=1.0)}, "confidence_level must be in the range"),
        ({"x": ["x1"], "options": OLSOptions(cov_type="hc9")}, "unknown cov_type: 'hc9'"), ({"x": ["x1"], "options": OLSOptions(cov_type="cluster")}, "requires cluster identifiers"),
        ({"x": ["x1"], "options": OLSOptions(cov_type="hac", hac_lags=400)}, "hac_lags must be in the range"), ({"x": ["g"]}, "could not be cast"),
    ],
)
def test_validation(frame, kwargs, message):
    with pytest.raises(ValidationError, match=message):
        OLS(frame, "y", **kwargs).fit()


def test_bad_rows(spark):
    rows = [(1.0, 2.0, 1.0), (2.0, 1.0, 1.0), (3.0, 5.0, 1.0), (4.0, 4.0, 1.0)]
    f = spark.createDataFrame(rows, "y double, x double, w double")
    for sql, message in (("NULL", "missing value"), ("double('NaN')", "non-finite"), ("double('Infinity')", "non-finite")):
        with pytest.raises(ValidationError, match=message):
            OLS(f.selectExpr("y", f"IF(y = 2, {sql}, x) AS x"), "y", ["x"]).fit()
    with pytest.raises(ValidationError, match="must be positive"):
        WLS(f.selectExpr("y", "x", "y - 1 AS w"), "y", ["x"], "w").fit()
    with pytest.raises(ValidationError, match="insufficient observations"):
        OLS(f.limit(2), "y", ["x"]).fit()
    with pytest.raises(ComputationError):
        OLS(f.selectExpr("y", "x", "2 * x AS z"), "y", ["x", "z"]).fit()
    with pytest.raises(ValidationError, match="at least 2 clusters"):
        OLS(f, "y", ["x"], OLSOptions(cov_type="cluster", cluster_col="w")).fit()
    with pytest.raises(ValidationError, match="'const'"):
        OLS(f.withColumnRenamed("x", "const"), "y", ["const"]).fit()
    assert OLS(f.withColumnRenamed("x", "const"), "y", ["const"], OLSOptions(include_intercept=False)).fit().param_names == ["const"]
