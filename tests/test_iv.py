"""2SLS and GMM against plain numpy on the whole table."""

import numpy as np
import pytest

from foldstat import IV, OLS, ComputationError, IvOptions, OLSOptions, ValidationError


def data(n=300, seed=1):
    rng = np.random.default_rng(seed)
    z = rng.standard_normal((n, 3))
    x = rng.standard_normal((n, 1))
    u = rng.standard_normal(n) * (1 + np.abs(z[:, 0]))
    v = 0.6 * u[:, None] + rng.standard_normal((n, 2))
    endog = z @ rng.uniform(0.4, 0.9, (3, 2)) * [1, -1] + z[:, [1, 2]] + 0.5 * x + v
    y = 1 + 2 * x[:, 0] + endog @ [0.7, -1.2] + u
    return np.column_stack([y, x, endog, z, rng.permutation(n), np.arange(n) % 9])


COLS = "y x1 e1 e2 z1 z2 z3 t g".split()


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([tuple(map(float, r)) for r in data()], ", ".join(f"{c} double" for c in COLS)).repartition(4).cache()


def middle(d, x, e, kind, lags=3, leverage=None, k=None):
    n = len(x)
    k = k or x.shape[1]
    s = x * e[:, None]
    if kind == "cluster":
        sums = np.array([s[d[:, 8] == g].sum(axis=0) for g in range(9)])
        return sums.T @ sums * 9 / 8 * (n - 1) / (n - k)
    if kind == "hac":
        s = s[np.argsort(d[:, 7])]
        m = s.T @ s
        for lag in range(1, lags + 1):
            g = s[lag:].T @ s[:-lag]
            m += (1 - lag / (lags + 1)) * (g + g.T)
        return m
    h = ((x @ np.linalg.inv(x.T @ x)) * x).sum(axis=1)
    f = {"hc0": 1, "hc1": n / (n - k), "hc2": 1 / (1 - h), "hc3": 1 / (1 - h) ** 2}[kind]
    return (x.T * (e * e * f)) @ x


def setup(d, endog=2, nz=3):
    n = len(d)
    exog = np.column_stack([np.ones(n), d[:, 1]])
    x = np.column_stack([exog, d[:, 2 : 2 + endog]])
    z = np.column_stack([exog, d[:, 4 : 4 + nz]])
    return d[:, 0], exog, x, z


def cov(d, x, e, kind):
    n, k = x.shape
    a = np.linalg.inv(x.T @ x)
    return a * (e @ e) / (n - k) if kind == "classical" else a @ middle(d, x, e, kind) @ a


@pytest.mark.parametrize("kind", ["classical", "hc0", "hc1", "hc2", "hc3", "cluster", "hac"])
@pytest.mark.parametrize("shape", [(2, 3), (1, 3), (2, 2)])
def test_two_stage(frame, kind, shape):
    endog, nz = shape
    d = data()
    y, exog, x, z = setup(d, endog, nz)
    n, k = x.shape
    opt = IvOptions(cov_type=kind, cluster_col="g", time_col="t", hac_lags=3)
    r = IV(frame, "y", ["x1"], ["e1", "e2"][:endog], ["z1", "z2", "z3"][:nz], opt).fit()
    pi = np.linalg.lstsq(z, x, rcond=None)[0]
    hat = z @ pi
    b = np.linalg.lstsq(hat, y, rcond=None)[0]
    e = y - x @ b
    np.testing.assert_allclose(list(r.params.values()), b, rtol=1e-9)
    v = cov(d, hat, e, kind)
    np.testing.assert_allclose(r.cov_params, v, rtol=1e-8)
    assert r.f_statistic == pytest.approx(b[1:] @ np.linalg.inv(v[1:, 1:]) @ b[1:] / (k - 1), rel=1e-8)
    assert r.r_squared == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum(), rel=1e-9)
    if nz > endog:
        pe = z @ np.linalg.lstsq(z, e, rcond=None)[0]
        assert r.overid_statistic == pytest.approx(pe @ pe / (e @ e / n), rel=1e-8)
        assert 0 <= r.overid_p_value <= 1
    else:
        assert r.overid_statistic is None and r.overid_p_value is None
    rest = x[:, 2:] - hat[:, 2:]
    aug = np.column_stack([x, rest])
    ab = np.linalg.lstsq(aug, y, rcond=None)[0]
    av = cov(d, aug, y - aug @ ab, kind)[-endog:, -endog:]
    assert r.wu_hausman_statistic == pytest.approx(ab[-endog:] @ np.linalg.inv(av) @ ab[-endog:] / endog, rel=1e-7)
    first = r.first_stage()
    for j, name in enumerate(["e1", "e2"][:endog]):
        np.testing.assert_allclose(list(first[name].params.values()), pi[:, 2 + j], rtol=1e-8, atol=1e-12)
        np.testing.assert_allclose(first[name].cov_params, cov(d, z, rest[:, j], kind), rtol=1e-8, atol=1e-14)
        small = x[:, 2 + j] - exog @ np.linalg.lstsq(exog, x[:, 2 + j], rcond=None)[0]
        ssr = rest[:, j] @ rest[:, j]
        assert r.weak_instrument_f_statistics[name] == pytest.approx((small @ small - ssr) / nz / (ssr / (n - z.shape[1])), rel=1e-8)
    assert r.diagnostics().count() == endog + 2
    assert (r.df_resid, r.df_model) == (n - k, k - 1)


def gmm(d, y, x, z, weights, steps):
    n = len(y)
    s = z.T @ z
    for i in range(steps):
        if i:
            e = y - x @ b  # noqa: F821
            s = z.T @ z * (e @ e) / n if weights == "unadjusted" else middle(d, z, e, {"robust": "hc0", "kernel": "hac"}.get(weights, weights))
            if weights == "cluster":
                s = s / (9 / 8 * (n - 1) / (n - z.shape[1]))
        w = np.linalg.inv(s)
        b = np.linalg.solve(x.T @ z @ w @ z.T @ x, x.T @ z @ w @ z.T @ y)
    e = y - x @ b
    if steps == 1:
        s = s * (e @ e) / n
    ze = z.T @ e
    return b, e, w, ze @ np.linalg.inv(s) @ ze


@pytest.mark.parametrize("weights", ["unadjusted", "robust", "cluster", "kernel"])
@pytest.mark.parametrize("kind", ["classical", "hc0", "hc1", "hc2", "hc3", "cluster", "hac"])
def test_gmm(frame, weights, kind):
    d = data()
    y, _, x, z = setup(d)
    n, k = x.shape
    for steps in (1, 2, 4):
        opt = IvOptions(method="gmm", weight_type=weights, cov_type=kind, cluster_col="g", time_col="t", hac_lags=3, gmm_iterations=steps)
        r = IV(frame, "y", ["x1"], ["e1", "e2"], ["z1", "z2", "z3"], opt).fit()
        b, e, w, j = gmm(d, y, x, z, weights, steps)
        np.testing.assert_allclose(list(r.params.values()), b, rtol=1e-9)
        omega = z.T @ z * ((e - e.mean()) ** 2).sum() / (n - k) if kind == "classical" else middle(d, z, e, kind, k=k)
        inv = np.linalg.inv(x.T @ z @ w @ z.T @ x)
        v = inv @ x.T @ z @ w @ omega @ w @ z.T @ x @ inv
        np.testing.assert_allclose(r.cov_params, v, rtol=1e-7)
        assert r.overid_statistic == pytest.approx(j, rel=1e-7)
        assert r.f_statistic == pytest.approx(b[1:] @ np.linalg.inv(v[1:, 1:]) @ b[1:], rel=1e-7)
        assert (r.n_iterations, r.converged) == (steps, True)
        if kind not in ("classical", "hc0"):
            break


def test_gmm_iteration_modes(frame):
    roles = (frame, "y", ["x1"], ["e1"], ["z1", "z2", "z3"])
    r = IV(*roles, IvOptions(method="gmm", weight_type="heteroskedastic", gmm_iterations=60, gmm_convergence=1e-10)).fit()
    assert r.converged and 2 < r.n_iterations < 60
    with pytest.raises(ComputationError, match="GMM failed to converge"):
        IV(*roles, IvOptions(method="gmm", weight_type="robust", gmm_iterations=2, gmm_convergence=1e-14)).fit()
    r = IV(*roles, IvOptions(method="gmm", weight_type="robust", gmm_iterations=2, gmm_convergence=1e-14, raise_on_non_convergence=False)).fit()
    assert not r.converged
    for bad in ({"gmm_iterations": 0}, {"gmm_convergence": 0.0}, {"weight_type": "odd"}, {"weight_type": "cluster"}):
        with pytest.raises(ValidationError):
            IV(*roles, IvOptions(method="gmm", **bad)).fit()


def test_no_endogenous_is_ols(frame):
    a, b = IV(frame, "y", ["x1", "z1"], [], []).fit(), OLS(frame, "y", ["x1", "z1"]).fit()
    assert a.params == pytest.approx(b.params) and a.std_errors == pytest.approx(b.std_errors)
    assert a.overid_statistic is None and a.wu_hausman_statistic is None and a.first_stage() == {}


def test_hac_without_lags_is_hc0(frame):
    a = IV(frame, "y", ["x1"], ["e1"], ["z1"], IvOptions(cov_type="hac", hac_lags=0, time_col="t")).fit()
    b = IV(frame, "y", ["x1"], ["e1"], ["z1"], IvOptions(cov_type="hc0")).fit()
    assert a.std_errors == pytest.approx(b.std_errors, rel=1e-9)


def test_validation(frame, spark):
    for roles, message in (
        (("y", ["x1"], ["e1", "e2"], ["z1"]), "insufficient instruments"), (("y", ["x1"], ["e1"], ["x1"]), "the column 'x1' specified as instruments is also included in x_exog"),
        (("y", ["y"], ["e1"], ["z1"]), "specified as y is also included in x_exog"), (("y", ["x1"], ["e1", "e1"], ["z1", "z2"]), "more than once in x_endog"),
    ):
        with pytest.raises(ValidationError, match=message):
            IV(frame, *roles).fit()
    with pytest.raises(ValidationError, match="unknown method"):
        IV(frame, "y", ["x1"], ["e1"], ["z1"], IvOptions(method="3sls")).fit()
    with pytest.raises(ValidationError, match="first-stage"):
        IV(frame.limit(4), "y", ["x1"], ["e1"], ["z1", "z2"]).fit()
    with pytest.raises(ComputationError):
        IV(frame.selectExpr("*", "2 * z1 AS z9"), "y", ["x1"], ["e1"], ["z1", "z9"]).fit()
    with pytest.raises(ComputationError):
        IV(frame.selectExpr("*", "t % 2 AS two"), "y", ["x1"], ["e1", "e2"], ["z1", "z2"], IvOptions(cov_type="cluster", cluster_col="two")).fit()


def test_small_sample_ols_equivalence(frame):
    r = OLS(frame, "y", ["x1"], OLSOptions(include_intercept=False)).fit()
    d = data()
    assert r.params["x1"] == pytest.approx((d[:, 0] @ d[:, 1]) / (d[:, 1] @ d[:, 1]))
