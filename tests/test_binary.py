"""Logit and probit against plain numpy Newton steps, and their parts."""

import math

import numpy as np
import pytest

from foldstat import ComputationError, Logit, LogitOptions, Probit, ProbitOptions, ValidationError
from foldstat.functions import links
from foldstat.functions.distributions import beta_inc, chi2_sf, f_sf, norm_ppf, norm_sf2, t_ppf, t_sf2

MODELS = {"logit": (Logit, LogitOptions, links.Logit), "probit": (Probit, ProbitOptions, links.Probit)}


def data(n=500, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 2)) * [1, 200]
    y = (0.3 + x @ [0.8, -0.004] + rng.logistic(size=n) > 0).astype(float)
    return np.column_stack([y, x, np.arange(n) % 11])


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([tuple(map(float, r)) for r in data()], "y double, x1 double, x2 double, g double").repartition(4).cache()


def oracle(link, intercept=True):
    d = data()
    y, x = d[:, 0], d[:, 1:3]
    x = np.column_stack([np.ones(len(d)), x]) if intercept else x
    b = np.zeros(x.shape[1])
    for _ in range(40):
        _, first, second = link.terms(y, x @ b)
        b = b + np.linalg.solve((x.T * second) @ x, x.T @ first)
    value, first, second = link.terms(y, x @ b)
    return x, b, value.sum(), np.linalg.inv((x.T * second) @ x), x * first[:, None]


@pytest.mark.parametrize("model", MODELS)
@pytest.mark.parametrize("kind", ["classical", "opg", "hc0", "hc1", "cluster"])
@pytest.mark.parametrize("intercept", [True, False])
def test_fit(frame, model, kind, intercept):
    cls, options, link = MODELS[model]
    x, b, value, bread, s = oracle(link, intercept)
    n, k = x.shape
    r = cls(frame, "y", ["x1", "x2"], options(cov_type=kind, cluster_col="g", include_intercept=intercept)).fit()
    np.testing.assert_allclose(list(r.params.values()), b, rtol=1e-7)
    sums = np.array([s[data()[:, 3] == g].sum(axis=0) for g in range(11)])
    v = {
        "classical": lambda: bread, "opg": lambda: np.linalg.inv(s.T @ s), "hc0": lambda: bread @ s.T @ s @ bread,
        "hc1": lambda: bread @ s.T @ s @ bread * n / (n - k), "cluster": lambda: bread @ sums.T @ sums @ bread * 11 / 10 * (n - 1) / (n - k),
    }[kind]()
    np.testing.assert_allclose(r.cov_params, v, rtol=1e-6, atol=1e-13)
    assert r.log_likelihood == pytest.approx(value, rel=1e-10)
    ones = data()[:, 0].sum()
    null = ones * math.log(ones / n) + (n - ones) * math.log(1 - ones / n)
    assert (r.log_likelihood_null, r.lr_statistic, r.pseudo_r_squared) == pytest.approx((null, 2 * (value - null), 1 - value / null))
    assert (r.df_model, r.df_resid, r.converged) == (k - 1, n - k, True)
    assert r.aic == pytest.approx(-2 * value + 2 * k)


@pytest.mark.parametrize("model", MODELS)
@pytest.mark.parametrize("method", ["bfgs", "lbfgs"])
def test_other_solvers(frame, model, method):
    cls, options, link = MODELS[model]
    r = cls(frame, "y", ["x1", "x2"], options(method=method, max_iter=100)).fit()
    np.testing.assert_allclose(list(r.params.values()), oracle(link)[1], rtol=1e-5)
    assert r.converged and r.n_iter > 1


@pytest.mark.parametrize("model", MODELS)
def test_predictions_and_effects(frame, model):
    cls, _, link = MODELS[model]
    x, b, _, v, _ = oracle(link)
    r = cls(frame, "y", ["x1", "x2"]).fit()
    p = {row.x2: row.probability for row in r.predict().collect()}
    np.testing.assert_allclose([p[a] for a in x[:, 2]], link.probability(x @ b), rtol=1e-6)
    for threshold in (0.5, 0.3, 2.0):
        counts = r.pred_counts(threshold)
        want = [[int(((data()[:, 0] == a) & ((link.probability(x @ b) > threshold) == q)).sum()) for q in (0, 1)] for a in (0, 1)]
        assert counts == want
    assert r.pred_table().columns == ["actual", "predicted_0", "predicted_1"]
    for at, point in (("overall", None), ("MEAN", x.mean(axis=0)), ("median", np.median(x, axis=0))):
        effect = (lambda c, point=point: (link.slopes(x @ c)[0].mean() if point is None else link.slopes(np.array([point @ c]))[0][0]) * c)
        h = 1e-6 * np.maximum(np.abs(b), 1e-4)
        jac = np.array([(effect(b + d) - effect(b - d)) / (2 * d[i]) for i, d in enumerate(np.diag(h))]).T
        rows = r.marginal_effects_rows(at)
        assert [q["param"] for q in rows] == ["x1", "x2"]
        np.testing.assert_allclose([q["dydx"] for q in rows], effect(b)[1:], rtol=1e-6)
        np.testing.assert_allclose([q["std_err"] for q in rows], np.sqrt(np.diag(jac @ v @ jac.T))[1:], rtol=1e-5)
    assert r.marginal_effects().columns == ["param", "dydx", "std_err", "z", "p_value", "conf_low", "conf_high"]


def test_errors(spark, frame):
    for opt, message in (
        (LogitOptions(confidence_level=0), "confidence_level"), (LogitOptions(max_iter=0), "max_iter"), (LogitOptions(tol=0), "tol"), (LogitOptions(cov_type="hc2"), "unknown cov_type"),
        (LogitOptions(method="sgd"), "unknown method"), (LogitOptions(cov_type="cluster"), "cluster identifiers"),
    ):
        with pytest.raises(ValidationError, match=message):
            Logit(frame, "y", ["x1"], opt).fit()
    with pytest.raises(ValidationError, match="binary"):
        Logit(frame, "x1", ["x2"]).fit()
    with pytest.raises(ComputationError, match="failed to converge"):
        Logit(frame, "y", ["x1", "x2"], LogitOptions(max_iter=1)).fit()
    assert not Logit(frame, "y", ["x1", "x2"], LogitOptions(max_iter=1, raise_on_non_convergence=False)).fit().converged
    with pytest.raises(ComputationError):
        Logit(frame.selectExpr("y", "x1", "3 * x1 AS x3"), "y", ["x1", "x3"]).fit()
    apart = frame.selectExpr("IF(x1 > 0, 1.0D, 0.0D) AS y", "x1")
    with pytest.raises(ComputationError):
        Logit(apart, "y", ["x1"], LogitOptions(max_iter=200)).fit()
    with pytest.raises(ValidationError, match="unknown at"):
        Logit(frame, "y", ["x1"]).fit().marginal_effects("mode")


def test_intercept_only_value(frame):
    r = Logit(frame.selectExpr("y", "1.0D AS one"), "y", ["one"], LogitOptions(include_intercept=False)).fit()
    mean = data()[:, 0].mean()
    assert r.params["one"] == pytest.approx(math.log(mean / (1 - mean)), rel=1e-8)


def test_distributions():
    for df, t in ((4, 2.7), (10, 2.2), (60, 1.9)):  # even degrees of freedom: a finite sum
        c2, term, total = 1 / (1 + t * t / df), 1.0, 1.0
        for j in range(1, df // 2):
            term *= (2 * j - 1) / (2 * j) * c2
            total += term
        assert t_sf2(t, df) == pytest.approx(1 - math.sqrt(1 - c2) * total, rel=1e-12)
    assert norm_ppf(0.975) == pytest.approx(1.959963984540054, rel=1e-14)
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-12)
    assert chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-12)
    assert f_sf(4.102821015, 2, 10) == pytest.approx(0.05, rel=1e-8)
    for df in (1, 2, 3, 7, 30, 500, 59996, 1e7):
        for p in (0.6, 0.975, 0.9999):
            assert t_sf2(t_ppf(p, df), df) == pytest.approx(2 * (1 - p), rel=1e-9)
        assert f_sf(2.3**2, 1, df) == pytest.approx(t_sf2(2.3, df), rel=1e-12)
    assert t_sf2(1, 1) == pytest.approx(0.5, rel=1e-14)  # Cauchy
    assert t_sf2(3, 2) == pytest.approx(1 - 3 / math.sqrt(11), rel=1e-13)
    assert t_sf2(2.0, 1e12) == pytest.approx(norm_sf2(2.0), rel=1e-9)
    for a, b in ((0.5, 0.5), (2, 30), (400, 20), (30000, 0.5), (12, 13)):
        for x in (0.01, 0.3, 0.9, 0.999):
            assert beta_inc(a, b, x) + beta_inc(b, a, 1 - x) == pytest.approx(1, abs=1e-12)
    # Even degrees of freedom: the chi-square tail is a finite Poisson sum.
    for x in (0.5, 20.0, 90.0):
        assert chi2_sf(x, 24) == pytest.approx(sum(math.exp(-x / 2 + i * math.log(x / 2) - math.lgamma(i + 1)) for i in range(12)), rel=1e-12)


def test_links_at_the_tails():
    z = np.array([-800.0, -40, -9, -1, 0, 1, 9, 40, 800])
    for link in (links.Logit, links.Probit):
        for y in (0.0, 1.0):
            assert all(np.isfinite(t).all() for t in link.terms(np.full(len(z), y), z))
    assert links.Logit.terms(np.ones(1), np.array([-800.0]))[0][0] == -800
    h = 1e-6
    for link in (links.Logit, links.Probit):
        v = np.linspace(-4, 4, 41)
        for y in (np.zeros(41), np.ones(41)):
            up, down = link.terms(y, v + h), link.terms(y, v - h)
            np.testing.assert_allclose((up[0] - down[0]) / (2 * h), link.terms(y, v)[1], atol=1e-7)
            np.testing.assert_allclose(-(up[1] - down[1]) / (2 * h), link.terms(y, v)[2], atol=1e-7)
