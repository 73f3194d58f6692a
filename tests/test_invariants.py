"""Invariants of the estimators on random small tables."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foldstat.functions.linalg import pivoted_diagonal, require_full_rank, spd_inverse, well_conditioned
from foldstat.operators.fold import triangle
from foldstat.options import no_overlap
from foldstat.errors import ComputationError, ValidationError
from foldstat.plans.regression import automatic_lags, least_squares, unit
from foldstat.plans.solvers import SOLVERS, Point


def table(seed, n, p):
    rng = np.random.default_rng(seed)
    return np.column_stack([np.ones(n), rng.standard_normal((n, p)) * rng.uniform(0.1, 50, p)])


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 10**6), n=st.integers(8, 80), cut=st.integers(1, 7))
def test_factor_in_any_pieces_gives_the_same_fit(seed, n, cut):
    w = table(seed, n, 4)
    whole, pieces = triangle(None, w), None
    for part in np.array_split(w, cut):
        pieces = triangle(pieces, part)
    np.testing.assert_allclose(whole.T @ whole, pieces.T @ pieces, rtol=1e-9, atol=1e-8)
    fits = [least_squares(r, unit(5, 0, 2, 3, 4), unit(5, 1)[:, 0]) for r in (whole, pieces)]
    want = np.linalg.lstsq(w[:, [0, 2, 3, 4]], w[:, 1], rcond=None)[0]
    for f in fits:
        np.testing.assert_allclose(f.b, want, rtol=1e-7, atol=1e-9)
        assert f.ssr == pytest.approx(((w[:, 1] - w[:, [0, 2, 3, 4]] @ want) ** 2).sum(), rel=1e-8)
        assert abs((w @ f.residual).sum()) < 1e-7  # residuals sum to zero with an intercept


@settings(max_examples=40, deadline=None)
@given(seed=st.integers(0, 10**6), scale=st.floats(1e-3, 1e3))
def test_scale_and_order(seed, scale):
    w = table(seed, 40, 3)
    r = triangle(None, w)
    a = least_squares(r, unit(4, 0, 2, 3), unit(4, 1)[:, 0])
    b = least_squares(r, unit(4, 0, 2, 3), scale * unit(4, 1)[:, 0])
    c = least_squares(r, unit(4, 3, 0, 2), unit(4, 1)[:, 0])
    np.testing.assert_allclose(b.b, scale * a.b, rtol=1e-8)
    np.testing.assert_allclose(c.b[[1, 2, 0]], a.b, rtol=1e-7, atol=1e-10)
    # Robust middles: a whitened basis gives leverages that sum to the number of coefficients.
    h = ((w @ a.whitened) ** 2).sum(axis=1)
    assert h.sum() == pytest.approx(3) and (h < 1).all()


def test_rank_gates():
    x = np.column_stack([np.ones(9), np.arange(9.0), 2 * np.arange(9.0)])
    with pytest.raises(ComputationError):
        require_full_rank(x)
    require_full_rank(x[:, :2] * [1e6, 1e-6])
    assert pivoted_diagonal(np.full((3, 2), np.nan)).sum() != pivoted_diagonal(np.full((3, 2), np.nan)).sum() or not (pivoted_diagonal(np.full((3, 2), np.nan)) > 0).all()
    with pytest.raises(ComputationError):
        require_full_rank(np.array([[1.0, np.nan], [0.0, 1.0]]))
    assert not well_conditioned(np.ones((2, 2))) and well_conditioned(np.eye(2))
    with pytest.raises(ComputationError, match="why"):
        spd_inverse(np.zeros((2, 2)), "why")
    m = np.array([[4.0, 1], [1, 3]])
    np.testing.assert_allclose(spd_inverse(m, "") @ m, np.eye(2), atol=1e-12)


def test_role_messages():
    for roles, message in (
        ([("y", "a"), ("x", ["b", "a"])], "the column 'a' specified as y is also included in x"),
        ([("y", "a"), ("weight", "a")], "the column 'a' specified as weight is also specified as y"),
        ([("x", ["a"]), ("y", "a")], "the column 'a' specified as y is also included in x"),
        ([("x_exog", ["a"]), ("instruments", ["c", "a"])], "the column 'a' specified as instruments is also included in x_exog"),
    ):
        with pytest.raises(ValidationError) as e:
            no_overlap(roles)
        assert str(e.value) == message
    no_overlap([("y", "a"), ("x", ["b"]), ("z", [])])


def test_automatic_lags():
    assert [automatic_lags(n) for n in (5, 100, 500, 10_000, 1_000_000)] == [2, 4, 5, 11, 30]


@pytest.mark.parametrize("method", SOLVERS)
def test_solvers_on_a_quartic(method):
    calls = []

    def evaluate(thetas):
        calls.append(len(thetas))
        out = []
        for t in thetas:
            d = t - [1.0, -2.0]
            h = np.array([[3.0, 0.5], [0.5, 1.0]])
            out.append(Point(t, float(d @ h @ d / 2 + (d**4).sum()), h @ d + 4 * d**3, h + np.diag(12 * d**2)))
        return out

    at, converged, steps = SOLVERS[method](evaluate, np.zeros(2), 100, 1e-9)
    assert converged and steps < 60
    np.testing.assert_allclose(at.theta, [1, -2], atol=1e-8)
    assert max(calls) == (1 if method == "newton" else 5)
