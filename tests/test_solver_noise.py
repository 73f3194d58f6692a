"""Quasi-Newton fits of so many rows that rounding hides the last decreases of the log-likelihood."""

import numpy as np
import pytest

from foldstat.functions import links
from foldstat.plans.solvers import SOLVERS, Point


@pytest.mark.parametrize("link", [links.Logit, links.Probit])
@pytest.mark.parametrize("method", ["bfgs", "lbfgs"])
@pytest.mark.parametrize("n", [3_600_000, 36_000_000, 3_600_000_000])
def test_converges_in_spite_of_rounding(link, method, n):
    x, y = np.tile(np.arange(1, 51) / 10, 2), np.repeat([0.0, 1.0], 50)
    for seed in range(10):
        rng = np.random.default_rng(seed)
        many = rng.multinomial(600_000, np.repeat([0.667 / 50, 0.333 / 50], 50)) * (n / 600_000)
        z_x = np.column_stack([np.ones(100), x / np.sqrt((many * x * x).sum() / n)])

        def evaluate(thetas):
            out = []
            for t in thetas:
                value, first, second = link.terms(y, z_x @ t)
                noise = 4e-16 * rng.standard_normal(), 1e-16 * rng.standard_normal(2)  # the rounding of long sums
                gradient = -(many * first) @ z_x + noise[1] * ((many * np.abs(first)) @ z_x)
                out.append(Point(t, float(-(many * value).sum() * (1 + noise[0])), gradient, (z_x * (many * second)[:, None]).T @ z_x))
            return out

        at, converged, steps = SOLVERS[method](evaluate, np.zeros(2), 35, 1e-6)
        assert converged and steps < 35
        exact = SOLVERS["newton"](evaluate, np.zeros(2), 35, 1e-4)[0]
        np.testing.assert_allclose(at.theta, exact.theta, rtol=1e-8, atol=1e-10)
