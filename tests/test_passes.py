"""How passes run: each row once whatever the number of partitions, native time order, bounded cluster sums, exact medians."""

import numpy as np
import pytest

from foldstat import OLS, OLSOptions
from foldstat.operators import passes
from foldstat.operators.fold import fold
from foldstat.sources.design import Design


@pytest.mark.parametrize("known", [True, False])
def test_every_row_is_stepped_over_once(spark, known):
    seen = spark.sparkContext.accumulator(0)
    df = spark.range(0, 3000, 1, 300).selectExpr("cast(id as double) as x")

    def step(state, m, _):
        seen.add(len(m))
        return [*state, m[:, 0].copy()]

    out = fold(df, 300 if known else None, list, step, lambda a, b: a + b)
    assert np.concatenate(out).tolist() == list(range(3000))  # in the order of the partitions
    assert seen.value == 3000


def test_parts_of_an_input_that_has_to_be_shuffled(spark):
    df = spark.range(100).selectExpr("cast(id as double) as x", "cast(id % 7 as double) as y")
    assert Design(df, ["x", "y"]).parts == df.rdd.getNumPartitions()
    shuffled = df.groupBy("y").agg({"x": "sum"}).withColumnRenamed("sum(x)", "x")
    design = Design(shuffled, ["x", "y"])
    assert design.parts is None
    assert passes.totals(design).n == 7


@pytest.mark.parametrize("start", [0, 1_764_000_000_000_000_000])
def test_time_is_ordered_as_it_is(spark, start):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(200)
    y = 1 + 2 * x + np.convolve(rng.standard_normal(205), np.ones(6) / 6, "valid")
    rows = [(start + i, float(x[i]), float(y[i])) for i in range(200)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(200)], "t long, x double, y double").repartition(5)
    se = OLS(df, "y", ["x"], OLSOptions(cov_type="hac", hac_lags=4, time_col="t")).fit().std_errors["x"]
    w = np.column_stack([np.ones(200), x])
    b, *_ = np.linalg.lstsq(w, y, rcond=None)
    s = w * (y - w @ b)[:, None]
    middle = s.T @ s
    for lag in range(1, 5):
        g = s[lag:].T @ s[:-lag]
        middle += (1 - lag / 5) * (g + g.T)
    bread = np.linalg.inv(w.T @ w)
    assert se == pytest.approx(np.sqrt((bread @ middle @ bread)[1, 1]), rel=1e-9)


@pytest.mark.parametrize("pending", [3, 1 << 16])
def test_cluster_sums_in_bounded_runs(spark, monkeypatch, pending):
    monkeypatch.setattr(passes, "PENDING", pending)
    rng = np.random.default_rng(3)
    g = np.where(rng.random(600) < 0.4, 0, rng.integers(1, 40, 600))
    x = rng.standard_normal(600)
    y = x + rng.standard_normal(600) * (1 + g / 20)
    df = spark.createDataFrame([(f"c{a}", float(b), float(c)) for a, b, c in zip(g, x, y, strict=True)], "g string, x double, y double").repartition(7)
    se = OLS(df, "y", ["x"], OLSOptions(cov_type="cluster", cluster_col="g")).fit().std_errors["x"]
    w = np.column_stack([np.ones(600), x])
    bread = np.linalg.inv(w.T @ w)
    s = w * (y - w @ (bread @ w.T @ y))[:, None]
    sums = np.array([s[g == k].sum(axis=0) for k in np.unique(g)])
    n = len(sums)
    v = bread @ (sums.T @ sums) @ bread * n / (n - 1) * 599 / 598
    assert se == pytest.approx(np.sqrt(v[1, 1]), rel=1e-9)


@pytest.mark.parametrize("n", [1, 2, 5, 64, 333])
def test_medians(spark, n):
    rng = np.random.default_rng(n)
    m = np.column_stack([rng.standard_normal(n) * 10.0 ** rng.integers(-30, 30, n), rng.integers(-2, 3, n), np.full(n, -0.0), np.exp(rng.standard_normal(n))])
    df = spark.createDataFrame([tuple(map(float, r)) for r in m], "a double, b double, c double, d double").repartition(3)
    assert passes.medians(Design(df, ["a", "b", "c", "d"])).tolist() == np.median(m, axis=0).tolist()
