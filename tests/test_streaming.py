"""A streamed fit equals the fit of all rows, and a replayed batch counts once."""

import pytest

from foldstat import OLS, ValidationError
from foldstat.streaming.sufficient import StreamingOLS, fit_stream


def test_stream_of_files(spark, tmp_path):
    df = spark.range(500).selectExpr("double(id % 37) AS x", "double(id % 11) AS z", "2.0 * (id % 37) - (id % 11) + sin(id) AS y").repartition(6)
    df.write.parquet(str(tmp_path / "t.parquet"))
    a, b = fit_stream(spark, str(tmp_path / "t.parquet"), "y", ["x", "z"]), OLS(df, "y", ["x", "z"]).fit()
    assert a.params == pytest.approx(b.params, rel=1e-10) and a.std_errors == pytest.approx(b.std_errors, rel=1e-9) and a.n_obs == 500


def test_replay_and_merge(spark):
    df = spark.range(90).selectExpr("id", "double(id % 13) AS x", "3.0 * (id % 13) + cos(id) AS y")
    m = StreamingOLS("y", ["x"])
    for i in range(3):
        batch = df.filter(f"id % 3 = {i}")
        m.update(batch, i)
        m.update(batch, i)
    whole = OLS(df, "y", ["x"]).fit()
    assert m.fit().params == pytest.approx(whole.params) and m.fit().r_squared == pytest.approx(whole.r_squared)
    with pytest.raises(ValidationError):
        m.update(df.selectExpr("y", "cast(null AS double) AS x"), 3)
