"""The registered queries of the estimators, each with DuckDB SQL that computes the same numbers in closed form."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import IV, OLS, WLS, IvOptions, Logit, LogitOptions, OLSOptions, Probit, ProbitOptions
from .errors import ComputationError, ValidationError
from .plans.linear import Coefficients
from .streaming.sufficient import fit_stream

Query = Callable[[SparkSession, str], DataFrame]

PRICE, QUANTITY = "l_extendedprice", "l_quantity"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").withColumn("returned", (F.col("l_returnflag") == "R").cast("double")).withColumn("supply", F.col("l_suppkey").cast("double"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "value", "ts", F.hour("ts").cast("double").alias("hour"))


def _coefficients(spark: SparkSession, r: Coefficients, digits: int = 6) -> DataFrame:
    stats = r._stats()
    rows = [(p, round(r.params[p], digits), round(r.std_errors[p], digits), round(stats[p], 4)) for p in r.param_names]
    return spark.createDataFrame(rows, "param string, coef double, std_err double, stat double")


def _numbers(spark: SparkSession, values: dict[str, float | None], digits: dict[str, int]) -> DataFrame:
    row = tuple(None if v is None else round(float(v), digits.get(k, 6)) for k, v in values.items())
    return spark.createDataFrame([row], ", ".join(f"{k} double" for k in values))


# ---- closed forms in SQL -------------------------------------------------------------------------------------------

LINES = f"SELECT {PRICE} AS y, {QUANTITY} AS x, 1.0::DOUBLE AS w, l_suppkey AS g, 0 AS t FROM lineitem"
WEIGHTED = f"SELECT {PRICE} AS y, l_discount AS x, {QUANTITY} AS w, l_suppkey AS g, 0 AS t FROM lineitem"
EVENTS = "SELECT value AS y, hour(ts)::DOUBLE AS x, 1.0::DOUBLE AS w, user_id AS g, ts AS t FROM events"


def _line(source: str, first: str = "x") -> str:
    """CTEs of a weighted one-slope regression: each coefficient is a weighted sum of y, by c0 and c1; ``first`` is the regressor or its fitted value."""
    return f"""
        d AS ({source}),
        m AS (SELECT count(*)::DOUBLE AS n, sum(w) AS sw, sum(w * {first}) / sum(w) AS mx, sum(w * x) / sum(w) AS mr, sum(w * y) / sum(w) AS my FROM d),
        s AS (SELECT any_value(n) AS n, any_value(sw) AS sw, any_value(mx) AS mx, any_value(mr) AS mr, any_value(my) AS my,
                     sum(w * ({first} - mx) * (x - mr)) AS sxx, sum(w * ({first} - mx) * (y - my)) AS sxy, sum(w * ({first} - mx) ** 2) AS sff, sum(w * (y - my) ** 2) AS syy FROM d, m),
        b AS (SELECT *, sxy / sxx AS b1, my - sxy / sxx * mr AS b0 FROM s),
        r AS (SELECT d.*, y - b0 - b1 * x AS e, w * ({first} - mx) / sff AS c1, w / sw - mx * w * ({first} - mx) / sff AS c0,
                     w * (1 / sw + ({first} - mx) ** 2 / sff) AS h, n FROM d, b)"""


def _robust(kind: str, lags: str = "0") -> str:
    """v(v0, v1): the variances of the two coefficients."""
    if kind == "classical":
        return "v AS (SELECT sum(w * e * e) / (any_value(b.n) - 2) * (1 / any_value(sw) + any_value(mx) ** 2 / any_value(sff)) AS v0, sum(w * e * e) / (any_value(b.n) - 2) / any_value(sff) AS v1 FROM r, b)"
    if kind == "cluster":
        return """
            k AS (SELECT g, sum(c0 * e) AS s0, sum(c1 * e) AS s1, any_value(n) AS n FROM r GROUP BY g),
            v AS (SELECT sum(s0 * s0) * f AS v0, sum(s1 * s1) * f AS v1 FROM k, (SELECT count(*) / (count(*) - 1.0) * (any_value(n) - 1) / (any_value(n) - 2) AS f FROM k) GROUP BY f)"""
    if kind == "hac":
        return f"""
            o AS (SELECT row_number() OVER (ORDER BY t) AS i, c0 * e AS s0, c1 * e AS s1 FROM r),
            l AS (SELECT unnest(range(0, ({lags}) + 1)) AS lag, ({lags}) AS top FROM m),
            v AS (SELECT sum(f * a.s0 * z.s0) AS v0, sum(f * a.s1 * z.s1) AS v1
                  FROM (SELECT lag, (1 - lag / (top + 1.0)) * CASE WHEN lag = 0 THEN 1 ELSE 2 END AS f FROM l) q JOIN o a ON true JOIN o z ON z.i = a.i - q.lag)"""
    f = {"hc0": "1", "hc1": "n / (n - 2)", "hc2": "1 / (1 - h)", "hc3": "1 / (1 - h) ** 2"}[kind]
    return f"v AS (SELECT sum(c0 * c0 * e * e * {f}) AS v0, sum(c1 * c1 * e * e * {f}) AS v1 FROM r)"


def _rows(name: str, digits: int = 6) -> str:
    one = "SELECT '{}' AS param, round(b{i}, {d}) AS coef, round(sqrt(v{i}), {d}) AS std_err, round(b{i} / sqrt(v{i}), 4) AS stat FROM b, v"
    return one.format("const", i=0, d=digits) + " UNION ALL " + one.format(name, i=1, d=digits)


def _line_sql(source: str, kind: str, name: str, digits: int = 6, lags: str = "0", first: str = "x") -> str:
    return f"WITH {_line(source, first)}, {_robust(kind, lags)} {_rows(name, digits)}"


TWO = f"""
    d AS (SELECT {PRICE} AS y, {QUANTITY} AS p, l_discount AS q FROM lineitem),
    m AS (SELECT count(*)::DOUBLE AS n, avg(y) AS my, avg(p) AS mp, avg(q) AS mq FROM d),
    s AS (SELECT any_value(n) AS n, any_value(my) AS my, any_value(mp) AS mp, any_value(mq) AS mq, sum((p - mp) ** 2) AS pp, sum((q - mq) ** 2) AS qq, sum((p - mp) * (q - mq)) AS pq,
                 sum((p - mp) * (y - my)) AS py, sum((q - mq) * (y - my)) AS qy, sum((y - my) ** 2) AS yy FROM d, m),
    b AS (SELECT *, (py * qq - qy * pq) / (pp * qq - pq * pq) AS b1, (qy * pp - py * pq) / (pp * qq - pq * pq) AS b2 FROM s),
    e AS (SELECT b.*, my - b1 * mp - b2 * mq AS b0, yy - b1 * py - b2 * qy AS ssr, pp * qq - pq * pq AS det FROM b)"""

#: Two instruments for one regressor: the fitted first stage x_hat as a column f.
FITTED = f"""
    WITH z AS (SELECT {PRICE} AS y, {QUANTITY} AS x, l_discount AS p, l_tax AS q, l_suppkey AS g FROM lineitem),
    zm AS (SELECT avg(x) AS mx, avg(p) AS mp, avg(q) AS mq FROM z),
    zs AS (SELECT any_value(mx) AS mx, any_value(mp) AS mp, any_value(mq) AS mq, sum((p - mp) ** 2) AS pp, sum((q - mq) ** 2) AS qq, sum((p - mp) * (q - mq)) AS pq, sum((p - mp) * (x - mx)) AS px, sum((q - mq) * (x - mx)) AS qx FROM z, zm)
    SELECT y, x, mx + (px * qq - qx * pq) / (pp * qq - pq * pq) * (p - mp) + (qx * pp - px * pq) / (pp * qq - pq * pq) * (q - mq) AS f, p, q, 1.0::DOUBLE AS w, g, 0 AS t FROM z, zs"""


def _newton_sql(extra: str) -> str:
    """A logit of `returned` on the quantity (in tens), by Newton steps in a recursive CTE: it(i, b0, b1), then the information matrix."""
    return f"""
        WITH RECURSIVE d AS MATERIALIZED (SELECT (l_returnflag = 'R')::INTEGER::DOUBLE AS y, {QUANTITY} / 10 AS x, l_suppkey AS g FROM lineitem),
        it(i, b0, b1) AS (
            SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
            UNION ALL
            SELECT i + 1, b0 + (hxx * g0 - hx * g1) / (h * hxx - hx * hx), b1 + (h * g1 - hx * g0) / (h * hxx - hx * hx)
            FROM (SELECT i, b0, b1, sum(p * (1 - p)) AS h, sum(p * (1 - p) * x) AS hx, sum(p * (1 - p) * x * x) AS hxx, sum(y - p) AS g0, sum((y - p) * x) AS g1
                  FROM (SELECT i, b0, b1, x, y, 1 / (1 + exp(-b0 - b1 * x)) AS p FROM it, d WHERE i < 8) GROUP BY i, b0, b1)),
        b AS (SELECT b0, b1 FROM it ORDER BY i DESC LIMIT 1),
        r AS (SELECT *, y - p AS u FROM (SELECT d.*, b0, b1, 1 / (1 + exp(-b0 - b1 * x)) AS p FROM d, b)),
        h AS (SELECT count(*)::DOUBLE AS n, sum(p * (1 - p)) AS h, sum(p * (1 - p) * x) AS hx, sum(p * (1 - p) * x * x) AS hxx, sum(ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) AS ll, avg(y) AS my FROM r),
        i AS (SELECT *, hxx / (h * hxx - hx * hx) AS i00, -hx / (h * hxx - hx * hx) AS i01, h / (h * hxx - hx * hx) AS i11 FROM h)
        {extra}"""


def _normal_cdf(x: str, terms: int = 40) -> str:
    """The normal distribution function by its power series around 0, which converges for all x; 40 terms do for |x| < 3."""
    series = "1"
    for n in range(terms, 0, -1):
        series = f"(1 + ({x}) ** 2 / {2 * n + 1} * {series})"
    return f"(0.5 + {_normal_density(x)} * ({x}) * {series})"


def _normal_density(x: str) -> str:
    return f"(exp(-0.5 * ({x}) ** 2) / sqrt(2 * pi()))"


def _probit_sql(extra: str) -> str:
    """As ``_newton_sql`` for a probit: u is the generalised residual, f the density, p the probability, e the index."""
    parts = f"{_normal_cdf('e')} AS p, {_normal_density('e')} AS f"
    residual = "(y - p) * f / (p * (1 - p)) AS u"
    return f"""
        WITH RECURSIVE d AS MATERIALIZED (SELECT (l_returnflag = 'R')::INTEGER::DOUBLE AS y, {QUANTITY} / 10 AS x, l_suppkey AS g FROM lineitem),
        c AS MATERIALIZED (SELECT y, x, count(*)::DOUBLE AS k FROM d GROUP BY y, x),
        it(i, b0, b1) AS (
            SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
            UNION ALL
            SELECT i + 1, b0 + (hxx * g0 - hx * g1) / (h * hxx - hx * hx), b1 + (h * g1 - hx * g0) / (h * hxx - hx * hx)
            FROM (SELECT i, b0, b1, sum(k * u * (u + e)) AS h, sum(k * u * (u + e) * x) AS hx, sum(k * u * (u + e) * x * x) AS hxx, sum(k * u) AS g0, sum(k * u * x) AS g1
                  FROM (SELECT *, {residual} FROM (SELECT *, {parts} FROM (SELECT i, b0, b1, x, y, k, b0 + b1 * x AS e FROM it, c WHERE i < 8))) GROUP BY i, b0, b1)),
        b AS (SELECT b0, b1 FROM it ORDER BY i DESC LIMIT 1),
        r AS (SELECT *, {residual} FROM (SELECT *, {parts} FROM (SELECT d.*, b0, b1, b0 + b1 * x AS e FROM d, b))),
        h AS (SELECT count(*)::DOUBLE AS n, sum(u * (u + e)) AS h, sum(u * (u + e) * x) AS hx, sum(u * (u + e) * x * x) AS hxx, sum(ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) AS ll, avg(y) AS my FROM r),
        i AS (SELECT *, hxx / (h * hxx - hx * hx) AS i00, -hx / (h * hxx - hx * hx) AS i01, h / (h * hxx - hx * hx) AS i11 FROM h)
        {extra}"""


def _t_tail_sql(t: str, df: str) -> str:
    """The two-sided tail of Student's t as a scalar subquery, by the finite sum over the degrees of freedom (even or odd)."""
    even = "2 * j - 1", "2 * j"
    odd = "2 * j", "2 * j + 1"
    ratio = " ".join(f"WHEN {df} % 2 = {k} THEN ln({a}) - ln({b})" for k, (a, b) in ((0, even), (1, odd)))
    angle = f"atan({t} / sqrt({df}))"
    body = f"coalesce(sum(exp(s + {{}} * ln(cos({angle})))), 0)"
    return f"""(SELECT 1 - CASE WHEN {df} % 2 = 0 THEN sin({angle}) * (1 + {body.format("2 * j")})
        ELSE 2 / pi() * ({angle} + sin({angle}) * (cos({angle}) + {body.format("(2 * j + 1)")})) END
        FROM (SELECT j, sum(CASE {ratio} END) OVER (ORDER BY j) AS s FROM (SELECT unnest(range(1, ({df} - 1) // 2 + 1 - CASE WHEN {df} % 2 = 0 THEN 0 ELSE 1 END)) AS j)))"""


def _sandwich(s: str) -> str:
    """v from the sums s00, s01, s11 of score products in table s."""
    return f", {s}, v AS (SELECT i00 * i00 * s00 + 2 * i00 * i01 * s01 + i01 * i01 * s11 AS v0, i01 * i01 * s00 + 2 * i01 * i11 * s01 + i11 * i11 * s11 AS v1 FROM i, s)"


_SCORES = "s AS (SELECT sum(u ** 2) AS s00, sum(u ** 2 * x) AS s01, sum(u ** 2 * x * x) AS s11 FROM r)"
_GROUP_SCORES = """k AS (SELECT g, sum(u) AS a, sum(u * x) AS c FROM r GROUP BY g),
    s AS (SELECT sum(a * a) * f AS s00, sum(a * c) * f AS s01, sum(c * c) * f AS s11 FROM k, (SELECT (SELECT count(*) FROM k) / ((SELECT count(*) FROM k) - 1.0) * (n - 1) / (n - 2) AS f FROM h) GROUP BY f)"""

_GMM = f"""
    WITH d AS (SELECT {PRICE} AS y, {QUANTITY} AS x, l_discount AS p, l_tax AS q, l_suppkey AS g FROM lineitem),
    a AS (SELECT count(*)::DOUBLE AS n, sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(p * x) AS px, sum(q * x) AS qx, sum(p * y) AS py, sum(q * y) AS qy FROM d),
    one AS (SELECT *, (px * (qq * py - pq * qy) + qx * (pp * qy - pq * py)) / (px * (qq * px - pq * qx) + qx * (pp * qx - pq * px)) AS b FROM a)"""


def _gmm_step(name: str, before: str, sums: str) -> str:
    """Table `name` with the next coefficient b from weights s11, s12, s22 of table {name}_s, which `sums` defines over residuals of table `before`."""
    return f""",
    {name}_e AS (SELECT d.*, y - b * x AS e FROM d, {before}),
    {sums},
    {name} AS (SELECT a.*, s11, s12, s22, (px * (s22 * py - s12 * qy) + qx * (s11 * qy - s12 * py)) / (px * (s22 * px - s12 * qx) + qx * (s11 * qx - s12 * px)) AS b FROM a, {name}_s)"""


def _gmm_robust(name: str) -> str:
    return f"{name}_s AS (SELECT sum(e * e * p * p) AS s11, sum(e * e * p * q) AS s12, sum(e * e * q * q) AS s22 FROM {name}_e)"


def _gmm_cluster(name: str) -> str:
    return f"{name}_g AS (SELECT sum(e * p) AS u, sum(e * q) AS v FROM {name}_e GROUP BY g), {name}_s AS (SELECT sum(u * u) AS s11, sum(u * v) AS s12, sum(v * v) AS s22 FROM {name}_g)"


def _gmm_hac(name: str, lags: int) -> str:
    """Bartlett-weighted sums in the order of t, which rows of table {name}_e carry."""
    return f"""{name}_o AS (SELECT row_number() OVER (ORDER BY t) AS i, e * p AS u, e * q AS v FROM {name}_e),
    {name}_s AS (SELECT sum(f * a.u * z.u) AS s11, sum(f * (a.u * z.v + a.v * z.u) / 2) AS s12, sum(f * a.v * z.v) AS s22
        FROM (SELECT lag, (1 - lag / {lags + 1}.0) * CASE WHEN lag = 0 THEN 1 ELSE 2 END AS f FROM (SELECT unnest(range(0, {lags + 1})) AS lag)) w JOIN {name}_o a ON true JOIN {name}_o z ON z.i = a.i - w.lag)"""


def _gmm_sums(kind: str, lags: int = 3) -> str:
    """Table fin_s with the sums of the sandwich's middle over the residuals of table fin_e, of a model with one coefficient."""
    n = "(SELECT n FROM a)"
    if kind == "classical":
        return f"""fin_v AS (SELECT (sum(e * e) - sum(e) ** 2 / {n}) / ({n} - 1) AS v FROM fin_e),
        fin_s AS (SELECT v * pp AS s11, v * pq AS s12, v * qq AS s22 FROM a, fin_v)"""
    if kind == "cluster":
        return f"""fin_g AS (SELECT sum(e * p) AS u, sum(e * q) AS v FROM fin_e GROUP BY g),
        fin_s AS (SELECT sum(u * u) * c AS s11, sum(u * v) * c AS s12, sum(v * v) * c AS s22 FROM fin_g, (SELECT count(*) / (count(*) - 1.0) AS c FROM fin_g) GROUP BY c)"""
    if kind == "hac":
        return _gmm_hac("fin", lags)
    left = "(1 - (qq * p * p - 2 * pq * p * q + pp * q * q) / (pp * qq - pq * pq))"
    f = {"hc0": "1", "hc1": "n / (n - 1)", "hc2": f"1 / {left}", "hc3": f"1 / {left} ** 2"}[kind]
    return f"fin_s AS (SELECT sum(e * e * p * p * {f}) AS s11, sum(e * e * p * q * {f}) AS s12, sum(e * e * q * q * {f}) AS s22 FROM fin_e, a)"


def _gmm_end(last: str, kind: str = "hc0", digits: int = 5, j_digits: int = 5) -> str:
    """Coefficient, standard error in the general sandwich form, and J."""
    return f""",
    fin_e AS (SELECT d.*, y - b * x AS e FROM d, {last}),
    {_gmm_sums(kind)},
    fin AS (SELECT any_value(o.s11) AS o11, any_value(o.s12) AS o12, any_value(o.s22) AS o22, sum(e * p) AS ep, sum(e * q) AS eq FROM fin_e, fin_s o),
    w AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * px - s12 * qx) / (s11 * s22 - s12 * s12) AS a1, (s11 * qx - s12 * px) / (s11 * s22 - s12 * s12) AS a2 FROM {last}, fin)
    SELECT round(b, {digits}) AS coef, round(sqrt(a1 * a1 * o11 + 2 * a1 * a2 * o12 + a2 * a2 * o22) / (px * a1 + qx * a2), {digits}) AS std_err,
           round((s22 * ep * ep - 2 * s12 * ep * eq + s11 * eq * eq) / det, {j_digits}) AS j FROM w"""


#: A just-identified equation with the tax as an exogenous regressor: all columns less what a constant and the tax explain, t less its mean.
EXOG = f"""
    WITH s AS (SELECT {PRICE} AS y, {QUANTITY} AS x, l_discount AS z, l_tax AS t, l_suppkey AS g FROM lineitem),
    m AS (SELECT avg(y) AS my, avg(x) AS mx, avg(z) AS mz, avg(t) AS mt, regr_slope(y, t) AS ty, regr_slope(x, t) AS tx, regr_slope(z, t) AS tz FROM s)
    SELECT y - my - ty * (t - mt) AS y, x - mx - tx * (t - mt) AS x, z - mz - tz * (t - mt) AS z, t - mt AS t, g FROM s, m"""


def _iv_exog_sql(kind: str) -> str:
    left = "(1 - 1 / n - t * t / tt - z * z / zz)"
    score = {"hc0": "z * e", "hc1": "z * e * sqrt(n / (n - 3))", "hc2": f"z * e / sqrt({left})", "hc3": f"z * e / {left}"}
    if kind == "classical":
        v = "SELECT sum(e * e) / (any_value(n) - 3) * any_value(zz) / any_value(zx) ** 2 AS v FROM r"
    elif kind == "cluster":
        v = "SELECT sum(s * s) * count(*) / (count(*) - 1.0) * (any_value(n) - 1) / (any_value(n) - 3) / any_value(zx) ** 2 AS v FROM (SELECT sum(z * e) AS s, any_value(n) AS n, any_value(zx) AS zx FROM r GROUP BY g)"
    else:
        v = f"SELECT sum(({score[kind]}) ** 2) / any_value(zx) ** 2 AS v FROM r"
    return f"""
        WITH d AS ({EXOG}), a AS (SELECT count(*)::DOUBLE AS n, sum(z * x) AS zx, sum(z * y) AS zy, sum(z * z) AS zz, sum(t * t) AS tt FROM d),
        r AS (SELECT d.*, a.*, y - zy / zx * x AS e FROM d, a), v AS ({v})
        SELECT '{QUANTITY}' AS param, round(zy / zx, 2) AS coef, round(sqrt(v), 2) AS std_err, round(zy / zx / sqrt(v), 4) AS stat FROM a, v"""


def _iv_two_sql(kind: str) -> str:
    """Two endogenous regressors and as many instruments, all less their means; inv is the inverse of Z'X."""
    middle = "sum(p * p * f) AS m11, sum(p * q * f) AS m12, sum(q * q * f) AS m22"
    f = "s2" if kind == "classical" else "e * e"
    row = "SELECT '{}' AS param, round(b{i}, 2) AS coef, round(sqrt(v{i}), 2) AS std_err, round(b{i} / sqrt(v{i}), 4) AS stat FROM v"
    return f"""
        WITH s AS (SELECT {PRICE} AS y, {QUANTITY} AS x, l_linenumber::DOUBLE AS w, l_discount AS p, l_tax AS q FROM lineitem),
        m AS (SELECT avg(y) AS my, avg(x) AS mx, avg(w) AS mw, avg(p) AS mp, avg(q) AS mq FROM s),
        d AS (SELECT y - my AS y, x - mx AS x, w - mw AS w, p - mp AS p, q - mq AS q FROM s, m),
        a AS (SELECT count(*)::DOUBLE AS n, sum(p * x) AS px, sum(p * w) AS pw, sum(q * x) AS qx, sum(q * w) AS qw, sum(p * y) AS py, sum(q * y) AS qy FROM d),
        b AS (SELECT *, px * qw - pw * qx AS det, (qw * py - pw * qy) / (px * qw - pw * qx) AS b1, (px * qy - qx * py) / (px * qw - pw * qx) AS b2 FROM a),
        r AS (SELECT d.*, y - b1 * x - b2 * w AS e FROM d, b), z AS (SELECT sum(e * e) / (any_value(n) - 3) AS s2 FROM r, b),
        o AS (SELECT {middle} FROM (SELECT r.*, {f} AS f FROM r, z)),
        v AS (SELECT b1, b2, (qw * qw * m11 - 2 * qw * pw * m12 + pw * pw * m22) / det ** 2 AS v1, (qx * qx * m11 - 2 * qx * px * m12 + px * px * m22) / det ** 2 AS v2 FROM b, o)
        {row.format(QUANTITY, i=1)} UNION ALL {row.format("l_linenumber", i=2)}"""


_FIVE_LAGS = "5"
_AUTO_LAGS = "floor(4 * (n / 100) ** (2.0 / 9))::INTEGER"


def _ols(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _coefficients(spark, OLS(_lineitem(spark, sf_dir), PRICE, [QUANTITY], OLSOptions(cov_type=kind, cluster_col="l_suppkey")).fit())

    return run


def _wls(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _coefficients(spark, WLS(_lineitem(spark, sf_dir), PRICE, ["l_discount"], QUANTITY, OLSOptions(cov_type=kind, cluster_col="l_suppkey")).fit(), 5)

    return run


def _hac(lags: int | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _coefficients(spark, OLS(_events(spark, sf_dir), "value", ["hour"], OLSOptions(cov_type="hac", hac_lags=lags, time_col="ts")).fit(), 8)

    return run


def wls_hac(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("w", F.minute("ts") + 1.0)
    return _coefficients(spark, WLS(e, "value", ["hour"], "w", OLSOptions(cov_type="hac", hac_lags=5, time_col="ts")).fit(), 8)


def ols_two_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, OLS(_lineitem(spark, sf_dir), PRICE, [QUANTITY, "l_discount"]).fit(), 5)


def ols_no_intercept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, OLS(_lineitem(spark, sf_dir), PRICE, [QUANTITY], OLSOptions(include_intercept=False)).fit())


def ols_fit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = OLS(_lineitem(spark, sf_dir), PRICE, [QUANTITY, "l_discount"]).fit()
    values = {"r_squared": r.r_squared, "r_squared_adj": r.r_squared_adj, "f_statistic": r.f_statistic, "log_likelihood": r.log_likelihood, "aic": r.aic, "bic": r.bic}
    return _numbers(spark, values, {"r_squared": 10, "r_squared_adj": 10, "f_statistic": 5, "log_likelihood": 4, "aic": 4, "bic": 4})


def ols_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = OLS(_lineitem(spark, sf_dir), PRICE, [QUANTITY]).fit()
    grid = spark.range(1, 51).select(F.col("id").alias("quantity"), F.col("id").cast("double").alias(QUANTITY))
    return r.predict(grid).select("quantity", F.round("fitted", 5).alias("fitted"))


def ols_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = OLS(_lineitem(spark, sf_dir), PRICE, [QUANTITY]).fit()
    by = r.residuals_df().groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.avg("residual").alias("m"), F.max("residual").alias("top"))
    return by.select("l_suppkey", "n", (F.round("m", 4) + 0.0).alias("mean_residual"), F.round("top", 4).alias("max_residual"))


def ols_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = OLS(_table(spark, sf_dir, "orders"), "o_totalprice", ["o_custkey"]).fit()
    rows = [(t["param"], round(t["p_value"], 8), round(t["conf_lower"], 4), round(t["conf_upper"], 4)) for t in r.coef_rows()]
    return spark.createDataFrame(rows, "param string, p_value double, conf_lower double, conf_upper double")


def wls_fit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = WLS(_lineitem(spark, sf_dir), PRICE, ["l_discount"], QUANTITY).fit()
    return _numbers(spark, {"r_squared": r.r_squared, "log_likelihood": r.log_likelihood, "f_statistic": r.f_statistic}, {"r_squared": 11, "log_likelihood": 4, "f_statistic": 6})


def _iv(kind: str, instruments: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        opt = IvOptions(cov_type=kind, cluster_col="l_suppkey")
        return _coefficients(spark, IV(_lineitem(spark, sf_dir), PRICE, [], [QUANTITY], instruments, opt).fit(), 2)

    return run


def _iv_exog(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = IV(_lineitem(spark, sf_dir), PRICE, ["l_tax"], [QUANTITY], ["l_discount"], IvOptions(cov_type=kind, cluster_col="l_suppkey")).fit()
        return _coefficients(spark, r, 2).filter(F.col("param") == QUANTITY)

    return run


def _iv_two(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = IV(_lineitem(spark, sf_dir), PRICE, [], [QUANTITY, "l_linenumber"], ["l_discount", "l_tax"], IvOptions(cov_type=kind)).fit()
        return _coefficients(spark, r, 2).filter(F.col("param") != "const")

    return run


def _iv_over(spark: SparkSession, sf_dir: str, **options):
    return IV(_lineitem(spark, sf_dir), PRICE, [], [QUANTITY], ["l_discount", "l_tax"], IvOptions(**options)).fit()


def iv_sargan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, {"sargan": _iv_over(spark, sf_dir).overid_statistic}, {"sargan": 6})


def iv_weak_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, {"weak_f": _iv_over(spark, sf_dir).weak_instrument_f_statistics[QUANTITY]}, {"weak_f": 7})


def iv_wu_hausman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, {"wu_hausman": _iv_over(spark, sf_dir).wu_hausman_statistic}, {"wu_hausman": 6})


def iv_first_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, IV(_lineitem(spark, sf_dir), PRICE, [], [QUANTITY], ["l_discount"]).fit().first_stage()[QUANTITY])


def _gmm(weights: str, steps: int, convergence: float | None = None, kind: str = "hc0") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = _iv_over(spark, sf_dir, method="gmm", weight_type=weights, gmm_iterations=steps, gmm_convergence=convergence, include_intercept=False, cov_type=kind, cluster_col="l_suppkey")
        return _numbers(spark, {"coef": r.params[QUANTITY], "std_err": r.std_errors[QUANTITY], "j": r.overid_statistic}, {"coef": 5, "std_err": 5, "j": 5})

    return run


def gmm_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("minute", F.minute("ts").cast("double")).withColumn("second", F.second("ts").cast("double"))
    r = IV(e, "value", [], ["hour"], ["minute", "second"], IvOptions(method="gmm", weight_type="kernel", cov_type="hac", hac_lags=3, time_col="ts", include_intercept=False)).fit()
    return _numbers(spark, {"coef": r.params["hour"], "std_err": r.std_errors["hour"], "j": r.overid_statistic}, {"coef": 7, "std_err": 7, "j": 6})


def gmm_cov_hac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unadjusted weights in one step, and a HAC covariance; the Wald statistic of the one coefficient."""
    e = _events(spark, sf_dir).withColumn("minute", F.minute("ts").cast("double")).withColumn("second", F.second("ts").cast("double"))
    r = IV(e, "value", [], ["hour"], ["minute", "second"], IvOptions(method="gmm", weight_type="robust", cov_type="hac", hac_lags=3, time_col="ts", include_intercept=False)).fit()
    return _numbers(spark, {"coef": r.params["hour"], "std_err": r.std_errors["hour"], "wald": r.f_statistic}, {"coef": 7, "std_err": 7, "wald": 4})


def _binary(spark: SparkSession, sf_dir: str, cls=Logit, **options):
    df = _lineitem(spark, sf_dir).withColumn("tens", F.col(QUANTITY) / 10)
    return cls(df, "returned", ["tens"], (LogitOptions if cls is Logit else ProbitOptions)(cluster_col="l_suppkey", **options)).fit()


def _logit(digits: int = 7, **options) -> Query:
    return lambda spark, sf_dir: _coefficients(spark, _binary(spark, sf_dir, **options), digits)


def _fit_stats(cls) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = _binary(spark, sf_dir, cls)
        values = {"log_likelihood": r.log_likelihood, "log_likelihood_null": r.log_likelihood_null, "lr_statistic": r.lr_statistic, "pseudo_r_squared": r.pseudo_r_squared, "aic": r.aic}
        return _numbers(spark, values, {"log_likelihood": 5, "log_likelihood_null": 5, "lr_statistic": 5, "pseudo_r_squared": 10, "aic": 5})

    return run


def _predict(cls) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = _binary(spark, sf_dir, cls)
        return r.predict().groupBy(QUANTITY).agg(F.round(F.max("probability"), 9).alias("probability"), F.count(F.lit(1)).alias("n"))

    return run


def _pred_table(cls) -> Query:
    return lambda spark, sf_dir: _binary(spark, sf_dir, cls).pred_table(0.333)


def _margins(at: str, cls=Logit) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        (m,) = _binary(spark, sf_dir, cls).marginal_effects_rows(at)
        return _numbers(spark, {"dydx": m["dydx"], "std_err": m["std_err"]}, {"dydx": 9, "std_err": 9})

    return run


def _probit(**options) -> Query:
    return lambda spark, sf_dir: _coefficients(spark, _binary(spark, sf_dir, Probit, **options), 6)


def probit_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    (m,) = _binary(spark, sf_dir, Probit).marginal_effects_rows()
    return _numbers(spark, {"dydx": m["dydx"], "std_err": m["std_err"], "p_value": m["p_value"]}, {"dydx": 9, "std_err": 9, "p_value": 7})


def stream_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fit as ``ols_simple``, its factor kept up by a stream over the file."""
    return _coefficients(spark, fit_stream(spark, f"{sf_dir}/lineitem.parquet", PRICE, [QUANTITY]))


def validate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that the engine's messages give for bad rows: missing, no number, non-finite, not binary; and the least weight."""
    word = F.when(F.col("l_returnflag") == "R", "3.5").otherwise(F.col("l_returnflag"))
    infinite = F.when(F.col("l_tax") > 0.05, float("inf")).otherwise(F.col("l_tax"))
    df = _lineitem(spark, sf_dir).select(PRICE, "l_quantity", F.nullif(F.col(QUANTITY), F.lit(7.0)).alias("gap"), word.alias("word"), infinite.alias("far"), (F.col("l_discount") - 0.5).alias("w"))
    cases = {
        "missing": lambda: OLS(df, PRICE, ["gap"]).fit(), "not_numeric": lambda: OLS(df, PRICE, ["word"]).fit(), "not_finite": lambda: OLS(df, PRICE, ["far"]).fit(),
        "not_binary": lambda: Logit(df, "l_quantity", ["w"]).fit(), "least_weight": lambda: WLS(df, PRICE, ["l_quantity"], "w").fit(),
    }
    found = {}
    for name, call in cases.items():
        try:
            call()
        except ValidationError as e:
            numbers = re.findall(r"-?\d+(?:\.\d+)?", str(e))
            found[name] = float(numbers[-1] if name in ("least_weight", "not_binary") else [x for x in numbers if x != "64"][0])
    return _numbers(spark, found, {})


def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engine raises for each kind of bad input: (rule, error class)."""
    df = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").withColumns(
        {"one": F.lit(1.0), "const": F.col("s_acctbal"), "twin": F.col("s_acctbal") * 2, "zero": F.lit(0), "y": (F.col("s_acctbal") > 3000).cast("int"), "near": F.col("s_acctbal") + F.col("s_suppkey") * 1e-13}
    )
    two, y, x, z = df.limit(2), "s_acctbal", "s_nationkey", "s_suppkey"
    ols = lambda **o: OLS(df, y, [x], OLSOptions(**o)).fit()
    gmm = lambda **o: IV(df, y, [], [x], [z], IvOptions(method="gmm", **o)).fit()
    cases = {
        "V1": lambda: OLS(df, y, []).fit(), "V2": lambda: OLS(df, y, [x, x]).fit(), "V3": lambda: OLS(df, y, ["const"]).fit(), "V4": lambda: OLS(df, y, [y]).fit(),
        "V5": lambda: OLS(df, y, ["absent"]).fit(), "V6": lambda: OLS(df.withColumn("x", F.nullif(F.col(x), F.lit(3))), y, ["x"]).fit(),
        "V7": lambda: OLS(df.withColumn("x", F.lit(float("nan"))), y, ["x"]).fit(), "V8": lambda: WLS(df, y, [x], "zero").fit(), "V10": lambda: ols(confidence_level=1.0),
        "V11": lambda: OLS(two, y, [x]).fit(), "V12": lambda: IV(df, y, [], [], [], IvOptions(include_intercept=False)).fit(), "V13": lambda: Logit(df, x, [y]).fit(),
        "V14_iterations": lambda: Logit(df, "y", [x], LogitOptions(max_iter=0)).fit(), "V14_tolerance": lambda: Probit(df, "y", [x], ProbitOptions(tol=0.0)).fit(),
        "V16": lambda: ols(cov_type="cluster", cluster_col="one"), "V17": lambda: ols(cov_type="cluster"), "V18": lambda: ols(cov_type="hac", hac_lags=-1, time_col=z),
        "V19": lambda: IV(df, y, [], [x], []).fit(), "V20": lambda: gmm(gmm_iterations=0), "V21": lambda: gmm(weight_type="cluster", cluster_col="one", gmm_iterations=1),
        "V22": lambda: OLS(df.withColumn("same", F.col("one") * 2), y, ["same"]).fit(), "V24": lambda: Logit(df, "y", [y], LogitOptions(max_iter=500, tol=1e-14)).fit(),
        "options": lambda: ols(cov_type="hc9"),
    }
    rows = []
    for rule, call in cases.items():
        try:
            call()
            rows.append((rule, "none"))
        except (ValidationError, ComputationError) as e:
            rows.append((rule, type(e).__name__))
    return spark.createDataFrame(rows, "rule string, error string")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {"ols_simple": _ols("classical")}
    out |= {f"ols_{k}": _ols(k) for k in ("hc0", "hc1", "hc2", "hc3", "cluster")}
    out |= {"ols_hac": _hac(5), "ols_hac_auto": _hac(None)}
    out |= {f.__name__: f for f in (ols_two_slopes, ols_no_intercept, ols_fit_stats, ols_predict, ols_residuals, ols_p_values)}
    out |= {f"wls_{k}": _wls(k) for k in ("classical", "hc0", "hc1", "hc2", "hc3", "cluster")} | {"wls_hac": wls_hac, "wls_fit_stats": wls_fit_stats}
    out |= {f"iv_exog_{k}": _iv_exog(k) for k in ("classical", "hc0", "hc1", "hc2", "hc3", "cluster")} | {f"iv_two_endogenous_{k}": _iv_two(k) for k in ("classical", "hc0")}
    out |= {"iv_just_identified": _iv("classical", ["l_discount"]), "iv_just_hc1": _iv("hc1", ["l_discount"]), "iv_overid": _iv("classical", ["l_discount", "l_tax"]), "iv_overid_hc0": _iv("hc0", ["l_discount", "l_tax"]), "iv_overid_cluster": _iv("cluster", ["l_discount", "l_tax"])}
    out |= {f.__name__: f for f in (iv_sargan, iv_weak_f, iv_wu_hausman, iv_first_stage)}
    out |= {"gmm_one_step": _gmm("unadjusted", 1), "gmm_two_step_robust": _gmm("robust", 2), "gmm_three_step_robust": _gmm("robust", 3), "gmm_cluster": _gmm("cluster", 2), "gmm_iterated": _gmm("robust", 100, 1e-10), "gmm_kernel": gmm_kernel, "gmm_cov_hac": gmm_cov_hac}
    out |= {f"gmm_cov_{k}": _gmm("robust", 2, kind=k) for k in ("classical", "hc1", "hc2", "hc3", "cluster")}
    out |= {"logit_newton": _logit(), "logit_bfgs": _logit(4, method="bfgs"), "logit_lbfgs": _logit(4, method="lbfgs")} | {f"logit_{k}": _logit(cov_type=k) for k in ("opg", "hc0", "hc1", "cluster")}
    for name, cls in (("logit", Logit), ("probit", Probit)):
        out |= {f"{name}_fit_stats": _fit_stats(cls), f"{name}_predict": _predict(cls), f"{name}_pred_table": _pred_table(cls)}
        out |= {f"{name}_margins_{a}": _margins(a, cls) for a in ("overall", "mean", "median")}
    out |= {"probit_newton": _probit(), "probit_bfgs": _probit(method="bfgs"), "probit_lbfgs": _probit(method="lbfgs"), "probit_opg": _probit(cov_type="opg"), "probit_hc0": _probit(cov_type="hc0"), "probit_hc1": _probit(cov_type="hc1"), "probit_cluster": _probit(cov_type="cluster"), "probit_margins": probit_margins}
    out |= {"stream_ols": stream_ols, "validate_counts": validate_counts, "validation_errors": validation_errors}
    return out


def oracle_sql() -> dict[str, str]:
    out = {"ols_simple": _line_sql(LINES, "classical", QUANTITY)}
    out["stream_ols"] = out["ols_simple"]
    out |= {f"ols_{k}": _line_sql(LINES, k, QUANTITY) for k in ("hc0", "hc1", "hc2", "hc3", "cluster")}
    out["ols_hac"] = _line_sql(EVENTS, "hac", "hour", 8, _FIVE_LAGS)
    out["ols_hac_auto"] = _line_sql(EVENTS, "hac", "hour", 8, _AUTO_LAGS)
    two = "SELECT '{}' AS param, round(b{i}, 5) AS coef, round(sqrt(ssr / (n - 3) * ({f})), 5) AS std_err, round(b{i} / sqrt(ssr / (n - 3) * ({f})), 4) AS stat FROM e"
    parts = [("const", 0, "1 / n + (mp * mp * qq - 2 * mp * mq * pq + mq * mq * pp) / det"), (QUANTITY, 1, "qq / det"), ("l_discount", 2, "pp / det")]
    out["ols_two_slopes"] = f"WITH {TWO} " + " UNION ALL ".join(two.format(name, i=i, f=f) for name, i, f in parts)
    out["ols_no_intercept"] = f"""
        WITH s AS (SELECT count(*) AS n, sum({QUANTITY} * {PRICE}) / sum({QUANTITY} ** 2) AS b, sum({QUANTITY} ** 2) AS xx FROM lineitem),
        v AS (SELECT sqrt(sum(({PRICE} - b * {QUANTITY}) ** 2) / (any_value(n) - 1) / any_value(xx)) AS se FROM lineitem, s)
        SELECT '{QUANTITY}' AS param, round(b, 6) AS coef, round(se, 6) AS std_err, round(b / se, 4) AS stat FROM s, v"""
    out["ols_fit_stats"] = f"""
        WITH {TWO}, l AS (SELECT *, -n / 2 * (ln(2 * pi()) + ln(ssr / n) + 1) AS ll FROM e)
        SELECT round(1 - ssr / yy, 10) AS r_squared, round(1 - (n - 1) / (n - 3) * ssr / yy, 10) AS r_squared_adj, round((yy - ssr) / 2 / (ssr / (n - 3)), 5) AS f_statistic,
               round(ll, 4) AS log_likelihood, round(-2 * ll + 6, 4) AS aic, round(-2 * ll + 3 * ln(n), 4) AS bic FROM l"""
    out["ols_predict"] = f"WITH {_line(LINES)} SELECT unnest(range(1, 51)) AS quantity, round(b0 + b1 * unnest(range(1, 51)), 5) AS fitted FROM b"
    out["ols_residuals"] = f"WITH {_line(LINES)} SELECT g AS l_suppkey, count(*) AS n, round(avg(e), 4) + 0.0 AS mean_residual, round(max(e), 4) AS max_residual FROM r GROUP BY g"
    out |= {f"wls_{k}": _line_sql(WEIGHTED, k, "l_discount", 5) for k in ("classical", "hc0", "hc1", "hc2", "hc3", "cluster")}
    out["wls_hac"] = _line_sql(EVENTS.replace("1.0::DOUBLE AS w", "minute(ts) + 1.0 AS w"), "hac", "hour", 8, _FIVE_LAGS)
    out |= {f"iv_exog_{k}": _iv_exog_sql(k) for k in ("classical", "hc0", "hc1", "hc2", "hc3", "cluster")} | {f"iv_two_endogenous_{k}": _iv_two_sql(k) for k in ("classical", "hc0")}
    normal = "1.959963984540054"  # the 97.5 % point of the normal distribution; the t point by its expansion in 1 / df
    crit = "z + (z ** 3 + z) / (4 * df) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * df ** 2) + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * df ** 3)"
    tail = _t_tail_sql("abs(stat)", "df")
    line = _line("SELECT o_totalprice AS y, o_custkey AS x, 1.0::DOUBLE AS w, 0 AS g, 0 AS t FROM orders")
    out["ols_p_values"] = f"""
        WITH {line}, {_robust("classical")}, c AS (SELECT param, b, se, b / se AS stat, (n - 2)::BIGINT AS df, {normal} AS z
            FROM (SELECT 'const' AS param, b0 AS b, sqrt(v0) AS se, n FROM b, v UNION ALL SELECT 'o_custkey', b1, sqrt(v1), n FROM b, v))
        SELECT param, round(CASE WHEN abs(stat) > 38 THEN 0 ELSE {tail} END, 8) AS p_value, round(b - se * ({crit}), 4) AS conf_lower, round(b + se * ({crit}), 4) AS conf_upper FROM c"""
    out["wls_fit_stats"] = f"""
        WITH {_line(WEIGHTED)}, q AS (SELECT sum(w * e * e) AS ssr, sum(ln(w)) AS lw FROM r)
        SELECT round(1 - ssr / syy, 11) AS r_squared, round(-n / 2 * (ln(2 * pi()) + ln(ssr / n) + 1) + lw / 2, 4) AS log_likelihood, round((syy - ssr) / (ssr / (n - 2)), 6) AS f_statistic FROM b, q"""
    just = f"SELECT {PRICE} AS y, {QUANTITY} AS x, mx + px / pp * (p - mp) AS f, 1.0::DOUBLE AS w, 0 AS g, 0 AS t FROM (SELECT *, l_discount AS p FROM lineitem), (SELECT avg({QUANTITY}) AS mx, avg(l_discount) AS mp, regr_sxy({QUANTITY}, l_discount) AS px, regr_sxx({QUANTITY}, l_discount) AS pp FROM lineitem)"
    out["iv_just_identified"], out["iv_just_hc1"] = (_line_sql(just, k, QUANTITY, 2, first="f") for k in ("classical", "hc1"))
    out |= {n: _line_sql(FITTED, k, QUANTITY, 2, first="f") for n, k in (("iv_overid", "classical"), ("iv_overid_hc0", "hc0"), ("iv_overid_cluster", "cluster"))}
    both = "any_value(n) AS n, sum((p - zp) ** 2) AS pp, sum((q - zq) ** 2) AS qq, sum((p - zp) * (q - zq)) AS pq"
    out["iv_sargan"] = f"""
        WITH {_line(FITTED, "f")}, zz AS (SELECT avg(p) AS zp, avg(q) AS zq FROM r), k AS (SELECT {both}, sum((p - zp) * e) AS pe, sum((q - zq) * e) AS qe, sum(e * e) AS ssr FROM r, zz)
        SELECT round((qq * pe * pe - 2 * pq * pe * qe + pp * qe * qe) / (pp * qq - pq * pq) / (ssr / n), 6) AS sargan FROM k"""
    out["iv_weak_f"] = f"WITH d AS ({FITTED}) SELECT round((var_pop(f) * count(*) / 2) / (sum((x - f) ** 2) / (count(*) - 3)), 7) AS weak_f FROM d"
    out["iv_wu_hausman"] = f"""
        WITH d AS ({FITTED}), c AS (SELECT count(*)::DOUBLE AS n, avg(y) AS my, avg(x) AS mx FROM d),
        s AS (SELECT any_value(n) AS n, sum((y - my) ** 2) AS yy, sum((x - mx) ** 2) AS xx, sum((x - f) ** 2) AS vv, sum((x - mx) * (x - f)) AS xv, sum((x - mx) * (y - my)) AS xy, sum((x - f) * (y - my)) AS vy FROM d, c),
        b AS (SELECT *, (xy * vv - vy * xv) / (xx * vv - xv * xv) AS b1, (vy * xx - xy * xv) / (xx * vv - xv * xv) AS b2 FROM s)
        SELECT round(b2 * b2 / ((yy - b1 * xy - b2 * vy) / (n - 3) * xx / (xx * vv - xv * xv)), 6) AS wu_hausman FROM b"""
    out["iv_first_stage"] = _line_sql(f"SELECT {QUANTITY} AS y, l_discount AS x, 1.0::DOUBLE AS w, 0 AS g, 0 AS t FROM lineitem", "classical", "l_discount")
    # One step: S is Z'Z, and J scales it by the residual variance.
    scaled = "one_e AS (SELECT sum((y - b * x) ** 2) / any_value(n) AS s2 FROM d, one), last AS (SELECT one.*, s2 * pp AS s11, s2 * pq AS s12, s2 * qq AS s22 FROM one, one_e)"
    out["gmm_one_step"] = f"{_GMM}, {scaled}{_gmm_end('last')}"
    out["gmm_two_step_robust"] = _GMM + _gmm_step("two", "one", _gmm_robust("two")) + _gmm_end("two")
    out["gmm_three_step_robust"] = _GMM + _gmm_step("two", "one", _gmm_robust("two")) + _gmm_step("three", "two", _gmm_robust("three")) + _gmm_end("three")
    out["gmm_cluster"] = _GMM + _gmm_step("two", "one", _gmm_cluster("two")) + _gmm_end("two")
    out |= {f"gmm_cov_{k}": _GMM + _gmm_step("two", "one", _gmm_robust("two")) + _gmm_end("two", k) for k in ("classical", "hc1", "hc2", "hc3", "cluster")}
    steps = [f"s{i}" for i in range(1, 13)]
    out["gmm_iterated"] = _GMM + "".join(_gmm_step(b, a, _gmm_robust(b)) for a, b in zip(["one", *steps], steps)) + _gmm_end(steps[-1])  # far beyond convergence
    hours = _GMM.replace(f"SELECT {PRICE} AS y, {QUANTITY} AS x, l_discount AS p, l_tax AS q, l_suppkey AS g FROM lineitem", "SELECT value AS y, hour(ts)::DOUBLE AS x, minute(ts)::DOUBLE AS p, second(ts)::DOUBLE AS q, 0 AS g, ts AS t FROM events")
    out["gmm_kernel"] = hours + _gmm_step("two", "one", _gmm_hac("two", 3)) + _gmm_end("two", "hac", 7, 6)
    wald = _gmm_end("two", "hac", 7).replace("round((s22 * ep * ep - 2 * s12 * ep * eq + s11 * eq * eq) / det, 5) AS j", "round(b ** 2 * (px * a1 + qx * a2) ** 2 / (a1 * a1 * o11 + 2 * a1 * a2 * o12 + a2 * a2 * o22), 4) AS wald")
    out["gmm_cov_hac"] = hours + _gmm_step("two", "one", _gmm_robust("two")) + wald
    classical = ", v AS (SELECT i00 AS v0, i11 AS v1 FROM i)"
    hc1 = ", s AS (SELECT s00 * n / (n - 2) AS s00, s01 * n / (n - 2) AS s01, s11 * n / (n - 2) AS s11 FROM s0, h)"
    null = "n * (my * ln(my) + (1 - my) * ln(1 - my))"
    effect = "SELECT round(b1 * w, 9) AS dydx, round(sqrt(j0 * j0 * i00 + 2 * j0 * j1 * i01 + j1 * j1 * i11), 9) AS std_err FROM (SELECT b1, w, b1 * s0 AS j0, b1 * s1 + w AS j1 FROM {0}), i"
    p_value = "round(2 * (1 - " + _normal_cdf("least(abs(dydx / std_err), 7)", 120) + "), 7)"
    # The first two derivatives of the probability by the index.
    slopes = {"logit": ("p * (1 - p)", "(1 - 2 * p) * p * (1 - p)"), "probit": ("f", "-e * f")}
    points = {"logit": "SELECT b1, x, 1 / (1 + exp(-b0 - b1 * x)) AS p FROM b, c", "probit": f"SELECT *, {_normal_density('e')} AS f FROM (SELECT b1, x, b0 + b1 * x AS e FROM b, m)"}
    for name, sql, digits in (("logit", _newton_sql, 7), ("probit", _probit_sql, 6)):
        out[f"{name}_newton"] = sql(classical + _rows("tens", digits))
        rough = 4 if name == "logit" else 6
        out[f"{name}_bfgs"] = out[f"{name}_lbfgs"] = sql(classical + _rows("tens", rough))
        out[f"{name}_hc0"] = sql(_sandwich(_SCORES) + _rows("tens", digits))
        out[f"{name}_hc1"] = sql(", " + _SCORES.replace("s AS", "s0 AS", 1) + _sandwich(hc1[2:]) + _rows("tens", digits))
        out[f"{name}_opg"] = sql(f", {_SCORES}, v AS (SELECT s11 / (s00 * s11 - s01 * s01) AS v0, s00 / (s00 * s11 - s01 * s01) AS v1 FROM s)" + _rows("tens", digits))
        out[f"{name}_cluster"] = sql(_sandwich(_GROUP_SCORES) + _rows("tens", digits))
        out[f"{name}_fit_stats"] = sql(f"SELECT round(ll, 5) AS log_likelihood, round({null}, 5) AS log_likelihood_null, round(2 * (ll - {null}), 5) AS lr_statistic, round(1 - ll / ({null}), 10) AS pseudo_r_squared, round(-2 * ll + 4, 5) AS aic FROM i")
        out[f"{name}_predict"] = sql(f"SELECT x * 10 AS {QUANTITY}, round(max(p), 9) AS probability, count(*) AS n FROM r GROUP BY x")
        out[f"{name}_pred_table"] = sql("SELECT y::INTEGER AS actual, count(*) FILTER (p <= 0.333) AS predicted_0, count(*) FILTER (p > 0.333) AS predicted_1 FROM r GROUP BY y")
        first, second = slopes[name]
        overall = f", a AS (SELECT any_value(b1) AS b1, avg({first}) AS w, avg({second}) AS s0, avg({second} * x) AS s1 FROM r) "
        out[f"{name}_margins_overall"] = sql(overall + effect.format("a"))
        if name == "probit":
            out["probit_margins"] = sql(overall + f"SELECT round(dydx, 9) AS dydx, round(std_err, 9) AS std_err, {p_value} AS p_value FROM (" + effect.format("a").replace("round(b1 * w, 9)", "b1 * w").replace("round(sqrt(", "(sqrt(").replace("i11), 9)", "i11))") + ")")
        for at, f in (("mean", "avg"), ("median", "median")):
            point = f", m AS (SELECT {f}(x) AS x FROM d), q AS ({points[name].replace('b, c', 'b, m')}), a AS (SELECT b1, {first} AS w, {second} AS s0, {second} * x AS s1 FROM q) "
            out[f"{name}_margins_{at}"] = sql(point + effect.format("a"))
    out["validate_counts"] = f"""
        SELECT count(*) FILTER ({QUANTITY} = 7)::DOUBLE AS missing, count(*) FILTER (l_returnflag <> 'R')::DOUBLE AS not_numeric, count(*) FILTER (l_tax > 0.05)::DOUBLE AS not_finite,
               count(*) FILTER ({QUANTITY} NOT IN (0, 1))::DOUBLE AS not_binary, round(min(l_discount - 0.5), 6) AS least_weight FROM lineitem"""
    computed = ("V22", "V24")
    rules = ["V1", "V2", "V3", "V4", "V5", "V6", "V7", "V8", "V10", "V11", "V12", "V13", "V14_iterations", "V14_tolerance", "V16", "V17", "V18", "V19", "V20", "V21", "V22", "V24", "options"]
    out["validation_errors"] = "SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{'ComputationError' if r in computed else 'ValidationError'}')" for r in rules) + ") AS t(rule, error)"
    return out
