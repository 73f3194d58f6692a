"""Options of the estimators, and the rules for which column may play which role."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import ValidationError

LINEAR_COV = ("classical", "nonrobust", "hc0", "hc1", "hc2", "hc3", "hac", "cluster")
MLE_COV = ("classical", "nonrobust", "opg", "hc0", "hc1", "cluster")
WEIGHTS = {"unadjusted": "unadjusted", "homoskedastic": "unadjusted", "robust": "robust", "heteroskedastic": "robust", "cluster": "cluster", "kernel": "kernel"}
METHODS = ("newton", "bfgs", "lbfgs")


@dataclass
class OLSOptions:
    """Also of WLS. ``tie_cols`` order rows of one ``time_col`` value, which in a distributed table have no order of their own."""

    cov_type: str = "classical"
    include_intercept: bool = True
    confidence_level: float = 0.95
    cluster_col: str | None = None
    hac_lags: int | None = None
    time_col: str | None = None
    tie_cols: tuple[str, ...] = ()


@dataclass
class IvOptions:
    method: str = "2sls"
    cov_type: str = "classical"
    include_intercept: bool = True
    confidence_level: float = 0.95
    cluster_col: str | None = None
    hac_lags: int | None = None
    time_col: str | None = None
    tie_cols: tuple[str, ...] = ()
    weight_type: str = "unadjusted"
    gmm_iterations: int = 2
    gmm_convergence: float | None = None
    raise_on_non_convergence: bool = True


@dataclass
class LogitOptions:
    method: str = "newton"
    max_iter: int = 35
    tol: float = 1e-6
    raise_on_non_convergence: bool = True
    cov_type: str = "classical"
    include_intercept: bool = True
    confidence_level: float = 0.95
    cluster_col: str | None = None


@dataclass
class ProbitOptions(LogitOptions):
    pass


def one_of(value: str, known, message: str) -> str:
    low = value.lower()
    if low not in known:
        raise ValidationError(message.format(low))
    return low


def linear_cov(value: str) -> str:
    return one_of(value, LINEAR_COV, "unknown cov_type: '{}'. Expected one of 'classical', 'hc0' through 'hc3', 'hac', or 'cluster'")


def mle_cov(value: str) -> str:
    return one_of(value, MLE_COV, "unknown cov_type: '{}'. Expected one of 'classical' (or 'nonrobust'), 'opg', 'hc0', 'hc1', or 'cluster'")


def weight_type(value: str) -> str:
    return WEIGHTS[one_of(value, WEIGHTS, "unknown weight_type: '{}'. Expected one of 'unadjusted' ('homoskedastic'), 'robust' ('heteroskedastic'), 'cluster', or 'kernel'")]


def mle_method(value: str) -> str:
    return one_of(value, METHODS, "unknown method: '{}'. Expected one of 'newton', 'bfgs', or 'lbfgs'")


def effects_point(value: str) -> str:
    return one_of(value, ("overall", "mean", "median"), "unknown at: '{}'. Expected one of 'overall', 'mean', or 'median'")


def level(value: float) -> float:
    if not 0 < value < 1:
        raise ValidationError(f"confidence_level must be in the range (0, 1): {value}")
    return value


def non_empty(x: list[str]) -> None:
    if not x:
        raise ValidationError("x must contain at least one column name")


def no_repeats(role: str, columns: list[str]) -> None:
    for i, c in enumerate(columns):
        if c in columns[:i]:
            raise ValidationError(f"column '{c}' is specified more than once in {role}")


def no_const(x: list[str], intercept: bool) -> None:
    if intercept and "const" in x:
        raise ValidationError("when include_intercept=true, x cannot contain a column named 'const' (it collides with the automatically added intercept)")


def no_overlap(roles: list[tuple[str, str | list[str]]]) -> None:
    """No column in two roles: the first column, in the order of the roles, that a role shares with an earlier one is named."""
    single = {name for name, value in roles if isinstance(value, str)}
    role_of: dict[str, str] = {}
    for name, value in roles:
        columns = [value] if isinstance(value, str) else value
        clash = min((c for c in columns if c in role_of), key=lambda c: [n for n, _ in roles].index(role_of[c]), default=None)
        if clash is not None:
            raise ValidationError(_two_roles(clash, role_of[clash], name, single))
        role_of |= dict.fromkeys(columns, name)


def _two_roles(column: str, earlier: str, later: str, single: set[str]) -> str:
    """The subject is the later role, unless the earlier one is a single column and the later one a list."""
    if earlier in single and later not in single:
        return f"the column '{column}' specified as {earlier} is also included in {later}"
    return f"the column '{column}' specified as {later} is also {'specified as' if earlier in single else 'included in'} {earlier}"
