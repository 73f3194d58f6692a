"""foldstat: econometric estimation over Spark DataFrames from a few fixed-size distributed reductions."""

from .errors import ComputationError, ValidationError
from .options import IvOptions, LogitOptions, OLSOptions, ProbitOptions
from .plans.binary import Logit, LogitResults, Probit, ProbitResults
from .plans.iv import IV, IvResults
from .plans.linear import OLS, WLS, OlsResults, WlsResults

__version__ = "0.1.0"

__all__ = [
    "IV", "OLS", "WLS", "ComputationError", "IvOptions", "IvResults", "Logit", "LogitOptions", "LogitResults", "OLSOptions", "OlsResults",
    "Probit", "ProbitOptions", "ProbitResults", "ValidationError", "WlsResults",
]
