"""The binary-choice likelihoods on arrays of linear predictors, and as SQL expressions where SQL has them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Beyond this a probit argument is cut for densities and tails (fixed value): Phi(-8.12...) is the machine epsilon's half.
PROBIT_CUT = 8.125890664701908
_ROOT_2PI = math.sqrt(2 * math.pi)
_erfc = np.frompyfunc(math.erfc, 1, 1)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(z, float) / math.sqrt(2)).astype(float)


def normal_density(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z) / _ROOT_2PI


class Logit:
    @staticmethod
    def terms(y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-likelihood, its derivative and its negative second derivative in z) of each row."""
        p = Logit.probability(z)
        return y * z - (np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))), y - p, p * (1 - p)

    @staticmethod
    def probability(z: np.ndarray) -> np.ndarray:
        t = np.exp(-np.abs(z))
        return np.where(z >= 0, 1, t) / (1 + t)

    @staticmethod
    def slopes(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivative of the probability."""
        p = Logit.probability(z)
        return p * (1 - p), (1 - 2 * p) * p * (1 - p)

    @staticmethod
    def column(z: Column) -> Column:
        t = F.exp(-F.abs(z))
        return F.when(z >= 0, 1 / (1 + t)).otherwise(t / (1 + t))


class Probit:
    @staticmethod
    def terms(y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = 2 * y - 1
        u = np.clip(q * z, -PROBIT_CUT, PROBIT_CUT)
        tail = normal_cdf(u)
        rest = q * normal_density(u) / tail
        return np.log(tail), rest, rest * (rest + z)

    @staticmethod
    def probability(z: np.ndarray) -> np.ndarray:
        return normal_cdf(z)

    @staticmethod
    def slopes(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = normal_density(z)
        return d, -z * d

    @staticmethod
    def column(z: Column) -> Column:
        @F.pandas_udf(DoubleType())
        def cdf(s):  # SQL has no error function
            import pandas as pd

            return pd.Series(normal_cdf(s.to_numpy()))

        return cdf(z)
