"""The two classes of failure: what the caller gave, and what the numbers allow."""


class ValidationError(ValueError):
    """The input or the options are not acceptable."""


class ComputationError(RuntimeError):
    """The computation cannot give a result: a singular matrix, no convergence."""
