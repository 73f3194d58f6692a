"""OLS over a stream: the triangular factor of the rows is additive, so each micro-batch is one fold merged into the state."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .. import options as o
from ..operators.passes import Totals, totals
from ..plans.linear import OlsResults, _describe
from ..plans.regression import Cov, enough, least_squares, unit
from ..sources.design import Design


class StreamingOLS:
    """Keeps the totals of all rows seen; ``update`` suits ``foreachBatch``, where a replayed batch id is not counted twice."""

    def __init__(self, y: str, x: list[str], include_intercept: bool = True, confidence_level: float = 0.95):
        o.non_empty(x)
        o.no_overlap([("y", y), ("x", x)])
        o.no_repeats("x", x)
        o.no_const(x, include_intercept)
        self.y, self.x, self.intercept, self.level = y, list(x), include_intercept, o.level(confidence_level)
        self.totals, self.last, self.frame = Totals(len(x) + 1, 0), -1, None

    def update(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last:
            return
        self.totals = self.totals.merge(totals(Design(batch, [self.y, *self.x])))
        self.last, self.frame = batch_id, batch

    def fit(self) -> OlsResults:
        size, const = len(self.x) + 2, int(self.intercept)
        r = self.totals.r if self.totals.r is not None else np.zeros((size, size))
        basis = unit(size, *([0] if const else []), *range(2, size))
        enough(self.totals.n, basis.shape[1])
        fit = least_squares(r, basis, unit(size, 1)[:, 0])
        v = fit.bread(np.eye(fit.k)) * (fit.ssr / (self.totals.n - fit.k))
        out = OlsResults()
        _describe(out, self.frame, self.y, self.x, self.intercept, self.totals, fit, v, Cov("classical", "classical"), self.level, False)
        return out


def fit_stream(spark: SparkSession, path: str, y: str, x: list[str]) -> OlsResults:
    """Fit over whatever Parquet files are under ``path`` now, as one available-now run of a stream."""
    import tempfile

    model = StreamingOLS(y, x)
    schema = spark.read.parquet(path).schema
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="foldstat-")
    run = (
        spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, path)).writeStream.foreachBatch(model.update)
        .option("checkpointLocation", f"{shared}/foldstat/{uuid.uuid4().hex}").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return model.fit()


def _folder(spark: SparkSession, path: str) -> str:
    """A stream reads folders; a single file is named by a pattern that only it matches."""
    return path if not path.endswith(".parquet") else f"{path.rsplit('/', 1)[0]}/[{path.rsplit('/', 1)[1][0]}]{path.rsplit('/', 1)[1][1:]}"


