"""The one pattern of every pass over the rows: fold each partition's Arrow batches into a small state, merge the states in partition order.

The states have a fixed size, whatever the number of rows. They reach the driver one for
each partition; beyond ``FAN_IN`` partitions neighbours are merged in a tree of tasks before.
Where the number is known only when the input has run, one level of the tree is always there.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 256


def fold(df: DataFrame, parts: int | None, start: Callable[[], object], step: Callable, merge: Callable):
    """step(state, matrix of doubles with nan for null, Arrow batch) and merge(left, right) return the new state; ``df`` has about ``parts`` partitions, None if unknown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for b in batches:
            if b.num_rows:
                state = step(state, matrix(b), b)
        yield _row(TaskContext.get().partitionId(), state)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((k, s) for b in batches for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for group, own in groupby(rows, lambda r: r[0] // FAN_IN):  # hashing may bring several groups of neighbours here
            yield _row(group, reduce(merge, (pickle.loads(s) for _, s in own)))

    shape = "part int, state binary"
    states = df.mapInArrow(run, shape)
    while parts is None or parts > FAN_IN:
        groups = FAN_IN if parts is None else -(-parts // FAN_IN)
        # By hash of the group: a range partitioning would run the whole pass once more to find its bounds.
        states = states.repartition(groups, F.floor(F.col("part") / FAN_IN)).mapInArrow(again, shape)
        parts = min(groups, FAN_IN) if parts is None else groups
    rows = sorted(states.collect(), key=lambda r: r.part)
    return reduce(merge, (pickle.loads(r.state) for r in rows)) if rows else start()


def fold_here(table: pa.Table, start: Callable[[], object], step: Callable):
    """The same over rows that are on the driver."""
    state = start()
    for b in table.to_batches(max_chunksize=10_000):
        if b.num_rows:
            state = step(state, matrix(b), b)
    return state


def _row(part: int, state) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(state, protocol=5)], pa.binary())], names=["part", "state"])


def matrix(b: pa.RecordBatch) -> np.ndarray:
    """The double columns of a batch side by side, column-major; nulls are nan."""
    cols = [c for c in b.columns if pa.types.is_float64(c.type)]
    out = np.empty((b.num_rows, len(cols)), order="F")
    for j, c in enumerate(cols):
        out[:, j] = c.to_numpy(zero_copy_only=False)
    return out


def triangle(r: np.ndarray | None, m: np.ndarray) -> np.ndarray:
    """The triangular factor of the rows of r and m together, always square."""
    whole = m if r is None else np.vstack([r, m])
    k = m.shape[1]
    if len(whole) < k:
        whole = np.vstack([whole, np.zeros((k - len(whole), k))])
    return np.linalg.qr(whole, mode="r")
