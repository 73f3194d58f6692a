"""Exact top-k search by distributed histogram selection.

Every query meets every candidate: queries go in blocks of at most ``block`` vectors,
which are small enough to send to all tasks, and each task scores its candidates
against a block by matrix products. A round counts the scores of each query in
``BINS`` equal bins of its score range; the counts of all tasks are summed, the bin
that holds the k-th best score becomes the range of the next round, until it is one
integer wide: the exact k-th score. A last pass keeps the scores above it and, of
those equal to it, the smallest ids that still fit, which settles ties.

Vectors are integers: ``floor(scale * x)`` of each component as a double. Scores are
exact: products run in float64 while every partial sum stays below 2**53, in int64 up to
2**63, and an ``ArithmeticError`` is raised beyond.

Defined results: vectors that are null, empty or hold null or non-finite components take
no part, nor do rows with a null id. A shorter vector counts as filled up with zeros.
Repeated rows (same id and vector) are one vector; one id with different vectors is
several candidates, and as several queries gives several lists. A query's own id is no
candidate of it. With fewer than k candidates all are returned. Empty in, empty out. Further
columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, stored

BINS = 128


def integer_vectors(table: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>), the distinct usable vectors."""
    v = F.col("v")
    rows = table.select(table[id_col].cast("long").alias("vec_id"), table[vector_col].cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    return rows.select("vec_id", F.transform(v, lambda x: F.floor(F.lit(scale) * x)).alias("v")).distinct()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, off = np.asarray(column.flatten()), np.diff(np.asarray(column.offsets))
    out = np.zeros((len(off), width), np.int64)
    out[np.repeat(np.arange(len(off)), off), np.arange(len(flat)) - np.repeat(np.cumsum(off) - off, off)] = flat
    return out


class _Block:
    """A block of queries as every task gets it."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, exact_in_float: bool):
        order = np.argsort(ids, kind="stable")
        self.ids, self.float = ids[order], exact_in_float
        self.q = q[order].astype(np.float64) if exact_in_float else q[order]

    def scores(self, batches: Iterator[pa.RecordBatch], rows: int = 1024, step: int = 512) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first query, scores of some queries, candidate ids, which are no candidates of the query) piece by piece."""
        width = self.q.shape[1]
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                ids, c = np.asarray(part.column(0)), _matrix(part.column(1), width)
                c = c.astype(self.q.dtype)
                lo, hi = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
                for first in range(0, len(self.ids), step):
                    s = (self.q[first : first + step] @ c.T).astype(np.int64)
                    own = np.zeros(s.shape, bool)
                    for j in np.flatnonzero((hi > lo) & (hi > first) & (lo < first + step)):
                        own[max(0, lo[j] - first) : hi[j] - first, j] = True
                    yield first, s, ids, own


def _kth_scores(candidates: DataFrame, block: _Block, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query of the block: the k-th best score (the least of all, if fewer), and how many places are left for scores equal to it."""
    spark = candidates.sparkSession
    n = len(block.ids)
    low, high, above = -reach, reach + 1, np.zeros(n, np.int64)  # the k-th lies in [low, high)
    shared = spark.sparkContext.broadcast(block)
    while (high - low > 1).any():
        width = -(-(high - low) // BINS)

        def count(batches, low=low, high=high, width=width):
            held = np.zeros((n, BINS), np.int64)
            for first, s, _, own in shared.value.scores(batches):
                m = len(s)
                lo, wd = low[first : first + m, None], width[first : first + m, None]
                bin_ = (s - lo) // wd
                keep = (s >= lo) & (s < high[first : first + m, None]) & ~own
                flat = (np.arange(m)[:, None] * BINS + bin_)[keep]
                held[first : first + m] += np.bincount(flat, minlength=m * BINS).reshape(m, BINS)
            some = np.flatnonzero(held.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([held[i].tobytes() for i in some], pa.binary())], names=["q", "counts"])

        def add(batches):
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for q, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    held[q] = held.get(q, 0) + np.frombuffer(x, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["q", "counts"])

        shape = "q long, counts binary"
        total = np.zeros((n, BINS), np.int64)  # at most `block` rows come back, one for each query
        for row in candidates.mapInArrow(count, shape).repartition("q").mapInArrow(add, shape).collect():
            total[row.q] = np.frombuffer(row.counts, np.int64)
        down = np.cumsum(total[:, ::-1], axis=1)  # from the best bin down
        reached = down + above[:, None] >= k
        found = reached.any(axis=1)
        at = np.where(found, reached.argmax(axis=1), BINS - 1)
        more = np.take_along_axis(down, at[:, None], 1)[:, 0] - np.take_along_axis(total[:, ::-1], at[:, None], 1)[:, 0]
        bin_ = BINS - 1 - at
        new_low = np.where(found, low + bin_ * width, -reach)
        high = np.where(found, np.minimum(high, new_low + width), -reach + 1)  # all candidates are wanted
        above, low = np.where(found, above + more, above), new_low
    return low, k - above


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score from two frames of ``integer_vectors``."""
    spark = candidates.sparkSession
    candidates = stored(candidates, "candidates")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    top = candidates.agg(F.max(F.size("v")).alias("width"), F.max(norm).alias("norm")).first()
    count = queries.count()
    out = None
    if top.width and count:
        blocks = max(1, -(-count * 5 // (4 * block)))
        # Rows are distinct, so hashing spreads them; a block gets about 4/5 of what it may hold. Blocks are folders, and so are their results.
        placed, results = scratch_path(spark, "queries"), scratch_path(spark, "best")
        queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(placed)
        placed = spark.read.parquet(placed)
        for number in range(blocks):
            rows = placed.filter(F.col("block") == number).select("vec_id", "v").toArrow()
            if not rows.num_rows:
                continue
            width = max(top.width, max(len(x) for x in rows.column("v").to_pylist()))
            ids, q = np.asarray(rows.column("vec_id").combine_chunks()), _matrix(rows.column("v"), width)
            size = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
            reach = np.ceil(size * top.norm * (1 + 1e-9)) + 1
            if reach.max() >= 2**62:
                raise ArithmeticError("scores do not fit in 64 bits")
            made = _Block(ids, q, float(np.abs(q).max() if q.size else 0) * max(top.norm, 1.0) * width < 2**53)
            order = np.argsort(ids, kind="stable")
            kth, places = _kth_scores(candidates, made, k, reach.astype(np.int64)[order])
            _best(candidates, spark.sparkContext.broadcast(made), kth, places, number).write.parquet(f"{results}/{number}")
            out = results
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = spark.read.schema("block long, q long, query_id long, vec_id long, score long").parquet(f"{results}/*")
    each = Window.partitionBy("block", "q").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(each)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _best(candidates: DataFrame, shared, kth: np.ndarray, places: np.ndarray, number: int) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        ties, held = [], 0

        def least() -> tuple[np.ndarray, np.ndarray]:
            """Of the ties so far, for each query the smallest ids that still have a place."""
            q, v = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (zip(*ties, strict=True) if ties else ((), ())))
            order = np.lexsort((v, q))
            q, v = q[order], v[order]
            some = np.arange(len(q)) - np.searchsorted(q, q) < places[q]
            return q[some], v[some]

        def out(q, vec, score) -> pa.RecordBatch:
            q = np.asarray(q, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), number, np.int64)), pa.array(q), pa.array(block.ids[q]), pa.array(np.asarray(vec, np.int64)), pa.array(np.asarray(score, np.int64))], names=["block", "q", "query_id", "vec_id", "score"])

        for first, s, ids, own in block.scores(batches):
            t = kth[first : first + len(s), None]
            i, j = np.nonzero((s > t) & ~own)
            if len(i):
                yield out(i + first, ids[j], s[i, j])
            i, j = np.nonzero((s == t) & ~own)
            if len(i):
                ties.append((i + first, ids[j]))
                held += len(i)
                if held > 1 << 20:
                    ties = [least()]
                    held = 0
        q, v = least()
        if len(q):
            yield out(q, v, kth[q])

    return candidates.mapInArrow(keep, "block long, q long, query_id long, vec_id long, score long")
