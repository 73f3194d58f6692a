"""The distributed reductions: validity and triangular factor, score outer products, cluster sums, lag products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from ..errors import ValidationError
from ..sources.design import Design
from .fold import fold, fold_here, matrix, triangle


class Totals:
    """What one pass over a design gives: validity counts, the triangular factor of [1, columns] (weighted by the root of the weight), moments."""

    def __init__(self, p: int, extra: int):
        self.n, self.r = 0, None
        self.nulls, self.words, self.odd = (np.zeros(p + extra, np.int64) for _ in range(3))
        self.no_group = self.not_binary = 0
        self.mean, self.square = np.zeros(p), np.zeros(p)  # of the columns, unweighted: mean, sum of squared deviations
        self.sum_w, self.w_mean, self.w_square = 0.0, np.zeros(p), np.zeros(p)
        self.least_w, self.log_w = np.inf, 0.0

    @staticmethod
    def _moments(n1, m1, s1, n2, m2, s2):
        n = n1 + n2
        d = m2 - m1
        return (n, m1 + d * (n2 / n), s1 + s2 + d * d * (n1 * n2 / n)) if n else (n, m1, s1)

    def merge(self, o: Totals) -> Totals:
        _, self.mean, self.square = self._moments(self.n, self.mean, self.square, o.n, o.mean, o.square)
        self.sum_w, self.w_mean, self.w_square = self._moments(self.sum_w, self.w_mean, self.w_square, o.sum_w, o.w_mean, o.w_square)
        self.n += o.n
        self.r = self.r if o.r is None else o.r if self.r is None else triangle(self.r, o.r)
        self.nulls, self.words, self.odd = self.nulls + o.nulls, self.words + o.words, self.odd + o.odd
        self.no_group, self.not_binary = self.no_group + o.no_group, self.not_binary + o.not_binary
        self.least_w, self.log_w = min(self.least_w, o.least_w), self.log_w + o.log_w
        return self


def with_const(m: np.ndarray, p: int, weighted: bool) -> np.ndarray:
    """[1, columns] of the rows, times the root of the weight (the column after the p numeric ones)."""
    out = np.empty((len(m), p + 1), order="F")
    out[:, 0] = 1
    out[:, 1:] = m[:, :p]
    if weighted:
        out *= np.sqrt(m[:, p])[:, None]
    return out


def totals(design: Design, binary: bool = False, factor: bool = True) -> Totals:
    """One pass; raises where a value is missing, no number, not finite, or a weight not positive. ``binary``: count values of the first column that are not 0 or 1."""
    p, extra, weighted = len(design.columns), len(design.numeric) - len(design.columns), bool(design.weight)

    def step(t: Totals, m: np.ndarray, b: pa.RecordBatch) -> Totals:
        own = Totals(p, extra)
        own.n = len(m)
        names = b.schema.names
        for i in range(p + extra):
            missing = b.column(names.index(f"_{i}")).null_count
            if f"_s{i}" in names:
                own.nulls[i] = b.column(names.index(f"_s{i}")).true_count
                own.words[i] = missing - own.nulls[i]
            else:
                own.nulls[i] = missing
        infinite = ~np.isfinite(m)
        own.odd = infinite.sum(axis=0) - own.nulls - own.words
        if "_g" in names:
            own.no_group = b.column(names.index("_g")).null_count
        if infinite.any():
            return t.merge(own)  # an error follows: numbers no longer matter
        x = m[:, :p]
        own.mean = x.mean(axis=0)
        own.square = ((x - own.mean) ** 2).sum(axis=0)
        if binary:
            own.not_binary = int(((x[:, 0] != 0) & (x[:, 0] != 1)).sum())
        if weighted:
            w = m[:, p]
            own.least_w = float(w.min())
            if own.least_w <= 0:
                return t.merge(own)
            own.log_w, own.sum_w = float(np.log(w).sum()), float(w.sum())
            own.w_mean = (w @ x) / own.sum_w
            own.w_square = w @ (x - own.w_mean) ** 2
        if factor:
            own.r = triangle(None, with_const(m, p, weighted))
        return t.merge(own)

    t = design.fold(lambda: Totals(p, extra), step, lambda a, b: a.merge(b), checked=False)
    for i, name in enumerate(design.numeric):
        if t.words[i]:
            raise ValidationError(f"column '{name}' could not be cast to a numeric type (f64): {t.words[i]} value(s) are no numbers")
        if t.nulls[i]:
            raise ValidationError(f"column '{name}' contains {t.nulls[i]} missing value(s). Missing values are not handled automatically; please impute or remove them before calling this function")
        if t.odd[i]:
            raise ValidationError(f"column '{name}' contains {t.odd[i]} non-finite value(s). NaN and infinite values are not handled automatically; please impute or remove them before calling this function")
    if t.no_group:
        raise ValidationError(f"column '{design.cluster}' contains missing values")
    if weighted and t.n and t.least_w <= 0:
        raise ValidationError(f"weights must be positive, got {t.least_w}")
    if t.r is None:
        t.r = np.zeros((p + 1, p + 1))
    return t


#: A block of scores: regressors W @ B and residual W @ c, where W is [1, columns].
Block = tuple[np.ndarray, np.ndarray]


def scores(w: np.ndarray, blocks: list[Block]) -> list[np.ndarray]:
    return [(w @ b) * (w @ c)[:, None] for b, c in blocks]


def products(design: Design, blocks: list[Block], kind: str) -> list[np.ndarray]:
    """For each block the sum of r r' e^2 (hc0, hc1), / (1 - h) (hc2) or / (1 - h)^2 (hc3); B is whitened, so that h is r'r."""
    p, weighted = len(design.columns), bool(design.weight)

    def step(s: list[np.ndarray], m: np.ndarray, _) -> list[np.ndarray]:
        w = with_const(m, p, weighted)
        for i, (b, c) in enumerate(blocks):
            r, e = w @ b, w @ c
            if kind in ("hc2", "hc3"):
                left = 1 - (r * r).sum(axis=1)
                e = e / np.sqrt(left) if kind == "hc2" else e / left
            r *= e[:, None]
            s[i] = s[i] + r.T @ r
        return s

    start = lambda: [np.zeros((b.shape[1],) * 2) for b, _ in blocks]
    return design.fold(start, step, lambda a, b: [x + y for x, y in zip(a, b, strict=True)])


#: Cluster sums that a partition holds back at most.
PENDING = 1 << 16


def cluster_products(design: Design, score: Callable[[np.ndarray], list[np.ndarray]], sizes: list[int]) -> tuple[list[np.ndarray], int]:
    """For each block the sum over clusters ``_g`` of S S', S a cluster's score sum; and the number of clusters.

    Each partition adds up its clusters before it sends them, PENDING sums at a time, so a cluster that holds most rows moves
    no more than others; sums go in a fixed order.
    """

    frame = design.numbers

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()  # none on the driver
        part, seq, keys, sums = task.partitionId() if task else 0, 0, pa.array([], pa.string()), np.zeros((0, sum(sizes)))

        def added(g: pa.Array, s: np.ndarray) -> tuple[pa.Array, np.ndarray]:
            codes = g.dictionary_encode()
            at, n = np.asarray(codes.indices), len(codes.dictionary)
            return codes.dictionary, np.column_stack([np.bincount(at, s[:, j], n) for j in range(s.shape[1])]) if n else s[:0]

        def out() -> pa.RecordBatch:
            n = len(sums)
            return pa.RecordBatch.from_arrays([keys, pa.array(np.full(n, part)), pa.array(np.full(n, seq)), pa.array([x.tobytes() for x in sums], pa.binary())], names=["g", "part", "seq", "s"])

        for b in batches:
            g, s = added(b.column(b.schema.get_field_index("_g")), np.hstack(score(matrix(b))))
            keys, sums = added(pa.concat_arrays([keys, g]), np.vstack([sums, s]))
            if len(sums) > PENDING:
                yield out()
                seq, keys, sums = seq + 1, keys[:0], sums[:0]
        yield out()

    bounds = np.r_[0, np.cumsum(sizes)]

    def close(state) -> None:
        if state["open"] is not None:
            state["groups"] += 1
            for i in range(len(sizes)):
                x = state["sum"][bounds[i] : bounds[i + 1]]
                state["out"][i] += np.outer(x, x)
            state["open"] = None

    def step(state, _, b: pa.RecordBatch):
        for g, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(s)
            if g == state["open"]:
                state["sum"] = state["sum"] + x
            else:
                close(state)
                state["open"], state["sum"] = g, x
        return state

    def merge(a, b):
        close(a)
        close(b)
        return {"open": None, "sum": None, "groups": a["groups"] + b["groups"], "out": [x + y for x, y in zip(a["out"], b["out"], strict=True)]}

    start = lambda: {"open": None, "sum": None, "groups": 0, "out": [np.zeros((k, k)) for k in sizes]}
    if design.near is not None:
        near = pa.Table.from_batches(partial(design.near.select(frame.columns).to_batches(max_chunksize=10_000)))
        state = fold_here(near.sort_by([(c, "ascending") for c in ("g", "part", "seq")]).select(["g", "s"]), start, step)
        close(state)
        return state["out"], state["groups"]
    sums = frame.mapInArrow(partial, "g string, part long, seq long, s binary").repartition("g").sortWithinPartitions("g", "part", "seq").select("g", "s")
    state = fold(sums, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), start, step, merge)
    close(state)
    return state["out"], state["groups"]


def lag_products(design: Design, blocks: list[Block], lags: int) -> list[np.ndarray]:
    """For each block the Bartlett-weighted sum of lagged outer products of the scores, in time order.

    A partition sums its own products and keeps its first and last ``lags`` scores; products across a border are made when states meet.
    """
    p, weighted = len(design.columns), bool(design.weight)
    weights = [1 - lag / (lags + 1) for lag in range(lags + 1)]
    sizes = [b.shape[1] for b, _ in blocks]
    bounds = np.r_[0, np.cumsum(sizes)]
    width = int(bounds[-1])

    def across(out: list[np.ndarray], before: np.ndarray, after: np.ndarray, upto: int) -> None:
        """Products of the first ``upto`` rows of ``after`` with rows of ``before``, its direct forerunners."""
        for lag in range(1, lags + 1):
            n = min(lag, upto)
            first = len(before) - lag  # the partner of row 0
            skip = max(0, -first)
            if skip < n:
                x, y = after[skip:n], before[first + skip : first + n]
                for i in range(len(sizes)):
                    cut = slice(bounds[i], bounds[i + 1])
                    g = x[:, cut].T @ y[:, cut]
                    out[i] += weights[lag] * (g + g.T)

    def step(state, m: np.ndarray, _):
        s = np.hstack(scores(with_const(m, p, weighted), blocks))
        across(state["out"], state["tail"], s, len(s))
        for lag in range(lags + 1):
            x, y = s[lag:], s[: len(s) - lag]
            if len(x):
                for i in range(len(sizes)):
                    cut = slice(bounds[i], bounds[i + 1])
                    g = x[:, cut].T @ y[:, cut]
                    state["out"][i] += g if not lag else weights[lag] * (g + g.T)
        if len(state["head"]) < lags:
            state["head"] = np.vstack([state["head"], s])[:lags]
        state["tail"] = np.vstack([state["tail"], s])[-lags:] if lags else s[:0]
        state["n"] += len(s)
        return state

    def merge(a, b):
        across(a["out"], a["tail"], b["head"], len(b["head"]))
        return {
            "out": [x + y for x, y in zip(a["out"], b["out"], strict=True)], "n": a["n"] + b["n"],
            "head": np.vstack([a["head"], b["head"]])[:lags] if len(a["head"]) == a["n"] else a["head"],
            "tail": np.vstack([a["tail"], b["tail"]])[-lags:] if lags else a["tail"],
        }

    empty = np.zeros((0, width))
    start = lambda: {"out": [np.zeros((k, k)) for k in sizes], "head": empty, "tail": empty, "n": 0}
    return design.fold_ordered(start, step, merge)["out"]


def block_products(design: Design, blocks: list[Block], kind: str, lags: int = 0) -> tuple[list[np.ndarray], int | None]:
    """Score products of any kind: (one matrix for each block, number of clusters where it matters)."""
    if kind == "cluster":
        p, weighted = len(design.columns), bool(design.weight)
        return cluster_products(design, lambda m: scores(with_const(m, p, weighted), blocks), [b.shape[1] for b, _ in blocks])
    if kind == "hac":
        return lag_products(design, blocks, lags), None
    return products(design, blocks, kind), None


def medians(design: Design) -> np.ndarray:
    """The exact median of each column, by radix selection: counts of the next 16 bits below a known prefix, one pass for each of four."""
    p = len(design.columns)
    sign, digit = np.uint64(1 << 63), 1 << 16

    def ordered(m: np.ndarray) -> np.ndarray:
        """Unsigned integers in the order of the doubles (-0.0 as 0.0)."""
        u = (m + 0.0).view(np.uint64)
        return np.where(u & sign, ~u, u | sign)

    prefix, rank = np.zeros((p, 2), np.uint64), None
    for shift in (48, 32, 16, 0):

        def step(s: np.ndarray, m: np.ndarray, _, shift=shift, prefix=prefix) -> np.ndarray:
            for j in range(p):
                u = ordered(np.ascontiguousarray(m[:, j]))
                for side in (0, 1):
                    own = u if shift == 48 else u[u >> np.uint64(shift + 16) == prefix[j, side]]
                    s[j, side] += np.bincount((own >> np.uint64(shift) & np.uint64(digit - 1)).astype(np.int64), minlength=digit)
            return s

        counts = design.fold(lambda: np.zeros((p, 2, digit), np.int64), step, np.add)
        if rank is None:
            n = int(counts[0, 0].sum())
            rank = np.tile([(n - 1) // 2, n // 2], (p, 1))  # the two places in the middle
        upto = np.cumsum(counts, axis=2)
        at = (upto <= rank[..., None]).sum(axis=2)
        rank = rank - np.where(at > 0, np.take_along_axis(upto, np.maximum(at - 1, 0)[..., None], 2)[..., 0], 0)
        prefix = prefix << np.uint64(16) | at.astype(np.uint64)
    values = np.where(prefix & sign, prefix ^ sign, ~prefix).view(np.float64)
    return values.mean(axis=1)
