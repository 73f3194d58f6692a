"""Best-fit packing with large-item matching.

Which piece goes where depends on lengths alone, and there are at most ``capacity``
different lengths. So the plan is made from the exact histogram of lengths, which
never grows with the corpus: pieces longer than a third of a sequence are matched
greedily, the longest with the longest partner that still fits (never three in a
sequence); shorter ones then best-fit the remaining gaps, longest first; whole
classes of equal gaps are filled at once. The plan is a list of intervals "pieces
number r to r+n of length L go to sequences s, s+1, ..., m to each, from place p on".
It has under 70 intervals a length class of gaps, so it is small enough to ship to
every task at any size of corpus.

Pieces are numbered within their length by prefix sums of each task's counts. A join by
(task, length) brings the sums to the pieces; it moves rows of a few numbers (and ids,
where they are wanted), and a key of it has no more rows than one task made, so that
no length, however common, meets in one task.

Defined results: a null text counts as empty and gives one piece of the end id alone.
Only documents longer than ``capacity`` ids are cut, every ``capacity`` ids. Rows of
one doc_id are packed apart. A long text is encoded whole, in the memory of its ids. An empty
table gives no sequence. Further columns of any name are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import narrowed, small_batches, stored
from .word_encoder import word_encoder


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, n, first sequence, pieces a sequence, place) for pieces of the given counts by length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[int, int, int, int, int, int]] = []
    used = np.zeros(capacity + 1, np.int64)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: (first sequence, number of sequences)
    opened = 0

    def put(length: int, n: int, first: int, each: int, place: int) -> None:
        out.append((length, int(used[length]), n, first, each, place))
        used[length] += n
        left[length] -= n

    least = capacity // 3 + 1
    for a in range(capacity, least - 1, -1):
        while left[a]:
            b = min(a, capacity - a)
            while b >= least and not left[b]:
                b -= 1
            if b < least:  # no partner is left: alone, with a gap for short ones
                n = int(left[a])
                put(a, n, opened, 1, 0)
                gaps[capacity - a].append((opened, n))
            elif b == a:
                n = int(left[a]) // 2
                if not n:
                    b = a - 1
                    while b >= least and not left[b]:
                        b -= 1
                    n = 1
                    put(a, 1, opened, 1, 0)
                    if b >= least:
                        put(b, 1, opened, 1, a)
                    gaps[capacity - a - (b if b >= least else 0)].append((opened, 1))
                else:
                    put(a, 2 * n, opened, 2, 0)
                    gaps[capacity - 2 * a].append((opened, n))
            else:
                n = int(min(left[a], left[b]))
                put(a, n, opened, 1, 0)
                put(b, n, opened, 1, a)
                gaps[capacity - a - b].append((opened, n))
            opened += n
    for length in range(least - 1, 0, -1):
        gap = length
        while left[length]:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:  # open as many as the rest needs
                each = capacity // length
                n = -(-int(left[length]) // each)
                gaps[capacity].append((opened, n))
                opened += n
                gap = capacity
            first, n = gaps[gap].pop()
            each, want = gap // length, int(left[length])
            full = min(n, want // each)
            if full:
                put(length, full * each, first, each, capacity - gap)
                gaps[gap - each * length].append((first, full))
            rest = want - full * each
            first, n = first + full, n - full
            if n and rest:  # fewer than `each` are left
                put(length, rest, first, rest, capacity - gap)
                gaps[gap - rest * length].append((first, 1))
                first, n = first + 1, n - 1
            if n:
                gaps[gap].append((first, n))
    rows = np.array(sorted(out), np.int64).reshape(-1, 6)
    return rows


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, ids: bool, id_col: str, text_col: str) -> DataFrame:
    """A row per piece, with its number among the pieces of its length that its task made."""
    rows = narrowed(docs, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = word_encoder(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in small_batches(batches):
            flat, offsets = encoder.encode(b.column(1), end_id)
            sizes = np.diff(offsets)
            each = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), each)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
            start = piece * capacity
            length = np.minimum(sizes[owner] - start, capacity)
            at = offsets[owner] + start
            raw = flat.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            sorted_ = length[order]
            fresh = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)
            run = np.arange(len(sorted_)) - np.repeat(fresh, np.diff(np.r_[fresh, len(sorted_)]))
            rank = np.empty(len(length), np.int64)
            rank[order] = run + seen[sorted_]
            seen += np.bincount(length, minlength=capacity + 1)
            out = {
                "doc_id": b.column(0).take(pa.array(owner)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length),
                "ids_crc32": pa.array(crc, pa.int64()), "task": pa.array(np.full(len(owner), task, np.int32)), "rank": pa.array(rank),
            }
            if ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.r_[at, len(flat)].astype(np.int32)), pa.array(flat.astype(np.int64)))
            yield pa.RecordBatch.from_pydict(out)
        encoder.forget()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<long>" * ids)


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, ids: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if wanted, ids."""
    cut = stored(pieces(docs, tokenizer_path, capacity, end_id, ids, id_col, text_col), "pieces")
    by_task = cut.groupBy("task", "length").count()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select(F.col("task").alias("_t"), F.col("length").alias("_l"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    table = plan(counts, capacity)
    keys = table[:, 0] * (1 << 40) + table[:, 1]  # a length has under 2**40 pieces

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            row = table[np.searchsorted(keys, length * (1 << 40) + rank, "right") - 1]
            nth = rank - row[:, 1]
            sequence = row[:, 3] + nth // row[:, 4]
            offset = row[:, 5] + nth % row[:, 4] * length
            keep = [c for c in b.schema.names if c not in ("rank", "ids")]
            arrays = [*(b.column(c) for c in keep), pa.array(sequence), pa.array(offset), *([b.column("ids")] if ids else [])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "sequence_id", "offset", *(["ids"] if ids else [])])

    joined = cut.join(bases, (cut["task"] == bases["_t"]) & (cut["length"] == bases["_l"]))
    ranked = joined.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"), *(["ids"] if ids else []))
    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<long>" * ids)
