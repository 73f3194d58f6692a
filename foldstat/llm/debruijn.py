"""The de Bruijn graph of a corpus's repeated windows, compacted by Spark joins.

Each distinct repeated window of ``k`` words is an edge from its first k - 1 words to its
last; it has one source, the coordinates (block, word) of its earliest occurrence. Tables:

* spans: runs of later occurrences that follow each other, as their sources do.
* asked: the distinct runs of sources, with the number of spans that came from each.
* nodes: a row for each place in the sources where edges end or begin. Summed by node,
  their ins and outs are the node's degrees: each edge is counted at its one source.
* pieces: source runs cut at every branching node, found by a join with the degrees.
* paths: where one piece ends and another begins in a node of degree one and one, a join
  by node links them; pointer doubling over the links, a join a round, gives each piece
  its path and its place in it. Rounds grow with the logarithm of the longest path in
  pieces, and all of it is in pieces, of which there are far fewer than edges. Doubling
  never ends in a circle: once a round settles no further piece, those left lie in
  circles, and they are linked again without the links that lead back in the sources.

Then every span is rewritten as stretches of paths: (block, word, n, path, at).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, ending, evenly_joined, stored


def lists_of(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """The fields of a column of lists of structs of integers, as arrays, row by row; a null list is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, at = column.flatten(), np.r_[0, np.cumsum(np.asarray(column.value_lengths().fill_null(0)))]
    fields = [np.asarray(f).astype(np.int64) for f in flat.flatten()]
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield [f[s:e] for f in fields]


def asked(spans: DataFrame) -> DataFrame:
    """(block, word, n, many) of the distinct sources of spans (block, word, n, from_block, from_word)."""
    return spans.groupBy(F.col("from_block").alias("block"), F.col("from_word").alias("word"), "n").agg(F.count(F.lit(1)).alias("many"))


def nodes(blocks: DataFrame, asked_: DataFrame, words_of, k: int) -> DataFrame:
    """(node, block, at, ins, outs) of all source edges; ``words_of`` gives the words of a block's payload, with ``grams``."""
    grouped = asked_.groupBy("block").agg(F.collect_list(F.struct("word", "n")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ending(batches):
            for block, payload, (word, n) in zip(b.column(0).to_pylist(), b.column(1), lists_of(b.column(2)), strict=True):
                w = words_of(payload.as_buffer())
                change = np.zeros(w.n + 2, np.int64)
                np.add.at(change, word, 1)
                np.add.at(change, word + n, -1)
                outs = np.cumsum(change)[: w.n + 1] > 0
                ins = np.r_[False, outs[:-1]]
                at = np.flatnonzero(outs | ins)
                names = w.grams(at, at + k - 1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.array(np.full(len(at), block)), pa.array(at), pa.array(ins[at].astype(np.int32)), pa.array(outs[at].astype(np.int32))],
                    names=["node", "block", "at", "ins", "outs"],
                )

    return blocks.join(grouped, "block").select("block", "payload", "runs").mapInArrow(run, "node long, block long, at long, ins int, outs int")


def pieces(nodes_: DataFrame) -> DataFrame:
    """(block, word, n, tail, head): source runs of n edges without a branching node inside; tail and head are their end nodes, null where those branch."""
    degrees = nodes_.groupBy("node").agg(F.sum("ins").alias("in_degree"), F.sum("outs").alias("out_degree"), F.count(F.lit(1)).alias("many"))
    branching = stored(degrees.filter("in_degree > 1 or out_degree > 1").select("node", "many", F.lit(True).alias("branching")), "branching")
    marked = evenly_joined(nodes_, branching, ["node"], ["block", "at"], nodes_.count(), "left")
    ends = marked.filter("branching is not null or ins = 0 or outs = 0").withColumn("joint", F.when(F.col("branching").isNull(), F.col("node")))
    along = Window.partitionBy("block").orderBy("at")  # a block has a bounded number of words
    out = ends.select("block", F.col("at").alias("word"), "outs", (F.lead("at").over(along) - F.col("at")).alias("n"), F.col("joint").alias("tail"), F.lead("joint").over(along).alias("head"))
    return out.filter("outs = 1").drop("outs")


def _chained(links: DataFrame, sizes: DataFrame) -> tuple[DataFrame, int]:
    """(piece, path, at, done) from links (a, b): b follows a. At the end of doubling; the number that did not get done lie in circles."""
    before = links.join(sizes, links["a"] == sizes["piece"]).select(F.col("b").alias("piece"), F.col("a").alias("path"), F.col("n").alias("at"))
    inner = before.select(F.col("piece").alias("x"))
    now = stored(before.join(inner, before["path"] == inner["x"], "left").select("piece", "path", "at", F.col("x").isNull().alias("done")), "pointers")
    left, last = now.filter("not done").count(), -1
    while left and left != last:
        ahead = now.select(F.col("piece").alias("x"), F.col("path").alias("far"), F.col("at").alias("more"), F.col("done").alias("ends"))
        open_ = now.filter("not done")  # their pointers all differ
        moved = open_.join(ahead, open_["path"] == ahead["x"]).select("piece", F.col("far").alias("path"), (F.col("at") + F.col("more")).alias("at"), F.col("ends").alias("done"))
        fresh = stored(now.filter("done").unionByName(moved), "pointers")
        dropped(now)
        now, last = fresh, left
        left = now.filter("not done").count()
    return now, left


def paths(pieces_: DataFrame) -> DataFrame:
    """(block, word, n, path, at): each piece with its path and the number of edges before it there."""
    own = stored(pieces_.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    sizes = own.select("piece", "n")
    ends, starts = own.select(F.col("head").alias("node"), F.col("piece").alias("a")), own.select(F.col("tail").alias("node"), F.col("piece").alias("b"))
    links = stored(ends.filter("node is not null").join(starts.filter("node is not null"), "node").filter("a <> b").select("a", "b"), "links")
    found, left = _chained(links, sizes)
    if left:
        circles = found.filter("not done").select(F.col("piece").alias("b"))
        again, _ = _chained(links.filter("a < b").join(circles, "b", "left_semi"), sizes)
        found = found.filter("done").unionByName(again)
    placed = own.join(found.select("piece", "path", "at"), "piece", "left")
    return placed.select("block", "word", "n", F.coalesce("path", "piece").alias("path"), F.coalesce("at", F.lit(0)).cast("long").alias("at"))


def stretches(asked_: DataFrame, paths_: DataFrame) -> DataFrame:
    """(from_block, from_word, n, many, parts): each distinct source run as parts (skip, n, path, at): n edges from the skip-th on are those of a path from ``at`` on."""
    runs = asked_.groupBy("block").agg(F.collect_list(F.struct("word", "n", "many")).alias("runs"))
    own = paths_.groupBy("block").agg(F.collect_list(F.struct("word", "n", "path", "at")).alias("own"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ending(batches):
            for block, (word, n, many), (start, size, path, at) in zip(b.column(0).to_pylist(), lists_of(b.column(1)), lists_of(b.column(2)), strict=True):
                order = np.argsort(start)
                start, size, path, at = start[order], size[order], path[order], at[order]
                first, last = np.searchsorted(start, word, "right") - 1, np.searchsorted(start, word + n, "left")
                each = last - first
                offsets = np.r_[0, np.cumsum(each)]
                run = np.repeat(np.arange(len(word)), each)
                piece = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first, each)
                low, high = np.maximum(word[run], start[piece]), np.minimum(word[run] + n[run], start[piece] + size[piece])
                parts = pa.StructArray.from_arrays([pa.array(x) for x in (low - word[run], high - low, path[piece], at[piece] + low - start[piece])], names=["skip", "n", "path", "at"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(word), block)), pa.array(word), pa.array(n), pa.array(many), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), parts)],
                    names=["from_block", "from_word", "n", "many", "parts"],
                )

    shape = "from_block long, from_word long, n long, many long, parts array<struct<skip:long,n:long,path:long,at:long>>"
    return runs.join(own, "block").select("block", "runs", "own").mapInArrow(cut, shape)


def occurrences(spans: DataFrame, stretches_: DataFrame) -> DataFrame:
    """(block, word, n, path, at): the spans as stretches of paths. A source that very many spans share is dealt over many tasks."""
    joined = evenly_joined(spans, stretches_, ["from_block", "from_word", "n"], ["block", "word"], spans.count())
    return joined.select("block", "word", F.explode("parts").alias("x")).select("block", (F.col("word") + F.col("x.skip")).alias("word"), "x.n", "x.path", "x.at")


def places(stretches_: DataFrame) -> DataFrame:
    """(block, word, n, path, at): the distinct stretches at their sources."""
    each = stretches_.select("from_block", "from_word", F.explode("parts").alias("x"))
    return each.select(F.col("from_block").alias("block"), (F.col("from_word") + F.col("x.skip")).alias("word"), "x.n", "x.path", "x.at").distinct()
