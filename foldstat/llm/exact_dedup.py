"""Exact dedup with a heavy-hitter split.

Texts are equal when identical after lower-casing A-Z only; equality is decided
on the SHA-256 of the normalised UTF-8 text. Misra-Gries summaries, one for each
partition and merged in a tree of shuffles of bounded fan-in, name every digest that
more than 1/``counters`` of all rows share. Those candidates (at most ``counters`` of
them) are verified by exact counts, and the verified winners are broadcast: their
copies are settled map-side and never shuffled. All other digests, none of which has
more than 1/``counters`` of the rows, are shuffled in the ordinary way, once, and meet
their group's totals in a join that holds no group in memory.

Defined results: a null text counts as empty, a long one is hashed whole. Of equal texts
the row with the largest doc_id stays (a null doc_id loses to any other). Where a whole
row is repeated, exactly one copy is ``kept``. An empty table gives an empty result.
Further columns may have any name.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrowed, stored, unused

FAN_IN = 32


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase).cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, row) of every row; ``row`` tells rows apart once the table is stored."""
    return narrowed(docs, id_col, text_col).select("doc_id", digest_of(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row"))


def summarise(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """The Misra-Gries cut: keep at most ``counters`` keys by subtracting the next largest count from all."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {k: v - cut for k, v in counts.items() if v > cut}


def summaries(table: DataFrame, counters: int) -> DataFrame:
    """(part, digest, n): at most FAN_IN summaries of at most ``counters`` digests, of all rows of a table with a digest column."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for b in batches:
            for k, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + n
            if len(held) > 8 * counters:
                held = summarise(held, counters)
        held = summarise(held, counters)
        part = pa.array([TaskContext.get().partitionId()] * len(held), pa.int32())
        yield pa.RecordBatch.from_arrays([part, pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["part", "digest", "n"])

    shape = "part int, digest binary, n long"
    found = table.select(F.lit(0).alias("part"), "digest", F.lit(1).cast("long").alias("n")).mapInArrow(partial, shape)
    parts = table.rdd.getNumPartitions()
    while parts > FAN_IN:  # a shuffle, so that the rows themselves are still read by all tasks; a merge reads about FAN_IN summaries
        parts = -(-parts // FAN_IN)
        found = found.repartition(parts, "part").mapInArrow(partial, shape)
    return found


def frequent(table: DataFrame, counters: int) -> list[bytes]:
    """A superset of the digests that more than 1/(counters + 1) of the rows have; at most ``counters`` of them."""
    held: dict[bytes, int] = {}
    for row in summaries(table, counters).collect():  # at most FAN_IN * counters rows
        held[bytes(row.digest)] = held.get(bytes(row.digest), 0) + row.n
    return sorted(summarise(held, counters))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size long, kept boolean, digest binary.

    ``counters``, unless given, is the number of shuffle partitions, between 256 and 4096: a group that is not
    told apart is then no larger than a fair share of a task.
    """
    spark = docs.sparkSession
    if counters is None:
        counters = min(max(256, int(spark.conf.get("spark.sql.shuffle.partitions"))), 4096)
    table = stored(digests(docs, id_col, text_col), "digests")
    heavy = spark.createDataFrame([(bytearray(k),) for k in frequent(table, counters)], "digest binary")
    top, size = F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size")  # a null doc_id is the least
    winners = stored(table.join(F.broadcast(heavy), "digest").groupBy("digest").agg(top, size).filter("group_size > 1"), "winners")  # at most ``counters`` rows
    split = table.join(F.broadcast(winners), "digest", "left")
    rest = split.filter(F.col("group_size").isNull()).select("digest", "doc_id", "row").repartition("digest")  # the aggregate and the join below both use it
    joined = rest.join(rest.groupBy("digest").agg(top, size), "digest")
    both = joined.unionByName(split.filter(F.col("group_size").isNotNull()))
    return both.select("doc_id", "digest", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names."""
    marked = stored(exact_dedup(docs, id_col, text_col, counters), "marked")
    kept_id, kept_digest, mark = (unused(docs.columns, x) for x in ("kept_id", "kept_digest", "digest"))
    kept = marked.filter("kept").select(F.col("doc_id").alias(kept_id), F.col("digest").alias(kept_digest))
    if not marked.groupBy("doc_id").count().filter("count > 1").limit(1).count():  # the id alone tells rows apart
        return docs.join(kept, docs[id_col].eqNullSafe(kept[kept_id]), "left_semi").select(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.withColumn(mark, digest_of(docs[text_col].cast("string")))
    out = rows.join(kept, rows[id_col].eqNullSafe(kept[kept_id]) & (rows[mark] == kept[kept_digest]), "left_semi")
    return out.dropDuplicates([id_col, mark]).select(*[out[f"`{c}`"] for c in docs.columns])
