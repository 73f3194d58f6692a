"""WARC records and a Merkle fixity audit of their replicas.

An archive is a sequence of records at ascending byte offsets. Its records are hashed;
the records that begin in one range of ``leaf`` bytes make a leaf, ``fanout`` neighbouring
nodes make a node of the next level, up to one root for each unit (a file, or a whole
archive). Two replicas agree where their roots do. Where they don't, the audit goes down
level by level and reads only the children of nodes that differ; in the leaves that are
left, records are compared one by one, which locates each corrupt, missing or extra one.

All of it is joins and aggregations over tables that halve many times on the way up; a
node gathers at most ``fanout`` children and a leaf what fits in its bytes.

Defined results: null urls and pages count as empty; control characters CR and LF of a url
are percent-encoded, so that a url never ends its header line. Rows go by page_id, a null one
first, then by content; repeated rows are records of their own. Two records never share an
offset within a unit. A long page is one record, however many leaves it covers. An empty
archive has no root, and equals another empty one. Further columns may have any name; an
``offset`` among them is replaced by that of the record.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import FileStream, dropped, opened, qualified, stored, unused

LEAF = 1 << 16
EPOCH = "1970-01-01T00:00:00Z"
FANOUT = 16


def record_of(page_id: Column, url: Column, html: Column, date: Column | None = None) -> Column:
    """The bytes of a ``resource`` record of WARC 1.1; ``date``, an ISO 8601 string, is the crawl's (the epoch, where the table has none)."""
    body = F.coalesce(html.cast("string"), F.lit(""))
    safe = F.replace(F.replace(F.coalesce(url.cast("string"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Date: "), F.lit(EPOCH) if date is None else F.coalesce(date, F.lit(EPOCH)), F.lit("\r\nWARC-Target-URI: "), safe,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def placed(records: DataFrame) -> DataFrame:
    """``records`` (with page_id, digest and length) with the offset of each in one archive: running sums within range partitions, and sums of the partitions before."""
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if "offset" in [c.lower() for c in records.columns]:
        records = records.drop("offset")
    row, part, base, total = (unused(records.columns, x) for x in ("row_", "part_", "base_", "total_"))
    # Stored first, so that the sample for the ranges and the shuffle see the same row numbers.
    numbered = stored(records.withColumn(row, F.monotonically_increasing_id()), "records")
    ordered = numbered.repartitionByRange(n, "page_id", "digest", row).sortWithinPartitions("page_id", "digest", row)
    at = ordered.columns.index("length")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, before = TaskContext.get().partitionId(), 0
        for b in batches:
            ends = before + np.cumsum(np.asarray(b.column(at), np.int64))
            if len(ends):
                starts = np.r_[before, ends[:-1]]
                before = int(ends[-1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts), pa.array(np.full(len(starts), k))], names=[*b.schema.names, "offset", part])

    shape = StructType([*ordered.schema.fields, StructField("offset", LongType()), StructField(part, LongType())])
    ordered = stored(ordered.mapInArrow(running, shape), "ordered")
    totals = ordered.groupBy(part).agg(F.sum("length").alias(total))  # a row for each partition
    bases = totals.select(part, (F.sum(total).over(Window.orderBy(part)) - F.col(total)).alias(base))
    out = ordered.join(F.broadcast(bases), part).withColumn("offset", F.col("offset") + F.col(base))
    dropped(numbered)
    return out.drop(row, part, base)


def leaves(records: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(unit, idx, hash) of the lowest level from (unit, offset, length, digest)."""
    each = F.concat_ws(" ", F.col("offset").cast("string"), F.col("length").cast("string"), F.lower(F.hex("digest")))
    rows = records.select("unit", F.floor(F.col("offset") / leaf).cast("long").alias("idx"), "offset", each.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("offset", "line"))), lambda x: x["line"])
    return rows.groupBy("unit", "idx").agg(lines.alias("lines")).select("unit", "idx", F.sha2(F.concat_ws("\n", "lines"), 256).alias("hash"))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: F.concat_ws(" ", x["idx"].cast("string"), x["hash"]))
    grouped = nodes.groupBy("unit", F.floor(F.col("idx") / fanout).cast("long").alias("up")).agg(lines.alias("lines"))
    return grouped.select("unit", F.col("up").alias("idx"), F.sha2(F.concat_ws("\n", "lines"), 256).alias("hash"))


def trees(records: DataFrame, levels: int, leaf: int = LEAF, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of the trees of all units, leaves first, roots last."""
    out = [stored(leaves(records, leaf), "leaves")]
    for _ in range(levels):
        out.append(stored(parents(out[-1], fanout), "nodes"))
    return out


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.select("unit", "idx", F.col("hash").alias("x")), b.select("unit", "idx", F.col("hash").alias("y"))
    return left.join(right, ["unit", "idx"], "full").filter(~F.col("x").eqNullSafe(F.col("y"))).select("unit", "idx")


def audit(first: DataFrame, second: DataFrame, leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """The records in which two replicas differ: unit, offset, status (corrupt, missing from the second, or extra in it).

    Both have unit string, offset long, length long, digest binary.
    """
    reach = first.select("offset").unionByName(second.select("offset")).agg(F.max("offset")).first()[0]
    nodes, levels = (reach or 0) // leaf + 1, 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    ours, theirs = trees(first, levels, leaf, fanout), trees(second, levels, leaf, fanout)
    bad = _differing(ours[-1], theirs[-1])
    for level in range(levels - 1, -1, -1):
        up = bad.select(F.col("unit").alias("_u"), F.col("idx").alias("_i"))
        below = lambda t, up=up: t.join(up, (t["unit"] == up["_u"]) & (F.floor(t["idx"] / fanout).cast("long") == up["_i"]), "left_semi")
        bad = stored(_differing(below(ours[level]), below(theirs[level])), "differing")
    spots = bad.select(F.col("unit").alias("_u"), F.col("idx").alias("_i"))

    def inside(t: DataFrame, x: str) -> DataFrame:
        t = t.join(spots, (t["unit"] == spots["_u"]) & (F.floor(t["offset"] / leaf).cast("long") == spots["_i"]), "left_semi")
        return t.select("unit", "offset", F.struct("length", "digest").alias(x))

    both = inside(first, "a").join(inside(second, "b"), ["unit", "offset"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt")
    return both.select("unit", "offset", status.alias("status"))


def write_warc(pages: DataFrame, uri: str) -> DataFrame:
    """Write each partition of (page_id, url, html) as one WARC file under ``uri``; returns the index (unit, offset, length, page_id)."""
    uri = qualified(pages.sparkSession, uri)
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), record_of(pages["page_id"], pages["url"], pages["html"]).alias("record"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = f"part-{TaskContext.get().partitionId():05d}.warc"
        stream, at = FileStream(f"{uri}/{unit}"), 0
        for b in batches:
            offsets, lengths = [], []
            for record in b.column(1).to_pylist():
                stream.write(record)
                offsets.append(at)
                lengths.append(len(record))
                at += len(record)
            yield pa.RecordBatch.from_arrays([pa.array([unit] * b.num_rows), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), b.column(0)], names=["unit", "offset", "length", "page_id"])
        stream.close()

    return stored(rows.mapInArrow(write, "unit string, offset long, length long, page_id long"), "index")


def _opened_or_none(uri: str):
    try:
        return opened(uri, "rb")
    except FileNotFoundError:
        return None


def file_records(index: DataFrame, uri: str) -> DataFrame:
    """The records of the files under ``uri`` as they are now, at the places an index (unit, offset, length) gives: with digest, or absent where a file has no such bytes."""
    import hashlib

    uri = qualified(index.sparkSession, uri)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for b in batches:
            out = []
            for unit, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if unit != name:
                    if file:
                        file.close()
                    name, file = unit, _opened_or_none(f"{uri}/{unit}")
                if file:
                    file.seek(offset)
                    data = file.read(length)
                    if data:
                        out.append((unit, offset, len(data), hashlib.sha256(data).digest()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["unit", "offset", "length", "digest"])
        if file:
            file.close()

    rows = index.select("unit", "offset", "length").repartition("unit").sortWithinPartitions("unit", "offset")
    return rows.mapInArrow(read, "unit string, offset long, length long, digest binary")


def read_warc(spark: SparkSession, uri: str, units: list[str]) -> DataFrame:
    """(unit, offset, length, page_id, url, html) parsed from WARC files."""

    uri = qualified(spark, uri)
    names, kinds = ("unit", "offset", "length", "page_id", "url", "html"), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def parsed(file) -> Iterator[tuple[int, int, int | None, str, str]]:
        at = 0
        while head := file.readline():
            start, fields = at, {}
            at += len(head)
            while (line := file.readline()) not in (b"\r\n", b""):
                at += len(line)
                key, _, value = line.decode("utf-8", "surrogateescape").partition(": ")
                fields[key] = value.rstrip("\r\n")
            size = int(fields["Content-Length"])
            body = file.read(size)
            file.read(4)
            at += 2 + size + 4
            page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
            yield start, at - start, int(page) if page else None, fields["WARC-Target-URI"], body.decode()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit in b.column(0).to_pylist():
                with opened(f"{uri}/{unit}", "rb") as raw:
                    held, size = [], 0
                    for r in parsed(io.BufferedReader(raw) if not isinstance(raw, io.BufferedReader) else raw):
                        held.append((unit, *r))
                        size += r[1]
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=list(names))
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=list(names))

    listed = spark.createDataFrame([(u,) for u in units], "unit string").repartition(max(1, len(units)))
    return listed.mapInArrow(read, "unit string, offset long, length long, page_id long, url string, html string")
