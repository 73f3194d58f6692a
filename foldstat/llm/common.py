"""Ground shared by the corpus operators: scratch tables in the cluster's shared folder and tolerant input columns."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach, from ``spark.checkpoint.dir``, with its scheme. Only a local
    session, whose executors are the driver, may leave it unset and gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="foldstat-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        found = _OWN[app]
    return qualified(spark, found)


_OWN: dict[str, str] = {}


def qualified(spark: SparkSession, uri: str) -> str:
    """``uri`` with the scheme that Spark reads it by: a plain path belongs to the cluster's default file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString().rstrip("/")


#: Bytes of a batch that Spark hands to a Python worker, where the session has not chosen any bound of its own.
BATCH_BYTES = 8 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound batches by bytes: by rows alone, ten thousand long texts would be one batch."""
    if spark.conf.get(_SETTING) == "67108864b":  # the default
        spark.conf.set(_SETTING, str(BATCH_BYTES))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder. Results may read it as long as the driver lives; on a file system it goes with the driver."""
    top = f"{shared_dir(spark)}/foldstat/{uuid.uuid4().hex}"
    local = local_or_none(top)
    if local is not None:
        atexit.register(shutil.rmtree, local, ignore_errors=True)
    return f"{top}/{name}"


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors, never recomputes."""
    spark = df.sparkSession
    bound_batches(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` stored in buckets of ``key`` in the shared folder: joins by it shuffle the other side alone. Rows are moved once, here."""
    spark = df.sparkSession
    path, name = scratch_path(spark, "buckets"), f"foldstat_{uuid.uuid4().hex}"
    n = max(1, min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))))
    df.repartition(n, key).write.option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name)
    out = spark.table(name)
    out._scratch, out._table = path, name
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete scratch tables that no later result reads."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if getattr(df, "_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS `{df._table}`")
        if path:
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def local_or_none(uri: str) -> str | None:
    """The plain path of a file: URI or of a path without a scheme (which can be memory-mapped), None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def opened(uri: str, mode: str):
    """A binary file in the shared store, 'rb' or 'wb'. Local paths are plain files; other schemes go through pyarrow."""
    path = local_or_none(uri)
    if path is not None:
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    fs, p = remote(uri)
    if mode == "wb":
        fs.create_dir(os.path.dirname(p), recursive=True)
    return fs.open_input_file(p) if mode == "rb" else fs.open_output_stream(p)


def remote(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class FileStream:
    """Appends to a file of this attempt, which gets its name when it is whole: a retried or speculative task never leaves a torn file."""

    def __init__(self, uri: str):
        self.uri, self.part = uri, f"{uri}.{uuid.uuid4().hex}"
        self.file = opened(self.part, "wb")

    def write(self, data) -> None:
        self.file.write(data)

    def close(self) -> None:
        self.file.close()
        path = local_or_none(self.uri)
        if path is not None:
            os.replace(local_or_none(self.part), path)
        else:
            fs, p = remote(self.uri)
            fs.move(remote(self.part)[1], p)


def put_file(uri: str, data) -> None:
    stream = FileStream(uri)
    stream.write(data)
    stream.close()


def mapped(uri: str, dtype) -> np.ndarray:
    """A flat array in a file, memory-mapped where the store is a file system."""
    path = local_or_none(uri)
    if path is not None:
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with opened(uri, "rb") as f:
        return np.frombuffer(f.read(), dtype)


def narrowed(docs: DataFrame, id_col: str, text_col: str, null_text: str | None = "") -> DataFrame:
    """Only (doc_id, text) under fixed names, so that further columns, whatever their names, never meet ours. null_text None keeps nulls."""
    bound_batches(docs.sparkSession)
    text: Column = docs[text_col].cast("string")
    return docs.select(docs[id_col].alias("doc_id"), (F.coalesce(text, F.lit(null_text)) if null_text is not None else text).alias("text"))


def unused(names: list[str], name: str) -> str:
    """A column name like ``name`` that none of ``names`` has, whatever the case of its letters."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys that are told apart as hot, at most.
HOT = 4096


def evenly_joined(rows: DataFrame, facts: DataFrame, key: list[str], by: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, which has one row for each ``key`` and in ``many`` how many of the ``total`` rows carry it.

    Keys with more than 1/HOT of the rows, of which there are fewer than HOT, are made known to every task: their rows are
    dealt over so many shares, by the hash of the columns ``by``, that none has much more than 1/HOT of the rows, and their
    facts are copied to each share (fewer than 2 * HOT copies in all). No key, however common, meets in one task.
    """
    shares = F.ceil(F.col("many") * HOT / max(total, 1)).cast("int")
    hot = facts.filter(F.col("many") * HOT > total).select(*key, shares.alias("shares_"))
    dealt = rows.join(F.broadcast(hot), key, "left")
    dealt = dealt.withColumn("share_", F.when(F.col("shares_").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("shares_"))).cast("int"))
    copied = facts.withColumn("share_", F.explode(F.sequence(F.lit(0), F.when(F.col("many") * HOT > total, shares - 1).otherwise(0))))
    return dealt.join(copied.drop("many"), [*key, "share_"], how).drop("share_", "shares_")


def small_batches(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches by bytes, so that the working memory of a kernel follows neither the row count nor the longest texts."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        step = max(1, int(n * most / max(b.nbytes, 1)))
        at = 0
        while at < n:
            part = b.slice(at, step)
            at += part.num_rows
            yield part
    give_back()


def give_back() -> None:
    """Return memory to the system at the end of a partition: a worker that waits for its next task should hold little."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; a null is empty."""
    raw, offsets = text_buffer(column)
    at = offsets.tolist()
    for s, e in zip(at[:-1], at[1:], strict=True):
        yield raw[s:e].tobytes()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column of an Arrow batch without copying; nulls have length zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``text_buffer`` of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


#: The six ASCII white spaces.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: (starts, ends) in bytes and, for each text, the index of its first word (with the end)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[raw]
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(raw)]
    before[inner] = False  # words end where a text ends
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# Odd multiplier of the polynomial prefix hash, and the constants of the 64-bit finaliser (both fixed values).
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base is odd, so it has an inverse)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = -(-n // 65536) * 65536
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        up[1:], down[1:] = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 4 << 20:  # tables for a single huge text are not kept
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


class SpanHasher:
    """64-bit hashes of values[start:end] for many spans at once, from one prefix sum."""

    def __init__(self, values: np.ndarray, seed: int = 0):
        up, self.down = powers(len(values) + 1, (_BASE + 2 * (seed * 0x632BE59BD9B4E019)) % (1 << 64) | 1)
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches
    give_back()
