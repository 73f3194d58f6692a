"""Token-id files: flat unsigned integers plus 64-bit document offsets, memory-mapped.

Layout of a folder: ``part-NNNNN.bin`` holds the ids of a range of documents (uint16
where the vocabulary fits, else uint32, little-endian), ``part-NNNNN.idx`` the offset
of each document within its part (uint64, one more than documents), and
``part-NNNNN.doc`` the doc_ids (int64). ``manifest.json`` gives each part's base, the
number of ids before it: the prefix sums of the parts' totals. Parts and documents
within them are in ascending doc_id order.

Documents are encoded where they are read; only their ids are shuffled into ranges.

Defined results: a null text counts as empty and holds the end id alone. Rows of one
doc_id stay apart, in the order of their texts' hashes. A null doc_id comes first and is
stored as the smallest int64, which reads back as null, as that very doc_id would. Further
columns of any name are ignored. A long text is encoded whole, in the memory of its ids. An empty table gives a manifest of
empty parts. Each task streams its part to a file of its own attempt and renames it, so
a lost executor costs a rewrite of the part and nothing else.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FileStream, binary_buffer, dropped, ending, mapped, narrowed, opened, put_file, qualified, small_batches, stored
from .word_encoder import word_encoder

NO_ID = -(1 << 63)


def _part(uri: str, k: int) -> str:
    return f"{uri}/part-{k:05d}"


def write_token_files(
    docs: DataFrame, uri: str, tokenizer_path: str, end_id: int = 1, width: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> dict:
    """Encode every document, write the files under ``uri`` (a folder that all executors share), return the manifest."""
    uri = qualified(docs.sparkSession, uri)
    rows = narrowed(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    kind = {2: np.dtype("<u2"), 4: np.dtype("<u4")}[width]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        for b in small_batches(batches):
            ids, offsets = encoder.encode(b.column(1), end_id)
            if len(ids) and int(ids.max()) >> (8 * width):
                raise OverflowError(f"an id does not fit in {width} bytes")
            data = pa.py_buffer(ids.astype(kind))
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(offsets * width), data]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), packed], names=["doc_id", "h", "ids"])
        encoder.forget()

    # Texts stay where they are read: what is stored once, sampled for the ranges and shuffled are ids.
    encoded = stored(rows.mapInArrow(encode, "doc_id long, h long, ids binary"), "encoded")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The text's hash splits even a doc_id that a third of the rows carry.
    dealt = encoded.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "ids").select("doc_id", "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId()
        streams = {x: FileStream(f"{_part(uri, k)}.{x}") for x in ("bin", "idx", "doc")}
        n_docs = n_ids = 0
        for b in ending(batches):
            raw, at = binary_buffer(b.column(1))
            streams["bin"].write(raw.tobytes())
            streams["idx"].write((at[:-1] // width + n_ids).astype("<u8").tobytes())
            streams["doc"].write(np.asarray(b.column(0).fill_null(NO_ID), "<i8").tobytes())
            n_docs += b.num_rows
            n_ids += len(raw) // width
        streams["idx"].write(np.array([n_ids], "<u8").tobytes())
        for s in streams.values():
            s.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int64()), "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    totals = sorted((r.part, r.n_docs, r.n_ids) for r in dealt.mapInArrow(write, "part long, n_docs long, n_ids long").collect())
    dropped(encoded)
    parts, base_docs, base_ids = [], 0, 0
    for k, n_docs, n_ids in totals:
        parts.append({"part": k, "docs": n_docs, "ids": n_ids, "first_doc": base_docs, "first_id": base_ids})
        base_docs, base_ids = base_docs + n_docs, base_ids + n_ids
    manifest = {"width": width, "end_id": end_id, "docs": base_docs, "ids": base_ids, "parts": parts}
    put_file(f"{uri}/manifest.json", json.dumps(manifest).encode())
    return manifest


def read_manifest(uri: str) -> dict:
    with opened(f"{uri}/manifest.json", "rb") as f:
        return json.loads(f.read())


def read_token_files(spark: SparkSession, uri: str, ids: bool = True, slice_ids: int = 1 << 20) -> DataFrame:
    """A row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids."""
    uri = qualified(spark, uri)
    manifest = read_manifest(uri)
    kind = np.dtype(f"<u{manifest['width']}")
    bases = [(p["part"], p["first_id"]) for p in manifest["parts"] if p["docs"]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column(0).to_pylist():
                k, base = bases[at]
                flat, idx, doc = mapped(f"{_part(uri, k)}.bin", kind), mapped(f"{_part(uri, k)}.idx", "<u8"), mapped(f"{_part(uri, k)}.doc", "<i8")
                lo = 0
                while lo < len(doc):  # bounded slices, whatever the size of the part
                    hi = max(lo + 1, int(np.searchsorted(idx, idx[lo] + slice_ids, "right")) - 1)
                    hi = min(hi, len(doc), lo + 8192)
                    off = idx[lo : hi + 1].astype(np.int64)
                    own = np.asarray(flat[off[0] : off[-1]])
                    wide = own.astype("<u4").tobytes()
                    near = (off - off[0]) * 4
                    crc = [zlib.crc32(wide[s:e]) for s, e in zip(near[:-1].tolist(), near[1:].tolist(), strict=True)]
                    names = np.asarray(doc[lo:hi]).astype(np.int64)
                    out = {"doc_id": pa.array(names, mask=names == NO_ID), "start": pa.array(off[:-1] + base), "n_tokens": pa.array(np.diff(off)), "ids_crc32": pa.array(crc, pa.int64())}
                    if ids:
                        out["ids"] = pa.ListArray.from_arrays(pa.array((off - off[0]).astype(np.int32)), pa.array(own.astype(np.int64)))
                    yield pa.RecordBatch.from_pydict(out)
                    lo = hi

    shape = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return spark.range(0, len(bases), 1, max(1, len(bases))).mapInArrow(read, shape)


class TokenFiles:
    """Random access for a loader: documents by their place in the order, and any run of ids across documents."""

    def __init__(self, uri: str):
        self.uri, self.manifest = uri, read_manifest(uri)
        self.parts = [p for p in self.manifest["parts"] if p["docs"]]
        self.kind = np.dtype(f"<u{self.manifest['width']}")
        self.first_docs = np.array([p["first_doc"] for p in self.parts])
        self.first_ids = np.array([p["first_id"] for p in self.parts])

    def __len__(self) -> int:
        return self.manifest["docs"]

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self.first_docs, i, "right")) - 1
        part, own = _part(self.uri, self.parts[k]["part"]), i - self.first_docs[k]
        idx = mapped(f"{part}.idx", "<u8")
        doc = int(mapped(f"{part}.doc", "<i8")[own])
        return None if doc == NO_ID else doc, np.asarray(mapped(f"{part}.bin", self.kind)[int(idx[own]) : int(idx[own + 1])])

    def ids(self, start: int, stop: int) -> np.ndarray:
        out = []
        k = max(0, int(np.searchsorted(self.first_ids, start, "right")) - 1)
        while k < len(self.parts) and start < stop:
            base, n = int(self.first_ids[k]), self.parts[k]["ids"]
            end = min(stop, base + n)
            out.append(np.asarray(mapped(f"{_part(self.uri, self.parts[k]['part'])}.bin", self.kind)[start - base : end - base]))
            start, k = end, k + 1
        return np.concatenate(out) if out else np.zeros(0, self.kind)
