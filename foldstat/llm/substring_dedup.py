"""Substring dedup over the de Bruijn graph of a corpus's word k-mers.

A window of ``k`` words is an edge of the graph. Removed is each word under a window
whose words also start earlier (smaller doc_id, or the same document and an earlier
start). The steps, each a Spark stage with tables in the shared folder between them:

1. Documents are packed in blocks of a few MB, in a table that is bucketed by block: the
   later steps join it with what they know of a block, and texts are not shuffled again.
2. Anchors. Each window has a smallest (k // 2)-gram, and equal windows have it in
   equal places, so only windows whose anchor occurs twice in the corpus can repeat.
   Each block deals its distinct anchors out by value; what comes back are those that
   occur more than once.
3. Edges. Windows with such an anchor are dealt out by their 96-bit hash, distinct ones
   of a block only. Where an edge meets itself, its earliest occurrence is its source,
   and each other occurrence learns the source's coordinates.
4. Compaction (``debruijn``). The repeated edges make a graph: nodes of k - 1 words with
   their degrees, nonbranching paths linked by joins. Every run of later occurrences
   becomes stretches of paths (block, first word, n, path, place in the path).
5. Verification and removal. Stretches join both the blocks they lie in and the blocks of
   their sources; each side hashes the words of the stretch with SHA-256 from the texts
   themselves. If a single pair of digests differs, 96 bits were not enough, and all is
   done again with another hash: the result rests on compared texts, not on luck.

Nothing a single key gathers grows with its copies: a block sends an anchor or an edge
once however often it holds it, and a source is asked once for a stretch however many
copies there are. The ranges of hashes that anchors and edges are dealt to grow with the
number of blocks, so that one holds the windows of about eight blocks.

Defined results: a null text has no words. Rows of one doc_id count as one document:
of equal windows the smaller start is the earlier, and equal starts stand side by side,
so repeated rows get equal results. A null doc_id comes before all others; doc_ids are
integers, or strings of such. Texts without any removed word are returned as they were.
A text longer than a block is a block of its own, in one task's memory. An empty table
stays empty. Further columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from . import debruijn
from .debruijn import lists_of
from .common import SpanHasher, bound_batches, bucketed, dropped, ending, small_batches, stored, text_buffer, unused, word_spans

#: Bytes of the documents of a block.
BLOCK = 2 << 20
NO_ID = -(1 << 63)


def _packed(x: np.ndarray) -> bytes:
    """Integers that mostly go on from one another: differences, compressed."""
    x = np.asarray(x, np.int64)
    d = np.diff(x, prepend=np.int64(0)).astype("<i8")
    planes = d.view(np.uint8).reshape(-1, 8).T.copy()
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(b[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(planes.T.copy().view("<i8").reshape(-1))


def _sliding(x: np.ndarray, n: int, op, rest) -> np.ndarray:
    """op over x[i : i + n] for every i, with ``rest`` beyond the end."""
    out, have = np.concatenate([x, np.full(n, rest, x.dtype)]), 1
    while 2 * have <= n:
        out = op(out[:-have], out[have:])
        have *= 2
    if have < n:
        out = op(out[: len(out) - (n - have)], out[n - have :])
    return out[: len(x)]


class _Words:
    """The words of a block's texts, and hashes of all their windows."""

    def __init__(self, texts: pa.Array, k: int, seed: int):
        self.raw, offsets = text_buffer(texts)
        self.starts, self.ends, self.first = word_spans(self.raw, offsets)
        self.k, self.seed = k, seed
        self.n = len(self.starts)
        self.last = np.repeat(self.first[1:], np.diff(self.first))  # end of each word's document
        self.doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        at = np.arange(self.n)
        self.whole = at + k <= self.last
        # The hash of a window is one of its words' hashes; a second one, independent of the first, makes 96 bits.
        self.hashes = SpanHasher(self.raw, seed)(self.starts, self.ends)
        self.grams = SpanHasher(self.hashes, seed + 1)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(the anchor of each window, 0 where there is none; the values of all anchored places, one for each place)."""
        g = max(1, self.k // 2)
        at = np.arange(self.n)
        some = at + g <= self.last
        grams = np.full(self.n, np.uint64(0xFFFFFFFFFFFFFFFF))
        grams[some] = self.grams(at[some], at[some] + g) | np.uint64(1)
        least = _sliding(grams, self.k - g + 1, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
        least[~self.whole] = 0
        # A place is anchored if it is the smallest of any window over it: its value is then the greatest of those least ones.
        greatest = _sliding(least[::-1], self.k - g + 1, np.maximum, np.uint64(0))[::-1]
        return least, grams[(greatest == grams) & some & (greatest > 0)]

    def edges(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        second = SpanHasher(self.hashes, self.seed + 2)(at, at + self.k)
        return self.grams(at, at + self.k), (second >> np.uint64(32)).astype(np.uint32)

    def joined(self) -> tuple[memoryview, list[int], list[int]]:
        """All words joined by one space, and where each starts and ends in that."""
        size = self.ends - self.starts
        ends = np.cumsum(size + 1) - 1
        starts = ends - size
        out = np.full(int(ends[-1]) if self.n else 0, 0x20, np.uint8)
        at = np.arange(int(size.sum()))
        before = np.cumsum(size) - size
        out[np.repeat(starts - before, size) + at] = self.raw[np.repeat(self.starts - before, size) + at]
        return memoryview(out.tobytes()), starts, ends


def _payload(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(b)
    return sink.getvalue().to_pybytes()


def _opened(payload: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(payload).read_all().combine_chunks()
    batches = table.to_batches()
    return batches[0] if batches else pa.RecordBatch.from_pylist([], table.schema)


def blocks_of(docs: DataFrame) -> DataFrame:
    """(block, payload): the rows of ``docs``, all columns, in compressed batches under stable numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([_payload(whole)], pa.binary())], names=["block", "payload"])

        for b in small_batches(batches, BLOCK):
            if held and size + b.nbytes > BLOCK:
                yield out()
                number, held, size = number + 1, [], 0
            held.append(b)
            size += b.nbytes
        if held:
            yield out()

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(pack, "block long, payload binary")


def _buckets(values: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the n equal ranges of 64-bit values in an ascending array."""
    edges = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.r_[0, np.searchsorted(values, edges), len(values)]


def repeated_anchors(blocks: DataFrame, text_col: str, k: int, seed: int, buckets: int) -> DataFrame:
    """(block, anchors): of each block's anchors those that occur more than once in the corpus."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ending(batches):
            for block, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                _, places = _Words(_opened(payload.as_buffer()).column(text_col), k, seed).anchors()
                values, counts = np.unique(places, return_counts=True)
                cut = _buckets(values, buckets)
                some = np.flatnonzero(np.diff(cut))
                parts = [(values[cut[i] : cut[i + 1]].tobytes(), np.packbits(counts[cut[i] : cut[i + 1]] > 1).tobytes()) for i in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), block)), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())],
                    names=["bucket", "block", "anchors", "more"],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            values = [np.frombuffer(r[2], np.uint64) for r in rows]
            more = [np.unpackbits(np.frombuffer(r[3], np.uint8))[: len(v)].astype(bool) for r, v in zip(rows, values, strict=True)]
            distinct, counts = np.unique(np.concatenate(values), return_counts=True)
            repeated = np.union1d(distinct[counts > 1], np.concatenate([v[m] for v, m in zip(values, more, strict=True)]))
            out = [(r[1], v[np.isin(v, repeated, assume_unique=True)]) for r, v in zip(rows, values, strict=True)]
            out = [(b, v.tobytes()) for b, v in out if len(v)]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([v for _, v in out], pa.binary())], names=["block", "anchors"])

    dealt = blocks.mapInArrow(deal, "bucket int, block long, anchors binary, more binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "block long, anchors binary")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one bucket at a time, from batches sorted by it."""
    held: list[tuple] = []
    for b in ending(batches):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def sources(blocks: DataFrame, anchors: DataFrame, id_col: str, text_col: str, k: int, seed: int, buckets: int) -> DataFrame:
    """(block, words, source blocks, source words), packed: all windows with an earlier occurrence, and where its edge's source is."""
    grouped = anchors.groupBy("block").agg(F.collect_list("anchors").alias("anchors"))
    asked = blocks.join(grouped, "block").select("block", "payload", "anchors")  # blocks without a repeated anchor have nothing to remove
    shape = "bucket int, block long, one binary, two binary, doc binary, start binary, word binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ending(batches):
            for block, payload, known in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                rows = _opened(payload.as_buffer())
                w = _Words(rows.column(text_col), k, seed)
                ids = np.asarray(rows.column(id_col).cast(pa.int64()).fill_null(NO_ID))
                least, _ = w.anchors()
                repeated = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in known]))
                near = np.minimum(np.searchsorted(repeated, least), len(repeated) - 1)
                at = np.flatnonzero(w.whole & (repeated[near] == least))
                one, two = w.edges(at)
                doc, start = ids[w.doc[at]], at - w.first[w.doc[at]]
                order = np.lexsort((start, doc, two, one))
                one, two, doc, start, at = (x[order] for x in (one, two, doc, start, at))
                fresh = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])] if len(at) else np.zeros(0, bool)
                lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(at) else np.zeros(0, np.int64)
                later = (doc != doc[lead]) | (start != start[lead])
                # Repeats within the block go straight through under its own number; of each edge one goes out.
                own = np.flatnonzero(later)
                own = own[np.argsort(at[own])]
                out = [(int(block % buckets), block, b"", b"", b"", _packed(at[lead[own]]), _packed(at[own]))] if len(own) else []
                equal = np.flatnonzero(~later & ~fresh)  # the very same coordinates: as early as the first, and sent along
                send = np.sort(np.r_[np.flatnonzero(fresh), equal])
                cut = _buckets(one[send], buckets)
                for i in np.flatnonzero(np.diff(cut)):
                    x = send[cut[i] : cut[i + 1]]
                    x = x[np.argsort(at[x])]
                    out.append((int(i), block, one[x].tobytes(), two[x].tobytes(), _packed(doc[x]), _packed(start[x]), _packed(at[x])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 5), strict=True)] if out else [pa.array([], t) for t in (pa.int32(), pa.int64(), *[pa.binary()] * 5)], names=["bucket", "block", "one", "two", "doc", "start", "word"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def reply(block: np.ndarray, word: np.ndarray, from_block: np.ndarray, from_word: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((word, block))
            block, word, from_block, from_word = (x[order] for x in (block, word, from_block, from_word))
            ends = np.flatnonzero(np.r_[block[1:] != block[:-1], True]) + 1 if len(block) else np.zeros(0, np.int64)
            out = [(int(block[s]), _packed(word[s:e]), _packed(from_block[s:e]), _packed(from_word[s:e] - word[s:e])) for s, e in zip(np.r_[0, ends[:-1]].tolist() if len(ends) else [], ends.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "word", "from_block", "from_word"])

        for rows in _by_bucket(batches):
            for r in (r for r in rows if not r[2]):
                word = _unpacked(r[6])
                yield reply(np.full(len(word), r[1]), word, np.full(len(word), r[1]), _unpacked(r[5]))
            rows = sorted((r for r in rows if r[2]), key=lambda r: r[1])  # of equal coordinates all edges take the same block's
            if not rows:
                continue
            one = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
            two = np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows])
            doc, start, word = (np.concatenate([_unpacked(r[i]) for r in rows]) for i in (4, 5, 6))
            block = np.repeat(np.array([r[1] for r in rows], np.int64), [len(r[2]) // 8 for r in rows])
            order = np.lexsort((start, doc, two, one))
            one, two, doc, start, word, block = (x[order] for x in (one, two, doc, start, word, block))
            fresh = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
            lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            later = np.flatnonzero((doc != doc[lead]) | (start != start[lead]))
            if len(later):
                yield reply(block[later], word[later], block[lead[later]], word[lead[later]])

    dealt = asked.mapInArrow(deal, shape)
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "block long, word binary, from_block binary, from_word binary")


def spans(found: DataFrame) -> DataFrame:
    """(block, word, n, from_block, from_word): runs of n later windows that follow each other, as their sources do."""

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            block = rows[0][0]
            word, from_block, shift = (np.concatenate([_unpacked(r[i]) for r in rows]) for i in (1, 2, 3))
            order = np.argsort(word)
            word, from_block, from_word = word[order], from_block[order], (word + shift)[order]
            # A window met earlier in its own block has its source there, unless that one was itself met earlier in another.
            near = np.flatnonzero(from_block == block)
            far = np.flatnonzero(from_block != block)
            if len(near) and len(far):
                at = far[np.minimum(np.searchsorted(word[far], from_word[near]), len(far) - 1)]
                led = word[at] == from_word[near]
                near, at = near[led], at[led]
                from_block[near], from_word[near] = from_block[at], from_word[at]
            fresh = np.flatnonzero(np.r_[True, (word[1:] != word[:-1] + 1) | (from_block[1:] != from_block[:-1]) | (from_word[1:] != from_word[:-1] + 1)])
            n = np.diff(np.r_[fresh, len(word)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(fresh), block)), pa.array(word[fresh]), pa.array(n), pa.array(from_block[fresh]), pa.array(from_word[fresh])],
                names=["block", "word", "n", "from_block", "from_word"],
            )

    return found.repartition("block").sortWithinPartitions("block").mapInArrow(compact, "block long, word long, n long, from_block long, from_word long")


def _removal(blocks: DataFrame, later: DataFrame, sources_: DataFrame, schema: StructType, names_: list[str], text_col: str, k: int, seed: int, with_text: bool) -> DataFrame:
    """Rows of the result, and beside them a digest for each stretch (path, at, n) from each block that has it: ``later`` ones are removed, ``sources_`` stay."""
    stretch = F.collect_list(F.struct("word", "n", "path", "at"))
    own, asked_ = later.groupBy("block").agg(stretch.alias("later")), sources_.groupBy("block").agg(stretch.alias("asked"))
    joined = blocks.join(own, "block", "left").join(asked_, "block", "left").select("block", "payload", "later", "asked")
    counts_, removed_, kept_, path_, at_, n_, digest_ = names_
    arrow = to_arrow_schema(schema)
    names = [f.name for f in schema]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ending(batches):
            for payload, later_, asked_ in zip(b.column(1), lists_of(b.column(2)), lists_of(b.column(3)), strict=True):
                rows = _opened(payload.as_buffer())
                w = _Words(rows.column(text_col), k, seed)
                joined, starts, ends = w.joined()
                change = np.zeros(w.n + 1, np.int64)
                np.add.at(change, later_[0], 1)
                np.add.at(change, later_[0] + later_[1] + k - 1, -1)
                word, n, path, at = (np.concatenate(x) for x in zip(later_, asked_, strict=True))
                # Equal stretches stand together; each is hashed, and a block sends one digest for all of them.
                order = np.lexsort((n, at, path))
                word, n, path, at = word[order], n[order], path[order], at[order]
                sha = hashlib.sha256
                digests = np.frombuffer(b"".join([sha(joined[s:e]).digest() for s, e in zip(starts[word].tolist(), ends[word + n + k - 2].tolist(), strict=True)]), "<u8").reshape(-1, 4)
                fresh = np.r_[True, (path[1:] != path[:-1]) | (at[1:] != at[:-1]) | (n[1:] != n[:-1])] if len(word) else np.zeros(0, bool)
                first = np.flatnonzero(fresh)
                differs = (digests != digests[first[np.cumsum(fresh) - 1]]).any(axis=1) if len(word) else fresh
                sent = [digests[i].tobytes() for i in first.tolist()]
                for i in np.unique(np.searchsorted(first, np.flatnonzero(differs), "right") - 1).tolist():
                    sent[i] = b"differs"
                found = {path_: path[first], at_: at[first], n_: n[first], digest_: sent}
                gone = np.cumsum(change)[:-1] > 0
                # Runs of kept words of one document, as pieces of the joined text.
                kept = ~gone
                heads = np.flatnonzero(kept & np.r_[True, ~kept[:-1] | (w.doc[1:] != w.doc[:-1])]) if w.n else np.zeros(0, np.int64)
                tails = np.flatnonzero(kept & np.r_[~kept[1:] | (w.doc[1:] != w.doc[:-1]), True]) if w.n else np.zeros(0, np.int64)
                bounds = np.searchsorted(heads, w.first).tolist()
                spans = list(zip(starts[heads].tolist(), ends[tails].tolist(), strict=True))
                counts = np.diff(w.first)
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[w.first[1:]] - total[w.first[:-1]]
                text = rows.column(text_col)
                texts, shas = [], []
                for i in range(rows.num_rows):
                    body = b" ".join([joined[s:e] for s, e in spans[bounds[i] : bounds[i + 1]]])
                    shas.append(hashlib.sha256(body).hexdigest())
                    if with_text:
                        texts.append(body.decode("utf-8", "surrogatepass") if removed[i] else text[i].as_py())
                columns = dict(zip(rows.schema.names, rows.columns, strict=True))
                if with_text:
                    columns[text_col] = pa.array(texts, pa.string())
                columns |= {counts_: pa.array(counts), removed_: pa.array(removed), kept_: pa.array(shas, pa.string())}
                yield pa.RecordBatch.from_arrays([columns[f].cast(arrow.field(f).type) if f in columns else pa.nulls(rows.num_rows, arrow.field(f).type) for f in names], schema=arrow)
                if sent:
                    yield pa.RecordBatch.from_arrays([pa.array(found[f], arrow.field(f).type) if f in found else pa.nulls(len(sent), arrow.field(f).type) for f in names], schema=arrow)

    return joined.mapInArrow(remove, schema)


def _deduplicated(docs: DataFrame, id_col: str, text_col: str, k: int, with_text: bool, seed: int = 0) -> tuple[DataFrame, list[str]]:
    """The columns of ``docs`` (or the id alone) and three more: words, removed words, SHA-256 of the kept words. Also their names."""
    spark = docs.sparkSession
    kept_cols = docs.schema.fields if with_text else [f for f in docs.schema.fields if f.name == id_col]
    names = [unused(docs.columns, x) for x in ("n_words", "n_removed", "kept_sha256", "path_", "at_", "n_", "digest_")]
    kinds = [LongType(), LongType(), StringType(), LongType(), LongType(), LongType(), BinaryType()]
    schema = StructType([StructField(f.name, f.dataType, True) for f in kept_cols] + [StructField(*x) for x in zip(names, kinds, strict=True)])
    packed = stored(blocks_of(docs), "blocks")
    count, partitions = packed.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucketed(packed, "block", max(partitions, count // 4))
    dropped(packed)
    buckets = max(4 * partitions, count // 8)
    while True:
        anchors = repeated_anchors(blocks, text_col, k, seed, buckets)
        found = stored(sources(blocks, anchors, id_col, text_col, k, seed, buckets), "sources")
        runs = stored(spans(found), "spans")
        dropped(found)
        asked = stored(debruijn.asked(runs), "asked")
        nodes = stored(debruijn.nodes(blocks, asked, lambda payload, seed=seed: _Words(_opened(payload).column(text_col), k, seed), k), "nodes")
        paths = stored(debruijn.paths(debruijn.pieces(nodes)), "paths")
        dropped(nodes)
        parts = stored(debruijn.stretches(asked, paths), "stretches")
        later = debruijn.occurrences(runs, parts)
        out = stored(_removal(blocks, later, debruijn.places(parts), schema, names, text_col, k, seed, with_text), "removed")
        dropped(runs, asked, paths, parts)
        path, at, n, digest = names[3:]
        pairs = out.filter(F.col(digest).isNotNull()).groupBy(path, at, n).agg(F.min(digest).alias("a"), F.max(digest).alias("b"))
        if not pairs.filter("a <> b").limit(1).count():
            break
        dropped(out)
        seed += 100
    dropped(blocks)
    return out.filter(F.col(digest).isNull()).select(*[f"`{f.name}`" for f in kept_cols], *names[:3]), names


def substring_dedup(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out, _ = _deduplicated(rows, "doc_id", "text", k, with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def deduplicated(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all their columns; a text that loses words becomes the words it keeps, joined by one space."""
    out, _ = _deduplicated(docs, id_col, text_col, k, with_text=True)
    return out.select(*[f"`{c}`" for c in docs.columns])
