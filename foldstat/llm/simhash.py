"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are 64-bit SimHashes of word shingles. Two of them within ``radius`` bits
agree on all but ``radius`` of m blocks of bits, so they share the bits of some choice
of m - radius blocks: each such choice is a bucket key, and only buckets are compared.
m grows with the number of fingerprints, which changes cost, never results.

Within a bucket bits are stored by plane: one long bit string for each of the 64 bits.
All rows are compared with the rows ``lag`` places on, for every lag inside a bucket: a
plane XOR the shifted plane gives 64 differences at once, and a carry-save counter of two
bits and an overflow adds them up. Blocks of 64 lanes whose lanes all exceed the radius
are abandoned after each group of planes.

A bucket of any size is split: its rows are dealt over chunks by hash, and each pair of
chunks is a task's unit of work, so no bucket, however hot, meets in one task. A unit
emits a spanning forest of what it links (fewer rows than it read), never all its pairs;
components are found by star steps over these edges.

A fingerprint, a component or a bucket that many rows share is dealt over many tasks in every
join (``evenly_joined``).

Equal fingerprints are one node. Defined results: a null text counts as empty; a text
without words has fingerprint zero, and links like any other; a text of fewer words than
a shingle is one shingle. A null doc_id loses to any other as the least of a component,
and is the component's id only where no row has one. Repeated rows share their result.
A long text is read whole; its shingles' digests are added up a run of words at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import dropped, ending, evenly_joined, narrowed, small_batches, stored, text_bytes, unused
from .components import components

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
#: Shingles of a text that are added up at once.
RUN = 1 << 16
#: Rows of a chunk of a bucket.
CHUNK = 2048


def fingerprint(text: bytes, shingle: int = 3) -> int:
    import xxhash

    words = text.translate(_LOWER).split()  # splits at the six ASCII white spaces
    if not words:
        return 0
    h, total, n = xxhash.xxh64_digest, np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for at in range(0, n, RUN):
        own = words[at : min(at + RUN, n) + shingle - 1]
        digests = b"".join([h(s, SEED) for s in map(b" ".join, zip(*(own[i:] for i in range(min(shingle, len(own)))), strict=False))])
        total += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint as a signed long)."""
    rows = narrowed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            out = np.array([fingerprint(t, shingle) for t in text_bytes(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def block_masks(count: int, radius: int) -> list[int]:
    """Bit masks of the bucket keys: all choices of m - radius of m blocks, with m chosen so that buckets stay small on average."""
    m = radius + 1
    while m < 16 and count > 64 << (64 * (m - radius) // m):
        m += 1
    cuts = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(blocks, m - radius)]


def planes_of(values: np.ndarray) -> np.ndarray:
    """64 bit strings, plane by plane, as words of 64 lanes (with one spare word)."""
    words = len(values) // 64 + 2
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # lane, bit
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def lanes_of(flags: np.ndarray, words: int) -> np.ndarray:
    padded = np.zeros(words * 64, bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def _within(planes: np.ndarray, lag: int, words: np.ndarray, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the given words of lanes: those with a wanted lane whose row and the row ``lag`` on differ in at most ``radius`` bits."""
    jump, shift = lag // 64, np.uint64(lag % 64)
    counters = [np.zeros(len(words), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = ~wanted
    for first in range(0, 64, 8):
        for p in range(first, first + 8):
            row = planes[p]
            other = row[words + jump]
            if shift:
                other = (other >> shift) | (row[words + jump + 1] << (np.uint64(64) - shift))
            carry = row[words] ^ other
            for i, c in enumerate(counters):
                counters[i], carry = c ^ carry, c & carry
            over |= carry
        alive = over != np.uint64(0xFFFFFFFFFFFFFFFF)
        if not alive.all():  # every lane of these words has exceeded the radius
            words, over = words[alive], over[alive]
            counters = [c[alive] for c in counters]
            if not len(words):
                break
    if radius + 1 != 1 << len(counters):  # the counters hold more than the radius: compare them with it
        greater, equal = np.zeros(len(words), np.uint64), np.full(len(words), 0xFFFFFFFFFFFFFFFF, np.uint64)
        for i in reversed(range(len(counters))):
            if radius >> i & 1:
                equal &= counters[i]
            else:
                greater |= equal & counters[i]
                equal &= ~counters[i]
        over = over | greater
    return words, ~over


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]
        labels = parent[labels]


def linked(values: np.ndarray, unit: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by unit: the least row each is linked to within its unit (sides 0 and 1 of a unit meet; side 2 meets all of it)."""
    n = len(values)
    labels = np.arange(n)
    if n < 2:
        return labels
    ends = np.flatnonzero(np.r_[unit[1:] != unit[:-1], True]) + 1
    last = np.repeat(ends, np.diff(np.r_[0, ends]))  # end of each row's unit
    planes = np.pad(planes_of(values), ((0, 0), (0, int(np.diff(np.r_[0, ends]).max()) // 64 + 2)))
    width = len(values) // 64 + 1
    row, room = np.arange(n), last - np.arange(n) - 1
    lag, held_i, held_j, held = 1, [], [], 0
    active = np.flatnonzero(room >= 1)
    while len(active):
        flags = np.zeros(width * 64, bool)
        meets = active[(side[active] == 2) | (side[active] != side[active + lag])]
        meets = meets[labels[meets] != labels[meets + lag]]
        if len(meets):
            flags[meets] = True
            wanted = np.packbits(flags, bitorder="little").view(np.uint64)
            words = np.flatnonzero(wanted)
            words, near = _within(planes, lag, words, wanted[words], radius)
            if len(words):
                lanes = np.unpackbits(near.view(np.uint8), bitorder="little").reshape(-1, 64)
                w, b = np.nonzero(lanes)
                i = words[w] * 64 + b
                held_i.append(row[i])
                held_j.append(row[i] + lag)
                held += len(i)
                if held > n:
                    labels = _merge(labels, np.concatenate(held_i), np.concatenate(held_j))
                    held_i, held_j, held = [], [], 0
        lag += 1
        active = active[room[active] >= lag]
    if held:
        labels = _merge(labels, np.concatenate(held_i), np.concatenate(held_j))
    return labels


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (u, v) that join exactly the distinct fingerprints ``fp`` within ``radius`` bits, transitively."""
    count = nodes.count()
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(count, radius)]
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "bits"))
    sizes = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > CHUNK)
    sizes = sizes.select("choice", "bits", "many", F.ceil(F.col("many") / CHUNK).cast("int").alias("chunks"))
    dealt = evenly_joined(keyed, sizes, ["choice", "bits"], ["fp"], count * len(masks), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    each = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    units = each.select(
        "fp",
        F.xxhash64("choice", "bits", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int").alias("side"),
    )
    sorted_ = units.repartition("unit").sortWithinPartitions("unit", "side", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(unit: np.ndarray, side: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            labels = linked(fp.view(np.uint64), unit, side, radius)
            some = np.flatnonzero(labels != np.arange(len(labels)))
            return pa.RecordBatch.from_arrays([pa.array(fp[some]), pa.array(fp[labels[some]])], names=["u", "v"])

        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
        for b in ending(batches):
            fresh = [np.asarray(b.column(i)) for i in (1, 2, 0)]
            held = [np.concatenate(x) for x in zip(held, fresh, strict=True)]
            if len(held[0]) < 4 * CHUNK:
                continue
            cut = int(np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]])[-1])  # the last unit may go on
            if cut:
                yield edges(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield edges(*held)

    return sorted_.mapInArrow(compare, "u long, v long")


def near_dedup(docs: DataFrame, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id."""
    made = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stored(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("many")), "nodes")
    return labelled(made, nodes, components(links(nodes.select("fp"), radius)))


def labelled(made: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of the rows ``made`` (doc_id, fp) from their nodes (fp, least doc_id, many rows) and the nodes' components."""
    found = stored(found, "components")
    rooted = stored(nodes.join(found, nodes["fp"] == found["node"]).select("fp", "least", F.col("component").alias("root")), "rooted")  # nodes without a link stand alone
    leasts = rooted.groupBy("root").agg(F.min("least").alias("led"), F.count(F.lit(1)).alias("many"))
    led = evenly_joined(rooted, leasts, ["root"], ["fp"], rooted.count()).select("fp", "led")
    alone = nodes.join(found, nodes["fp"] == found["node"], "left_anti").select("fp", F.col("least").alias("led"))
    named = stored(led.unionByName(alone).join(nodes.select("fp", "many"), "fp"), "named")
    dropped(nodes, found, rooted)
    return evenly_joined(made, named, ["fp"], ["doc_id"], made.count()).select("doc_id", "fp", F.col("led").alias("component_id"))


def deduplicated(docs: DataFrame, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one of each component stays: that with the smallest doc_id.

    Rows without a doc_id stay where their whole component has none. Where doc_ids repeat, rows
    are told apart by their fingerprints, and of equal ones a single row stays. Columns may have any name.
    """
    made = stored(near_dedup(docs, radius, shingle, id_col, text_col), "marked")
    return only_least(docs, made, lambda texts: np.array([fingerprint(t, shingle) for t in text_bytes(texts)], np.uint64), id_col, text_col)


def only_least(docs: DataFrame, made: DataFrame, prints: Callable[[pa.Array], np.ndarray], id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that are the least of their component in ``made`` (doc_id, fp, component_id); ``prints`` gives the fp of texts."""
    kept_id, kept_fp, mark = (unused(docs.columns, x) for x in ("kept_id", "kept_fp", "fp"))
    kept = made.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept_id), F.col("fp").alias(kept_fp))
    all_columns = [f"`{c}`" for c in docs.columns]
    if not made.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return docs.join(kept, docs[id_col].eqNullSafe(kept[kept_id]), "left_semi").select(*[docs[c] for c in all_columns])
    at = docs.columns.index(text_col)

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            out = prints(b.column(at).cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out.view(np.int64))], names=[*b.schema.names, mark])

    rows = docs.mapInArrow(tagged, StructType([*docs.schema.fields, StructField(mark, LongType())]))
    out = rows.join(kept, rows[id_col].eqNullSafe(kept[kept_id]) & (rows[mark] == kept[kept_fp]), "left_semi")
    numbered = out.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col, mark]).unionByName(out.filter(F.col(id_col).isNull()))
    return numbered.select(*all_columns)
