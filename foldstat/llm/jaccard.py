"""Near-dedup by bit-sliced SimHash and the exact Jaccard similarity of word shingles.

Two texts are linked when the sets of their shingles have a Jaccard similarity of at least
``similarity``, a fraction of whole numbers; components are taken over all links. No pair is
lost: in any one order of all shingles, two such sets share one of the first
``n - ceil(similarity * n) + 1`` shingles of each. Only rows that share such a shingle are
compared: first by their sizes and by the parities of how many shingles fall on each of a number
of places (as many as shingles, 512 at least), which differ in at most as many places as the sets
do in shingles, and then, where these allow the similarity, on their whole sets.

Any order gives the same links. Shingles that many texts share come last in it, so that a
common line brings no texts together; the counts for it are of a quarter of the texts and
serve for cost alone. Pairs that bit-sliced SimHash (``simhash``) links within RADIUS bits come first, and texts
that meet are compared with a leader of each shingle, so that a group of copies is settled by these, not by all
its pairs; on whole sets each such pair counts only if it is as similar. SimHash alone would lose most pairs of
just that similarity, whose fingerprints differ in about nine bits; the shared shingles are the exact way for them. Those that share a shingle and
are in different components still are compared inside tasks, a chunk of a group with a chunk of it:
by sizes and parities, which leave groups of texts that may be linked, and then, within these groups,
on whole sets. Tasks give forests, fewer pairs than rows, so no group of near copies makes a row for each pair.

Shingles are 64-bit hashes, equal sets are one node under a hash of the set. Defined results:
A-Z count as a-z; a null text counts as empty; texts without words are equal; a text of fewer
words than a shingle is one shingle; a long text is one set, in one task's memory. Columns may
have any name. A null doc_id loses to any other as the least of a
component, and rows whose ids repeat are told apart by their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher, binary_buffer, dropped, ending, evenly_joined, mixed, narrowed, small_batches, stored, text_buffer, text_bytes, word_spans
from .components import components
from . import simhash
from .simhash import CHUNK, labelled, only_least

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bits in which SimHashes may differ for their texts to be compared first.
RADIUS = 3
#: Shingles counted as common, at most.
COMMON = 50_000
#: Rows of the counted quarter that make a shingle common.
OFTEN = 4
#: Places of the parities, at least.
PLACES = 512
#: Bits of the filter by which sets are fetched, at most.
FILTER = 1 << 23
#: Shingles of a chunk of a group, about.
WORDS = 1 << 22
#: Leaders of a group of texts that share all their shingles.
LEADERS = 4


def shingles(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    raw, offsets = text_buffer(texts)
    starts, ends, first = word_spans(raw, offsets)
    words = SpanHasher(_FOLD[raw], 2)(starts, ends)
    n = np.diff(first)
    many = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    cuts = np.r_[0, np.cumsum(many)]
    at = np.repeat(first[:-1] - cuts[:-1], many) + np.arange(cuts[-1])
    hashes = SpanHasher(words, 3)(at, np.minimum(at + shingle, np.repeat(first[1:], many)))
    return [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def parities(ids: np.ndarray) -> bytes:
    """A bit for each place, a power of two of them."""
    places = max(PLACES, 1 << (len(ids) - 1).bit_length() if len(ids) else 1)
    return np.packbits(np.bincount((ids & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1).tobytes()


def apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many places the parities of each two sets differ; those of more places are folded to as many as the other's."""
    a, b = np.array([len(i) for i in x], np.int64), np.array([len(i) for i in y], np.int64)
    out = np.zeros(len(x), np.int64)
    for m, n in {*zip(a.tolist(), b.tolist(), strict=True)}:
        some = np.flatnonzero((a == m) & (b == n))
        p, q = (np.frombuffer(b"".join([side[i] for i in some.tolist()]), np.uint8).reshape(len(some), -1, min(m, n)) for side in (x, y))
        out[some] = np.bitwise_count(np.bitwise_xor.reduce(p, axis=1) ^ np.bitwise_xor.reduce(q, axis=1)).sum(axis=1, dtype=np.int64)
    return out


def name_of(ids: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(ids.tobytes(), 42)


def names(texts: pa.Array, shingle: int) -> np.ndarray:
    return np.array([name_of(x) for x in shingles(texts, shingle)], np.uint64)


def first_ones(ids: np.ndarray, similarity: tuple[int, int], common: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Of sorted shingles those that a set as similar must share one of: the first by (count where common, hash)."""
    p, q = similarity
    k = len(ids) - -(-p * len(ids) // q) + 1 if len(ids) else 0
    if common is None or not len(common[0]):
        return ids[:k]
    at = np.minimum(np.searchsorted(common[0], ids), len(common[0]) - 1)
    count = np.where(common[0][at] == ids, common[1][at], 0)
    return ids[np.argsort(count, kind="stable")[:k]]


def similar(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> bool:
    p, q = similarity
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return q * shared >= p * (len(both) - shared)


def _common(rows: DataFrame, shingle: int, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1 << 20):
            out = [first_ones(x, similarity) for x in shingles(b.column(0), shingle)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["token"])

    some = rows.filter(F.pmod(F.xxhash64("text"), F.lit(4)) == 0).select("text")
    counts = some.mapInArrow(run, "token long").groupBy("token").count().filter(F.col("count") > OFTEN)
    found = counts.orderBy(F.desc("count"), "token").limit(COMMON).toArrow()
    token, count = np.asarray(found["token"]).astype(np.int64).view(np.uint64), np.asarray(found["count"]).astype(np.int64)
    order = np.argsort(token)
    return token[order], count[order]


def _met(rows: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """(token, fp, n, leader, leader_n) of the sets that share one of their first shingles with another."""
    shared = rows.sparkSession.sparkContext.broadcast(_common(rows, shingle, similarity))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1 << 20):
            sets = shingles(b.column(0), shingle)
            out = [first_ones(x, similarity, shared.value) for x in sets]
            many = [len(x) for x in out]
            fp = np.repeat(np.array([name_of(x) for x in sets], np.uint64), many)
            n = np.repeat(np.array([len(x) for x in sets], np.int32), many)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(fp.view(np.int64)), pa.array(n)], names=["token", "fp", "n"])

    def groups(token: np.ndarray, fp: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        own = np.r_[True, (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])]
        token, fp, n = token[own], fp[own], n[own]
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[starts, len(token)])
        some = np.repeat(size > 1, size)
        token, fp, n, size = token[some], fp[some], n[some], size[size > 1]
        starts = np.cumsum(size) - size
        key = mixed(fp.view(np.uint64) ^ mixed(token.view(np.uint64) % np.uint64(LEADERS) + np.uint64(1)))
        least = np.repeat(np.minimum.reduceat(key, starts), size) if len(key) else key
        lead = np.repeat(np.flatnonzero(key == least), size) if len(key) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (token, fp, n, fp[lead], n[lead])], names=["token", "fp", "n", "leader", "leader_n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in ending(batches):
            if not b.num_rows:
                continue
            fresh = [np.asarray(b.column(i)) for i in range(3)]
            last = int(np.flatnonzero(np.r_[True, fresh[0][1:] != fresh[0][:-1]])[-1])  # where the last group, which may go on, starts
            if last or (held and held[-1][0][-1] != fresh[0][0]):
                yield groups(*(np.concatenate(x) for x in zip(*held, [x[:last] for x in fresh], strict=True)))
                held = []
            held.append([x[last:] for x in fresh])
        if held:
            yield groups(*(np.concatenate(x) for x in zip(*held, strict=True)))

    spread_ = rows.select("text").mapInArrow(spread, "token long, fp long, n int")
    return spread_.repartition("token").sortWithinPartitions("token", "fp").mapInArrow(meet, "token long, fp long, n int, leader long, leader_n int")


def _sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(fp, ids) of the wanted nodes. A filter of bits keeps most other sets in their tasks, so that no text is shuffled."""
    bits = 1 << 16
    while bits < min(FILTER, 16 * wanted.count()):
        bits *= 2

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits, bool)
        for b in batches:
            held[np.asarray(b.column(0)) & (bits - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(held).tobytes()], pa.binary())], names=["bits"])

    packed = np.zeros(bits // 8, np.uint8)
    for r in wanted.coalesce(8).mapInArrow(marked, "bits binary").toLocalIterator():
        packed |= np.frombuffer(r.bits, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(np.unpackbits(packed).astype(bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1 << 20):
            sets = shingles(b.column(0), shingle)
            fp = np.array([name_of(x) for x in sets], np.uint64).view(np.int64)
            some = np.flatnonzero(shared.value[fp & (bits - 1)])
            yield pa.RecordBatch.from_arrays([pa.array(fp[some]), pa.array([sets[i].tobytes() for i in some], pa.binary())], names=["fp", "ids"])

    return rows.select("text").mapInArrow(run, "fp long, ids binary").dropDuplicates(["fp"]).join(wanted, "fp", "left_semi")


def _with_facts(pairs: DataFrame, one: DataFrame, other: DataFrame) -> DataFrame:
    """The stored pairs (u, v) with what is known of u and of v. A leader may be in a large part of all pairs."""
    total = pairs.count()
    for side, facts, by in (("u", one, "v"), ("v", other, "u")):
        known = facts.join(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("many")), side)
        out = evenly_joined(pairs if side == "u" else out, known, [side], [by], total)
    return out


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) without those whose sizes or parities rule the similarity out."""
    p, q = similarity
    one, other = (nodes.select(F.col("fp").alias(x), F.col("n").alias("n" + x), F.col("bits").alias("b" + x)) for x in "uv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            n, m = (np.asarray(b.column(i)).astype(np.int64) for i in (2, 3))
            good = pa.array((apart(b.column(4).to_pylist(), b.column(5).to_pylist()) * (p + q) <= (n + m) * (q - p)) & (np.minimum(n, m) * q >= np.maximum(n, m) * p))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], names=["u", "v"])

    return _with_facts(pairs, one, other).select("u", "v", "nu", "nv", "bu", "bv").mapInArrow(run, "u long, v long")


def allowed(fp: np.ndarray, n: np.ndarray, root: np.ndarray, bits: np.ndarray, side: np.ndarray, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of one unit's rows the pairs of different roots that sizes and parities allow; sides 0 and 1 meet each other, side 2 itself."""
    p, q = similarity
    left = np.flatnonzero(side != 1)
    right = left if side[0] == 2 else np.flatnonzero(side == 1)
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(left), 64):
        i, j = left[at : at + 64, None], right[None, :]
        good = (root[i] != root[j]) & (np.minimum(n[i], n[j]) * q >= np.maximum(n[i], n[j]) * p)
        if side[0] == 2:
            good &= i < j
        a, b = np.nonzero(good)
        a, b = left[at + a], right[b]
        some = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) * (p + q) <= (n[a] + n[b]) * (q - p)
        u.append(fp[a[some]])
        v.append(fp[b[some]])
    u, v = np.concatenate(u), np.concatenate(v)
    return np.minimum(u, v), np.maximum(u, v)


def forest(fp: np.ndarray, n: np.ndarray, root: np.ndarray, sets: list[np.ndarray], side: np.ndarray, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of one unit's rows, on whole sets, pairs as similar that join all of them that are (sides as in ``allowed``): fewer pairs than rows, however many are alike."""
    p, q = similarity
    label = np.unique(root, return_inverse=True)[1].reshape(-1)
    words = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    ends = np.cumsum(n)
    starts, mark = ends - n, np.zeros(int(words.max()) + 1, bool)
    bits = np.zeros((len(fp), PLACES // 64), np.uint64)
    for i, x in enumerate(sets):
        bits[i] = np.packbits(np.bincount((x & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES) & 1).view(np.uint64)
    left = np.flatnonzero(side != 1)
    right = left if side[0] == 2 else np.flatnonzero(side == 1)
    u, v = [], []
    for i in left.tolist():
        j = right[right > i] if side[0] == 2 else right
        j = j[(label[j] != label[i]) & (np.minimum(n[i], n[j]) * q >= np.maximum(n[i], n[j]) * p)]
        j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64) * (p + q) <= (n[j] + n[i]) * (q - p)]
        if not len(j):
            continue
        own = words[starts[i] : ends[i]]
        mark[own] = True
        cuts = np.cumsum(n[j]) - n[j]
        at = np.repeat(starts[j] - cuts, n[j]) + np.arange(int(n[j].sum()))
        shared = np.add.reduceat(mark[words[at]].astype(np.int64), cuts)
        mark[own] = False
        j = j[shared * q >= p * (n[i] + n[j] - shared)]
        met, first = np.unique(label[j], return_index=True)
        if len(met):
            u.append(np.repeat(fp[i], len(met)))
            v.append(fp[j[first]])
            label[np.isin(label, met)] = label[i]
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))
    return np.minimum(u, v), np.maximum(u, v)


def _units(batches: Iterator[pa.RecordBatch], columns, done) -> Iterator[pa.RecordBatch]:
    """``done(lists of columns, starts of units with the end)`` of whole units; ``columns`` makes lists or arrays of a batch sorted by its first column, the unit."""
    held = None
    for b in ending(batches):
        if not b.num_rows:
            continue
        fresh = columns(b)
        held = fresh if held is None else [x + y if isinstance(x, list) else np.concatenate((x, y)) for x, y in zip(held, fresh, strict=True)]
        cut = int(np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]])[-1])  # the last unit may go on
        if cut:
            yield done([x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held is not None:
        yield done(held)


def _dealt(rows: DataFrame) -> DataFrame:
    """The stored rows (token, fp, n, root) once for each unit, a chunk of a token's rows with a chunk of them: (unit, side, fp, n, root)."""
    sizes = rows.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("words"))
    sizes = sizes.withColumn("chunks", F.ceil(F.greatest(F.col("many") / CHUNK, F.col("words") / WORDS)).cast("int")).filter("chunks > 1").drop("words")
    dealt = evenly_joined(rows, sizes, ["token"], ["fp"], rows.count(), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.select(
        F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int").alias("side"),
        "fp", F.col("n").cast("long").alias("n"), "root",
    )


def _close(rest: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """Edges (u, v) that join those of the stored rows (token, fp, n, root) with one token that are as similar.

    Rows that sizes and parities leave a partner under some token form groups, the components of these pairs; within a group
    whole sets are compared. Both times a unit gives a forest, so that nothing makes as many rows as it has pairs.
    """

    def numbers(b: pa.RecordBatch) -> list[np.ndarray]:
        return [np.asarray(b.column(i)) for i in range(5)]

    def with_bits(b: pa.RecordBatch) -> list:
        return [*numbers(b), b.column(5).to_pylist()]

    def with_sets(b: pa.RecordBatch) -> list:
        raw, at = binary_buffer(b.column(5))
        return [*numbers(b), [np.frombuffer(raw[s:e].tobytes(), np.uint64) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]]

    def possible(fp, n, root, bits, side) -> tuple[np.ndarray, np.ndarray]:
        ids, width = np.unique(fp), np.array([len(x) for x in bits])
        label = np.arange(len(ids))
        for w in np.unique(width).tolist():  # sets of a similarity over a half have as many places, or twice as many
            same, twice = width == w, width == 2 * w
            own, zero, one = (side == x for x in (2, 0, 1))
            for left, right in ((same & own, None), (same & own, twice & own), (same & zero, same & one), (same & zero, twice & one), (twice & zero, same & one)):
                at = np.flatnonzero(left) if right is None else np.r_[np.flatnonzero(left), np.flatnonzero(right)]
                if len(at) < 2 or not left.any() or (right is not None and not right.any()):
                    continue
                table = np.array([np.bitwise_xor.reduce(np.frombuffer(bits[i], np.uint64).reshape(-1, w // 8), axis=0) for i in at.tolist()])
                sides = np.full(len(at), 2) if right is None else np.r_[np.zeros(left.sum(), int), np.ones(right.sum(), int)]
                label = simhash._merge(label, *(np.searchsorted(ids, x) for x in allowed(fp[at], n[at], root[at], table, sides, similarity)))
        some = np.flatnonzero(label != np.arange(len(ids)))
        return ids[label[some]], ids[some]

    def exact(fp, n, root, sets, side) -> tuple[np.ndarray, np.ndarray]:
        return forest(fp, n, root, sets, side, similarity)

    def edges(units: DataFrame, columns, compare) -> DataFrame:
        def done(held: list) -> pa.RecordBatch:
            unit, side, fp, n, root, own = held
            cuts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True]).tolist()
            found = [compare(fp[s:e], n[s:e], root[s:e], own[s:e], side[s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True) if e - s > 1]
            u, v = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        run = lambda batches: _units(batches, columns, done)
        return units.repartition("unit").sortWithinPartitions("unit", "side", "fp").mapInArrow(run, "u long, v long").distinct()

    near = stored(edges(_dealt(rest).join(nodes.select("fp", "bits"), "fp").select("unit", "side", "fp", "n", "root", "bits"), with_bits, possible), "possible")
    groups = stored(components(near), "groups")
    facts = rest.select("fp", "n", "root").distinct()
    members = stored(groups.join(facts, groups["node"] == facts["fp"]).select(F.col("component").alias("token"), "fp", "n", "root"), "members")
    sets = stored(_sets(rows, members.select("fp"), shingle), "sets")
    out = stored(edges(_dealt(members).join(sets, "fp").select("unit", "side", "fp", "n", "root", "ids"), with_sets, exact), "links")
    dropped(near, groups, members, sets)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Those of the pairs (u, v) that are as similar."""
    one, other = sets.select(F.col("fp").alias("u"), F.col("ids").alias("a")), sets.select(F.col("fp").alias("v"), F.col("ids").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            both = zip(b.column(2), b.column(3), strict=True)
            good = pa.array([similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity) for x, y in both])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], names=["u", "v"])

    return _with_facts(pairs, one, other).select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _by_simhash(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes (fp, sim) that bit-sliced SimHash links: equal fingerprints with the least node of each, linked ones by these."""
    leads = stored(nodes.groupBy("sim").agg(F.min("fp").alias("lead"), F.count(F.lit(1)).alias("many")), "leads")
    equal = evenly_joined(nodes, leads, ["sim"], ["fp"], nodes.count()).select(F.col("fp").alias("u"), F.col("lead").alias("v"))
    near = simhash.links(leads.select(F.col("sim").alias("fp")), RADIUS)
    one, other = (leads.select(F.col("sim").alias(x), F.col("lead").alias("l" + x)) for x in "uv")
    linked = near.join(one, "u").join(other, "v").select(F.col("lu").alias("u"), F.col("lv").alias("v"))
    both = equal.unionByName(linked).filter("u <> v")
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def links(rows: DataFrame, nodes: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """Edges (u, v) that join exactly the sets as similar, transitively. rows: (doc_id, text); nodes: (fp, n, bits, sim)."""
    p, q = similarity
    fits = lambda x, y: F.least(x, y).cast("long") * q >= F.greatest(x, y).cast("long") * p
    met = stored(_met(rows, shingle, similarity), "met")

    def linked(pairs: DataFrame) -> DataFrame:
        met_pairs = stored(pairs, "met_pairs")
        some = stored(_possible(met_pairs, nodes, similarity), "pairs")
        dropped(met_pairs)
        wanted = stored(some.select(F.explode(F.array("u", "v")).alias("fp")).distinct(), "wanted")
        sets = stored(_sets(rows, wanted, shingle), "sets")
        out = stored(_verified(some, sets, similarity), "links")
        dropped(some, wanted, sets)
        return out

    led = met.filter((F.col("fp") != F.col("leader")) & fits("n", "leader_n"))
    led = led.select(F.least("fp", "leader").alias("u"), F.greatest("fp", "leader").alias("v"))
    first = linked(_by_simhash(nodes.select("fp", "sim")).unionByName(led).distinct())
    found = stored(components(first), "components")
    named = met.join(found, met["fp"] == found["node"], "left").select("token", "fp", "n", F.coalesce("component", "fp").alias("root"))
    apart = named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("many"))
    apart = apart.filter("lo <> hi and many > 2").select("token")  # of two, the leader has met the other
    rest = stored(named.join(apart, "token", "left_semi"), "rest")
    second = _close(rest, rows, nodes, shingle, similarity)
    dropped(met, found, rest)
    return first.unionByName(second)


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp (a hash of the set), component_id."""
    rows = narrowed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1 << 20):
            sets = shingles(b.column(1), shingle)
            fp = np.array([name_of(x) for x in sets], np.uint64).view(np.int64)
            sim = np.array([simhash.fingerprint(x, shingle) for x in text_bytes(b.column(1))], np.uint64).view(np.int64)
            made = [b.column(0), pa.array(fp), pa.array([len(x) for x in sets], pa.int32()), pa.array([parities(x) for x in sets], pa.binary()), pa.array(sim)]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "fp", "n", "bits", "sim"])

    made = stored(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long, n int, bits binary, sim long"), "named")
    nodes = stored(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("many"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("sim").alias("sim")), "nodes")
    found = components(links(rows, nodes.select("fp", "n", "bits", "sim"), shingle, similarity))
    return labelled(made.select("doc_id", "fp"), nodes.select("fp", "least", "many"), found)


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one of each component stays: that with the smallest doc_id. Null and repeated ids as in ``simhash.deduplicated``."""
    made = stored(near_dedup(docs, shingle, similarity, id_col, text_col), "marked")
    return only_least(docs, made, lambda texts: names(texts, shingle), id_col, text_col)
