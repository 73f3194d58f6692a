"""Toxicity: a convolutional text classifier in numpy.

A word (letters and digits between other ASCII characters, A-Z lower-cased) is the sum
of hashed embeddings: one of the whole word, one of its first five and one of its first
seven bytes, which inflected forms of a stem share. Filters of several widths run over a text's words, each is max-pooled over
the whole text, and a dense layer gives a logit. Only pooled places carry gradient, so
training is cheap. Rows of the table that fewer than ``Settings.support`` training texts
use stay zero, as do those of words never seen: a text is not learnt by its rare words.

It learns from every labelled row. Rows are dealt by the hash of the id to shards of about
``Settings.toxic + Settings.clean`` texts, a shard with more than ``Settings.words`` words is cut into
pieces, and each piece is kept as one file. ``Settings.nets`` networks are trained, each without its share
of the rows, by hash of the id; a logit is the mean of theirs. Where there is one piece, a task
for each network runs all epochs. Otherwise an epoch is a round: a task for each piece and network goes on from
the network of the round before, and what the tasks made of it is averaged, rows of the table over
those tasks that changed them. How many training texts use a row of the table is counted over all pieces.
On each row the network that has not seen it serves to calibrate, again over all rows: the logit is scaled to a
probability of the label at the label's own rate among all training labels,
then shifted so that ``Settings.threshold`` is the score at which those rows' labels are told
apart best. What rejects a row is a decision threshold of its language, where that has enough
rows, or else one of all rows; for these a clean row lost weighs twice a toxic one kept. Language serves the threshold only, never the score.
Nothing depends on the layout of the rows: shards, pieces and the order of all sums follow from the ids.

Scores cover every row and whole texts, however long; repeated rows get equal scores. Of a
doc_id that several rows of the documents carry, the text that hashes least is learnt from.
Defined results: a null or empty text is scored
as a text without words. Labels other than 0 and 1, and labels without a document, are
ignored; of several labels of one id the largest counts. Without labels of both classes
every score is the rate of label 1 (0.5 without any label). An empty table stays empty.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import SpanHasher, bound_batches, delete_path, dropped, give_back, mapped, opened, put_file, scratch_path, small_batches, stored, text_buffer, unused

BITS = 18
PARTS = 3
SLICES = 16  # of the table, each summed over all tasks in one
CHUNK = 1 << 18  # words that are convolved at once


@dataclass(frozen=True)
class Settings:
    toxic: int = 3000  # the two together: texts that one task learns from in a round
    clean: int = 5000
    words: int = 6_000_000  # their words
    dims: int = 8
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    steps: int = 400  # batches, spread over whole epochs, 40 at most
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    support: int = 3
    threshold: float = 0.7
    nets: int = 3
    seed: int = 7


# Bytes of words: ASCII letters and digits, and all bytes of other characters.
_INNER = np.zeros(256, bool)
_INNER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the embedding table for each word, PARTS of them; the first word of each text, with the end)."""
    raw, offsets = text_buffer(texts)
    if not len(raw):
        return np.zeros((0, PARTS), np.int32), np.zeros(len(offsets), np.int64)
    inner = _INNER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # a word ends with its text
    starts = np.flatnonzero(inner & np.r_[True, ~inner[:-1] | edge[1:-1]])
    ends = np.flatnonzero(inner & np.r_[~inner[1:] | edge[1:-1], True]) + 1
    low = _FOLD[raw]
    out = np.empty((len(starts), PARTS), np.int32)
    hashed = SpanHasher(low, 1)
    whole = hashed(starts, ends)
    top = np.uint64(64 - BITS)
    out[:, 0] = whole >> top
    for part, n in ((1, 5), (2, 7)):
        out[:, part] = (hashed(starts, np.minimum(ends, starts + n)) >> top).astype(np.int32) + (part << BITS)
    return out, np.searchsorted(starts, offsets)


@dataclass
class Net:
    table: np.ndarray  # PARTS << BITS rows of embeddings; with ``place``, only those that are not zero, and a row of zeros before them
    kernels: list[np.ndarray]  # for each width: (width, dims, filters)
    biases: list[np.ndarray]
    dense: np.ndarray
    bias: float
    place: np.ndarray | None = None  # where the rows of the whole table are

    def packed(self) -> Net:
        """The same network without the rows that stayed zero, most of the table."""
        some = np.flatnonzero(self.table.any(axis=1))
        place = np.zeros(len(self.table), np.int32)
        place[some] = np.arange(1, len(some) + 1)
        return Net(np.vstack([np.zeros((1, self.table.shape[1]), np.float32), self.table[some]]), self.kernels, self.biases, self.dense, self.bias, place)

    def pooled(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(max-pooled filters of each text before bias and rectifier, the places of the maxima); -inf and -1 where a text is too short."""
        if len(rows) <= CHUNK:
            return self._pooled(rows, first)
        # Windows that begin in a chunk of words are taken together, so that memory follows neither long texts nor many.
        widest = max(k.shape[0] for k in self.kernels)
        best = np.full((len(first) - 1, sum(k.shape[2] for k in self.kernels)), -np.inf, np.float32)
        place = np.full(best.shape, -1, np.int64)
        for lo in range(0, len(rows), CHUNK):
            hi = min(lo + CHUNK + widest - 1, len(rows))
            a, b = np.searchsorted(first, lo, "right") - 1, np.searchsorted(first, hi, "left")  # texts that reach into it
            own, where = self._pooled(rows[lo:hi], np.clip(first[a : b + 1], lo, hi) - lo)
            more = own > best[a:b]
            best[a:b][more], place[a:b][more] = own[more], where[more] + lo
        return best, place

    def _pooled(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_docs, total = len(first) - 1, sum(k.shape[2] for k in self.kernels)
        best = np.full((n_docs, total), -np.inf, np.float32)
        place = np.full((n_docs, total), -1, np.int64)
        if not len(rows):
            return best, place
        if self.place is not None:
            rows = self.place[rows]
        x = self.table[rows[:, 0]]
        for p in range(1, PARTS):
            x += self.table[rows[:, p]]
        at = 0
        for kernel in self.kernels:
            width, dims, filters = kernel.shape
            shifted = x @ kernel.transpose(1, 0, 2).reshape(dims, width * filters)
            out = shifted[: len(x) - width + 1, :filters].copy()
            for j in range(1, width):
                out += shifted[j : len(x) - width + 1 + j, j * filters : (j + 1) * filters]
            # Windows that reach over a text's end don't count.
            for d in np.flatnonzero(np.diff(first) >= width):
                own = out[first[d] : first[d + 1] - width + 1]
                arg = own.argmax(axis=0)
                best[d, at : at + filters] = own[arg, np.arange(filters)]
                place[d, at : at + filters] = arg + first[d]
            at += filters
        return best, place

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        best, _ = self.pooled(rows, first)
        hidden = np.maximum(best + np.concatenate(self.biases), 0)
        return hidden @ self.dense + self.bias


@dataclass
class Model:
    settings: Settings
    nets: list[Net]
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    other: float | None = None  # of languages without a threshold of their own

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang, self.settings.threshold if self.other is None else self.other)

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.mean([net.logits(rows, first) for net in self.nets], axis=0) if self.nets else np.zeros(len(first) - 1)

    def scores(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = self.logits(rows, first).astype(np.float64) * self.scale[0] + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class _Adam:
    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.m, self.v, self.t = value, rate, np.zeros_like(value), np.zeros_like(value), 0

    def step(self, grad: np.ndarray, rows=slice(None)) -> None:
        self.t += 1
        m, v = self.m[rows] * 0.9 + 0.1 * grad, self.v[rows] * 0.99 + 0.01 * grad * grad
        self.m[rows], self.v[rows] = m, v
        t = min(self.t, 1000)
        self.value[rows] -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)


def used(rows, first: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """How many of the texts use each row of the table."""
    uses = np.zeros(PARTS << BITS, np.int32)
    for d in texts.tolist():
        own = rows[first[d] : first[d + 1]]
        for p in range(PARTS):
            uses[np.unique(own[:, p])] += 1
    return uses


def started(s: Settings, number: int, known: np.ndarray) -> Net:
    """The network before any training; rows of the table that are not known are zero."""
    rng = np.random.default_rng(s.seed + number)
    table = rng.standard_normal((PARTS << BITS, s.dims), np.float32)
    table *= 0.01
    table[~known] = 0
    kernels = [(rng.standard_normal((w, s.dims, s.filters)) / np.sqrt(w)).astype(np.float32) for w in s.widths]
    biases = [np.zeros(s.filters, np.float32) for _ in s.widths]
    return Net(table, kernels, biases, (rng.random(s.filters * len(s.widths)) * 0.5 + 0.1).astype(np.float32), -1.0)


def epochs_of(s: Settings, n_texts: int) -> int:
    """``Settings.steps`` batches of so many texts, or of those one task has."""
    share = max(s.nets - 1, 1) / s.nets
    return min(40, int(np.ceil(s.steps * s.batch / max(1, min(n_texts, (s.toxic + s.clean) * share)))))


def train(rows: np.ndarray, first: np.ndarray, labels: np.ndarray, s: Settings, number: int = 0, texts: np.ndarray | None = None) -> Net:
    """Train on some of the texts, by their numbers (all, if not given)."""
    texts = np.arange(len(labels)) if texts is None else texts
    known = used(rows, first, texts) >= min(s.support, len(texts))
    net, epochs = started(s, number, known), epochs_of(s, len(texts))
    learn(net, known, rows, first, labels, s, texts, range(epochs), epochs, (s.seed + number, 0))
    return net


def learn(net: Net, known: np.ndarray, rows, first: np.ndarray, labels: np.ndarray, s: Settings, texts: np.ndarray, which_epochs: range, epochs: int, key: tuple[int, ...]) -> np.ndarray:
    """Train ``net`` further, in place, for some of its epochs; which rows of the table changed. ``rows`` may be ``Words``."""
    changed = np.zeros(len(net.table), bool)
    on_table, on_dense = _Adam(net.table, s.rate), _Adam(net.dense, s.rate)
    on_kernels, on_biases = [_Adam(k, s.rate) for k in net.kernels], [_Adam(b, s.rate) for b in net.biases]
    on_bias = _Adam(np.array([net.bias], np.float32), s.rate)
    for epoch in which_epochs:
        order = np.random.default_rng([*key, epoch]).permutation(texts)
        for a in (on_table, on_dense, on_bias, *on_kernels, *on_biases):
            a.rate = s.rate * (1 - epoch / epochs)
        for lo in range(0, len(order), s.batch):
            docs = order[lo : lo + s.batch]
            sizes = first[docs + 1] - first[docs]
            own_first = np.r_[0, np.cumsum(sizes)]
            own = rows[np.repeat(first[docs] - own_first[:-1], sizes) + np.arange(own_first[-1])]
            best, place = net.pooled(own, own_first)
            before = best + np.concatenate(net.biases)
            hidden = np.maximum(before, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.dense + net.bias, -30, 30)))
            slope = ((p - labels[docs]) / len(docs)).astype(np.float32)
            to_hidden = np.outer(slope, net.dense) * (before > 0)
            grads, touched, at = [], [], 0
            for kernel in net.kernels:
                width, dims, filters = kernel.shape
                d, f = np.nonzero((place[:, at : at + filters] >= 0) & (to_hidden[:, at : at + filters] != 0))
                g, where = to_hidden[d, at + f], place[d, at + f]
                grad = np.zeros_like(kernel)
                for j in range(width):
                    x = net.table[own[where + j]].sum(axis=1)
                    np.add.at(grad[j].T, f, g[:, None] * x)
                    touched.append((own[where + j], g[:, None] * kernel[j][:, f].T))
                grads.append(grad + s.decay * kernel)
                at += filters
            if touched:
                ids = np.concatenate([t[0] for t in touched])
                flow = np.concatenate([t[1] for t in touched])
                which, back = np.unique(ids, return_inverse=True)
                back = back.reshape(ids.shape)
                grad = np.zeros((len(which), s.dims), np.float32)
                for part in range(PARTS):
                    np.add.at(grad, back[:, part], flow)
                some = known[which]
                changed[which[some]] = True
                on_table.step((grad + s.decay * net.table[which])[some], which[some])
            on_dense.step(hidden.T @ slope + s.decay * net.dense)
            on_bias.step(slope.sum(keepdims=True))
            net.bias = float(on_bias.value[0])
            at = 0
            for i in range(len(net.kernels)):
                on_kernels[i].step(grads[i])
                on_biases[i].step(to_hidden[:, at : at + s.filters].sum(axis=0))
                at += s.filters
    return changed


def calibrate(model: Model, sums: Callable[[float, float], np.ndarray], counted: Callable[[np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]], weights: np.ndarray) -> None:
    """Scale logits to probabilities of the weighted labels, with a weak pull to the identity, and shift them to the threshold; then a threshold for each language.

    ``weights`` are those of a row of label 0 and 1. ``sums`` gives ``slopes`` over all rows at a scale, and ``counted`` how
    many rows of label 0 and 1 score below the first of the options, from there to the second and so on: of all rows and of each language with enough.
    """
    a, b = 1.0, 0.0
    for _ in range(50):
        ga, gb, haa, hab, hbb = weights @ sums(a, b)
        g, h = np.array([ga + (a - 1), gb + 0.1 * b]), np.array([[haa + 1, hab], [hab, hbb + 0.1]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.scale = (max(a, 0.05), b)

    def best(counts: np.ndarray, options: np.ndarray, price: float) -> np.ndarray | None:
        """Those of the thresholds that serve these rows best, a lost clean one at this price; None where they are too few to tell."""
        if counts.sum(axis=1).min() < ENOUGH:
            return None
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:] * weights[:, None]
        hit, false, miss = above[1], above[0], counts[1].sum() * weights[1] - above[1]
        worth = 2 * hit / np.maximum(2 * hit + price * false + miss, 1e-9)
        return options[worth >= worth.max() - 1e-9]

    threshold = model.settings.threshold
    fine, options = np.linspace(0.02, 0.98, 97), np.arange(0.4, 0.91, 0.05)
    good = best(counted(fine)[0], fine, 1)
    if good is None:
        return
    logit = lambda p: float(np.log(p / (1 - p)))
    model.scale = (model.scale[0], model.scale[1] + logit(threshold) - logit(float(np.median(good))))
    all_, langs = counted(options)
    model.other = float(min(best(all_, options, 2), key=lambda t: abs(t - threshold)))
    for lang, counts in sorted(langs.items()):
        good = best(counts, options, 2)
        if good is not None:
            model.thresholds[lang] = float(min(good, key=lambda t: abs(t - threshold)))


ENOUGH = 20  # rows of either label, for a threshold


def slopes(z: np.ndarray, y: np.ndarray, a: float, b: float) -> np.ndarray:
    """First and second derivatives of the loss by the scale and the shift, of the rows of label 0 and of label 1."""
    p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
    w = p * (1 - p) + 1e-9
    each = np.stack([(p - y) * z, p - y, w * z * z, w * z, w])
    return np.stack([each[:, y == v].sum(axis=1) for v in (0, 1)])


def labels_of(labels: DataFrame, usable: Column | None) -> tuple[DataFrame, dict[int, int]]:
    """(Usable labels (doc_id, y), one of each id; how many there are of each kind.)"""
    given = labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    given = given.groupBy("doc_id").agg(F.max("y").alias("y"))
    if usable is not None:
        given = given.filter(usable)
    return given, {r.y: r["n"] for r in given.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}


def texts_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """The rows of ``chosen`` (doc_id and more) that have a document, with its text and lang; of an id that repeats, one."""
    lang = docs[lang_col].cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), lang.alias("lang"))
    one = F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), F.xxhash64("lang")))
    return rows.join(chosen, "doc_id").groupBy(*chosen.columns).agg(one.alias("x")).select("x.text", "x.lang", *chosen.columns)


def sample_of(docs: DataFrame, labels: DataFrame, usable: Column | None, s: Settings, id_col: str, text_col: str, lang_col: str | None) -> tuple[DataFrame, dict[int, int]]:
    """(A stored sample of training texts (h, y, lang, n words, ids), how many usable labels there are of each kind.)

    For a look at few texts; ``fit`` learns from all and takes none of this. At most ``Settings.toxic`` rows of label 1 and
    ``Settings.clean`` of label 0, those whose ids hash lowest, and at most ``Settings.words`` words in all, spent in the order
    of the id's hash, both labels in step, up to the first text that does not fit (a text longer than all of it is left out).
    """
    bound_batches(docs.sparkSession)
    given, rates = labels_of(labels, usable)
    key = F.xxhash64("doc_id")
    chosen = given.filter("y = 1").orderBy(key, "doc_id").limit(s.toxic).unionByName(given.filter("y = 0").orderBy(key, "doc_id").limit(s.clean))
    rank = F.row_number().over(Window.partitionBy("y").orderBy(key, "doc_id")) / F.count(F.lit(1)).over(Window.partitionBy("y"))  # of bounded rows
    chosen = F.broadcast(chosen.select("doc_id", "y", rank.alias("rank"), key.alias("k")))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            ids, first = features(b.column(0))
            out = [ids[first[i] : first[i + 1]].tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.diff(first)), pa.array(out, pa.binary())], names=["lang", "y", "h", "rank", "k", "n", "ids"])

    table = texts_of(docs, chosen, id_col, text_col, lang_col).select("text", "lang", "y", F.xxhash64("doc_id", F.lit(1)).alias("h"), "rank", "k")
    table = stored(table.mapInArrow(prepare, "lang string, y int, h long, rank double, k long, n long, ids binary").filter(F.col("n") <= s.words), "sample")
    words, end = 0, None
    for r in sorted(table.select("rank", "k", "n").collect()):
        words += r.n
        if words > s.words:
            end = r
            break
    fits = F.lit(True) if end is None else (F.col("rank") < end.rank) | ((F.col("rank") == end.rank) & (F.col("k") < end.k))
    sample = stored(table.filter(fits).select("h", "y", F.coalesce("lang", F.lit("")).alias("lang"), "n", "ids"), "sample")  # at most `words` words
    dropped(table)
    return sample, rates


class Words:
    """The table rows of each word of a piece, by its distinct words."""

    def __init__(self, distinct: np.ndarray, which: np.ndarray):
        self.distinct = np.stack([(distinct >> np.uint64(20 * p)) & np.uint64((1 << 20) - 1) for p in range(PARTS)], axis=1).astype(np.int32)
        self.which = which

    def __getitem__(self, at) -> np.ndarray:
        return self.distinct[self.which[at]]


class Piece:
    """Training texts of a file, in the order of their hash: words, labels, shares and languages."""

    def __init__(self, uri: str):
        with opened(f"{uri}.npz", "rb") as f:
            data = np.load(io.BytesIO(f.read()))
        self.rows, self.first = Words(data["distinct"], mapped(f"{uri}.words", np.int32)), data["first"]
        self.y, self.share, self.lang, self.names = data["y"], data["share"], data["lang"], json.loads(data["names"].tobytes())

    @staticmethod
    def put(uri: str, packed: list[np.ndarray], y: list[int], share: list[int], langs: list[str]) -> tuple[Words, np.ndarray]:
        distinct, which = np.unique(np.concatenate(packed), return_inverse=True)
        which, first = which.astype(np.int32), np.r_[0, np.cumsum([len(x) for x in packed])]
        put_file(f"{uri}.words", which.tobytes())
        names = sorted(set(langs))
        lang = np.array([names.index(x) for x in langs], np.int32) if len(names) < 50 else np.searchsorted(np.array(names, object), np.array(langs, object)).astype(np.int32)
        out = io.BytesIO()
        np.savez(out, distinct=distinct, first=first, y=np.array(y, np.int8), share=np.array(share, np.int8), lang=lang, names=np.frombuffer(json.dumps(names).encode(), np.uint8))
        put_file(f"{uri}.npz", out.getvalue())
        return Words(distinct, which), first


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _tasks(spark: SparkSession, n: int, run: Callable[[int], list], each: int = 1) -> list:
    """What ``run`` gives for each of the numbers below n, so many of them in a task."""

    def all_(numbers: Iterator[int]) -> Iterator:
        for i in numbers:
            yield from run(i)
        give_back()

    return spark.sparkContext.parallelize(range(n), -(-n // each)).mapPartitions(all_).collect()


_CUT = pa.schema([("shard", pa.int32()), ("piece", pa.int32()), ("slice", pa.int32()), ("at", pa.binary()), ("data", pa.binary())])
SLICE = (PARTS << BITS) // SLICES


def cut(texts: DataFrame, shards: int, base: str, s: Settings) -> tuple[list[tuple[str, np.ndarray]], np.ndarray]:
    """Write the pieces of ``texts`` (text, lang, doc_id, y): ([(the piece's path, its texts by share and label)], how many texts of each share use each row of the table)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, piece, words, held = None, 0, 0, ([], [], [], [])

        def flush() -> Iterator[pa.RecordBatch]:
            rows, first = Piece.put(f"{base}/{now}-{piece}", *held)
            y, share = np.array(held[1]), np.array(held[2])
            uses = np.stack([used(rows, first, np.flatnonzero(share == k)) for k in range(s.nets)])
            kinds = np.array([[((share == k) & (y == v)).sum() for v in (0, 1)] for k in range(s.nets)], np.int64)
            out = [(now, piece, -1, b"", kinds.tobytes())]
            for i in range(SLICES):
                part = uses[:, i * SLICE : (i + 1) * SLICE].ravel()
                at = np.flatnonzero(part).astype(np.int32)
                out.append((now, piece, i, at.tobytes(), part[at].tobytes()))
            yield _rows(_CUT, out)

        for b in small_batches(batches):
            ids, first = features(b.column(0))
            packed = ids[:, 0].astype(np.uint64)
            for p in range(1, PARTS):
                packed |= ids[:, p].astype(np.uint64) << np.uint64(20 * p)
            for i, (lang, y, h, shard) in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)):
                own = packed[first[i] : first[i + 1]]
                if held[0] and (shard != now or words + len(own) > s.words):
                    yield from flush()
                    piece, words, held = piece + 1 if shard == now else 0, 0, ([], [], [], [])
                now, words = shard, words + len(own)
                for x, v in zip(held, (own.copy(), y, h % s.nets, lang), strict=True):
                    x.append(v)
        if held[0]:
            yield from flush()
        give_back()

    h, shard = F.xxhash64("doc_id", F.lit(1)), F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(shards)).cast("int")
    rows = texts.select("text", F.coalesce("lang", F.lit("")).alias("lang"), "y", h.alias("h"), shard.alias("shard"), "doc_id")
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h", "doc_id").drop("doc_id")
    table = stored(rows.mapInArrow(write, "shard int, piece int, slice int, at binary, data binary"), "cut")
    found = sorted((r.shard, r.piece, r["data"]) for r in table.filter("slice < 0").collect())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, at, data in zip(*(b.column(c).to_pylist() for c in ("slice", "at", "data")), strict=True):
                sums.setdefault(i, np.zeros(s.nets * SLICE, np.int64))[np.frombuffer(at, np.int32)] += np.frombuffer(data, np.int32)
        for i, x in sums.items():
            yield _rows(_CUT, [(0, 0, i, b"", np.minimum(x, 2**31 - 1).astype(np.int32).tobytes())])

    uses = np.zeros((s.nets, PARTS << BITS), np.int32)
    for r in table.filter("slice >= 0").repartition("slice").mapInArrow(add, table.schema).collect():
        uses[:, r.slice * SLICE : (r.slice + 1) * SLICE] = np.frombuffer(r["data"], np.int32).reshape(s.nets, SLICE)
    dropped(table)
    return [(f"{base}/{shard}-{piece}", np.frombuffer(data, np.int64).reshape(s.nets, 2)) for shard, piece, data in found], uses


@dataclass
class _State:
    """A network between rounds: what changed in the table since its start, and the rest of it."""

    known: np.ndarray
    at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    values: np.ndarray | None = None
    rest: np.ndarray | None = None

    def net(self, s: Settings, number: int) -> Net:
        net = started(s, number, self.known)
        if self.rest is not None:
            net.table[self.at] = self.values
            lo = 0
            for x in (*net.kernels, *net.biases, net.dense):
                x[...] = self.rest[lo : lo + x.size].reshape(x.shape)
                lo += x.size
            net.bias = float(self.rest[lo])
        return net


def _rest(net: Net) -> np.ndarray:
    return np.concatenate([*(x.ravel() for x in (*net.kernels, *net.biases, net.dense)), [net.bias]]).astype(np.float32)


def _round(spark: SparkSession, pieces: list[str], states: list[_State], all_of: list[bool], s: Settings, now: range, epochs: list[int]) -> None:
    """Train every network on every piece for these epochs (those it has of them) and average what comes of it."""
    units = [(uri, number) for number in range(s.nets) if now.start < epochs[number] for uri in pieces]
    base, shared = scratch_path(spark, "round"), spark.sparkContext.broadcast(states)

    def run(i: int) -> list:
        uri, number = units[i]
        own, state = Piece(uri), shared.value[number]
        texts = np.arange(len(own.y)) if all_of[number] else np.flatnonzero(own.share != number)
        if not len(texts):
            return []
        net = state.net(s, number)
        mine = range(now.start, min(now.stop, epochs[number]))
        at = np.flatnonzero(learn(net, state.known, own.rows, own.first, own.y.astype(np.float32), s, texts, mine, epochs[number], (s.seed + number, i % len(pieces))))
        parts = []
        for k in range(SLICES):
            part = at[(at >= k * SLICE) & (at < (k + 1) * SLICE)]
            parts.append((part - k * SLICE).astype(np.int32).tobytes() + net.table[part].tobytes())
        parts.append(_rest(net).tobytes())
        put_file(f"{base}/{i}", np.cumsum([8 * (SLICES + 2), *map(len, parts)]).astype(np.int64).tobytes() + b"".join(parts))
        return [(number, i, len(texts))]

    done = sorted(_tasks(spark, len(units), run))
    means = [(number, k) for number in sorted({x[0] for x in done}) for k in range(SLICES + 1)]

    def mean(i: int) -> list:
        """The mean of a slice of a network's table, over the tasks that changed a row, or of the rest of it, by texts."""
        number, k = means[i]
        sums, weights = None, None
        for _, task, texts in (x for x in done if x[0] == number):
            with opened(f"{base}/{task}", "rb") as f:
                ends = np.frombuffer(f.read(8 * (SLICES + 2)), np.int64)
                f.seek(int(ends[k]))
                data = f.read(int(ends[k + 1] - ends[k]))
            n = len(data) // (4 * (1 + s.dims)) if k < SLICES else len(data) // 4
            at = np.frombuffer(data, np.int32, n) if k < SLICES else np.arange(n)
            values = np.frombuffer(data, np.float32, offset=4 * n if k < SLICES else 0).reshape(n, -1 if n else s.dims)
            if sums is None:
                size = SLICE if k < SLICES else n
                sums, weights = np.zeros((size, s.dims if k < SLICES else 1)), np.zeros(size)
            weight = 1 if k < SLICES else texts
            sums[at] += weight * values.astype(np.float64)
            weights[at] += weight
        some = np.flatnonzero(weights)
        return [(number, k, some.astype(np.int32).tobytes(), (sums[some] / weights[some, None]).astype(np.float32).tobytes())]

    changed: dict[int, list] = {}
    for number, k, at, values in sorted(_tasks(spark, len(means), mean)):
        at, values = np.frombuffer(at, np.int32), np.frombuffer(values, np.float32)
        if k == SLICES:
            states[number].rest = values
        else:
            changed.setdefault(number, []).append((at.astype(np.int64) + k * SLICE, values.reshape(len(at), s.dims)))
    shared.destroy()
    delete_path(spark, base)
    for number, parts in changed.items():
        state, at, values = states[number], *(np.concatenate(x) for x in zip(*parts, strict=True))
        old = np.isin(state.at, at, invert=True)
        state.values = np.concatenate([state.values[old], values]) if state.values is not None else values
        state.at = np.concatenate([state.at[old], at])
    for state in states:
        if state.values is None:
            state.values = np.zeros((0, s.dims), np.float32)


def _judged(spark: SparkSession, pieces: list[str], model: Model, all_of: list[bool]) -> None:
    """Write beside each piece the logits of its texts by the networks that have not seen them (nan where there is none)."""
    shared = spark.sparkContext.broadcast(model)

    def run(i: int) -> list:
        own, nets = Piece(pieces[i]), shared.value.nets
        z = np.full(len(own.y), np.nan)
        for d in range(len(z)):
            if not all_of[own.share[d]]:
                z[d] = nets[own.share[d]].logits(own.rows[own.first[d] : own.first[d + 1]], np.array([0, own.first[d + 1] - own.first[d]]))[0]
        put_file(f"{pieces[i]}.z", z.tobytes())
        return []

    _tasks(spark, len(pieces), run)
    shared.destroy()


def _calibrated(spark: SparkSession, pieces: list[str], model: Model, weights: np.ndarray) -> None:
    each = max(1, len(pieces) // (4 * spark.sparkContext.defaultParallelism))

    def logits(uri: str) -> tuple[Piece, np.ndarray, np.ndarray]:
        own, z = Piece(uri), np.array(mapped(f"{uri}.z", np.float64))
        some = np.flatnonzero(~np.isnan(z))
        return own, z[some], some

    def sums(a: float, b: float) -> np.ndarray:
        def run(i: int) -> list:
            own, z, some = logits(pieces[i])
            return [slopes(z, own.y[some], a, b)]

        return np.sum(_tasks(spark, len(pieces), run, each), axis=0)  # in the order of the pieces

    def counted(options: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        scale = model.scale

        schema = pa.schema([("lang", pa.string()), ("y", pa.int32()), ("level", pa.int32()), ("n", pa.int64())])

        def run(i: int) -> pa.RecordBatch:
            own, z, some = logits(pieces[i])
            level = np.searchsorted(options, 1 / (1 + np.exp(-np.clip(scale[0] * z + scale[1], -60, 60))), "right")
            kinds, n = np.unique(np.stack([own.lang[some], own.y[some], level]), axis=1, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([own.names[x] for x in kinds[0].tolist()], pa.string()), *(pa.array(x, f.type) for x, f in zip((*kinds[1:], n), list(schema)[1:], strict=True))], schema=schema)

        def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in b.column(0).to_pylist():
                    yield run(i)

        numbers = spark.range(0, len(pieces), 1, -(-len(pieces) // each))
        table = stored(numbers.mapInArrow(all_, "lang string, y int, level int, n long"), "levels")

        def filled(rows) -> np.ndarray:
            out = np.zeros((2, len(options) + 1))
            for y, x, n in rows:
                out[y, x] += n
            return out

        all_ = filled(table.groupBy("y", "level").agg(F.sum("n")).collect())
        few = [F.sum(F.when(F.col("y") == v, F.col("n")).otherwise(0)) >= ENOUGH for v in (0, 1)]
        langs = table.groupBy("lang").agg(F.collect_list(F.struct("y", "level", "n")).alias("rows"), (few[0] & few[1]).alias("enough")).filter("enough").collect()
        dropped(table)
        return all_, {r.lang: filled(r["rows"]) for r in langs}

    calibrate(model, sums, counted, weights)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> Model:
    """Train on all ``labels`` (doc_id, toxic), of those rows for which ``usable``, an expression over doc_id, holds."""
    s, spark = settings or Settings(), docs.sparkSession
    bound_batches(spark)
    given, rates = labels_of(labels, usable)
    found = {r.y: r["n"] for r in given.join(docs.select(docs[id_col].alias("doc_id")), "doc_id", "left_semi").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(found) < 2:
        rate = rates.get(1, 0) / max(sum(rates.values()), 1) if rates else 0.5
        return Model(s, [], (1.0, float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))))

    base = scratch_path(spark, "pieces")
    shards = -(-sum(found.values()) // (s.toxic + s.clean))
    cuts, uses = cut(texts_of(docs, given, id_col, text_col, lang_col), shards, base, s)
    pieces, kinds = [uri for uri, _ in cuts], np.sum([k for _, k in cuts], axis=0)
    # A network that would have one label only, without its share, learns from all rows and judges none.
    all_of = [bool((np.delete(kinds, k, axis=0).sum(axis=0) == 0).any()) for k in range(s.nets)]
    states, epochs = [], []
    for k in range(s.nets):
        own = [i for i in range(s.nets) if all_of[k] or i != k]
        n = int(kinds[own].sum())
        states.append(_State(uses[own].sum(axis=0) >= min(s.support, n)))
        epochs.append(epochs_of(s, n))
    for start in range(max(epochs)) if len(pieces) > 1 else [0]:
        _round(spark, pieces, states, all_of, s, range(start, start + 1 if len(pieces) > 1 else max(epochs)), epochs)
    model = Model(s, [state.net(s, k).packed() for k, state in enumerate(states)])

    judged = kinds[[not x for x in all_of]].sum(axis=0)
    if (judged > 0).all():
        _judged(spark, pieces, model, all_of)
        weights = np.array([rates[v] / judged[v] for v in (0, 1)])
        _calibrated(spark, pieces, model, weights * judged.sum() / (weights @ judged))
    delete_path(spark, base)
    give_back()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang", score_col: str = "score", flag_col: str = "toxic_flag") -> DataFrame:
    """``docs`` with a score (0 to 1), and whether it reaches the threshold of the row's language; columns that have these names already are replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in (score_col.lower(), flag_col.lower())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    lang_at = names.index(lang_col) if lang_col and lang_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in small_batches(batches, 1 << 20):
            s = m.scores(*features(b.column(names.index(text_col)).cast(pa.large_string())))
            langs = b.column(lang_at).cast(pa.string()).to_pylist() if lang_at is not None else [None] * b.num_rows
            limits = np.array([m.threshold(x) for x in langs])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array(s >= limits)], names=[*names, score_col, flag_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType()), StructField(flag_col, BooleanType())]))


def rejected_out(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of ``docs`` below the threshold of their language."""
    score_col, flag = unused(docs.columns, "score"), unused(docs.columns, "toxic_flag")
    out = score(docs, model, text_col, lang_col, score_col, flag)
    return out.filter(~F.col(flag)).select(*[f"`{c}`" for c in docs.columns])
