"""Toxicity by held-out accuracy, the fixity audit by planted faults, the pipeline by a brute-force version of its stages."""

import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from foldstat.llm import toxicity, warc

from .conftest import SF
from .test_substring_dedup import brute as brute_substrings
from .test_substring_dedup import words_of

FAST = toxicity.Settings(steps=120, batch=16)


def toy(n, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 400, rng.integers(3, 60))]
        y = int(i % 4 == 0)
        if y:
            words[int(rng.integers(len(words)))] = ("Vile!", "nasty,", "grimblo" + str(rng.integers(999)))[int(rng.integers(3))]
        rows.append((i, " ".join(words), ("en", "de")[i % 2], y))
    return rows


def test_features_split_words_by_text():
    ids, first = toxicity.features(pa.array(["Idiot, x", "", None, "idiot", "idiots", "É!é"], pa.large_string()))
    assert first.tolist() == [0, 2, 2, 2, 3, 4, 6]
    assert (ids[0] == ids[2]).all()
    assert (ids[2] != ids[3]).any() and ids[2][1] == ids[3][1]


def test_learns_and_calibrates(spark):
    rows = toy(900)
    docs = spark.createDataFrame([r[:3] for r in rows] + [(None, None, None), (5000, "", "xx")], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(7, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, usable=F.col("doc_id") % 3 != 1, settings=FAST)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if r[0] % 3 == 1]
    right = sum((got[r[0]].score >= 0.7) == bool(r[3]) for r in held)
    assert right / len(held) > 0.95
    assert got[5000].score == got[None].score < 0.5
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = toxicity.rejected_out(docs, model)
    assert kept.columns == ["doc_id", "text", "lang"]
    assert {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if not r.toxic_flag}
    again = toxicity.fit(docs.repartition(7), labels, usable=F.col("doc_id") % 3 != 1, settings=FAST)
    assert again.scale == model.scale and again.thresholds == model.thresholds


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [round(r.score, 6) for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert all(r.score > 0.99 for r in toxicity.score(docs, toxicity.fit(docs, one)).collect())
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, one)).collect() == []


def test_gradient_of_the_network():
    """One pooled place at a time, the training step lowers the loss it is meant to lower."""
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 1 << toxicity.BITS, (60, toxicity.PARTS)).astype(np.int32)
    first = np.array([0, 20, 40, 60])
    y = np.array([1, 0, 1], np.float32)
    loss = lambda net: float(np.mean([-np.log(p if t else 1 - p) for p, t in zip(toxicity.Model(toxicity.Settings(), [net]).scores(rows, first), y, strict=True)]))
    few, many = (toxicity.train(rows, first, y, toxicity.Settings(steps=n, batch=3, seed=1, support=1)) for n in (1, 40))
    assert loss(many) < loss(few) / 3


def brute_near(texts):
    """The first text each is linked to by shared sets of five-word shingles of a Jaccard similarity of 0.8 or more, transitively."""
    sets = []
    for text in texts:
        words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


PAGES = [(i, f"http://h/{i}", "<p>" + "é" * (i * 37 % 900) + "</p>") for i in range(400)] + [(None, None, None), (7, "http://h/7", "twice"), (7, "http://h/7", "twice")]


def records(spark, pages):
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    r = warc.record_of(frame["page_id"], frame["url"], frame["html"])
    return warc.placed(frame.select("page_id", F.octet_length(r).cast("long").alias("length"), F.unhex(F.sha2(r, 256)).alias("digest"))).withColumn("unit", F.lit("a"))


def test_offsets_are_prefix_sums(spark):
    got = sorted((r.offset, r.length, bytes(r.digest)) for r in records(spark, PAGES).collect())
    made = []
    for p, u, h in PAGES:
        body = (h or "").encode()
        rec = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if p is None else p}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {u or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        made.append((-1 if p is None else p, hashlib.sha256(rec).digest(), len(rec)))
    want, at = [], 0
    for _, d, n in sorted(made):
        want.append((at, n, d))
        at += n
    assert got == want


@pytest.mark.parametrize("leaf", [700, 1 << 16])
def test_audit_finds_exactly_the_faults(spark, leaf):
    first = records(spark, PAGES).select("unit", "offset", "length", "digest")
    rows = sorted((tuple(r) for r in first.collect()), key=lambda r: r[1])
    broken = [r if i % 50 else (*r[:3], b"bad") for i, r in enumerate(rows) if i % 67 != 5] + [("a", 10**7, 5, b"new")]
    second = spark.createDataFrame([tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in broken], "unit string, offset long, length long, digest binary")
    got = {(r.offset, r.status) for r in warc.audit(first, second, leaf, 4).collect()}
    want = {(r[1], "missing") for i, r in enumerate(rows) if i % 67 == 5} | {(r[1], "corrupt") for i, r in enumerate(rows) if i % 50 == 0 and i % 67 != 5} | {(10**7, "extra")}
    assert got == want
    assert warc.audit(first, first, leaf, 4).collect() == []
    assert warc.audit(first.limit(0), first.limit(0)).collect() == []


def test_a_url_never_ends_its_header_line(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a\r\nContent-Length: 2", "whole"), (2, "\n", "")], "page_id long, url string, html string").coalesce(1)
    index = warc.write_warc(pages, str(tmp_path))
    back = sorted((r.page_id, r.url, r.html) for r in warc.read_warc(spark, str(tmp_path), [r.unit for r in index.select("unit").distinct().collect()]).collect())
    assert back == [(1, "http://a%0D%0AContent-Length: 2", "whole"), (2, "%0A", "")]


def test_placed_keeps_columns_of_any_name(spark):
    names = "page_id long, length long, digest binary, row_ int, part_ int, base_ int, total_ int, `offset` string, _r int, _p int"
    out = warc.placed(spark.createDataFrame([(i, 10, b"d", 1, 2, 3, 4, "x", 5, 6) for i in range(20)], names))
    assert sorted(out.columns) == sorted(["page_id", "length", "digest", "row_", "part_", "base_", "total_", "_r", "_p", "offset"])
    assert sorted((r["offset"], r.row_, r.part_, r.base_, r.total_) for r in out.collect()) == [(10 * i, 1, 2, 3, 4) for i in range(20)]


def test_pooling_against_plain_loops():
    rng = np.random.default_rng(4)
    table = rng.standard_normal((toxicity.PARTS << toxicity.BITS, 3)).astype(np.float32)
    kernels = [rng.standard_normal((w, 3, 2)).astype(np.float32) for w in (1, 2, 3)]
    table[rng.random(len(table)) < 0.7] = 0
    model = toxicity.Net(table, kernels, [rng.standard_normal(2).astype(np.float32) for _ in range(3)], rng.standard_normal(6).astype(np.float32), 0.3)
    sizes = [0, 1, 2, 3, 7, 0, 5]
    rows = (rng.integers(0, 1 << toxicity.BITS, (sum(sizes), toxicity.PARTS)) + (np.arange(toxicity.PARTS) << toxicity.BITS)).astype(np.int32)
    first = np.r_[0, np.cumsum(sizes)]
    logits = model.logits(rows, first)
    for d in range(len(sizes)):
        words = [sum(table[i] for i in rows[w]) for w in range(first[d], first[d + 1])]
        out = 0.3
        for a, (kernel, bias) in enumerate(zip(kernels, model.biases, strict=True)):
            for f in range(2):
                best = max((sum(float(words[i + j] @ kernel[j, :, f]) for j in range(len(kernel))) for i in range(len(words) - len(kernel) + 1)), default=-np.inf)
                out += max(best + bias[f], 0) * model.dense[2 * a + f]
        assert abs(out - logits[d]) < 1e-4
    np.testing.assert_allclose(model.packed().logits(rows, first), logits, atol=1e-5)


def test_files_round_trip_and_audit(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    index = warc.write_warc(pages, str(tmp_path / "one"))
    units = [r.unit for r in index.select("unit").distinct().collect()]
    back = warc.read_warc(spark, str(tmp_path / "one"), units)
    key = lambda r: (-1 if r[0] is None else r[0], r[1] or "", r[2] or "")
    assert sorted((key((r.page_id, r.url, r.html)) for r in back.collect())) == sorted(map(key, PAGES))
    assert sorted((r.unit, r.offset, r.length) for r in back.collect()) == sorted((r.unit, r.offset, r.length) for r in index.collect())
    (tmp_path / "two").mkdir()
    for u in units:
        data = bytearray((tmp_path / "one" / u).read_bytes())
        if u == units[0]:
            data[-10] ^= 1
        (tmp_path / "two" / u).write_bytes(data)
    found = warc.audit(warc.file_records(index, str(tmp_path / "one")), warc.file_records(index, str(tmp_path / "two"))).collect()
    last = max(r.offset for r in index.collect() if r.unit == units[0])
    assert [(r.unit, r.offset, r.status) for r in found] == [(units[0], last, "corrupt")]


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.toxic_out(spark, docs, SF)
    assert first.columns == docs.columns
    rows = [tuple(r) for r in first.collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [d for d in labels if zlib.crc32(str(d).encode()) % 3 != 1]
    assert len({r[0] for r in rows}.intersection(d for d in seen if not labels[d])) >= 0.95 * sum(not labels[d] for d in seen)
    names = docs.columns
    d, t = names.index("doc_id"), names.index("text")
    best = {}
    for r in rows:
        k = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[t] or "")
        best[k] = max(best.get(k, r), r, key=lambda r: r[d])
    exact = list(best.values())
    roots = brute_near([r[t] or "" for r in exact])
    least = {}
    for r, root in zip(exact, roots, strict=True):
        least[root] = min(least.get(root, r), r, key=lambda r: r[d])
    near = sorted(least.values(), key=lambda r: r[d])
    cut = {w[0]: w for w in brute_substrings([(r[d], words_of(r[t] or "")) for r in near], 20)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in near:
        text = cut[r[d]][4] if cut[r[d]][2] else r[t] or ""
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        want += [(r[d], k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)
