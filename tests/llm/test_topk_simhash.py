"""Top-k and SimHash against brute force."""

import itertools

import numpy as np
import pytest
import xxhash

from foldstat.llm import simhash, topk
from foldstat.llm.components import components

from .conftest import SF


def brute_topk(vectors, k, mod=20):
    out = []
    rows = sorted(set(vectors))
    for qi, q in rows:
        if qi % mod:
            continue
        scored = sorted((-sum(a * b for a, b in itertools.zip_longest(q, c, fillvalue=0)), ci) for ci, c in rows if ci != qi)
        out += [(qi, r + 1, ci, -s) for r, (s, ci) in enumerate(scored[:k])]
    return sorted(out)


def run_topk(spark, rows, k, block):
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    v = topk.integer_vectors(frame)
    return sorted(tuple(r) for r in topk.exact_top_k(v.filter("vec_id % 20 = 0"), v, k, block).collect())


def test_topk_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    good = [(i, tuple(rng.integers(-2, 3, 3).astype(float).tolist())) for i in range(300)]  # many ties
    good += [(20, (1.0, 1.0, 1.0)), (20, (1.0, 1.0, 1.0)), (500, (2.0,)), (520, (1e4, -3e4, 7.0))]
    bad = [(600, None), (None, [1.0, 2.0, 3.0]), (620, [1.0, None, 0.0]), (640, [float("nan"), 0.0, 0.0]), (660, [float("inf")]), (680, [])]
    want = brute_topk([(i, tuple(int(np.floor(64 * x)) for x in v)) for i, v in good], 7)
    assert run_topk(spark, [(i, list(v)) for i, v in good] + bad, 7, 4096) == want
    assert run_topk(spark, [(i, list(v)) for i, v in good] + bad, 7, 6) == want  # several blocks


def test_topk_fewer_and_none(spark):
    assert run_topk(spark, [(0, [1.0]), (1, [2.0]), (2, [2.0])], 20, 16) == [(0, 1, 1, 64 * 128), (0, 2, 2, 64 * 128)]
    assert run_topk(spark, [(0, [1.0])], 20, 16) == []
    assert run_topk(spark, [(0, None)], 20, 16) == []


def test_topk_identical_vectors(spark):
    rows = [(i, [0.5, -0.5]) for i in range(400)]
    assert run_topk(spark, rows, 5, 64) == brute_topk([(i, (32, -32)) for i in range(400)], 5)


def test_topk_large_numbers(spark):
    rows = [(0, [3e7, 1.0]), (20, [3e7, 2.0]), (1, [3e7, 3.0])]
    assert run_topk(spark, rows, 2, 16) == brute_topk([(i, tuple(int(64 * x) for x in v)) for i, v in rows], 2)
    with pytest.raises(ArithmeticError):
        run_topk(spark, [(0, [1e12]), (1, [1e12])], 2, 16)


def brute_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words, at = [], ""
    for c in t + " ":
        if c in " \t\n\x0b\x0c\r":
            if at:
                words.append(at)
            at = ""
        else:
            at += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint():
    for text in ["", " \n", "One", "one TWO", "a b c", "É A\x1cB c d\x85e f", "x y z " * 50, "日 本 語 テ"]:
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def brute_roots(values, radius):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5])
def test_linked_kernel(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 12, dtype=np.int64).astype(np.uint64)
    values = np.array([int(rng.choice(base)) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(500)], np.uint64)
    unit = np.sort(rng.integers(0, 3, 500))
    labels = simhash.linked(values, unit, np.full(500, 2), radius)
    for u in range(3):
        own = np.flatnonzero(unit == u)
        want = [int(own[r]) for r in brute_roots([int(values[i]) for i in own], radius)]
        assert labels[own].tolist() == want


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_masks_lose_no_pair(radius):
    rng = np.random.default_rng(1)
    for count in (10, 10**8, 10**10):
        masks = simhash.block_masks(count, radius)
        for _ in range(300):
            d = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(d & m == 0 for m in masks)


def test_links_with_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**62, 6)]
    values = sorted({b ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(60)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.node: r.component for r in components(simhash.links(nodes)).collect()}
    roots = brute_roots(values, 3)
    groups = {}
    for v, r in zip(signed, roots, strict=True):
        groups.setdefault(r, []).append(v)
    for own in groups.values():
        assert {found.get(v, v) for v in own} == {min(own)}


def test_components_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 0 for i in range(50)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_near_dedup_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(900, None), (901, ""), (902, docs[3][1] + " extra"), (903, docs[3][1].upper()), (903, docs[3][1].upper()), (None, docs[3][1]), (None, "alone here")]
    frame = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, fp int").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.fp, -1 if r.component_id is None else r.component_id) for r in simhash.near_dedup(frame).collect())
    fps = [brute_fingerprint(t or "") for _, t in docs]
    roots = brute_roots(fps, 3)
    least = {}
    for (d, _), r in zip(docs, roots, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    want = sorted((-1 if d is None else d, f - (1 << 64) if f >> 63 else f, least.get(r, -1)) for (d, _), f, r in zip(docs, fps, roots, strict=True))
    assert got == want
    kept = simhash.deduplicated(frame)
    assert kept.columns == ["doc_id", "text", "fp"]
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted(least.values())
    single = frame.filter("doc_id is not null").dropDuplicates(["doc_id"])
    assert sorted(r.doc_id for r in simhash.deduplicated(single).collect()) == sorted(least.values())
    assert simhash.near_dedup(frame.limit(0)).collect() == []
