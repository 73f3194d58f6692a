"""Substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from foldstat.llm import substring_dedup as m

from .conftest import SF

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(rows, k):
    first = {}
    for d, words in rows:
        for i in range(len(words) - k + 1):
            g, at = tuple(words[i : i + k]), (m.NO_ID if d is None else d, i)
            first[g] = min(first.get(g, at), at)
    out = []
    for d, words in rows:
        gone = [False] * len(words)
        for i in range(len(words) - k + 1):
            if first[tuple(words[i : i + k])] != (m.NO_ID if d is None else d, i):
                gone[i : i + k] = [True] * k
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((m.NO_ID if d is None else d, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


def check(spark, rows, k=20, parts=3):
    frame = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n_words int").repartition(parts)
    got = sorted((m.NO_ID if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in m.substring_dedup(frame, k).collect())
    want = brute([(d, words_of(t or "")) for d, t in rows], k)
    assert got == [w[:4] for w in want]
    fresh = m.deduplicated(frame, k)
    assert fresh.columns == ["doc_id", "text", "n_words"]
    texts = {(d, t) for d, t in rows}
    for r in fresh.collect():
        assert (r.doc_id, r.text) in texts or any(w[0] == (m.NO_ID if r.doc_id is None else r.doc_id) and w[4] == r.text and w[2] for w in want)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 60_000)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(spark, docs)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 2_000)
    rng = random.Random(3)
    passage = " ".join(f"w{rng.randrange(50)}" for _ in range(60))
    rows = [
        (1, None), (2, ""), (3, " \n "), (4, "a " * 19), (5, "a " * 20), (6, "a " * 21), (7, "a b " * 40), (8, passage), (9, "x\t" + passage.replace(" ", "\n") + " y"),
        (10, passage[:-4]), (10, passage[:-4]), (11, passage + " " + passage), (None, passage), (None, passage), (12, "é́ " * 30), (13, "x\x85y " * 25), (14, "x\x85y " * 25),
        (15, "long " * 5000), (16, passage.upper()),
    ]
    check(spark, rows, parts=4)


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_small_alphabet(spark, monkeypatch, k):
    monkeypatch.setattr(m, "BLOCK", 400)
    rng = random.Random(k)
    check(spark, [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for i in range(40)], k)


def test_empty(spark):
    assert m.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_packing_of_numbers():
    rng = np.random.default_rng(0)
    for x in (np.zeros(0, np.int64), np.arange(1000), rng.integers(-(2**62), 2**62, 500), np.array([m.NO_ID, 5, m.NO_ID])):
        assert m._unpacked(m._packed(x)).tolist() == x.tolist()
    for n in (1, 2, 3, 5, 11, 16):
        v = rng.integers(0, 99, 40).astype(np.uint64)
        assert m._sliding(v, n, np.minimum, np.uint64(999)).tolist() == [min([*v[i : i + n].tolist(), 999]) for i in range(40)]
