"""The pipeline's near dedup against all pairs by brute force."""

import itertools

import numpy as np
import pytest

import corpus_pipeline
from foldstat.llm import jaccard

SF = "/root/testdata/sf0.01"


def brute_shingles(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def brute_kept(rows):
    """Ids that stay of (doc_id, text), ids being distinct and not null."""
    sets = [brute_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
            shared = len(a & b)
            if 5 * shared >= 4 * (len(a) + len(b) - shared):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def made(seed=3):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(5000)}"
    common = [word() for _ in range(12)]
    texts = []
    for size in (5, 6, 9, 14, 30, 60, 120, 400):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for changes in (0, 0, 1, 1, 2, 3, 5, 8):
                text = list(base)
                for at in rng.integers(0, size, min(changes, size // 3)):
                    text[at] = word()
                texts.append(" ".join(common * int(rng.integers(3) == 0) + text))
    hot = [word() for _ in range(100)]
    for _ in range(150):  # one large group, more and less alike
        text = list(hot)
        for at in rng.integers(0, 100, rng.integers(1, 5)):
            text[at] = word()
        texts.append(" ".join(text))
    texts += ["", None, " \n", "one", "ONE", "a b c d", "A  b c\td", "a b c d e"]
    return [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]


@pytest.mark.parametrize("often", [0, jaccard.OFTEN])
def test_keeps_every_pair(spark, monkeypatch, often):
    monkeypatch.setattr(jaccard, "OFTEN", often)
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == brute_kept(rows)


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    out = corpus_pipeline.near(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == brute_kept(rows)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, "alone"), (2, text), (2, text), (2, "of its own"), (3, text + " end"), (None, text + " other"), (None, "no id here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, "alone"), (2, text), (2, "of its own"), (None, "no id here")], key=str)
    assert corpus_pipeline.near(spark, docs.limit(0), "").collect() == []
