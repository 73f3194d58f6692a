"""Near dedup of large groups of near copies: what leaves the tasks, and the SimHash step."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from foldstat.llm import jaccard, simhash

from .test_jaccard import brute_kept


def group(rng, n, words, most):
    base = [f"g{i}" for i in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for at in rng.integers(0, words, rng.integers(0, most)):
            text[at] = f"w{rng.integers(1 << 30)}"
        out.append(" ".join(text))
    return out


def test_a_forest_joins_all_that_are_as_similar():
    rng = np.random.default_rng(5)
    texts = group(rng, 120, 90, 6)
    sets = jaccard.shingles(pa.array(texts), 5)
    names = [jaccard.name_of(x) for x in sets]
    order = np.unique(np.array(names, np.uint64).view(np.int64), return_index=True)[1]
    sets = [sets[i] for i in order]
    fp = np.arange(len(sets)) + 10
    for side in (np.full(len(sets), 2), (np.arange(len(sets)) >= 40).astype(int)):
        u, v = jaccard.forest(fp, np.array([len(x) for x in sets]), fp, sets, side, (4, 5))
        assert len(u) < len(sets)
        label, want = fp - 10, fp - 10
        for i in range(len(sets)):
            for j in range(i):
                if (side[0] == 2 or side[i] != side[j]) and jaccard.similar(sets[i], sets[j], (4, 5)):
                    want = np.where(want == want[i], want[j], want)
        for a, b in zip(u - 10, v - 10, strict=True):
            assert jaccard.similar(sets[a], sets[b], (4, 5))
            label = np.where(label == label[a], label[b], label)
        same = lambda x: x[:, None] == x[None, :]
        assert (same(label) == same(want)).all() and len(set(want.tolist())) > 1


def test_no_row_for_each_pair(spark, monkeypatch):
    """Also where leaders and SimHash join none of a group, its tables have fewer rows than the shingles met."""
    sizes = {}

    def counted(df, name="t", f=jaccard.stored):
        out = f(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    rng = np.random.default_rng(6)
    rows = list(enumerate(group(rng, 300, 100, 9)))
    monkeypatch.setattr(jaccard, "stored", counted)
    monkeypatch.setattr(jaccard, "LEADERS", 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == brute_kept(rows)
    assert sizes["rest"] > 300 > sizes["members"] and sizes["possible"] < sizes["rest"]
    assert sizes["links"] < 4 * len(rows) and sizes["pairs"] < 10 * len(rows)


def test_simhash_comes_first_and_loses_nothing(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(simhash, "links", lambda nodes, radius, f=simhash.links: asked.append((nodes.count(), radius)) or f(nodes, radius))
    rng = np.random.default_rng(7)
    texts = [t for k in range(20) for t in group(rng, 3, 40 + 10 * k, 4)]
    rows = [(i, " ".join(f"{w}x{i // 3}" for w in t.split())) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == brute_kept(rows)
    assert len(asked) == 1 and asked[0][0] > 20 and asked[0][1] == 3
