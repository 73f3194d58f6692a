"""The toxicity classifier learns from every label, however many there are beyond what one task holds."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foldstat.llm import toxicity

SMALL = toxicity.Settings(toxic=100, clean=200, words=6000, steps=120, batch=16)


def tables(spark, n=2400):
    """A quarter is toxic: by ``vile`` the 100 ids that hash lowest, by ``nasty`` most of the others."""
    rng = np.random.default_rng(5)
    order = [r.id for r in spark.range(n).filter("id % 4 = 0 and id % 3 <> 1").orderBy(F.xxhash64("id"), "id").collect()]
    early, rows = set(order[:100]), []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 300, rng.integers(5, 40))]
        if i % 4 == 0:
            words[int(rng.integers(len(words)))] = "vile" if i in early or i % 5 == 0 else "nasty"
        rows.append((i, " ".join(words), ("en", "de")[i % 2]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return rows, docs, docs.selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) as toxic")


def test_what_only_later_labels_show_is_learnt(spark):
    rows, docs, labels = tables(spark)
    usable = F.col("doc_id") % 3 != 1
    model = toxicity.fit(docs.repartition(3), labels, usable, SMALL)
    got = {r.doc_id: r.score >= 0.7 for r in toxicity.score(docs, model).collect()}
    held = [(i, text) for i, text, _ in rows if i % 3 == 1]
    nasty = [got[i] for i, text in held if "nasty" in text.split()]
    assert len(nasty) > 100 and np.mean(nasty) > 0.9
    assert np.mean([got[i] for i, _ in held if i % 4]) < 0.05
    again = toxicity.fit(docs.repartition(7), labels, usable, SMALL)
    assert again.scale == model.scale and again.thresholds == model.thresholds and again.other == model.other
    assert all((a.table == b.table).all() for a, b in zip(model.nets, again.nets, strict=True))


def test_pieces_hold_every_text_and_their_uses(spark):
    rows, docs, labels = tables(spark, 900)
    rows += [(900, "long " * 9000, "en"), (901, "", None), (902, None, "en")]
    docs = spark.createDataFrame(rows, docs.schema)
    given, rates = toxicity.labels_of(docs.selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) as toxic"), None)
    base = toxicity.scratch_path(spark, "pieces")
    cuts, uses = toxicity.cut(toxicity.texts_of(docs, given, "doc_id", "text", "lang"), 3, base, SMALL)
    kinds, pieces = sum(k for _, k in cuts), [toxicity.Piece(uri) for uri, _ in cuts]
    assert len(cuts) > 3 and kinds.sum(axis=0).tolist() == [rates[0], rates[1]] == [677, 226]
    assert all(p.first[-1] <= SMALL.words for p in pieces if len(p.y) > 1)
    ids, first = toxicity.features(pa.array([r[1] for r in rows], pa.large_string()))
    assert (uses.sum(axis=0) == toxicity.used(ids, first, np.arange(len(rows)))).all()
    texts = sorted((p.rows[p.first[d] : p.first[d + 1]].tobytes(), int(p.y[d]), p.names[p.lang[d]]) for p in pieces for d in range(len(p.y)))
    assert texts == sorted((ids[first[i] : first[i + 1]].tobytes(), int(r[0] % 4 == 0), r[2] or "") for i, r in enumerate(rows))


def test_pooling_in_chunks(monkeypatch):
    rng = np.random.default_rng(6)
    net = toxicity.started(toxicity.Settings(), 0, np.ones(toxicity.PARTS << toxicity.BITS, bool))
    rows = rng.integers(0, toxicity.PARTS << toxicity.BITS, (400, toxicity.PARTS)).astype(np.int32)
    first = np.array([0, 0, 3, 3, 170, 172, 290, 400, 400])
    whole = net.pooled(rows, first)
    monkeypatch.setattr(toxicity, "CHUNK", 16)
    for a, b in zip(net.pooled(rows, first), whole, strict=True):
        np.testing.assert_allclose(a, b, atol=1e-6)
