"""The bounded sample that the toxicity classifier learns from."""

import numpy as np

from foldstat.llm import toxicity


def trained_on(docs, labels, settings=None):
    """Labels and words of the training texts."""
    sample, _ = toxicity.sample_of(docs, labels, None, settings or toxicity.Settings(), "doc_id", "text", "lang")
    rows = sorted((r.h, r.y, r.n) for r in sample.collect())
    return [r[1] for r in rows], [r[2] for r in rows]


def test_bounds(spark):
    docs = spark.range(12000).selectExpr("id as doc_id", "'some words here' as text", "'en' as lang")
    labels, _ = trained_on(docs, docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic"))
    assert sum(labels) == 3000 and len(labels) == 8000
    assert toxicity.BITS == 18 and toxicity.Settings().words == 6_000_000


def test_words_are_spent_by_hash(spark):
    """The sample does not follow the layout of the rows, nor the length of the texts, and has both labels."""
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('word ', 1 + cast(id * 7 % 50 as int)) as text", "'en' as lang")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 8 = 0 as int) as toxic")
    s = toxicity.Settings(toxic=150, clean=600, words=4000)
    y, n = trained_on(docs.repartitionByRange(4, "doc_id"), labels, s)
    assert (y, n) == trained_on(docs.orderBy(docs["doc_id"].desc()).repartitionByRange(3, docs["doc_id"].desc()), labels, s)
    assert 0.1 < sum(y) / len(y) < 0.3 and 22 < np.mean(n) < 30
    long = docs.unionByName(docs.selectExpr("doc_id", "repeat('word ', 5000) as text", "lang").filter("doc_id < 100"))
    assert max(trained_on(long.filter("length(text) > 1000 or doc_id >= 100"), labels, s)[1]) <= 50


def test_an_id_that_repeats_is_one_text(spark):
    docs = spark.range(300).selectExpr("id % 100 as doc_id", "concat('text ', id) as text", "'en' as lang")
    labels = spark.range(100).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    y, n = trained_on(docs.repartition(3), labels)
    assert len(y) == 100 and sum(y) == 50 and set(n) == {2}
