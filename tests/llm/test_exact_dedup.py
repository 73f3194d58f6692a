"""Exact dedup against brute force, with heavy groups on and off."""

import hashlib

import pytest

from foldstat.llm import exact_dedup as m

from .conftest import SF


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("counters", [1, 3, 256])
def test_against_brute_force(spark, counters):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(1000 + i, "Hot TEXT") for i in range(150)] + [(2000, "hot text"), (2001, None), (2002, ""), (2003, "É"), (2004, "é"), (None, "hot text"), (None, "no id"), (None, "no id")]
    rows += [(3000, "twice"), (3000, "twice"), (2000, "hot text")]
    frame = spark.createDataFrame([(a, b, True) for a, b in rows], "doc_id long, text string, kept boolean").repartition(7)
    groups = {}
    for d, t in rows:
        groups.setdefault(lower(t), []).append(-1 if d is None else d)
    out = m.exact_dedup(frame, counters=counters).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, bytes(r.digest)) for r in out)
    assert got == sorted((-1 if d is None else d, max(groups[lower(t)]), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).digest()) for d, t in rows)
    kept = [r for r in out if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    left = m.deduplicated(frame, counters=counters)
    assert left.columns == frame.columns
    assert sorted(lower(r.text) for r in left.collect()) == sorted(groups)


def test_frequent_is_a_superset(spark):
    rows = [bytes([i % 7]) for i in range(700)] + [bytes([1, i % 250]) for i in range(300)]
    table = spark.createDataFrame([(r,) for r in rows], "digest binary").repartition(40)
    found = m.frequent(table, 9)
    assert {bytes([i]) for i in range(7)} <= set(found) and len(found) <= 9


def test_empty(spark):
    assert m.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
