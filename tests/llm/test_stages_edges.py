"""Every stage of the pipeline on nulls in any column, clashing further columns, repeated rows, long texts and nothing at all."""

import pytest

import corpus_pipeline
from foldstat.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score double, fp long, digest binary, block long, word string, n int, kept boolean, task int, rank long, component_id long, bucket int, payload string, toxic_flag boolean, h long, runs string, __kept string, __digest string, __n_words int, __score int, __flag int, __fp int, __foldstat_digest int, kept_id int, kept_fp int, digest_ string, n_words string, n_removed int, kept_sha256 string, path_ int, row int, top int, group_size int, share_ int, shares_ int, many int"
LONG = "words of a very long text " * 20000


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, None if doc_id is None else "s", None if text is None else len(text), 0.5, 1, b"x", 2, "w", 3, True, 4, 5, 6, 7, "p", False, 8, "r", "k", "d", 1, 2, 3, 4, 5, 6, 7, "e", "f", 8, "g", 9, 10, 11, 12, 13, 14, 15)


ROWS = [row(1, "a quiet day at the sea"), row(1, "a quiet day at the sea"), row(2, None), row(3, ""), row(4, " \n\t"), row(None, "no id here", None), row(None, None, None), row(5, LONG), row(6, "A QUIET day at the sea"), row(7, "quite another text, of its own"), row(8, "1 1 1 1 1 1")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    spark.createDataFrame([(1, 0), (2, 1), (None, 1), (7, None)], "doc_id long, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(str(d / "documents.parquet"))
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, folder), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out
        if name == "exact_dedup":
            texts = ["".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "") for r in docs.collect()]
            assert sorted(texts) == sorted({(r[1] or "").lower() for r in ROWS})
    assert {r.doc_id for r in docs.collect()} >= {6, 7, 8, 5}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in docs.collect()}


def test_stages_each_alone(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() > 0
        assert stage(spark, docs.limit(0), folder).collect() == []


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
