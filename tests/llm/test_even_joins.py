"""Joins on hot keys, the shared store and names that clash."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstat.llm import common, exact_dedup
from foldstat.llm.components import components


@pytest.mark.parametrize("how", ["inner", "left"])
def test_evenly_joined_equals_a_join(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HOT", 8)
    rows = [(0, i) for i in range(300)] + [(1, i) for i in range(100)] + [(k, k) for k in range(2, 60)] + [(None, 5)]
    left = spark.createDataFrame(rows, "k long, v long").repartition(5)
    facts = [(k, 10 * k, sum(r[0] == k for r in rows)) for k in range(40)]
    right = spark.createDataFrame(facts, "k long, w long, many long")
    got = sorted((r.k is None, r.k, r.v, r.w) if r.k is not None else (True, -1, r.v, r.w) for r in common.evenly_joined(left, right, ["k"], ["v"], len(rows), how).collect())
    want = [(False, k, v, 10 * k if k < 40 else None) if k is not None else (True, -1, v, None) for k, v in rows if how == "left" or (k is not None and k < 40)]
    assert got == sorted(want)


def test_a_hot_key_meets_in_no_task(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = 64_000
        left = spark.range(n).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
        facts = left.groupBy("k").agg(F.count(F.lit(1)).alias("many")).withColumn("w", F.col("k"))
        sizes = [r["count"] for r in common.evenly_joined(left, facts, ["k"], ["v"], n).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and max(sizes) < 2 * n / 64
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_components_of_one_star_over_half_the_nodes(spark):
    edges = [(500, i) for i in range(1000, 1400)] + [(i, i + 1) for i in range(2000, 2200)] + [(500, 2100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {i: 500 for i in [500, *range(1000, 1400), *range(2000, 2201)]}


def test_all_tasks_read_the_rows_for_the_heavy_digests(spark):
    table = spark.range(0, 4000, 1, 400).select(F.unhex(F.sha2((F.col("id") % 90).cast("string"), 256)).alias("digest"))
    sc = spark.sparkContext
    sc.setJobGroup("heavy", "heavy")
    try:
        exact_dedup.summaries(table, 100).collect()
        tracker = sc.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("heavy") for s in tracker.getJobInfo(j).stageIds]
        assert max(s.numTasks for s in stages if s) == 400
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_store_by_scheme(tmp_path, monkeypatch):
    monkeypatch.setattr(common, "local_or_none", lambda uri: None)  # every place counts as remote
    uri = f"file://{tmp_path}/deep/er/x.bin"
    common.put_file(uri, np.arange(5, dtype="<u2").tobytes())
    assert common.mapped(uri, "<u2").tolist() == [0, 1, 2, 3, 4]
    assert [p.name for p in (tmp_path / "deep/er").iterdir()] == ["x.bin"]


def test_paths_belong_to_the_default_store(spark):
    assert common.qualified(spark, "/a/b") == "file:/a/b"
    assert common.local_or_none("hdfs://n/a") is None and common.local_or_none("file:/a") == common.local_or_none("file:///a") == "/a"


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Fake.conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Fake)


def test_unused():
    assert common.unused(["a", "Digest", "digest_"], "digest") == "digest__"
