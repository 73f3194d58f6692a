"""Connected components by alternating large-star and small-star steps, all in Spark joins; no link reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, evenly_joined, stored


def _with_least(both: DataFrame, total: int) -> DataFrame:
    """Each of the ``total`` rows (u, v) with m, the least of u and all its neighbours. The centre of a star is no single task's."""
    least = both.groupBy("u").agg(F.min("v").alias("n"), F.count(F.lit(1)).alias("many")).select("u", F.least("u", "n").alias("m"), "many")
    return evenly_joined(both, least, ["u"], ["v"], total)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * edges.count()).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    led = _with_least(down, edges.count())
    each = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
    return led.select(each.alias("x")).select("x.*")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each child has one parent, and no parent is a child."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("child")), F.struct(F.col("v").alias("node"), F.lit(0).alias("child")))).alias("x"))
    nodes = ends.select("x.*").groupBy("node").agg(F.sum("child").alias("parents"), F.min("child").alias("leads"))
    return not nodes.filter("parents > 1 or (parents = 1 and leads = 0)").limit(1).count()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (u, v): the component is its least node."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = stored(down.filter("u <> v").distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(now):
            break
        # What the steps repeat is dropped once, where the round's edges are written.
        large = stored(_large_star(now), "edges")
        fresh = stored(_small_star(large).filter("u <> v").distinct(), "edges")
        dropped(now, large)
        now = fresh
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.distinct())
