"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as X

#: Edges of a task. A round that knows how many edges it has takes no more tasks than they need.
TASK_EDGES = 100_000


def _is_done(edges: DataFrame, tasks: int) -> bool:
    """Whether every node hangs on one other at most, and none on a node that hangs itself."""
    ends = edges.selectExpr("hi AS n", "1 AS hangs", "0 AS holds").union(edges.selectExpr("lo AS n", "0 AS hangs", "1 AS holds"))
    return ends.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter("hangs + holds > 1 AND hangs > 0").coalesce(tasks).isEmpty()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node that can be reached.

    Each round hangs neighbours on the smallest node in sight, in both directions, so that the number
    of rounds grows with the logarithm of a component's size. Minima are pre-aggregated before the
    shuffle; they are written before they are joined, so Spark can split the rows of a hub. Edges with
    a null end are ignored.
    """
    ends = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b")
    star = X.written(ends.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    least_tasks = edges.sparkSession.sparkContext.defaultParallelism
    while True:
        tasks = max(least_tasks, -(-star.count() // TASK_EDGES))
        if _is_done(star, tasks):
            break
        both = star.selectExpr("hi AS u", "lo AS v").union(star.selectExpr("lo AS u", "hi AS v"))
        least = X.written(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m").coalesce(tasks))
        large = X.written(both.join(least, "u").filter("v > u").selectExpr("v AS hi", "m AS lo").distinct().coalesce(tasks))
        low = X.written(large.groupBy("hi").agg(F.min("lo").alias("m")).coalesce(tasks))
        hung = large.join(low, "hi").select(F.explode(F.array(
            F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        star = X.written(hung.select("e.hi", "e.lo").filter("hi <> lo").distinct().coalesce(tasks))
    return star.selectExpr("hi AS node", "lo AS root").union(star.selectExpr("lo AS node", "lo AS root").distinct())
