"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a join and an aggregate over the edges; nothing is gathered on the driver but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import drop_saved, save


#: Edges that a task takes at least. A session's number of partitions suits its largest tables; what is left of a graph here is
#: often far smaller, and every step would take that many tasks, most of them without a row.
TOGETHER = 1 << 16


def _least(pairs: DataFrame, parts: int) -> DataFrame:
    least = pairs.groupBy("a").agg(F.min("b").alias("least")).coalesce(parts)
    return least.withColumn("least", F.least("a", "least")).withColumnRenamed("a", "node")


def large_star(edges: DataFrame, parts: int = 1 << 20) -> DataFrame:
    """In at most `parts` tasks a step; coalesce never makes more than there are."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.where("b > a").join(_least(both, parts), F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return joined.where("a <> b").coalesce(parts).distinct().coalesce(parts)


def small_star(edges: DataFrame, parts: int = 1 << 20) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    linked = down.join(_least(down, parts), F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    every = linked.unionAll(down.groupBy("a").agg(F.min("b").alias("b")).coalesce(parts))
    return every.where("a <> b").coalesce(parts).distinct().coalesce(parts)


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root): root is the smallest node of the component. Nodes without edges don't appear.

    Cases: loops and repeated edges add nothing; edges with a null end are left out; no edges give no rows.
    """
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = None
    while True:
        # stars whose centre is smaller than every leaf, and that no step changes, are the components
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if row["n"] == 0 or (row["n"], row["h"]) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = (row["n"], row["h"])
        parts = -(-row["n"] // TOGETHER)
        before, now = now, save(small_star(large_star(now.coalesce(parts), parts), parts), "cc")
        drop_saved(before)
