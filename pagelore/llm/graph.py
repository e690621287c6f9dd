"""Connected components by alternating large and small stars, in joins and grouped minima.

A hub's links are dealt over many tasks (``runs.spread_join``), so no node's links meet in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import spread_join
from .store import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): for each node with a link the smallest node that it reaches.

    Links may repeat, point either way or from a node to itself; nulls link nothing. A node without links has no row.
    The number of rounds grows with the logarithm of the longest path. Each round's stars are written, so lineage stays short.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before, state = None, _state(now)
    while state[0] and state != before:
        # large stars: the larger end of each link moves to the least neighbour of the smaller end
        both = now.select(F.col("v").alias("node"), F.col("u").alias("other")).union(now.select(F.col("u").alias("node"), F.col("v").alias("other")))
        least = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = spread_join(now.withColumnRenamed("v", "node"), least, "node").select("u", F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large)
        # small stars: a node and its smaller neighbours move to the least of them
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        ends = F.explode(F.array(F.col("u"), F.col("v")))
        now = written(spread_join(large, least, "u").select(ends.alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        before, state = state, _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
