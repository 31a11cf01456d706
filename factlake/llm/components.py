"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import checkpoint


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge.

    ``edges`` has two columns of the same ordered type. Alternates the large-star and
    small-star operations until every node points to its root: O(log^2 n) rounds, each
    of two aggregations and two joins whose hot nodes adaptive execution can split.
    Rows with a null and loops are ignored. Each round is written to the checkpoint
    folder, so a lost executor repeats one round at most.
    """
    a, b = edges.columns
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = checkpoint(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        inner = e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if inner.isEmpty():
            # no root has a root of its own; a node with two roots would join them in a further round
            twice = e.groupBy("u").count().where("count > 1")
            if twice.isEmpty():
                return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
