"""Connected components of a graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import saved, shared_path, temporary, written


#: Edges that one task of a step handles; small graphs need few tasks.
EDGES_A_TASK = 50_000


def _star(edges: DataFrame) -> DataFrame:
    """Tie the neighbours of each node u, given as (u, v), to the least node around u."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b); the component is its least node.

    Kiveris et al., "Connected components in MapReduce and beyond".  Each step is a partial minimum
    and a join, whose skewed keys Spark splits; rounds grow with the logarithm of the size.
    """

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    spark = links.sparkSession
    path = shared_path(spark, "components")
    with temporary(spark):
        edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
        now = state(edges)
        while True:
            tasks = 1 + 2 * now[0] // EDGES_A_TASK
            both = edges.union(edges.select("v", "u"))
            large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
            # small star: v < u for each edge (u, v); u and its smaller neighbours are tied to the least
            tied = _star(large).coalesce(tasks)
            small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(tied.select("u", F.col("m").alias("v")))
            edges = written(small.where("u <> v").distinct().coalesce(tasks), "edges")
            before, now = now, state(edges)
            if now == before:
                break
        found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        return saved(found.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().coalesce(tasks)), path)
